"""Vector functions as column expressions, and the built-in hash embedder."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from . import text


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v over its length; the zero vector as it is."""
    return text.let(F.sqrt(dot(v, v)), lambda n: F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x / n)))


def hash_cells(docs: DataFrame, key: str, content: str, dim: int) -> DataFrame:
    """(key, dim, value): signed counts of tokens hashed into `dim` places; partial sums before the shuffle."""
    tokens = docs.select(key, F.explode(text.lexical_tokens(F.col(content))).alias("token"))
    h = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long")
    sign = F.when(F.floor(h / dim) % 2 == 0, 1).otherwise(-1)
    return tokens.groupBy(key, (h % dim).cast("int").alias("dim")).agg(F.sum(sign).cast("double").alias("value"))


def hash_embed(docs: DataFrame, key: str, content: str, dim: int = 64) -> DataFrame:
    """(key, vector): unit vectors of the same cells, made a row at a time; documents without tokens have none."""
    from ..operators.retrieval import IDENTIFIER, Kept, names_of

    session.ship(docs.sparkSession)

    def cell(token: str) -> tuple[int, int]:
        h = int(hashlib.md5(token.encode()).hexdigest()[:8], 16)
        return h % dim, 1 if h // dim % 2 == 0 else -1

    def run(batches):
        of = Kept(lambda name: [cell(t) for t in names_of(name)])
        for batch in batches:
            rows, vectors = [], []
            for row, x in enumerate(batch.column(1).to_pylist()):
                sums, there = [0] * dim, False
                for name, n in Counter(IDENTIFIER.findall(x or "")).items():
                    for at, sign in of[name]:
                        sums[at] += sign * n
                        there = True
                if there:
                    size = math.sqrt(sum(v * v for v in sums)) or 1.0
                    rows.append(row)
                    vectors.append([v / size for v in sums])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(vectors, pa.list_(pa.float64()))], names=[key, "vector"])

    kind = docs.schema[key].dataType.simpleString()
    return session.spread(docs.select(key, content)).mapInArrow(run, f"{key} {kind}, vector array<double>")
