"""What several operators share: tables in the shared folder, skew-safe joins, words."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship  # noqa: F401
from ..storage import new_path, scratch, shared_dir, stored  # noqa: F401

#: The word rule of the contracts: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: A key with at least this share of all rows is hot; there can be no more than its inverse.
HOT_SHARE = 0.001
#: Rows of one key that one task may get before the key is salted.
ROWS_PER_SALT = 20_000
#: Bytes of texts that are Python objects at once, unless a single text is longer.
SLICE_BYTES = 8_000_000
#: A table up to so many bytes, its rows counted, is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 16_000_000


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for a text without words."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def join_on_hot_key(rows: DataFrame, facts: DataFrame, key: str, count: str, spread: Column) -> DataFrame:
    """rows LEFT JOIN facts, where facts has one row per key and `count`, the number of rows with it.

    Keys with at least HOT_SHARE of all rows are at most 1/HOT_SHARE, so the map from
    such a key to its number of salts has a fixed bound and is broadcast; facts about a
    hot key are repeated once per salt, and `spread` tells which salt a row takes. All
    others have one salt. Null keys match nothing.
    """
    total = facts.agg(F.coalesce(F.sum(count), F.lit(0)).alias("total"))
    least = F.greatest(F.lit(ROWS_PER_SALT), F.col("total") * HOT_SHARE)
    hot = (
        facts.crossJoin(F.broadcast(total))
        .where(F.col(count) >= least)
        .select(F.col(key).alias("_hot"), F.ceil(F.col(count) / ROWS_PER_SALT).cast("int").alias("_salts"))
    )
    left = (
        rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"), F.lit(0)))
        .drop("_hot", "_salts")
    )
    right = (
        facts.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0)))))
        .drop("_hot", "_salts", count)
    )
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def small(df: DataFrame, row_bytes: int = 16) -> DataFrame:
    """df to be broadcast if its rows, counted, take at most BROADCAST_BYTES; row_bytes is what a row takes at most."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join on a table of distinct ids: broadcast only if its counted size is small."""
    return df.join(small(ids), key, how)


def packed(docs: DataFrame) -> DataFrame:
    """docs as one struct `row`: whatever its columns are called, none can clash with an operator's own."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))


def unpacked(rows: DataFrame, keep: list[str] | None = None) -> list[Column]:
    """The columns of `row` again, all or those in keep."""
    names = keep if keep is not None else rows.schema["row"].dataType.names
    return [F.col(f"row.`{c}`").alias(c) for c in names]


def slices(batches, rows: int = 500):
    """Arrow batches in smaller pieces, so few texts at once are Python objects; pieces of over SLICE_BYTES hold one row."""
    waiting = []
    for batch in batches:
        waiting.append(batch)
        while waiting:
            part = waiting.pop()
            if part.num_rows <= 1 or (part.num_rows <= rows and part.nbytes <= SLICE_BYTES):
                yield part
                continue
            step = min(rows, (part.num_rows + 1) // 2)
            waiting += [part.slice(at, step) for at in reversed(range(0, part.num_rows, step))]


_kept: dict = {}
_keeper = ""


def released() -> None:
    """Gives freed memory back: workers of one executor share its limit, and stay after their task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def kept_for(operator: str) -> dict:
    """What this process keeps between tasks of an operator; what it kept for another one goes.

    Spark uses a worker for one stage after the other, so that else it holds the tables of all that it has run.
    """
    global _keeper
    if operator != _keeper:
        _keeper = operator
        if _kept:
            _kept.clear()
            gc.collect()
            released()
    return _kept


def lean(run):
    """run over Arrow batches, after which the worker gives back what it freed."""

    def wrapped(batches):
        yield from run(batches)
        released()

    return wrapped


def table(sf_dir: str, name: str, spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo: which rows are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))
