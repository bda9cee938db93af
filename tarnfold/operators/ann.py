"""Approximate search: inverted lists around k-means centroids, and int8 vectors."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session, storage
from ..functions import vectors
from .blocks import CELLS, best_rows, fetched, matrix_of, ranked

#: Centroids are fitted on a sample of at most so many vectors; all vectors are indexed.
SAMPLE = 20_000
#: Share of the exact neighbours that must be found, and queries on which that is measured.
LEAST_RECALL, MEASURED = 0.9, 500
MOST_LISTS, ROWS_PER_PART = 4096, 1_000_000
#: Distinct sizes of components, to 4 places, of vectors of about unit length.
MOST_SIZES = 100_000


def sampled(base: DataFrame) -> np.ndarray:
    """A bounded sample of vectors chosen by a hash of id."""
    rows = base.select("id", "vector").where("vector is not null").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    return np.array([r[1] for r in rows], np.float64)


def centroids(v: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means of the rows of v."""
    c = v[: min(lists, len(v))].copy()
    for _ in range(rounds):
        of = (v @ c.T).argmax(1)
        for i in range(len(c)):
            if (of == i).any():
                m = v[of == i].mean(0)
                c[i] = m / (np.linalg.norm(m) or 1)
    return c


def probes_for(v: np.ndarray, c: np.ndarray, q: np.ndarray, k: int, least: float = LEAST_RECALL) -> int:
    """How many lists a query must look into to find `least` of its k nearest, measured on a sample v and queries q.

    Two standard errors are asked for on top. Vectors equal to the query lie in its first list and do not count.
    In a sample the k nearest are farther away than among all vectors, so the figure is on the safe side.
    """
    q = q[np.linspace(0, len(q) - 1, min(len(q), MEASURED)).astype(int)]
    of = (v @ c.T).argmax(1)
    needed, found = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1), []
    for i, one in enumerate(q):
        scores = np.where((v == one).all(1), -np.inf, v @ one)
        best = np.argsort(-scores, kind="stable")[:k]
        found.append(needed[i, of[best[scores[best] > -np.inf]]])
    for n in range(1, len(c)):
        share = np.array([(x < n).mean() for x in found if len(x)])
        if len(share) > 1 and share.mean() - 2 * share.std(ddof=1) / len(share) ** 0.5 >= least:
            return n
    return len(c)


def lists_for(rows: int) -> int:
    """Half the root of the number of vectors, 16 to MOST_LISTS."""
    return max(16, min(MOST_LISTS, int(rows**0.5 / 2)))


class Ivf:
    """An index of inverted lists: vectors stored by the list of their nearest centroid, so a search reads the lists it looks into."""

    def __init__(self, spark: SparkSession, folder: str, centers: np.ndarray, sample: np.ndarray):
        self.spark, self.folder, self.centers, self.sample = spark, folder, centers, sample

    @classmethod
    def build(cls, base: DataFrame, lists: int | None = None, folder: str | None = None, sample: np.ndarray | None = None) -> Ivf:
        """base (id, vector). Centroids are fitted on a sample (drawn unless given); every vector is indexed. One shuffle, by list and part of it."""
        spark = base.sparkSession
        session.ship(spark)
        base = base.select("id", "vector").where("vector is not null")
        rows = base.count()
        v = sampled(base) if sample is None else sample
        c = centroids(v, lists or lists_for(rows))
        folder = folder or storage.new_path(spark, "ivf")
        held = spark.sparkContext.broadcast(c)

        def assign(batches):
            for batch in batches:
                if batch.num_rows:
                    of = (matrix_of(batch.column(1)) @ held.value.T).argmax(1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of.astype(np.int32))], names=["id", "vector", "list"])

        kinds = {c: base.schema[c].dataType.simpleString() for c in base.columns}
        found = base.mapInArrow(assign, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", list int")
        # a list of more than ROWS_PER_PART rows goes to several tasks and files
        parts = max(1, -(-rows // (max(1, len(c)) * ROWS_PER_PART)))
        spread = found.repartition(F.col("list"), F.pmod(F.xxhash64("id"), F.lit(parts)))
        spread.write.partitionBy("list").parquet(folder)
        return cls(spark, folder, c, v)

    def probes(self, queries: DataFrame, k: int) -> int:
        """Lists that a query must look into for LEAST_RECALL of its k nearest, measured on the sample."""
        asked = queries.select("vector").where("vector is not null").orderBy(F.xxhash64("qid")).limit(MEASURED).collect()
        return probes_for(self.sample, self.centers, np.array([r[0] for r in asked], np.float64), k) if asked and len(self.sample) else len(self.centers)

    def search(self, queries: DataFrame | list, k: int, probes: int | None = None) -> DataFrame:
        """queries (qid, vector), or with `probes` their rows -> (qid, id, score, rank): each looks into the lists of its nearest centroids only."""
        probes = probes or self.probes(queries, k)
        c = self.centers

        def prepared(rows):
            q = np.array([r.vector for r in rows], np.float64)
            near = np.argsort(-(q @ c.T), axis=1, kind="stable")[:, :probes]
            return q, [np.flatnonzero((near == i).any(1)) for i in range(len(c))]

        def scored(held, batch):
            q, asking = held
            of, v = batch.column(2).to_numpy(), matrix_of(batch.column(1))
            for i in np.unique(of).tolist():
                rows, own = asking[i], np.flatnonzero(of == i)
                for at in range(0, len(rows), step := max(1, CELLS // len(own))):
                    part = rows[at : at + step]
                    yield part, own, q[part] @ v[own].T

        if not len(c):
            return self.spark.createDataFrame([], "qid long, id long, score double, rank int")
        every = self.spark.read.parquet(self.folder).select("id", "vector", F.col("list").cast("int").alias("list"))
        asked = queries if isinstance(queries, list) else queries.select("qid", "vector").where("vector is not null")
        return best_rows(every, asked, k, prepared, scored, lambda held: F.col("list").isin([i for i, x in enumerate(held[1]) if len(x)]))


def ivf(base: DataFrame, queries: DataFrame, k: int, lists: int | None = None, probes: int | None = None) -> DataFrame:
    """Index and search in one call; without `probes` as many as LEAST_RECALL takes, as measured on a sample."""
    return Ivf.build(base, lists).search(queries, k, probes)


def scale_of(base: DataFrame, quantile: float = 0.99) -> float:
    """The quantile of the components' sizes, to 4 places: from how often each size occurs, so counts only travel."""
    sizes = base.select(F.explode("vector").alias("x")).groupBy(F.round(F.abs(F.col("x").cast("double")), 4).alias("size")).agg(F.count("*").alias("n"))
    rows = sizes.orderBy("size").limit(MOST_SIZES + 1).collect()
    if len(rows) > MOST_SIZES:
        raise ValueError(f"components of more than {MOST_SIZES} sizes: scale the vectors to unit length first")
    upto = np.cumsum([r.n for r in rows])
    return rows[int(np.searchsorted(upto, quantile * upto[-1]))].size if rows else 1.0


def codes_of(v: np.ndarray, top: float) -> np.ndarray:
    """Components cut at `top` and scaled to -127..127, halves away from 0."""
    x = np.clip(v / (top or 1.0), -1, 1) * 127
    return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int8)


def int8_topk(base: DataFrame, queries: DataFrame, k: int, rescore: int = 4) -> DataFrame:
    """Best by products of 8-bit codes, rescore * k of them a query, then by the full vectors."""
    spark = base.sparkSession
    session.ship(spark)
    base = base.select("id", "vector").where("vector is not null")
    top = scale_of(base)

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                c = codes_of(matrix_of(batch.column(1)), top)
                edges = np.arange(0, c.size + 1, c.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(edges), pa.array(c.ravel()))], names=["id", "codes"])

    # one byte a component is stored and read for the search
    coded = storage.stored(base.mapInArrow(code, f"id {base.schema['id'].dataType.simpleString()}, codes array<tinyint>"), "int8")

    def scored(q, batch):
        c = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, -1)
        for at in range(0, len(q), step := max(1, CELLS // len(c))):
            yield at, None, (q[at : at + step] @ c.T).astype(np.float64)  # whole numbers, exact

    asked = queries.select("qid", "vector").where("vector is not null")
    rough = best_rows(coded, asked, k * rescore, lambda rows: codes_of(np.array([r.vector for r in rows], np.float64), top).astype(np.float32), scored)
    full = rough.select("qid", "id").join(asked.withColumnRenamed("vector", "q"), "qid").join(base, "id")
    return ranked(full.select("qid", "id", vectors.dot(F.col("vector"), F.col("q")).alias("score")), k, "id")


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """One row: share of the exact k that were found."""
    hits = exact.join(found.select("qid", "id"), ["qid", "id"], "left_semi").agg(F.count("*").alias("hits"))
    return hits.crossJoin(exact.agg(F.countDistinct("qid").alias("queries"))).select("queries", "hits", F.round(F.col("hits") / (F.col("queries") * k), 6).alias("recall"))


def sweep(base: DataFrame, queries: DataFrame, exact: DataFrame, k: int, lists: tuple[int, ...], shares: tuple[float, ...]) -> DataFrame:
    """(lists, probes, queries, hits, recall) for indexes of several sizes, each looked into by several shares of its lists."""
    # the driver gets the sample and the queries once, not once an index and once a search
    out, sample, asked = [], sampled(base), fetched(queries.select("qid", "vector").where("vector is not null"))
    for n in lists:
        index = Ivf.build(base, n, sample=sample)
        for probes in sorted({max(1, round(share * len(index.centers))) for share in shares}):
            found = recall(index.search(asked, k, probes), exact, k)
            out.append(found.select(F.lit(n).alias("lists"), F.lit(probes).alias("probes"), "*"))
    return reduce(DataFrame.unionByName, out)


def made_vectors(spark: SparkSession, rows: int, dim: int = 384, seed: int = 7) -> DataFrame:
    """(id, vector): random unit vectors, each from its own id and the seed, so equal however they are partitioned."""
    session.ship(spark)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            v = np.stack([np.random.default_rng((seed, i)).normal(size=dim) for i in ids.tolist()]) if len(ids) else np.zeros((0, dim))
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(v), pa.list_(pa.float64()))], names=["id", "vector"])

    return spark.range(rows).mapInArrow(run, "id long, vector array<double>")
