"""A stated set of queries against all rows, in blocks: each partition keeps the k best of each query and
passes on only these, so the shuffle holds at most k rows a query and partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import session

#: Queries that are collected and broadcast at once; a larger set goes through the rows in several blocks.
MOST_QUERIES = 50_000
#: Scores that a worker holds at once.
CELLS = 1_000_000


class Best:
    """The k best of each query so far, by score to 8 places (so that sums in another order tie alike), then id."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.query, self.ids, self.scores = np.zeros(0, np.int64), None, np.zeros(0)

    def add(self, first: int | np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row for each query from number `first` on (or of these numbers), a column for each id; -inf is no candidate."""
        if not scores.size:
            return
        near = scores.round(8)
        number = first if isinstance(first, np.ndarray) else np.arange(first, first + len(near))
        least = self.least[number]
        if near.shape[1] > self.k:
            least = np.maximum(least, np.partition(near, near.shape[1] - self.k, axis=1)[:, near.shape[1] - self.k])
        q, j = np.nonzero((near >= least[:, None]) & (near > -np.inf))
        if len(q):
            self.merge(number[q], ids[j], scores[q, j])

    def merge(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        query = np.concatenate((self.query, query))
        ids = ids if self.ids is None else np.concatenate((self.ids, ids))
        scores = np.concatenate((self.scores, scores))
        order = np.lexsort((ids, -scores.round(8), query))
        query, ids, scores = query[order], ids[order], scores[order]
        begin = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
        place = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
        kept = place < self.k
        self.query, self.ids, self.scores = query[kept], ids[kept], scores[kept]
        full = place[kept] == self.k - 1
        self.least[self.query[full]] = self.scores[full].round(8)


def ranked(scored: DataFrame, k: int, item: str, by=None) -> DataFrame:
    """scored (qid, item, score) -> with rank 1 to k by descending score to 8 places, then item."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 8)) if by is None else by, item)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def in_blocks(rows, most: int) -> Iterator[list]:
    rows = iter(rows)
    while block := list(islice(rows, most)):
        yield block


def fetched(queries: DataFrame) -> DataFrame | list:
    """The rows of a query set that fits into one block, for searches that ask it again and again; a larger set as it is."""
    rows = queries.limit(MOST_QUERIES + 1).collect()
    return rows if len(rows) <= MOST_QUERIES else queries


def best_rows(base: DataFrame, queries: DataFrame | list, k: int, prepared: Callable[[list], object], scored: Callable, read: Callable | None = None) -> DataFrame:
    """base (id, ...), queries (qid, ...) -> (qid, id, score, rank).

    prepared(block of query rows) is broadcast; scored(prepared, batch) yields (first query, columns of the batch, scores);
    read(prepared), if given, says which rows of base the block needs.
    """
    spark = base.sparkSession
    session.ship(spark)
    kind = base.schema["id"].dataType.simpleString()
    schema = f"qid long, id {kind}, score double"
    first = queries if isinstance(queries, list) else fetched(queries)
    # a large set is fetched partition by partition, so the driver holds one of them and one block
    blocks = in_blocks(first.toLocalIterator(), MOST_QUERIES) if isinstance(first, DataFrame) else [first] if first else []

    def of_block(rows: list) -> DataFrame:
        ready = prepared(rows)
        held = spark.sparkContext.broadcast((np.array([r.qid for r in rows], np.int64), ready))
        needed = session.spread(base.where(read(ready)) if read else base)

        def run(batches):
            qids, own = held.value
            best, as_arrow = Best(len(qids), k), None
            for batch in batches:
                as_arrow = batch.schema.field(0).type
                for at in range(0, batch.num_rows, step := max(1, min(batch.num_rows, CELLS // max(1, min(len(qids), 2_000))))):
                    part = batch.slice(at, step)
                    ids = part.column(0).to_numpy(zero_copy_only=False)
                    ids = ids.astype(str) if ids.dtype == object else ids
                    for begin, columns, scores in scored(own, part):
                        best.add(begin, ids if columns is None else ids[columns], scores)
            if best.ids is not None:
                yield pa.RecordBatch.from_arrays([pa.array(qids[best.query]), pa.array(best.ids.tolist(), as_arrow), pa.array(best.scores)], names=["qid", "id", "score"])

        return needed.mapInArrow(run, schema)

    found = [of_block(rows) for rows in blocks]
    if not found:
        return spark.createDataFrame([], schema + ", rank int")
    return ranked(reduce(DataFrame.unionByName, found), k, "id")


def matrix_of(column: pa.Array) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class TermBlock:
    """Queries as a sparse matrix: for each term the queries that have it, with weights."""

    def __init__(self, terms: list[list[tuple[str, float]]], norm: list[float]):
        self.index: dict[str, int] = {}
        rows = [(self.index.setdefault(t, len(self.index)), q, w) for q, own in enumerate(terms) for t, w in own]
        term, query, weight = (np.array(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
        order = np.argsort(term, kind="stable")
        self.query, self.weight = query[order].astype(np.int64), weight[order].astype(np.float64)
        self.sizes = np.bincount(term.astype(np.int64), minlength=len(self.index))
        self.begin = np.concatenate(([0], np.cumsum(self.sizes)))[:-1] if len(self.index) else np.zeros(0, np.int64)
        self.norm = np.array(norm, np.float64)
        self.known: dict | None = None  # answers that a worker keeps

    def scores(self, docs: list[int], terms: list[int], values: list[float]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Entries (doc, term, value) of a sparse matrix times the queries -> blocks (first query, docs with any hit, scores)."""
        doc, term, value = np.array(docs, np.int64), np.array(terms, np.int64), np.array(values, np.float64)
        if not len(doc):
            return
        there, doc = np.unique(doc, return_inverse=True)
        times = self.sizes[term]
        starts = np.concatenate(([0], np.cumsum(times)))
        at = np.arange(starts[-1]) - np.repeat(starts[:-1] - self.begin[term], times)
        query, cell, amount = self.query[at], np.repeat(doc, times), np.repeat(value, times) * self.weight[at]
        step = max(1, CELLS // len(there))
        for first in range(0, len(self.norm), step):
            n = min(step, len(self.norm) - first)
            own = slice(None) if n == len(self.norm) else (query >= first) & (query < first + n)
            total = np.bincount((query[own] - first) * len(there) + cell[own], amount[own], n * len(there)).reshape(n, -1) / self.norm[first : first + n, None]
            yield first, there, np.where(total > 0, total, -np.inf)
