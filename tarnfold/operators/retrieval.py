"""Retrieval for whole tables of queries: exact search, BM25, substring and random baselines."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import session, storage
from ..functions import text
from . import blocks
from .blocks import CELLS, TermBlock, best_rows, in_blocks, matrix_of, ranked

#: Names, runs of letters and digits, and their answers that a worker keeps; terms that it counts before it passes them on.
NAMES_KEPT, TERMS_KEPT = 100_000, 100_000
IDENTIFIER, PART, RUN = re.compile(text.IDENTIFIER), re.compile(text.IDENTIFIER_PART), re.compile("[a-z0-9]+")


def exact_knn(base: DataFrame, queries: DataFrame, k: int, match: str | None = None, free: bool = False) -> DataFrame:
    """base (id, vector[, match]) and queries (qid, vector[, match]) -> (qid, id, score, rank).

    `match` names a column that must be equal (filtered before the choice, so k is filled up); with `free` a query with null
    there takes all. Rows without a vector are left out.
    """
    more = [match] if match else []

    def prepared(rows: list[Row]):
        wanted = {}
        codes = [wanted.setdefault(r[2], len(wanted)) if r[2] is not None else -1 for r in rows] if match else None
        return np.array([r[1] for r in rows], np.float64), wanted, codes and np.array(codes)

    def scored(held, batch):
        q, wanted, codes = held
        v = matrix_of(batch.column(1))
        own = np.array([wanted.get(x, -2) for x in batch.column(2).to_pylist()]) if codes is not None else None
        step = max(1, CELLS // len(v))
        for at in range(0, len(q), step):
            scores = q[at : at + step] @ v.T
            if own is not None:
                asked = codes[at : at + step, None]
                scores[(asked != own) & ((asked >= 0) | (not free))] = -np.inf
            yield at, None, scores

    return best_rows(base.select("id", "vector", *more).where("vector is not null"), queries.select("qid", "vector", *more).where("vector is not null"), k, prepared, scored)


def names_of(name: str) -> list[str]:
    """The lexical tokens of one identifier or number: its parts, and the joined form if there are several."""
    if name.isalpha() and (name.islower() or name.isupper() or name[1:].islower()):  # most names are one part
        return [name.lower()]
    parts = [x.lower() for x in PART.findall(name)]
    return [*parts, "".join(parts)] if len(parts) > 1 else parts


class Kept(dict):
    """Answers to `make` by key; emptied when NAMES_KEPT are there."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= NAMES_KEPT:
            self.clear()
        found = self[key] = self.make(key)
        return found


def term_weights(stats: DataFrame, n: int) -> DataFrame:
    """(term, df, idf): ln(n - df + .5) - ln(df + .5); negative ones become a quarter of the mean over all terms."""
    raw = stats.where("term <> ''").select("term", "df", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    floor = raw.agg(0.25 * F.avg("raw")).first()[0]
    return raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(floor)).otherwise(F.col("raw")).alias("idf"))


def term_stats(docs: DataFrame) -> DataFrame:
    """docs (text) -> (term, df, times, most): documents with the term, its occurrences, the most in one document.

    The term '' has the number of documents and of all tokens. Counts are summed in each task first.
    """
    session.ship(docs.sparkSession)

    def packed(found: dict[str, list[int]]) -> pa.RecordBatch:
        df, times, most = zip(*found.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array(x, pa.int64()) for x in (df, times, most))], names=["term", "df", "times", "most"])

    def run(batches):
        names, found, total = Kept(names_of), {}, [0, 0, 0]
        for batch in batches:
            for x in batch.column(0).to_pylist():
                tf: dict[str, int] = {}
                for name, n in Counter(IDENTIFIER.findall(x or "")).items():
                    for t in names[name]:
                        tf[t] = tf.get(t, 0) + n
                for t, n in tf.items():
                    own = found.get(t)
                    if own is None:
                        found[t] = [1, n, n]
                    else:
                        own[0] += 1
                        own[1] += n
                        own[2] = max(own[2], n)
                total[0] += 1
                total[1] += sum(tf.values())
            if len(found) >= TERMS_KEPT:
                yield packed(found)
                found = {}
        yield packed(found | {"": total})

    found = session.spread(docs.select("text")).mapInArrow(run, "term string, df long, times long, most long")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("times").alias("times"), F.max("most").alias("most"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """docs (id, text), queries (qid, query) -> (qid, id, score, rank); scores not above 0 are dropped.

    Texts are read twice: for the frequencies of terms, and to score each document against the weights of the asked ones.
    """
    stats = storage.stored(term_stats(docs), "bm25-terms")
    total = stats.where("term = ''").agg(F.sum("df"), F.sum("times")).first()
    n, mean = total[0] or 0, (total[1] or 0) / (total[0] or 1)
    weights = term_weights(stats, n)
    asked = queries.select("qid", F.explode(text.lexical_tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    weighed = asked.join(weights, "term").groupBy("qid").agg(F.collect_list(F.struct("term", F.col("times") * F.col("idf"))).alias("terms"))

    def scored(block: TermBlock, batch):
        if block.known is None:
            block.known = Kept(lambda name: [block.index.get(t) for t in names_of(name)])
        of, rows, terms, values = block.known, [], [], []
        for row, x in enumerate(batch.column(1).to_pylist()):
            found, size, tf = Counter(IDENTIFIER.findall(x or "")), 0, Counter()
            for name, times in found.items():
                own = of[name]
                size += times * len(own)
                for i in own:
                    if i is not None:
                        tf[i] += times
            for i, times in tf.items():
                rows.append(row)
                terms.append(i)
                values.append(times * (k1 + 1) / (times + k1 * (1 - b + b * size / mean)))
        yield from block.scores(rows, terms, values)

    return best_rows(docs.select("id", "text"), weighed, k, lambda rows: TermBlock([[tuple(t) for t in r.terms] for r in rows], [1.0] * len(rows)), scored)


def grep(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Share of a query's terms of over two characters that occur in the text, case aside.

    Terms hold letters and digits only, so one occurs in a text if it does in one of the text's runs of these; each run is
    looked up once.
    """
    terms = queries.select("qid", F.filter(text.lexical_tokens(F.col("query")), lambda t: F.length(t) > 2).alias("terms")).where("size(terms) > 0")

    def scored(held, batch):
        block, lengths = held
        if block.known is None:
            block.known = Kept(lambda run: {i for n in lengths for at in range(len(run) - n + 1) if (i := block.index.get(run[at : at + n])) is not None})
        of, rows, found = block.known, [], []
        for row, x in enumerate(batch.column(1).to_pylist()):
            own = set().union(*(of[run] for run in set(RUN.findall((x or "").lower()))))
            rows += [row] * len(own)
            found += own
        yield from block.scores(rows, found, [1.0] * len(rows))

    def prepared(rows: list[Row]):
        block = TermBlock([list(Counter(r.terms).items()) for r in rows], [len(r.terms) for r in rows])
        return block, sorted({len(t) for t in block.index})

    return best_rows(docs.select("id", "text"), terms, k, prepared, scored)


def random_ranking(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """k documents a query, by a hash of the query's text and the document (its first 52 bits, an exact double); score 0."""

    def scored(held, batch):
        ids = [str(x).encode() for x in batch.column(0).to_pylist()]
        for q, begun in enumerate(held):
            place = np.empty(len(ids))
            for j, x in enumerate(ids):
                h = hashlib.sha256(begun + x)
                place[j] = -(int.from_bytes(h.digest()[:8], "big") >> 12)
            yield q, None, place[None, :]

    found = best_rows(docs.select("id"), queries.select("qid", "query"), k, lambda rows: [f"{r.query}|".encode() for r in rows], scored)
    return found.withColumn("score", F.lit(0.0))


def contained(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """docs (id, text), queries (qid, query) -> (qid, id) where the text has the whole query.

    A word inside a query, with white space on both sides, is a word of each text that has the query: only texts with
    its longest inner word are searched. Queries without one are searched for in all texts.
    """
    spark = docs.sparkSession
    session.ship(spark)
    schema = f"qid long, id {docs.schema['id'].dataType.simpleString()}"
    out = None
    for rows in in_blocks(queries.select("qid", "query").where("query is not null").toLocalIterator(), blocks.MOST_QUERIES):
        by_word: dict[str | None, list] = {}
        for r in rows:
            by_word.setdefault(max(r.query.split()[1:-1], key=len, default=None), []).append((r.qid, r.query))
        held = spark.sparkContext.broadcast(by_word)

        def run(batches, held=held):
            by_word = held.value
            always = by_word.get(None, [])
            for batch in batches:
                ids, found = batch.column(0), []
                for row, x in enumerate(batch.column(1).to_pylist()):
                    near = [q for w in by_word.keys() & set(x.split()) for q in by_word[w]] if x is not None else []
                    found += [(qid, row) for qid, query in (near + always if x is not None else near) if query in x]
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa.int64()), ids.take(pa.array([r for _, r in found], pa.int64()))], names=["qid", "id"])

        part = session.spread(docs.select("id", "text")).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def overlap_score(query: Column, content: Column) -> Column:
    """Built-in pair scorer: share of the query's distinct tokens found among the text's."""
    q, t = F.array_distinct(text.lexical_tokens(query)), F.array_distinct(text.lexical_tokens(content))
    return text.let(q, lambda x: F.when(F.size(x) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, t)) / F.size(x)))


def rerank(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int, score=overlap_score) -> DataFrame:
    """hits (qid, id) scored anew on (query, text); only candidates' texts are joined."""
    pairs = hits.select("qid", "id").join(F.broadcast(queries.select("qid", "query")), "qid").join(docs.select("id", "text"), "id")
    return ranked(pairs.select("qid", "id", score(F.col("query"), F.col("text")).alias("score")), k, "id")


def rerank_enriched(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int, score=overlap_score) -> DataFrame:
    """The same on docs' `embed_text`; the hits keep the scores that they came with."""
    placed = rerank(hits, queries, docs.select("id", F.col("embed_text").alias("text")), k, score)
    return placed.select("qid", "id", "rank").join(hits.select("qid", "id", "score"), ["qid", "id"])


def per_key_cap(hits: DataFrame, key: str, cap: int, k: int) -> DataFrame:
    """At most `cap` hits of a key in rank order (0: no cap), ranked anew, k of them."""
    if cap > 0:
        own = F.row_number().over(Window.partitionBy("qid", key).orderBy("rank"))
        hits = hits.withColumn("_own", own).where(F.col("_own") <= cap).drop("_own")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("rank") <= k)


def mmr(hits: DataFrame, k: int, trade: float) -> DataFrame:
    """hits (qid, id, rank, score, vector) -> k of them, each next by trade * score - (1 - trade) * nearest chosen.

    A query has few candidates (the search depth), so the greedy choice is a fold over one array.
    """
    from ..functions.vectors import dot

    if not 0 <= trade <= 1:
        raise ValueError("the trade-off must lie in [0, 1]")
    listed = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score", "vector"))).alias("all"))
    start = F.struct(F.slice("all", 1, 1).alias("chosen"), F.slice("all", 2, 1_000_000).alias("left"))

    def pick(state: Column, _: Column) -> Column:
        def worth(x: Column) -> Column:
            near = F.array_max(F.transform(state["chosen"], lambda c: dot(x["vector"], c["vector"])))
            return trade * x["score"] - (1 - trade) * near

        tried = F.sort_array(F.transform(state["left"], lambda x: F.struct((-worth(x)).alias("cost"), x["rank"].alias("rank"), x.alias("hit"))))

        def taken(t: Column) -> Column:
            return F.struct(F.concat(state["chosen"], F.array(t[0]["hit"])).alias("chosen"), F.filter(state["left"], lambda x: x["rank"] != t[0]["rank"]).alias("left"))

        return F.when(F.size(state["left"]) == 0, state).otherwise(text.let(tried, taken))

    steps = F.sequence(F.lit(2), F.lit(k)) if k > 1 else F.array().cast("array<int>")
    done = F.aggregate(steps, start, pick, lambda s: s["chosen"])
    return listed.select("qid", F.posexplode(F.slice(done, 1, k)).alias("at", "hit")).select("qid", "hit.id", (F.col("at") + 1).alias("rank"), "hit.score")
