"""Mixing sources by temperature: weights from exponentiated shares, realised as block permutations.

A source with a share p of all tokens gets the weight p^a / sum p^a. The exponent a is
bisected to the flattest mixture (smallest a in 0..1) whose entropy is at most a target or in
which no source is repeated more often than a limit. A source's quota is its weight times
the budget; it is met by whole epochs and a part of one. Each epoch of a source is a fresh
permutation of its blocks and of the documents in each block; positions in it are prefix
sums over block totals and within blocks, so no task holds more than a block, whatever the
source's size. A part of an epoch takes the documents that end within the quota left.

Tokens are words (runs of other than ASCII white space). At most MOST_SOURCES sources are
planned on the driver and their plan broadcast; more are an error, not a cut.

Edge cases: null sources are a source of their own; null texts have no tokens; a source
without tokens is taken once; equal rows are placed apart or, if alike in id and text, side by
side; null doc_ids are mixed like others; an empty table gives none. Texts of any length are counted
whole. The columns of the input travel in one struct, so no name can clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

MOST_SOURCES, BLOCK_ROWS, SEED = 100_000, 5_000, 9
MOST_REPEATS = 2.0


def weights(tokens: list[int], exponent: float) -> list[float]:
    top = max(tokens, default=0) or 1
    raised = [(n / top) ** exponent if n else 0.0 for n in tokens]
    total = sum(raised) or 1.0
    return [x / total for x in raised]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log2(x) for x in w if x > 0)


def solve_exponent(tokens: list[int], most_repeats: float | None = None, most_entropy: float | None = None, whole: bool = False) -> float:
    """The smallest exponent that keeps to the limits. whole: the budget is such that no source is cut."""

    def fits(a: float) -> bool:
        w = weights(tokens, a)
        repeats = [x * budget_of(tokens, w, whole) / n for x, n in zip(w, tokens, strict=True) if n]
        return (most_repeats is None or max(repeats, default=0) <= most_repeats) and (most_entropy is None or entropy(w) <= most_entropy)

    low, high = 0.0, 1.0
    if fits(low) or not fits(high):
        return low if fits(low) else high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def budget_of(tokens: list[int], w: list[float], whole: bool) -> float:
    return max((n / x for n, x in zip(tokens, w, strict=True) if n), default=0.0) if whole else float(sum(tokens))


def plan_of(sources: list[tuple], budget: int | None, most_repeats: float | None, most_entropy: float | None, whole: bool) -> list[tuple]:
    """sources (source, tokens, rows) -> (source, tokens, blocks, epochs, rest): whole epochs, tokens of the part after them."""
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    tokens = [s[1] for s in sources]
    w = weights(tokens, solve_exponent(tokens, most_repeats, most_entropy, whole))
    total = budget if budget is not None else budget_of(tokens, w, whole)
    out = []
    for (name, n, rows), x in zip(sources, w, strict=True):
        quota = round(x * total)
        quota = max(quota, n) if whole else quota
        out.append((name, n, max(1, math.ceil(rows / BLOCK_ROWS)), quota // n if n else 1, quota % n if n else 0))
    return out


def counted(docs: DataFrame) -> DataFrame:
    text = common.text_or_empty()
    return docs.select("doc_id", "source", F.size(common.words_of(text)).cast("long").alias("n_tokens"), F.xxhash64(text).alias("_tie"))


def copies(facts: DataFrame, plan: list[tuple], seed: int = SEED) -> DataFrame:
    """facts (doc_id, source, n_tokens, _tie) -> a row for each copy taken, with epoch, at_token and at_share.

    at_token: the tokens before it in its source's stream; at_share: that as a share of the source's quota. In the order
    of at_share all sources advance alike, so each part of the whole stream holds them by their weights.
    """
    spark = facts.sparkSession
    planned = spark.createDataFrame(plan, "_source string, _tokens long, _blocks long, _epochs long, _rest long")
    placed = facts.join(F.broadcast(planned), F.col("source").eqNullSafe(F.col("_source")))
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_tie"), F.col("_blocks"))
    last = F.col("_epochs") - F.when(F.col("_rest") > 0, F.lit(0)).otherwise(F.lit(1))
    each = placed.where(last >= 0).withColumn("_block", block).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    key = ["source", "epoch", "_block"]
    mixed = lambda *c: F.xxhash64(F.lit(seed), *c)
    totals = each.groupBy(*key).agg(F.sum("n_tokens").alias("_n"))
    # a source has at most a row for each BLOCK_ROWS of its rows here
    before = totals.withColumn("_before", F.sum("_n").over(Window.partitionBy("source", "epoch").orderBy(mixed("epoch", "_block"), "_block")) - F.col("_n"))
    within = Window.partitionBy(*key).orderBy(mixed("epoch", "doc_id", "_tie"), F.col("doc_id").asc_nulls_first(), "_tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = each.withColumn("_upto", F.sum("n_tokens").over(within))
    match = F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l.epoch") == F.col("r.epoch")) & (F.col("l._block") == F.col("r._block"))
    joined = rows.alias("l").join(before.select("source", "epoch", "_block", "_before").alias("r"), match).select("l.*", "r._before")
    ends: Column = F.col("_before") + F.col("_upto")
    at_token, quota = F.col("epoch") * F.col("_tokens") + ends - F.col("n_tokens"), F.col("_epochs") * F.col("_tokens") + F.col("_rest")
    return joined.where((F.col("epoch") < F.col("_epochs")) | (ends <= F.col("_rest"))).select(
        "doc_id", "source", "n_tokens", "_tie", F.col("epoch").cast("int").alias("epoch"), at_token.alias("at_token"), F.coalesce(at_token / F.nullif(quota, F.lit(0)), F.lit(0.0)).alias("at_share")
    )


def planned_copies(docs: DataFrame, budget: int | None = None, most_repeats: float | None = MOST_REPEATS, most_entropy: float | None = None, whole: bool = False) -> DataFrame:
    facts = common.stored(counted(docs), "op9-counts")
    totals = facts.groupBy("source").agg(F.sum("n_tokens"), F.count("*")).limit(MOST_SOURCES + 1)
    sources = sorted((tuple(r) for r in totals.collect()), key=lambda r: (r[0] is not None, r[0] or ""))
    return copies(facts, plan_of(sources, budget, most_repeats, most_entropy, whole))


def mixed(docs: DataFrame, most_repeats: float, seed: int = SEED) -> DataFrame:
    """docs with each document as often as the mixture has it, at least once, in its own columns."""
    taken = planned_copies(docs, most_repeats=most_repeats, whole=True)
    more = taken.where("epoch > 0").groupBy("doc_id", F.col("_tie").alias("tie")).agg((F.max("epoch") + 1).cast("int").alias("copies"))
    more = common.small(common.stored(more, "op9-copies"), 32)
    rows = common.packed(docs)
    own = F.xxhash64(common.text_or_empty("row.text"))
    joined = rows.join(more, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (own == F.col("tie")), "left")
    repeated = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)))))
    return repeated.select(*common.unpacked(repeated))


def op9_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(sf_dir, "documents", spark).select("doc_id", "text", "source")
    return planned_copies(docs).drop("_tie")
