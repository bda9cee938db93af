"""Bottom-k sketches of shingle hashes, in SQL functions only.

A sketch is the ascending list of the K smallest distinct 64-bit hashes of a text's
shingles of five words (a shorter text with words is one shingle). Sketches of parts merge
into the sketch of the whole (union, sort, cut). Of two sketches the K smallest of the
union are a sample of the union of both sets, and the share of it in both estimates
resemblance; containment and the number of distinct shingles follow from the same sample.
With fewer than K shingles the sketch is the whole set and all estimates are exact.

The next document, by ascending doc_id, is found without a total order in one task: ids
are cut into ranges by quantiles and by quantiles between these, rows without one by their text's
hash; each range gets a copy of the first row of the range after it, and LEAD does the rest within
ranges.

Edge cases: a null text is empty and has the empty sketch, alike (1.0) only to another
empty one; null doc_ids come first; of null and repeated doc_ids the order is that of the texts'
hashes; a single document is its own next one; texts of any length are read whole; other columns of the
input play no part, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

K, WORDS = 128, 5
#: Ranges of ids: quantile cells, at most so many, times quantiles within each, at most so many; rows aimed at in one range.
QUANTILES, STEPS, ROWS_PER_RANGE = 256, 1024, 2_000


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """Array of at most k ascending hashes."""
    hashed = F.transform(common.words_of(text), lambda w: F.xxhash64(w))
    return F.transform(F.array(hashed), lambda h: _sketch_of_words(h, k, words))[0]


def _sketch_of_words(h: Column, k: int, words: int) -> Column:
    grams = F.transform(
        F.sequence(F.lit(1), F.size(h) - (words - 1)), lambda i: F.xxhash64(*[F.element_at(h, (i + j).cast("int")) for j in range(words)])
    )
    short = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h)))
    return F.slice(F.sort_array(F.array_distinct(F.when(F.size(h) >= words, grams).otherwise(short))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    both = F.array(F.struct(merged(a, b, k).alias("u"), F.array_intersect(a, b).alias("i")))
    share = F.transform(both, lambda x: F.size(F.array_intersect(x["u"], x["i"])) / F.size(x["u"]))[0]
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k; else (k - 1) over the k-th smallest hash, scaled to (0, 1]."""
    kth = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has, from the sample of the union."""
    both = F.array(F.struct(merged(a, b, k).alias("u"), F.array_intersect(a, b).alias("i")))
    share = F.transform(both, lambda x: F.size(F.array_intersect(x["u"], x["i"])) / F.size(F.array_intersect(x["u"], a)))[0]
    return F.when(F.size(a) == 0, F.lit(1.0)).when(F.size(b) == 0, F.lit(0.0)).otherwise(F.coalesce(share, F.lit(0.0)))


def as_text(a: Column) -> Column:
    """Hashes as 16 hex digits each."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def at_most(bounds: Column, value: Column) -> Column:
    """How many of the bounds are at most the value."""
    return F.size(F.filter(bounds, lambda b: b <= value))


def quantiles(name: str, parts: int) -> Column:
    """The bounds between `parts` parts of about equal size, as an array; empty for one part."""
    if parts < 2:
        return F.array().cast("array<bigint>")
    return F.percentile_approx(F.col(name).cast("long"), [i / parts for i in range(1, parts)], 10 * parts)


def id_ranges(ids: DataFrame, rows: int, nulls: int) -> tuple[DataFrame, int, int]:
    """(cell, bounds): the quantiles within each cell; and how many ranges a cell has, and how many the rows without id."""
    ranges = max(1, math.ceil(rows / ROWS_PER_RANGE))
    cells = min(QUANTILES, ranges)
    steps = min(STEPS, math.ceil(ranges / cells))
    first = ids.agg(quantiles("doc_id", cells)).first()[0] or []
    cell = at_most(F.array(*map(F.lit, first)).cast("array<bigint>"), F.col("doc_id")).alias("cell")
    within = ids.where("doc_id is not null").groupBy(cell).agg(quantiles("doc_id", steps).alias("bounds"))
    found = ids.sparkSession.createDataFrame([tuple(r) for r in within.collect()], "cell int, bounds array<bigint>")  # QUANTILES * STEPS numbers at most
    return found.withColumn("first", F.array(*map(F.lit, first)).cast("array<bigint>")), steps, max(1, math.ceil(nulls / ROWS_PER_RANGE))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): adds `bucket`, `ghost` and for use within a bucket the order columns.

    Ghosts are first rows of the next bucket; they serve LEAD only and are dropped after it.
    """
    spark = docs.sparkSession
    rows, there = docs.agg(F.count("*"), F.count("doc_id")).first()
    bounds, steps, null_steps = id_ranges(docs.select("doc_id"), there, rows - there)
    first = bounds.limit(1).collect()
    cell = at_most(F.array(*map(F.lit, first[0]["first"] if first else [])).cast("array<bigint>"), F.col("doc_id"))
    tie = F.xxhash64("text")
    # rows without id come first, dealt out by the order of their hashes
    unnamed = F.least(F.lit(null_steps - 1), F.floor((tie / F.lit(2.0**64) + 0.5) * null_steps).cast("int")) - null_steps

    def placed(df: DataFrame) -> DataFrame:
        by_id = F.col("_cell") * steps + F.coalesce(at_most(F.col("bounds"), F.col("doc_id")), F.lit(0))
        found = df.withColumn("_cell", cell).join(F.broadcast(bounds.select(F.col("cell").alias("_cell"), "bounds")), "_cell", "left")
        return found.withColumn("_at", F.when(F.col("doc_id").isNull(), unnamed).otherwise(by_id).cast("long")).drop("_cell", "bounds")

    firsts = placed(docs.select("doc_id", F.lit("").alias("text")).where("doc_id is not null")).groupBy("_at").agg(F.min("doc_id").alias("id")).select("_at", "id", F.lit(None).cast("long").alias("tie")).collect()
    if there < rows:
        firsts += placed(docs.where("doc_id is null")).groupBy("_at").agg(F.min(tie).alias("tie")).select("_at", F.lit(None).cast("long").alias("id"), "tie").collect()
    firsts = sorted(map(tuple, firsts))  # a row for each range
    before = [(i, t, firsts[n - 1][0]) for n, (_, i, t) in enumerate(firsts)]
    ghosts = F.broadcast(spark.createDataFrame(before, "first_id long, first_tie long, before long"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("first_tie").isNull() | (F.col("first_tie") == tie))
    own, ghost = F.struct(F.col("_at").alias("at"), F.lit(False).alias("ghost")), F.struct(F.col("before").alias("at"), F.lit(True).alias("ghost"))
    both = F.explode(F.array_compact(F.array(own, F.when(F.col("before").isNotNull(), ghost))))
    return placed(docs).join(ghosts, is_first, "left").withColumn("bucket", both).select("doc_id", "text", tie.alias("tie"), "bucket.at", "bucket.ghost")


def edited_pairs(docs: DataFrame, k: int = K) -> DataFrame:
    """Sketches of each text, of its edited text and of the next document's text."""
    read = with_next(docs.select("doc_id", common.text_or_empty().alias("text")))
    # after the last comes the first; the ghost stands behind the rows of its bucket
    order = Window.partitionBy("at").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "tie", "text")
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    moved = read.withColumn("next_text", F.lead("text").over(order))
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) as int))"), F.substring("next_text", F.lit(1), cut))
    own = moved.select("doc_id", "tie", "text", "at", "ghost", F.when(~F.col("ghost"), edited).alias("edited"), sketch(F.col("text"), k).alias("own"))
    paired = own.withColumn("next_own", F.lead("own").over(order)).where(~F.col("ghost"))
    return paired.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), "own", sketch(F.col("edited"), k).alias("changed"), "next_own"
    )


def op2_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = edited_pairs(common.table(sf_dir, "documents", spark).select("doc_id", "text"))
    own, changed, following = F.col("own"), F.col("changed"), F.col("next_own")
    return pairs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(own).alias("fingerprint"),
        as_text(changed).alias("edited_fingerprint"),
        resemblance(own, changed).alias("near_edited"),
        resemblance(own, following).alias("near_next"),
        F.round(distinct_shingles(own), 1).alias("about_shingles"),
    )
