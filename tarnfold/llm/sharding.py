"""Uniform shuffle into shards of exact size by a communication matrix.

Rows lie in blocks (a hash of doc_id, size and checksum); the result has cells, several to a shard. A matrix
with the block sizes as row sums and the cell sizes as column sums is drawn from the
multivariate hypergeometric law: how many rows of each block a uniform random permutation
of all rows would put into each cell. Then each block is permuted by itself and cut by its
row of the matrix, rows go to their cells, and each cell is permuted again. The slot is
the cell's offset in its shard, known from the start, plus the place in the cell.

Only the matrix is drawn on the driver, from the counts of blocks; BLOCKS and CELLS bound
it (8 MB), so the broadcast of its cumulated rows has a fixed bound too.

Edge cases: a null text has 0 bytes and crc32 0; null and repeated doc_ids are dealt like
others; equal rows are interchangeable (and share a block); texts of any length count whole; other
columns of the input play no part, whatever their names; an empty table gives none.
The law is `rows`: shard sizes differ by one at most. grown_shard is null under this law.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SHARDS, SEED = 40, 20
#: At most so many blocks and cells; rows for each of them below that, but no fewer than LEAST_BLOCKS blocks.
BLOCKS, CELLS, ROWS_PER_BLOCK, LEAST_BLOCKS = 1024, 1000, 10_000, 16


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among `draws` of good + bad without return: inversion from the mode outwards."""
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    fact = math.lgamma
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))

    def log_weight(k: int) -> float:
        return -(fact(k + 1) + fact(good - k + 1) + fact(draws - k + 1) + fact(bad - draws + k + 1))

    everything = fact(total + 1) - fact(good + 1) - fact(bad + 1) - fact(draws + 1) - fact(total - draws + 1)
    at_mode = math.exp(log_weight(mode) - everything)
    left = rng.random() - at_mode
    up, p_up, down, p_down = mode, at_mode, mode, at_mode
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) / (up + 1) * (draws - up) / (bad - draws + up + 1)
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down / (good - down + 1) * (bad - draws + down) / (draws - down + 1)
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if p_up < 1e-18 and p_down < 1e-18:
            break
    return mode


def matrix(block_sizes: list[int], cell_sizes: list[int], seed: int) -> list[list[int]]:
    """Rows: blocks, columns: cells; each row and column has exactly its sum."""
    rng, left, rest = random.Random(seed), list(cell_sizes), sum(cell_sizes)
    out = []
    for size in block_sizes:
        row, draws, others = [], size, rest
        for c, free in enumerate(left):
            others -= free
            n = hypergeometric(rng, free, others, draws) if draws and free else 0
            row.append(n)
            left[c] -= n
            draws -= n
        rest -= size
        out.append(row)
    return out


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = common.text_or_empty()
    facts = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    facts = common.stored(facts, "op5-facts")  # texts are read once
    rows = facts.count()
    n_blocks = max(LEAST_BLOCKS, min(BLOCKS, math.ceil(rows / ROWS_PER_BLOCK)))
    per_shard = max(1, min(CELLS // shards, math.ceil(rows / shards / ROWS_PER_BLOCK)))
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32"), F.lit(n_blocks)).cast("int")
    counts = {r[0]: r[1] for r in facts.groupBy(block.alias("block")).count().collect()}  # BLOCKS at most
    sizes = [rows // shards + (s < rows % shards) for s in range(shards)]
    cells, offsets = [], []
    for n in sizes:
        own = [n // per_shard + (c < n % per_shard) for c in range(per_shard)]
        cells += own
        offsets += [0, *accumulate(own)][:-1]
    drawn = matrix([counts.get(b, 0) for b in range(n_blocks)], cells, seed)
    # of each block only the cells that get rows: (last place, cell)
    cuts = [(b, [(e, c) for c, (e, n) in enumerate(zip(accumulate(row), row, strict=True)) if n]) for b, row in enumerate(drawn)]
    plan = spark.createDataFrame(cuts, "block int, cuts array<struct<last: long, cell: int>>")

    read = facts.withColumn("block", block)
    place = lambda part, salt: F.row_number().over(Window.partitionBy(part).orderBy(F.xxhash64(F.lit(salt), "doc_id", "text_crc32"), "doc_id", "text_crc32"))
    dealt = (
        read.withColumn("place", place("block", seed + 1))
        .join(F.broadcast(plan), "block")
        .withColumn("cell", F.expr("filter(cuts, x -> x.last >= place)[0].cell"))
        .select("doc_id", "size", "text_crc32", "cell")
    )
    offset = F.element_at(F.array(*map(F.lit, offsets)), F.col("cell") + 1)
    return dealt.withColumn("slot", offset + place("cell", seed + 2) - 1).select(
        "doc_id", "size", "text_crc32", (F.col("cell") / per_shard).cast("int").alias("shard"), F.col("slot").cast("long").alias("slot")
    )


def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = shuffle_into_shards(common.table(sf_dir, "documents", spark).select("doc_id", "text"))
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
