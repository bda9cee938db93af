"""Fusion of ranked lists (qid, id, rank, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .retrieval import ranked


def min_max(hits: DataFrame, name: str) -> DataFrame:
    """Scores scaled to 0..1 within a query; 1 where all are equal. Of an id that a list has twice the last one counts."""
    hits = hits.groupBy("qid", "id").agg(F.max_by("score", "rank").alias("score"))
    all_of = Window.partitionBy("qid")
    low, high = F.min("score").over(all_of), F.max("score").over(all_of)
    return hits.select("qid", "id", F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)).alias(name))


def weighted_scores(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """(qid, id, v, w): both lists' scaled scores, 0 where a list lacks the document."""
    both = min_max(vector, "v").join(min_max(keyword, "w"), ["qid", "id"], "full_outer")
    return both.select("qid", "id", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("w", F.lit(0.0)).alias("w"))


def weighted(vector: DataFrame, keyword: DataFrame, weight: float, k: int) -> DataFrame:
    if not 0 <= weight <= 1:
        raise ValueError("the weight must lie in [0, 1]")
    scored = weighted_scores(vector, keyword).select("qid", "id", (weight * F.col("v") + (1 - weight) * F.col("w")).alias("score"))
    return ranked(scored, k, "id")


def reciprocal_rank(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank) over the lists; an id that a list has twice counts twice."""
    union = lists[0].select("qid", "id", "rank")
    for x in lists[1:]:
        union = union.unionByName(x.select("qid", "id", "rank"))
    scored = union.groupBy("qid", "id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
    return ranked(scored, k, "id", F.desc(F.round("score", 12)))
