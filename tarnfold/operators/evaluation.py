"""Graded evaluation: hits (retriever, qid, id, rank, score) against labels (qid, id, grade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def graded(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """hits with their largest grade, 0 if unlabelled."""
    best = labels.groupBy("qid", "id").agg(F.max("grade").alias("grade"))
    return hits.join(best, ["qid", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def ideals(labels: DataFrame, k: int) -> DataFrame:
    """(qid, n_labels, ideal): labels of each query and the best possible DCG at k."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "id"))
    top = labels.withColumn("place", place)
    return top.groupBy("qid").agg(F.count("*").alias("n_labels"), F.sum(F.when(F.col("place") <= k, gain(F.col("grade"), F.col("place")))).alias("ideal"))


def ideals_of_counts(counts: DataFrame, k: int) -> DataFrame:
    """The same from (qid, n_labels) where all grades are 1."""
    top = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_labels").cast("int"))), F.lit(0.0), lambda s, i: s + gain(F.lit(1), i))
    return counts.select("qid", "n_labels", F.when(F.col("n_labels") > 0, top).alias("ideal"))


def query_scores(names: DataFrame, hits: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """One row for each of names (retriever, qid), hits or not. recall and nDCG are not cut at 1."""
    return scores_of(names, graded(hits, labels), ideals(labels, k), k)


def scores_of(names: DataFrame, found: DataFrame, ideal: DataFrame, k: int) -> DataFrame:
    """found: hits with `grade`; ideal (qid, n_labels, ideal). good_ranks: the ranks of relevant hits, in order."""
    good, near = F.col("grade") > 0, F.col("rank") <= k
    per = found.groupBy("retriever", "qid").agg(
        F.max((good & (F.col("rank") <= 1)).cast("int")).alias("hit_1"),
        F.max((good & near).cast("int")).alias("hit_k"),
        F.sum((good & near).cast("int")).alias("n_good"),
        F.min(F.when(good, F.col("rank"))).alias("first"),
        F.sum(F.when(near, gain(F.col("grade"), F.col("rank")))).alias("dcg"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"),
        F.sort_array(F.collect_list(F.when(good, F.col("rank")))).alias("good_ranks"),
    )
    every = names.join(per, ["retriever", "qid"], "left").join(ideal, "qid", "left")
    return every.select(
        "retriever",
        "qid",
        F.coalesce("n_labels", F.lit(0)).alias("n_labels"),
        F.coalesce("hit_1", F.lit(0)).alias("hit_1"),
        F.coalesce("hit_k", F.lit(0)).alias("hit_k"),
        F.coalesce(F.col("n_good") / F.nullif(F.col("n_labels"), F.lit(0)), F.lit(0.0)).alias("recall"),
        (F.coalesce("n_good", F.lit(0)) / k).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.coalesce(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")), F.lit(0.0)).alias("ndcg"),
        F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
        F.coalesce("good_ranks", F.array().cast("array<int>")).alias("good_ranks"),
    )


def summary(scores: DataFrame, confident: float, *by: str) -> DataFrame:
    """Means over answerable queries; of the others the share with a confident top score."""
    can = F.col("n_labels") > 0
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(can, F.col(c))), F.lit(0.0)), 6)
    return scores.groupBy(*by).agg(
        F.sum(can.cast("long")).alias("queries"),
        mean("hit_1").alias("hit_1"),
        mean("hit_k").alias("hit_k"),
        mean("recall").alias("recall"),
        mean("rr").alias("mrr"),
        mean("ndcg").alias("ndcg"),
        F.sum((~can).cast("long")).alias("unanswerable"),
        F.round(F.coalesce(F.avg(F.when(~can, (F.col("top_score") >= confident).cast("int"))), F.lit(0.0)), 6).alias("false_confidence"),
    )


def with_places(values: DataFrame, by: str, name: str) -> DataFrame:
    """values (by, name) -> (by, name, times, upto, all): how often each value occurs and how many are at most it."""
    per = values.groupBy(by, name).agg(F.count("*").alias("times"))
    upto = F.sum("times").over(Window.partitionBy(by).orderBy(name))
    return per.withColumn("upto", upto).withColumn("all", F.sum("times").over(Window.partitionBy(by)))


def at_fraction(name: str, fraction: float) -> Column:
    """Over with_places, an aggregate: the value at min(int(fraction * n), n - 1) of the sorted ones."""
    place = F.least(F.floor(F.lit(fraction) * F.col("all")), F.col("all") - 1)
    return F.min(F.when(F.col("upto") > place, F.col(name)))


def markdown(rows: DataFrame, most: int = 1_000) -> str:
    """A report as a Markdown table; for summaries of a few rows."""
    found = [["" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r] for r in rows.limit(most).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [rows.columns, ["---"] * len(rows.columns), *found])


def per_query_json(scores: DataFrame, hits: DataFrame) -> DataFrame:
    """One JSON document (`value`) a query of (retriever, qid, ...) with its graded hits in order: for df.write.text."""
    listed = hits.groupBy("retriever", "qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score", "grade"))).alias("hits"))
    return scores.join(listed, ["retriever", "qid"], "left").select("retriever", F.to_json(F.struct("*")).alias("value"))
