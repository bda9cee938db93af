"""What is shown on the driver: latencies, sizes and lines of text."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession


def latency(call, times: int = 20) -> dict[str, float]:
    """Median and 95th percentile (by place) of the seconds that a call takes."""
    took = []
    for _ in range(times):
        began = time.perf_counter()
        call()
        took.append(time.perf_counter() - began)
    return percentiles(took)


def percentiles(took: list[float]) -> dict[str, float]:
    took, n = sorted(took), len(took)
    median = (took[(n - 1) // 2] + took[n // 2]) / 2
    return {"n": n, "median": median, "p95": took[max(0, int(0.95 * n) - 1)]}


def stored_bytes(spark: SparkSession, folder: str) -> int:
    """Size of all files below a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def ann_scale(spark: SparkSession, sizes: tuple[int, ...], dim: int = 64, k: int = 10, queries: int = 50, times: int = 3) -> DataFrame:
    """For each number of made vectors: seconds to build the index, its bytes, latencies of exact and indexed search, recall."""
    from pyspark.sql import functions as F

    from . import storage
    from .operators import ann, retrieval

    rows = []
    for n in sizes:
        base = storage.stored(ann.made_vectors(spark, n, dim), "scale-base")
        asked = storage.stored(base.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // queries))) == 0).withColumnRenamed("id", "qid"), "scale-asked")
        began = time.perf_counter()
        index = ann.Ivf.build(base)
        built = time.perf_counter() - began
        probes = index.probes(asked, k)
        exact = storage.stored(retrieval.exact_knn(base, asked, k), "scale-exact")
        run = lambda df: latency(lambda: df().write.format("noop").mode("overwrite").save(), times)["median"]
        found = ann.recall(index.search(asked, k, probes), exact, k).first().recall
        rows.append((n, len(index.centers), probes, built, stored_bytes(spark, index.folder), run(lambda: retrieval.exact_knn(base, asked, k)), run(lambda: index.search(asked, k, probes)), found))  # noqa: B023
    return spark.createDataFrame(rows, "vectors long, lists int, probes int, build_s double, bytes long, exact_s double, ivf_s double, recall double")


def summary_text(name: str, row) -> str:
    """A row of evaluation.summary as one line."""
    return f"{name:<20} n={row.queries:<4} hit@1={row.hit_1:.3f} hit@k={row.hit_k:.3f} recall={row.recall:.3f} mrr={row.mrr:.3f} ndcg={row.ndcg:.3f}"


def hits_text(hits: DataFrame, lines: int = 6, most: int = 50) -> str:
    """hits (rank, score, citation, text) as text, each with its first lines."""
    from pyspark.sql import functions as F

    from .operators.chunking import snippet

    rows = hits.select("rank", "score", "citation", snippet(F.col("text"), lines).alias("text")).orderBy("rank").limit(most).collect()
    return "\n\n".join(f"{r['rank']}. {r.citation}  ({r.score:.3f})\n" + "\n".join(f"    {x}" for x in r.text.split("\n")) for r in rows)
