"""Source trees and gold sets as DataFrames."""

from __future__ import annotations

from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LANGUAGES, SKIPPED_ENDINGS, SKIPPED_FILES, SKIPPED_FOLDERS, Config

GOLD = "repo string, sha string, note string, queries array<struct<id: string, query: string, kind: string, note: string, gold: array<struct<file: string, symbol: string, grade: int>>>>"


def wanted(path: Column, size: Column, most_bytes: int) -> Column:
    """The discovery rules on a path relative to the root."""
    parts = F.split(path, "/")
    name, folders = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    skipped = F.exists(folders, lambda d: d.isin(*SKIPPED_FOLDERS) | d.startswith("."))
    generated = F.lit(False)
    for ending in SKIPPED_ENDINGS:
        generated = generated | name.endswith(ending)
    return ~skipped & ~name.startswith(".") & ~name.isin(*SKIPPED_FILES) & ~generated & (size <= most_bytes) & language(path).isNotNull()


def language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in sorted(LANGUAGES.items()) for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)))


def decoded(files: DataFrame) -> DataFrame:
    """files (file_path, content binary): those without NUL bytes that are UTF-8, as text with the hash of the bytes."""
    fine = ~F.contains("content", F.unhex(F.lit("00"))) & F.is_valid_utf8(F.col("content").cast("string"))
    return files.where(fine).select("file_path", language(F.col("file_path")).alias("language"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("sha"))


def load_tree(spark: SparkSession, root: str, most_bytes: int = Config.max_file_bytes) -> DataFrame:
    """(file_path, language, content, sha) of a checked-out tree; `length` is tested before contents are read. Links are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    relative = F.expr(f"substring(path, {len(whole) + 2})")
    found = raw.select(relative.alias("file_path"), "length", "content").where(wanted(F.col("file_path"), F.col("length"), most_bytes))
    links = links_below(whole)
    return decoded(found.where(~F.col("file_path").isin(links)) if links else found)


def links_below(root: str) -> list[str]:
    """Files of a local tree that are links or lie below one; other stores have none."""
    if not root.startswith("file:"):
        return []
    base = Path(urlsplit(root).path)
    return [str(p.relative_to(base)) for p in base.rglob("*") if p.is_file() and p.resolve() != base.resolve() / p.relative_to(base)]


def gold_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries: qid, query, kind) and (labels: qid, file, symbol, grade) of a gold set."""
    each = spark.read.schema(GOLD).json(path, multiLine=True).select(F.explode("queries").alias("q"))
    labels = each.select(F.col("q.id").alias("qid"), F.explode("q.gold").alias("g")).select("qid", "g.*")
    return each.select(F.col("q.id").alias("qid"), "q.query", "q.kind"), labels


def matches(labels: Column, file: Column, name: Column, qualified: Column) -> Column:
    """Whether a label (file, symbol) means a chunk: same file, and no symbol or one of its names."""
    return (labels["file"] == file) & (labels["symbol"].isNull() | labels["symbol"].isin(name, qualified))
