"""The corpus pipeline: language ID, quality, near duplicates, mixing, BPE.

STAGES holds (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame with the columns of documents (the last one: token digests), and works on all rows
that the one before kept. run() writes each stage's result to the shared folder and reads
it back for the next.

Edge cases: null and empty texts are in no language and go at the first stage; columns beyond those of
documents, whatever their names, are kept until the last stage; of documents with equal doc_id and text
one stays; texts of any length go through whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm import bpe, common, divergence, jaccard_join, mixing, ppm

#: Near duplicates: words of a shingle, percent of the union.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Texts of so many bytes are dropped if their code takes more than so many bits a byte.
LEAST_JUDGED, MOST_BITS = 8, 10.0
#: No source is repeated more often than this in the mixture.
MOST_REPEATS = 1.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language and writes the language found into `lang`, for the rules to come.

    In no language is a text without a letter, and one of LEAST_JUDGED bytes or more that even the best
    model codes in more than MOST_BITS bits a byte: without a model a byte takes 8.
    """
    found = ppm.identified(docs, ppm.fit(docs))
    short = F.octet_length("row.text") < LEAST_JUDGED
    kept = found.where((F.col("lang_pred") != "und") & (short | (F.col("bits_per_byte") <= MOST_BITS)))
    return kept.withColumn("row", F.col("row").withField("lang", F.col("lang_pred"))).select(*common.unpacked(found))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base counts or lie far from their language's references."""
    return divergence.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each component, one without doc_id only where none has one."""
    times = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1)
    if not times.isEmpty():
        return near_duplicates_by_key(docs)
    found = common.stored(jaccard_join.components_of(docs, NEAR_WORDS, NEAR_PERCENT), "near")
    gone = common.stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "near-gone")
    return common.by_ids(docs, gone, "doc_id", "left_anti").select(*docs.columns)


def near_duplicates_by_key(docs: DataFrame) -> DataFrame:
    """The same where doc_ids are null or repeated: a row is known by a hash of doc_id and text, and of equal rows one stays."""
    keyed = common.packed(docs).withColumn("key", F.xxhash64("row.doc_id", "row.text"))
    found = jaccard_join.components_of(keyed.select(F.col("key").alias("doc_id"), "row.text"), NEAR_WORDS, NEAR_PERCENT)
    found = common.stored(found.select(F.col("doc_id").alias("key"), "component_id").distinct(), "near")
    rows = common.stored(keyed.groupBy("key").agg(F.first("row.doc_id").alias("doc_id"), F.count("*").alias("n")), "near-keys")
    members = common.stored(found.join(rows.select("key", "doc_id"), "key"), "near-members")
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")
    firsts = members.groupBy("component_id").agg(F.min(order)["key"].alias("first"), F.count("*").alias("members"))
    known = common.join_on_hot_key(members, firsts.where("members > 1"), "component_id", "members", F.col("key"))
    gone = common.stored(known.where("key <> first").select("key"), "near-gone")
    kept = common.by_ids(keyed, gone, "key", "left_anti")
    twice = common.stored(rows.where("n > 1").select("key"), "near-twice")
    once = common.by_ids(kept, twice, "key", "left_semi").dropDuplicates(["key"])
    done = common.by_ids(kept, twice, "key", "left_anti").unionByName(once.select(*kept.columns))
    return done.select(*common.unpacked(done))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources up to the temperature weights; each document stays at least once."""
    return mixing.mixed(docs, MOST_REPEATS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and digests of ids and decoded text."""
    return bpe.encode(docs, bpe.vocabulary(), ["doc_id", "source"])


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: The stages are models, similarity joins and tokenizers: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = common.new_path(spark, f"pipeline-{name}")
        with common.scratch():  # what a stage keeps for itself goes when its result is written
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    return docs
