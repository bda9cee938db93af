"""The engine as one object: fetch, load, parse, chunk, index, search, ask and evaluate over a folder of collections."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import text as X
from .functions.text import checked_query, collection_name
from .operators import chunking, evaluation, generation, llms, parsing, search
from .sources import checkouts, files
from .sources.collection import Collection, EmbeddingCache, as_hits


class Engine:
    """root: a folder that driver and executors share; encode: (key, text) -> (key, vector), known to the cache as `model`."""

    def __init__(self, spark: SparkSession, root: str, config: Config = Config(), encode=None, model: str = "hash"):  # noqa: B008
        self.spark, self.root, self.config = spark, root.rstrip("/"), config
        self.encode, self.model = encode or search.hash_encoder(config.embed_dim), model
        self.cache = EmbeddingCache(spark, f"{self.root}/cache")

    def fetch(self, url: str, folder: str, ref: str | None = None) -> str:
        return str(checkouts.fetch(url, folder, ref))

    def load(self, tree: str) -> DataFrame:
        return files.load_tree(self.spark, tree, self.config.max_file_bytes)

    def parse(self, tree: str) -> DataFrame:
        return parsing.symbols(self.load(tree))

    def chunk(self, tree: str, strategy: str | None = None) -> DataFrame:
        own = chunking.chunks(self.load(tree), (strategy or self.config.strategy,), self.config.chunk_lines, self.config.chunk_overlap)
        return chunking.with_ids(own)

    def collection(self, name: str) -> Collection:
        return Collection(self.spark, f"{self.root}/collections/{name}")

    def name_of(self, tree: str, strategy: str | None = None) -> str:
        return collection_name(tree, self.model, strategy or self.config.strategy)

    def index(self, tree: str, strategy: str | None = None, name: str | None = None):
        """Brings a collection up to a tree; the report, the cache's counters and the seconds it took."""
        began, counters = time.perf_counter(), {}

        def embed(changed: DataFrame) -> DataFrame:
            texts = changed.select(F.col("point_id").alias("id"), X.cache_key(self.model, F.col("embed_text")).alias("key"), F.col("embed_text").alias("text"))
            vectors, found = self.cache.embed(self.model, texts, self.encode)
            counters.update(found)
            return changed.drop("position").join(vectors.withColumnRenamed("id", "point_id"), "point_id")

        chunks = self.chunk(tree, strategy).withColumn("position", F.col("start_line").cast("long"))
        report = self.collection(name or self.name_of(tree, strategy)).sync(chunks, embed).first()
        return report, counters, time.perf_counter() - began

    def points(self, name: str) -> DataFrame:
        return as_hits(self.collection(name).read()).withColumn("id", F.col("point_id"))

    def search(self, name: str, questions: list[str], **options) -> DataFrame:
        """(qid, rank, score, and the point's columns); qid counts the questions from 0. Options are those of operators.search."""
        points = self.points(name)
        hits = search.search_texts(points, questions, self.config, encode=self.encode, cache=self.cache, model=self.model, **options)
        return hits.join(points.drop("vector"), "id")

    def ask(self, name: str, questions: list[str], llm: llms.Model | None = None, **options) -> DataFrame:
        """(qid, text, prompt_chars, grounded, drifted, invented, bad_refs, ok, abstained)."""
        hits = self.search(name, questions, **options)
        shown = hits.select("qid", "rank", "citation", X.qualified_name(F.col("class_name"), F.col("symbol_name")).alias("name"), F.col("symbol_type").alias("kind"), "text")
        asked = self.spark.createDataFrame([(i, checked_query(q)) for i, q in enumerate(questions)], "qid long, query string")
        answers = llms.answered(asked, generation.blocks(shown), self.config, llm)
        cited = F.transform("blocks", lambda b: F.struct(b["citation"].alias("citation"), F.regexp_extract(b["citation"], "^(.*):", 1).alias("file_path")))
        return generation.checked(answers.withColumn("hits", cited)).withColumn("abstained", generation.abstained(F.col("text"))).drop("blocks", "hits", "prompt")

    def evaluate(self, name: str, gold: str, k: int | None = None, **options) -> DataFrame:
        """The summary of a search over a gold set's questions."""
        k = k or self.config.top_k
        queries, labels = files.gold_labels(self.spark, gold)
        numbered = queries.select(F.xxhash64("qid").alias("number"), "qid", "query")
        points = self.points(name).withColumn("qualified", X.qualified_name(F.col("class_name"), F.col("symbol_name")))
        hits = search.search(points, numbered.select(F.col("number").alias("qid"), "query"), self.config, k=k, encode=self.encode, cache=self.cache, model=self.model, **options)
        known = labels.join(numbered.select("number", "qid"), "qid").select(F.col("number").alias("qid"), "file", "symbol", "grade")
        found = search.grades(hits.join(points.select("id", "file_path", "symbol_name", "qualified"), "id"), known).withColumn("retriever", F.lit("vector"))
        ideal = evaluation.ideals(known.withColumn("id", F.concat_ws(":", "file", "symbol")), k)
        names = numbered.select(F.lit("vector").alias("retriever"), F.col("number").alias("qid"))
        return evaluation.summary(evaluation.scores_of(names, found, ideal, k), self.config.confident, "retriever")
