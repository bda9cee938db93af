"""Search as one call: filter, nearest vectors, MMR, reranking, cut; and evaluation against labels of files and symbols."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import vectors
from ..functions.text import checked_query
from ..sources.files import matches
from . import retrieval

FIELDS = ("language", "symbol_type", "directory")


def metadata(points: DataFrame, language: str = "", symbol_type: str = "", directory: str = "") -> DataFrame:
    """Points that equal each value given; empty ones are no filter. A directory means itself, not what lies below."""
    wanted = [(c, v) for c, v in zip(FIELDS, (language, symbol_type, directory), strict=True) if v]
    return points.where(reduce(and_, (F.col(c) == v for c, v in wanted))) if wanted else points


def hash_encoder(dim: int):
    """The built-in encoder: (key, text) -> (key, vector)."""
    return lambda texts: vectors.hash_embed(texts, "key", "text", dim)


def embedded(queries: DataFrame, encode, cache=None, model: str = "") -> DataFrame:
    """queries (qid, query) -> (qid, vector), through the cache if one is given."""
    from ..functions.text import cache_key

    texts = queries.select(F.col("qid").alias("id"), cache_key(model, F.col("query")).alias("key"), F.col("query").alias("text"))
    if cache is not None:
        return cache.embed(model, texts, encode)[0].withColumnRenamed("id", "qid")
    vectors_of = encode(texts.select("key", "text").dropDuplicates(["key"]))
    return texts.join(vectors_of, "key").select(F.col("id").alias("qid"), "vector")


def search(points: DataFrame, queries: DataFrame, config: Config = Config(), *, k: int | None = None, encode=None, cache=None, model: str = "", mmr: bool = False, rerank=None, match: str | None = None, **filters) -> DataFrame:  # noqa: B008
    """points (id, vector, text, FIELDS), queries (qid, query[, match]) -> (qid, id, rank, score).

    Filters come before the choice of neighbours, so k is filled up. With mmr or rerank `config.depth` candidates are
    searched; with both, MMR cuts to k first and only these are reranked. rerank: a function of (query, text) columns
    to a score. match: a column of both sides that must be equal; a query with null there is not filtered.
    """
    k = k or config.top_k
    wide = config.depth if mmr or rerank else k
    own = metadata(points, **filters)
    asked = embedded(queries, encode or hash_encoder(config.embed_dim), cache, model)
    asked = asked.join(queries.select("qid", match), "qid") if match else asked
    hits = retrieval.exact_knn(own, asked, wide, match, free=True)
    if mmr:
        hits = retrieval.mmr(hits.join(own.select("id", "vector"), "id"), k, config.mmr_lambda)
    if rerank:
        hits = retrieval.rerank(hits, queries, own, k, rerank)
    return hits.where(F.col("rank") <= k).select("qid", "id", "rank", "score")


def search_texts(points: DataFrame, queries: list[str], config: Config = Config(), **options) -> DataFrame:  # noqa: B008
    """search for a few questions, checked, numbered from 0."""
    rows = [(i, checked_query(q)) for i, q in enumerate(queries)]
    return search(points, points.sparkSession.createDataFrame(rows, "qid long, query string"), config, **options)


def first_language(labels: DataFrame, files: DataFrame) -> DataFrame:
    """labels (qid, position, file), files (file, language) -> (qid, language) of the first labelled file that is there."""
    return labels.join(files.select("file", "language"), "file").groupBy("qid").agg(F.min_by("language", "position").alias("language"))


def grades(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """hits (qid, file_path, symbol_name, qualified, ...) with the largest grade of the labels (qid, file, symbol, grade) that mean them, else 0."""
    keyed = hits.withColumn("_hit", F.monotonically_increasing_id()) if "_hit" not in hits.columns else hits
    label = F.struct(F.col("l.file").alias("file"), F.col("l.symbol").alias("symbol"))
    means: Column = (F.col("h.qid") == F.col("l.qid")) & (F.col("h.file_path") == F.col("l.file")) & matches(label, F.col("h.file_path"), F.col("h.symbol_name"), F.col("h.qualified"))
    joined = keyed.alias("h").join(labels.alias("l"), means, "left").select("h.*", "l.grade")
    rest = [c for c in hits.columns if c != "_hit"]
    return joined.groupBy("_hit", *rest).agg(F.coalesce(F.max("grade"), F.lit(0)).alias("grade")).drop("_hit")


def name_index(chunks: DataFrame) -> DataFrame:
    """(file, name): all names by which a label can mean a chunk."""
    names = F.explode(F.array_distinct(F.array("symbol_name", "qualified")))
    return chunks.select(F.col("file_path").alias("file"), names.alias("name")).distinct()


def unresolved(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """Labels of files or symbols that no chunk has."""
    index = name_index(chunks)
    by_symbol = labels.where("symbol is not null").join(index, (labels["file"] == index["file"]) & (labels["symbol"] == index["name"]), "left_anti")
    by_file = labels.where("symbol is null").join(index.select("file").distinct(), "file", "left_anti").select(*labels.columns)
    return by_symbol.unionByName(by_file)
