"""Chunks of files: line windows and symbols, with enriched text, ids and hashes. All of a file stays in its row until its chunks are cut."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions import text as X
from . import evaluation, parsing

WANTED = {"file": ("module",), "class": ("class", "function", "section"), "function": ("function", "method", "section")}
COLUMNS = "strategy string, symbol_type string, symbol_name string, class_name string, start_line int, end_line int, docstring string, text string"
CONTEXT = "imports array<string>, class_line string, class_docstring string, siblings array<string>"
#: What is not white space by Unicode.
INK = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def window_parts(lines: list[str], size: int, overlap: int) -> Iterator[tuple]:
    """Windows of `size` lines; blank ones are left out, the last one reaches the end."""
    step, n = size - overlap, len(lines)
    for start in range(0, max(0, -(-(n - size) // step) * step) + 1 if n else 0, step):
        text = "\n".join(lines[start : start + size])
        if INK.search(text):
            yield "fixed", "window", f"L{start + 1}", "", start + 1, min(start + size, n), "", text


def symbol_parts(symbols: list[dict], strategy: str) -> list[dict]:
    """The symbols that a strategy makes chunks of; a file without any gives its module.

    Under `function` a class counts if no method of the file names it.
    """
    owners = {s["class_name"] for s in symbols if s["symbol_type"] == "method"}
    own = lambda s: strategy == "function" and s["symbol_type"] == "class" and s["symbol_name"] not in owners
    return [s for s in symbols if s["symbol_type"] in WANTED[strategy] or own(s)] or symbols[:1]


def context_of(symbols: list[dict], lines: list[str], most_imports: int, most_siblings: int) -> Callable[[dict], tuple]:
    """For a symbol of the file the values of CONTEXT: the first imports; if a class owns it, that one's first line and docstring and its other methods."""
    imports, classes, methods = symbols[0]["imports"][:most_imports], {}, {}
    for s in symbols:
        if s["symbol_type"] == "class":
            classes.setdefault(s["symbol_name"], s)
        if s["symbol_type"] == "method":
            methods.setdefault(s["class_name"], []).append(s["symbol_name"])

    def found(s: dict) -> tuple:
        owner = classes.get(s["class_name"])
        if owner is None or owner["start_line"] > len(lines):
            return imports, None, None, None
        others = (x for x in methods[s["class_name"]] if x != s["symbol_name"]) if s["class_name"] in methods else None
        return imports, lines[owner["start_line"] - 1], owner["docstring"], others and list(islice(others, most_siblings))

    return found


def chunks(files: DataFrame, strategies: tuple[str, ...] = ("function",), size: int = 60, overlap: int = 10, context: tuple[int, int] | None = None) -> DataFrame:
    """files (file_path, language, content) -> chunks of each strategy, from one parse and without a shuffle.

    With `context`, the most imports and the most other methods, the columns of CONTEXT are there too.
    """
    if unknown := set(strategies) - {*WANTED, "fixed"}:
        raise ValueError(f"unknown strategies {sorted(unknown)}")
    parsed = set(strategies) & set(WANTED)

    def rows_of(path, language, content, lines):
        symbols = parsing.symbols_of(path, language, content, lines) if parsed else []
        around = context_of(symbols, lines, *context) if context and parsed else lambda s: (None,) * 4
        for strategy in strategies:
            if strategy == "fixed":
                yield from (x + around({"class_name": "", "symbol_name": ""}) if context else x for x in window_parts(lines, size, overlap))
                continue
            for s in symbol_parts(symbols, strategy):
                text = "\n".join(lines[s["start_line"] - 1 : s["end_line"]]) if content is not None else None
                own = strategy, s["symbol_type"], s["symbol_name"], s["class_name"], s["start_line"], s["end_line"], s["docstring"], text
                yield own + around(s) if context else own

    return parsing.in_files(files, f"{COLUMNS}, {CONTEXT}" if context else COLUMNS, rows_of)


def windows(files: DataFrame, size: int, overlap: int) -> DataFrame:
    return chunks(files, ("fixed",), size, overlap)


def snippet(content: Column, lines: int) -> Column:
    """The first lines of a text."""
    return F.array_join(F.slice(X.lines_of(content), 1, lines), "\n")


def enriched() -> Column:
    """The text that is embedded: path, kind and names, the name in words, docstring, a blank line, the body."""
    path = F.replace(F.replace("file_path", F.lit("/"), F.lit(" / ")), F.lit("_"), F.lit(" "))
    kind = F.concat_ws(" ", "language", "symbol_type", X.qualified_name(F.col("class_name"), F.col("symbol_name")))
    words = F.lower(F.array_join(X.identifier_parts(F.col("symbol_name")), " "))
    header = F.array(path, kind, F.nullif("class_name", F.lit("")), F.nullif(words, F.lit("")), F.nullif(F.trim("docstring"), F.lit("")))
    return F.concat(F.array_join(F.array_compact(header), "\n"), F.lit("\n\n"), F.col("text"))


def with_ids(chunks: DataFrame) -> DataFrame:
    """Adds embed_text, citation, directory, point_key, point_id and content_hash."""
    key = X.point_key(F.col("file_path"), F.col("class_name"), F.col("symbol_name"), F.col("start_line"), F.col("strategy"))
    return chunks.select(
        "*",
        enriched().alias("embed_text"),
        X.citation(F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("citation"),
        X.directory(F.col("file_path")).alias("directory"),
        key.alias("point_key"),
        X.uuid5(key).alias("point_id"),
    ).withColumn("content_hash", F.sha2("embed_text", 256))


def token_stats(counts: DataFrame, by: str, most: int = 256) -> DataFrame:
    """counts (by, n) -> chunks, mean, p95 (by place, not interpolated), max and truncated.

    The 95th percentile needs the values in order: of each distinct count only its frequency is gathered.
    """
    return (
        evaluation.with_places(counts, by, "n")
        .groupBy(by)
        .agg(
            F.sum("times").alias("chunks"),
            F.round(F.sum(F.col("n") * F.col("times")) / F.sum("times"), 6).alias("mean_tokens"),
            evaluation.at_fraction("n", 0.95).alias("p95_tokens"),
            F.max("n").alias("max_tokens"),
            F.sum(F.when(F.col("n") > most, F.col("times")).otherwise(0)).alias("truncated"),
        )
    )


def token_counts(chunks: DataFrame, encode=None) -> DataFrame:
    """chunks (embed_text, ...) with n_tokens: by `encode`, a function of a list of texts to a list of counts, or by estimate."""
    if encode is None:
        session.ship(chunks.sparkSession)
        return chunks.withColumn("n_tokens", F.arrow_udf(X.token_estimates, "int")("embed_text"))
    count = F.pandas_udf(lambda texts: pd.Series(encode(texts.tolist())), "int")
    return chunks.withColumn("n_tokens", count("embed_text"))


def context_cost(hits: DataFrame, counts: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """hits (qid, id, rank), counts (id, n_tokens) -> (k, mean_tokens): what the first k hits of a query cost, on average."""
    cuts = F.explode(F.array(*map(F.lit, ks)))
    per = hits.join(counts.select("id", "n_tokens"), "id").withColumn("k", cuts).where("rank <= k").groupBy("k", "qid").agg(F.sum("n_tokens").alias("tokens"))
    return per.groupBy("k").agg(F.round(F.avg("tokens"), 6).alias("mean_tokens"))
