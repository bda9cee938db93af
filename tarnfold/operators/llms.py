"""Language models behind one interface: a function (system, prompt) -> text. All calls are greedy."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session
from ..config import PROVIDERS, Config
from . import generation

Model = Callable[[str, str], str]


def posted(url: str, body: dict, headers: dict[str, str], seconds: float) -> dict:
    """The JSON answer to a JSON body; whatever goes wrong is a RuntimeError."""
    if urlsplit(url).scheme not in ("http", "https"):
        raise ValueError(f"not an http url: {url!r}")
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})  # noqa: S310
    try:
        with urllib.request.urlopen(request, timeout=seconds) as answer:  # noqa: S310
            return json.load(answer)
    except (urllib.error.URLError, OSError, ValueError) as e:
        raise RuntimeError(f"no answer from {url}: {e}") from e


def messages(system: str, prompt: str) -> list[dict[str, str]]:
    return [{"role": "system", "content": system}, {"role": "user", "content": prompt}]


def ollama(base: str, model: str, seconds: float = 120.0) -> Model:
    def complete(system: str, prompt: str) -> str:
        found = posted(f"{base.rstrip('/')}/api/chat", {"model": model, "messages": messages(system, prompt), "stream": False, "options": {"temperature": 0}}, {}, seconds)
        return field(found, "message", "content")

    return complete


def openai_compatible(base: str, model: str, key_variable: str = "", seconds: float = 120.0) -> Model:
    def complete(system: str, prompt: str) -> str:
        key = os.environ.get(key_variable, "") if key_variable else ""
        found = posted(f"{base.rstrip('/')}/chat/completions", {"model": model, "messages": messages(system, prompt), "temperature": 0}, {"Authorization": f"Bearer {key}"} if key else {}, seconds)
        return field(found, "choices", 0, "message", "content")

    return complete


def field(found, *path) -> str:
    for p in path:
        try:
            found = found[p]
        except (KeyError, IndexError, TypeError) as e:
            raise RuntimeError(f"an answer without {'.'.join(map(str, path))}") from e
    return str(found)


def model_of(config: Config) -> Model | None:
    """The model that the configuration names; None for extractive answers, which need none."""
    if config.provider not in PROVIDERS:
        raise ValueError(f"unknown provider {config.provider!r}")
    if config.provider == "extractive":
        return None
    return ollama(config.llm_url, config.llm_model) if config.provider == "ollama" else openai_compatible(config.llm_url, config.llm_model, config.llm_key_variable)


def completed(prompts: DataFrame, model: Model, system: str = generation.SYSTEM) -> DataFrame:
    """prompts (..., prompt) with `answer`, stripped, and `seconds`. Calls run where the rows are, one after another in a task."""
    session.ship(prompts.sparkSession)
    schema = prompts.select("*").schema.add("answer", "string").add("seconds", "double")  # add() changes its schema
    at = prompts.columns.index("prompt")

    def run(batches):
        for batch in batches:
            answers, took = [], []
            for prompt in batch.column(at).to_pylist():
                began = time.perf_counter()
                answers.append(model(system, prompt).strip())
                took.append(time.perf_counter() - began)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string()), pa.array(took, pa.float64())], names=schema.names)

    return prompts.mapInArrow(run, schema)


def answered(questions: DataFrame, blocks: DataFrame, config: Config = Config(), model: Model | None = None, system: str = generation.SYSTEM) -> DataFrame:  # noqa: B008
    """questions (qid, query), blocks (qid, blocks) -> (qid, prompt, prompt_chars, text): by `model`, the configured one, or extracts."""
    empty = F.array().cast(blocks.schema["blocks"].dataType)
    both = questions.join(blocks, "qid", "left").withColumn("blocks", F.coalesce("blocks", empty))
    both = both.withColumn("prompt", generation.prompt(F.col("query"), F.col("blocks"))).withColumn("prompt_chars", F.length("prompt") + len(system))
    model = model or model_of(config)
    if model is None:
        return both.select("qid", "prompt", "prompt_chars", generation.extractive_answer(F.col("blocks"), config.extract_blocks).alias("text"), "blocks")
    return completed(both, model, system).select("qid", "prompt", "prompt_chars", F.col("answer").alias("text"), "blocks")


def probed(answers: DataFrame) -> DataFrame:
    """answers (variant, text, hits: array of (citation, file_path)) -> for each variant how many abstain, and their citations by kind."""
    found = generation.checked(answers)
    n = lambda c: F.sum(F.size(c)).alias(c)
    return found.groupBy("variant").agg(F.count("*").alias("questions"), F.sum(generation.abstained(F.col("text")).cast("long")).alias("abstained"), n("grounded"), n("drifted"), n("invented"), F.sum(F.col("ok").cast("long")).alias("ok"))
