"""Stages of the pipeline: odd rows and clashing names, and each against SQL, brute force or the library on a whole table."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnfold.llm import bpe, divergence

DATA = "/root/testdata/sf0.001"
NAMES = ("score", "lang_pred", "bits_per_byte", "_text", "text_", "_q", "q", "row", "best", "_profile", "profile", "lang_", "words", "_copies", "copies", "copy", "tie", "_id", "id", "key", "doc", "n_tokens", "_lang")
PROSE = "the stone house by the water is old and it was built for the people of that town with great care on a hill near this road "
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (None, PROSE * 3, "en", "a", 0), (3, PROSE * 3 + "alpha", "xx", None, 0), (4, PROSE * 4, "en", "a", 0),
    (4, PROSE * 4, "en", "a", 0), (5, "1234 !!", "en", "b", 0), (6, "日本語の文章です。" * 30, "en", "b", 0), (7, PROSE * 2_000, "fr", "b", 0), (8, "short", "en", "b", 0),
]


@pytest.fixture(params=["odd", "empty"])
def docs(spark, request):
    made = spark.createDataFrame(ODD if request.param == "odd" else [], "doc_id long, text string, lang string, source string, n_chars long")
    return made.select("*", *(F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(n) for n in NAMES))


def test_stages_take_odd_tables_and_clashing_names(spark, docs):
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, "")
        rows = found.collect()
        if name == "tokens":
            assert len(rows) == n
            continue
        assert found.columns == docs.columns
        for r in rows:  # each column still belongs to its row
            assert all(r[c] == f"{c}-{'?' if r.doc_id is None else r.doc_id}" for c in NAMES)
        ids = Counter(r.doc_id for r in rows)
        if not n:
            assert not rows
        elif name == "language_id":
            assert set(ids) == {None, 3, 4, 6, 7, 8} and ids[4] == 2  # 6 is what `en` was learned from, too
        elif name == "near_duplicates":
            assert 4 not in ids or ids[4] == 1
        elif name == "mixture":
            assert all(ids[i] >= k for i, k in Counter(r[0] for r in ODD).items())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_language_stage_drops_what_no_model_fits(spark):
    odd = [(9001, "qqq xxx zzz vvv", None), (9002, "これは日本語の文章です。", None), (9003, "the in of and", None), (9004, "Эта вода", None), (9005, "x", None), (9006, "1 2 3", "en")]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    found = corpus_pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(odd, docs.schema)), "")
    assert {r.doc_id for r in found.where("doc_id > 9000").collect()} == {9003, 9005}
    assert found.where("doc_id <= 9000").count() == docs.count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages_on_a_whole_table(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = corpus_pipeline.language_id(spark, docs, DATA)
    first.coalesce(1).write.parquet(f"{tmp_path}/first")
    first = spark.read.parquet(f"{tmp_path}/first")
    assert first.join(docs.select("doc_id", F.col("lang").alias("given")), "doc_id").where("lang <> given").count() <= 2
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/first/*.parquet')")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({divergence.SQL}) WHERE kept").fetchall()}
    second = corpus_pipeline.quality_rules(spark, first, DATA)
    second.write.parquet(f"{tmp_path}/second")
    second = spark.read.parquet(f"{tmp_path}/second")
    assert {r.doc_id for r in second.select("doc_id").collect()} == kept and second.count() == len(kept)

    rows = second.select("doc_id", "text").collect()
    sets = {r.doc_id: set(zip(*(r.text.lower().split()[i:] for i in range(5)), strict=False)) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    third = corpus_pipeline.near_duplicates(spark, second, DATA)
    third.write.parquet(f"{tmp_path}/third")
    third = spark.read.parquet(f"{tmp_path}/third")
    assert sorted(r.doc_id for r in third.select("doc_id").collect()) == sorted(i for i in ids if find(i) == i)

    fourth = corpus_pipeline.mixture(spark, third, DATA)
    times = Counter(r.doc_id for r in fourth.select("doc_id").collect())
    assert set(times) == {i for i in ids if find(i) == i} and max(times.values()) <= 2
    library = Tokenizer.from_file(bpe.vocabulary())
    texts = dict(third.select("doc_id", "text").collect())
    for r in corpus_pipeline.tokens(spark, third, DATA).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_run_is_its_stages_one_after_another(spark):
    found = corpus_pipeline.run(spark, DATA)
    assert found.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < found.count() <= 400
