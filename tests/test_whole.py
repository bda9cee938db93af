"""Nothing is cut: recall, query sets and texts beyond the old limits."""

import ast

import numpy as np
from pyspark.sql import functions as F

from tarnfold.operators import ann, blocks, parsing, retrieval
from tarnfold.plans import registry


def vectors_of(spark, n, seed):
    v = np.random.default_rng(seed).normal(size=(n, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")


def test_ivf_finds_nine_tenths_of_the_exact_neighbours(spark):
    base = vectors_of(spark, 2000, 5)
    asked = base.where("id % 20 = 0").withColumnRenamed("id", "qid")
    found, exact = (f(base, asked, 11).where("id <> qid") for f in (ann.ivf, retrieval.exact_knn))
    assert ann.recall(found, exact, 10).first().recall >= 0.9


def test_exact_search_takes_more_queries_than_a_block(spark, monkeypatch):
    base = vectors_of(spark, 200, 6)
    asked = base.where("id % 2 = 0").withColumnRenamed("id", "qid")
    found = lambda: {(r.qid, r.id, r.rank, round(r.score, 8)) for r in retrieval.exact_knn(base, asked, 3).collect()}
    want = found()
    monkeypatch.setattr(blocks, "MOST_QUERIES", 30)
    assert found() == want and len(want) == 300


def test_source_files_hold_whole_texts(spark, tmp_path):
    texts = ["word " * 5000 + "the end", 'a "quoted" \\ """text\\', "# head\n```\n# in\n~~~\n## more", "", "nul \0 1 é\n日本"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    files = {r.file_path: r.content for r in registry.with_raw(spark, f"file://{tmp_path}").collect()}
    for i, t in enumerate(texts):
        assert ast.literal_eval(ast.parse(files[f"pkg/mod_{i}.py"]).body[3].value) == t
        assert files[f"docs/page_{i}.md"].split("### Deeper\n")[1].removesuffix("\n## End ##\nlast\n") == "> " + t.replace("\n", "\n> ")
        assert files[f"raw/text_{i}.py"] == files[f"raw/text_{i}.md"] == t
    n = parsing.symbols(registry.sources(spark, f"file://{tmp_path}")).groupBy("symbol_type").count()
    assert dict(map(tuple, n.collect())) == {"module": 10, "class": 5, "method": 10, "function": 5, "section": 20}
    whole = registry.strategy_chunks(spark, f"file://{tmp_path}", "file")
    assert whole.where(F.col("text").contains("word the end")).count() == 4 and whole.count() == 20
