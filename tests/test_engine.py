import uuid

import pytest
from pyspark.sql import functions as F

from tarnfold.config import Config
from tarnfold.functions import text as X
from tarnfold.operators import chunking, evaluation, fusion, generation, parsing, retrieval
from tarnfold.sources import collection, files


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_tokens_identifiers_and_ids(spark):
    assert one(spark, X.lexical_tokens(F.col("t")), t="box.openLid_now(x7)") == ["box", "open", "lid", "now", "openlidnow", "x", "7", "x7"]
    assert one(spark, X.identifier_parts(F.col("t")), t="_aB_HTTPRequest2") == ["a", "B", "HTTP", "Request", "2"]
    assert one(spark, X.uuid5(F.col("t")), t="a:é") == str(uuid.uuid5(uuid.UUID(X.NAMESPACE), "a:é"))
    assert one(spark, X.token_estimate(F.col("t")), t="abcde 12 !") == 4
    sample = "a\r\nb\x0bc\u2028\n"
    assert one(spark, X.lines_of(F.col("t")), t=sample) == sample.splitlines()


def test_names_and_config():
    assert X.repo_of("https://github.com/a/b.git") == ("a", "b")
    for bad in ("git@github.com:a/b", "https://evil.com/a/b", "https://github.com/a", "https://github.com/../b", "ext::sh"):
        with pytest.raises(ValueError):
            X.repo_of(bad)
    assert X.collection_name("https://github.com/a/b", "x/all-M", "function") == "a__b__all-M__function"
    for bad in ({"chunk_lines": 10, "chunk_overlap": 10}, {"strategy": "no"}, {"fusion_weight": 2.0}):
        with pytest.raises(ValueError):
            Config(**bad)
    with pytest.raises(ValueError):
        X.checked_query("  ")


def test_windows(spark):
    content = "\n".join(f"l{i}" for i in range(20))
    out = chunking.windows(spark.createDataFrame([("f", "x", content), ("g", "x", " \n")], ["file_path", "language", "content"]), 10, 4)
    assert sorted((r.start_line, r.end_line) for r in out.collect()) == [(1, 10), (7, 16), (13, 20)]


CODE = '"""Doc."""\nimport a as b\nfrom .x import y as z\n\n@deco\ndef f():\n    def inner(): pass\n\nclass K(B):\n    """Kay.\n    more"""\n    def m(self): pass\n    async def n(self): pass\n'
MARKS = "x\n# A\n```\n# no\n```\n### B\n### C\n## D\n"


def test_parsers(spark):
    rows = [("p/k.py", "python", CODE), ("bad.py", "python", "def ("), ("deep.py", "python", "(" * 20000), ("r.md", "markdown", MARKS), ("x.rb", "ruby", "a\nb"), ("empty.py", "python", "")]
    found = parsing.symbols(spark.createDataFrame(rows, ["file_path", "language", "content"])).orderBy("position").collect()
    got = [(s.symbol_type, s.symbol_name, s.start_line, s.end_line) for s in found if s.file_path == "p/k.py"]
    assert got == [("module", "k.py", 1, 13), ("function", "f", 5, 7), ("class", "K", 9, 13), ("method", "m", 12, 12), ("method", "n", 13, 13)]
    assert next(s for s in found if s.symbol_name == "k.py").imports == ["import b", "from .x import y"]
    assert [(s.symbol_name, s.end_line) for s in found if s.file_path in ("bad.py", "deep.py", "x.rb", "empty.py")].count(("empty.py", 1)) == 1
    assert sum(s.file_path in ("bad.py", "deep.py", "x.rb", "empty.py") for s in found) == 4
    marks = [(s.symbol_name, s.class_name, s.start_line, s.end_line) for s in found if s.symbol_type == "section"]
    assert marks == [("A", "", 2, 5), ("B", "A", 6, 6), ("C", "A > B", 7, 7), ("D", "A", 8, 8)]


def test_strategies_and_expansion(spark):
    own = spark.createDataFrame([("k.py", "python", CODE), ("c.py", "python", "X = 1\n")], ["file_path", "language", "content"])
    symbols = parsing.symbols(own)
    names = lambda s: sorted(r.symbol_name for r in chunking.chunks(own, (s,)).collect())
    assert names("function") == ["c.py", "f", "m", "n"] and names("class") == ["K", "c.py", "f"] and names("file") == ["c.py", "k.py"]
    single = [tuple(r) for s in ("file", "class", "function", "fixed") for r in chunking.chunks(own, (s,)).collect()]
    assert sorted(single) == sorted(tuple(r) for r in chunking.chunks(own, ("file", "class", "function", "fixed")).collect())
    with pytest.raises(ValueError):
        chunking.chunks(own, ("lines",))
    hits = chunking.chunks(own).where("symbol_name = 'm'").select("file_path", "class_name", "symbol_name", "text")
    assert generation.expanded(hits, symbols, own).first().expanded == 'import b\nfrom .x import y\n\nclass K(B):\n    """Kay."""\n    # other methods: n\n\n    def m(self): pass'
    assert one(spark, chunking.snippet(F.col("t"), 2), t="a\r\nb\nc") == "a\nb"


def test_fusion_mmr_and_cap(spark):
    hit = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "qid long, id string, rank int, score double")
    v, k = hit([("a", 1, 0.5), ("b", 2, 0.4)]), hit([("b", 1, 12.0), ("c", 2, 6.0)])
    out = [(r.id, round(r.score, 6)) for r in fusion.weighted(v, k, 0.7, 5).orderBy("rank").collect()]
    assert out == [("a", 0.7), ("b", 0.3), ("c", 0.0)]
    assert fusion.reciprocal_rank([v, k], 5).orderBy("rank").first().id == "b"
    found = spark.createDataFrame([(1, "a", 1, 0.9, [1.0, 0.0]), (1, "b", 2, 0.89, [0.99, 0.141]), (1, "c", 3, 0.6, [0.0, 1.0])], "qid long, id string, rank int, score double, vector array<double>")
    pick = lambda t: [r.id for r in retrieval.mmr(found, 2, t).orderBy("rank").collect()]
    assert pick(1.0) == ["a", "b"] and pick(0.5) == ["a", "c"]
    capped = spark.createDataFrame([(1, i, i, 1.0 / i, "f" if i < 5 else "g") for i in range(1, 6)], "qid long, id long, rank int, score double, file string")
    assert [r.id for r in retrieval.per_key_cap(capped, "file", 2, 5).orderBy("rank").collect()] == [1, 2, 5]


def test_metrics(spark):
    hits = spark.createDataFrame([("r", 1, i, i, 1.0) for i in range(1, 5)], "retriever string, qid long, id long, rank int, score double")
    labels = spark.createDataFrame([(1, 2, 2), (1, 4, 1)], "qid long, id long, grade int")
    names = spark.createDataFrame([("r", 1), ("r", 2)], "retriever string, qid long")
    rows = {r.qid: r for r in evaluation.query_scores(names, hits, labels, 5).collect()}
    assert (rows[1].hit_1, rows[1].hit_k, rows[1].recall, rows[1].rr) == (0, 1, 1.0, 0.5) and rows[2].n_labels == 0
    assert evaluation.summary(evaluation.query_scores(names, hits, labels, 5), 0.3).first().unanswerable == 1


def test_citations(spark):
    text = "a/b.py:1-9, a/b.py:3 and x.md:1-2 b.py [7] [1]"
    rows = spark.createDataFrame([(text, [("a/b.py:1-9", "a/b.py")])], "text string, hits array<struct<citation: string, file_path: string>>")
    r = generation.checked(rows).first()
    assert (r.grounded, r.drifted, r.invented, r.bad_refs) == (["a/b.py:1-9", "b.py"], ["a/b.py:3-3"], ["x.md:1-2"], [7])


def test_sync_and_discovery(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(p, h, i, "python", [1.0, 0.0]) for i, (p, h) in enumerate(x)], "point_id string, content_hash string, position long, language string, vector array<double>")
    store = collection.Collection(spark, f"file://{tmp_path}/c")
    with pytest.raises(ValueError):
        store.sync(rows(("a", "1")).limit(0), lambda c: c)
    assert store.sync(rows(("a", "1"), ("b", "1")), lambda c: c).first().upserted == 2
    r = store.sync(rows(("a", "1"), ("c", "2")), lambda c: c).first()
    assert (r.upserted, r.unchanged, r.deleted, r.points) == (1, 1, 1, 2) and store.count() == 2
    (tmp_path / "t" / "node_modules").mkdir(parents=True)
    for name, data in (("a.py", b"x = 1\r\n"), ("b.min.js", b"1"), ("node_modules/c.py", b"1"), ("d.py", b"\0"), ("e.md", b"\xff\xfe"), ("f.txt", b"1")):
        (tmp_path / "t" / name).write_bytes(data)
    assert [(r.file_path, r.content) for r in files.load_tree(spark, f"file://{tmp_path}/t").collect()] == [("a.py", "x = 1\r\n")]
