"""The engine as one object, collections, caches, models and reports."""

import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from tarnfold import __main__, reports
from tarnfold.api import Engine
from tarnfold.config import Config
from tarnfold.functions import text as X
from tarnfold.operators import blocks, evaluation, fusion, generation, llms, retrieval, search
from tarnfold.sources import checkouts, collection, files
from tarnfold.streaming import sync

CODE = '"""Doors."""\nimport os\n\n\nclass Door:\n    """A door."""\n\n    def open_wide(self):\n        return "open the door wide"\n\n    def close(self):\n        return None\n\n\ndef count_windows(house):\n    return len(house.windows)\n'


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "src" / "door.py").write_text(CODE)
    (root / "notes.md").write_text("# Windows\nHow to count windows of a house.\n## Glass\nold\n")
    return root


def test_index_search_ask_and_evaluate(spark, tree, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/root", Config(max_file_bytes=600))
    (tree / "src" / "long.py").write_text("x = 1\n" * 101)  # 606 bytes
    assert engine.load(f"file://{tree}").count() == 2
    report, counters, _ = engine.index(f"file://{tree}", name="c")
    assert report.upserted == 5 and counters == {"hits": 0, "misses": 5, "encoded": 5}
    (tree / "notes.md").write_text("# Windows\nHow to count windows of a house.\n")
    report, counters, _ = engine.index(f"file://{tree}", name="c")
    assert (report.upserted, report.unchanged, report.deleted) == (0, 4, 1) or report.deleted == 1
    assert engine.collection("c").dim() == 64 and engine.collection("c").count() == 4
    assert collection.report_text(report).startswith("4 chunks")
    hits = engine.search("c", ["count windows", "open the door"], k=2).orderBy("qid", "rank").collect()
    assert len(hits) == 4 and hits[0].symbol_name in ("count_windows", "Windows") and hits[2].symbol_name == "open_wide"
    only = engine.search("c", ["count windows"], k=3, language="markdown", rerank=retrieval.overlap_score).collect()
    assert {r.file_path for r in only} == {"notes.md"}
    with pytest.raises(ValueError):
        engine.search("c", [" "])
    answer = engine.ask("c", ["open the door"], k=2).first()
    assert answer.ok and not answer.abstained and len(answer.grounded) == 2 and not answer.drifted
    made = engine.ask("c", ["open the door"], llm=lambda system, prompt: " see src/door.py:1-2 and lost.py:3-4 ", k=2).first()
    assert (made.drifted, made.invented, made.ok) == (["src/door.py:1-2"], ["lost.py:3-4"], False)
    gold = {"queries": [{"id": "q1", "query": "open the door wide", "kind": "x", "gold": [{"file": "src/door.py", "symbol": "Door.open_wide", "grade": 2}]}, {"id": "q2", "query": "zebra", "kind": "none", "gold": []}]}
    (tmp_path / "gold.json").write_text(json.dumps(gold))
    row = engine.evaluate("c", f"file://{tmp_path}/gold.json").first()
    assert row.hit_1 == 1.0 and row.queries == 1 and row.unanswerable == 1
    assert "hit@1=1.000" in reports.summary_text("c", row)


def test_commands(spark, tree, tmp_path, capsys):
    at = ["--root", f"file://{tmp_path}/cli"]
    engine = Engine(spark, f"file://{tmp_path}/cli")
    run = lambda *args: __main__.run(engine, __main__.parser().parse_args([*at, *args]))
    assert "| python | 1 |" in run("load", f"file://{tree}") and "| python | method | 2 |" in run("parse", f"file://{tree}")
    assert "| function | 5 |" in run("chunk", f"file://{tree}")
    assert run("index", f"file://{tree}", "--name", "n").startswith("5 chunks: 5 written")
    assert "src/door.py:8-9" in run("search", "n", "open the door wide", "--k", "2", "--mmr")
    assert "grounded" in run("ask", "n", "open the door", "--language", "python")


def test_collection_pointer_snapshots_and_embedding_once(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(p, h, i, "python", "d") for i, (p, h) in enumerate(x)], "point_id string, content_hash string, position long, language string, directory string")
    seen = spark.sparkContext.accumulator(0)

    def embed(changed):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return changed.mapInArrow(run, changed.schema).withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))

    store = collection.Collection(spark, f"file://{tmp_path}/c")
    assert store.pointer() is None and store.count() == 0
    for n in range(5):
        store.sync(rows(("a", "1"), ("b", str(n))), embed)
    assert seen.value == 2 + 4 and store.dim() == 2 and store.count() == 2
    assert len([n for n in store.names() if n.startswith("snapshot-")]) == 2 and len(store.pointers()) == 2
    with pytest.raises(ValueError):
        store.sync(rows(("a", "9")), lambda c: c.withColumn("vector", F.array(F.lit(1.0))))
    store.drop()
    assert not store.exists()
    hits = collection.as_hits(spark.createDataFrame([("a", None)], "point_id string, text string")).first()
    assert (hits.text, hits.start_line, hits.class_name) == ("", 0, "")


def test_embedding_cache(spark, tmp_path):
    cache = collection.EmbeddingCache(spark, f"file://{tmp_path}/cache")
    vectors = lambda *x: spark.createDataFrame(list(x), "key string, vector array<double>")
    cache.put("m/1", vectors(("a", [0.1, 2.0]), ("b", [1.0, 1.0])), 2)
    cache.put("m/1", vectors(("a", [0.3, 0.0])), 2)
    cache.put("other", vectors(("a", [5.0])))
    assert dict(cache.read("m/1").collect())["a"][0] == pytest.approx(0.3, abs=1e-7) and dict(cache.read("m/1").collect())["a"][0] != 0.3
    assert (cache.count("m/1"), cache.count("other"), cache.count(), cache.count("none")) == (2, 1, 3, 0)
    with pytest.raises(ValueError):
        cache.put("m/1", vectors(("c", [1.0])), 2)
    encode = search.hash_encoder(2)
    texts = spark.createDataFrame([(1, "a", "x y"), (2, "n", "one"), (3, "n", "one"), (4, "k", "two")], "id long, key string, text string")
    got, counters = cache.embed("m/1", texts, encode)
    assert got.count() == 4 and counters == {"hits": 1, "misses": 3, "encoded": 2}
    assert cache.embed("m/1", texts, encode)[1] == {"hits": 4, "misses": 0, "encoded": 0}
    assert cache.embed("m/1", texts, encode, bypass=True)[1] == {"hits": 0, "misses": 4, "encoded": 3} and cache.count("m/1") == 4
    cache.clear("m/1")
    assert (cache.count("m/1"), cache.count()) == (0, 1)
    cache.clear()
    assert cache.count() == 0


def test_models_over_http():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), body))
            if body["model"] == "broken":
                self.send_error(500)
                return
            answer = {"message": {"content": " hi "}} if self.path == "/api/chat" else {"choices": [{"message": {"content": "there"}}]}
            if body["model"] == "odd":
                answer = {}
            data = json.dumps(answer).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert llms.ollama(base, "m")("be brief", "hello") == " hi "
    import os

    os.environ["TARNFOLD_TEST_KEY"] = "secret"
    assert llms.model_of(Config(provider="openai_compatible", llm_url=base, llm_model="m", llm_key_variable="TARNFOLD_TEST_KEY"))("s", "p") == "there"
    assert seen[0][2]["options"] == {"temperature": 0} and seen[1][:2] == ("/chat/completions", "Bearer secret") and seen[1][2]["messages"][0]["role"] == "system"
    for model in ("broken", "odd"):
        with pytest.raises(RuntimeError):
            llms.ollama(base, model)("s", "p")
    with pytest.raises(ValueError):
        llms.ollama("file:///etc", "m")("s", "p")
    server.shutdown()
    with pytest.raises(RuntimeError):
        llms.ollama("http://127.0.0.1:9", "m", 1.0)("s", "p")
    assert llms.model_of(Config()) is None


def test_filters_labels_and_languages(spark):
    points = spark.createDataFrame([(i, "en" if i % 2 else "de", "function", "a" if i < 4 else "a/b") for i in range(8)], "id long, language string, symbol_type string, directory string")
    assert search.metadata(points).count() == 8
    assert [r.id for r in search.metadata(points, language="en", symbol_type="function", directory="a").orderBy("id").collect()] == [1, 3]
    hits = spark.createDataFrame([(1, "f.py", "open", "Door.open"), (1, "f.py", "close", "Door.close"), (1, "g.py", "x", "x"), (2, "f.py", "open", "Door.open")], "qid long, file_path string, symbol_name string, qualified string")
    labels = spark.createDataFrame([(1, "f.py", "Door.open", 2), (1, "f.py", "open", 1), (1, "g.py", None, 1), (3, "f.py", None, 1)], "qid long, file string, symbol string, grade int")
    got = {(r.qid, r.symbol_name): r.grade for r in search.grades(hits, labels).collect()}
    assert got == {(1, "open"): 2, (1, "close"): 0, (1, "x"): 1, (2, "open"): 0}
    assert search.name_index(hits).count() == 5
    lost = spark.createDataFrame([(1, "f.py", "gone", 1), (1, "h.py", None, 1), (1, "f.py", "close", 1)], labels.schema)
    assert sorted(r.file for r in search.unresolved(lost, hits).collect()) == ["f.py", "h.py"]
    first = search.first_language(spark.createDataFrame([(1, 0, "gone"), (1, 1, "b"), (1, 2, "c")], "qid long, position int, file string"), spark.createDataFrame([("b", "de"), ("c", "en")], "file string, language string"))
    assert [tuple(r) for r in first.collect()] == [(1, "de")]
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "en"), (2, [0.9, 0.1], "de"), (3, None, "de")], "id long, vector array<double>, language string")
    asked = spark.createDataFrame([(1, [1.0, 0.0], "de"), (2, [1.0, 0.0], None)], "qid long, vector array<double>, language string")
    found = lambda free: {(r.qid, r.id) for r in retrieval.exact_knn(vectors, asked, 5, "language", free).collect()}
    assert found(False) == {(1, 2)} and found(True) == {(1, 2), (2, 1), (2, 2)}


def test_mmr_cuts_before_reranking(spark):
    points = spark.createDataFrame([(i, t) for i, t in enumerate(["red house", "red house roof", "red house door", "blue sea", "red sea"])], "id long, text string")
    own = points.join(search.hash_encoder(64)(points.select(F.col("id").alias("key"), "text")).withColumnRenamed("key", "id"), "id")
    asked = spark.createDataFrame([(0, "red house")], "qid long, query string")
    by_mmr = {r.id for r in search.search(own, asked, Config(mmr_lambda=0.3), k=2, mmr=True).collect()}
    both = {r.id for r in search.search(own, asked, Config(mmr_lambda=0.3), k=2, mmr=True, rerank=retrieval.overlap_score).collect()}
    assert by_mmr == both and 0 in by_mmr and len(both) == 2


def test_best_lists_break_ties_by_id():
    import numpy as np

    rng = np.random.default_rng(1)
    scores, ids = rng.integers(0, 4, (3, 200)).astype(float), rng.permutation(200)
    best = blocks.Best(3, 7)
    for at in range(0, 200, 33):
        best.add(0, ids[at : at + 33], scores[:, at : at + 33])
    for q in range(3):
        want = sorted(zip(-scores[q], ids, strict=True))[:7]
        assert [(-s, i) for s, i in zip(best.scores[best.query == q], best.ids[best.query == q], strict=True)] == [(float(s), i) for s, i in want]


def test_grep_bm25_and_containment_against_brute_force(spark):
    import math
    import random
    from collections import Counter

    rng = random.Random(2)
    words = ["openDoor", "door", "HTTPServer2", "sea_side", "İstanbul", "x", "rooftop", "roof", "déjà"]
    docs = [(f"d{i:02}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 15)))) for i in range(40)] + [("none", None)]
    asked = [(1, "door server roof roof"), (2, "openDoor"), (3, "zzz a"), (4, "")]
    df, qf = spark.createDataFrame(docs, "id string, text string"), spark.createDataFrame(asked, "qid long, query string")
    terms = lambda t: [x for n in retrieval.IDENTIFIER.findall(t or "") for x in retrieval.names_of(n)]
    tf = {i: Counter(terms(t)) for i, t in docs}
    dl, n = {i: sum(c.values()) for i, c in tf.items()}, len(docs)
    seen = Counter(t for c in tf.values() for t in c)
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in seen.items()}
    idf = {t: r if r >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, r in raw.items()}
    mean = sum(dl.values()) / n
    for name, score in (
        ("grep", lambda q, i, t: (lambda own: sum(x in (t or "").lower() for x in own) / len(own) if own else 0)([x for x in terms(q) if len(x) > 2])),
        ("bm25", lambda q, i, t: sum(idf.get(x, 0) * tf[i][x] * 2.5 / (tf[i][x] + 1.5 * (0.25 + 0.75 * dl[i] / mean)) for x in terms(q) if tf[i][x])),
    ):
        got = {(r.qid, r.id): (r["rank"], round(r.score, 8)) for r in getattr(retrieval, name)(df, qf, 6).collect()}
        want = {}
        for q, query in asked:
            order = sorted(((-round(score(query, i, t), 8), i) for i, t in docs if score(query, i, t) > 1e-12))[:6]
            want |= {(q, i): (r, -s) for r, (s, i) in enumerate(order, 1)}
        assert got == pytest.approx(want) if not got else {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    texts = [(1, "a b c d"), (2, "xa b c dx"), (3, "b  c"), (4, None), (5, "a b")]
    wanted = [(1, "a b c"), (2, "b c"), (3, "b"), (4, ""), (5, "a b c d"), (6, None)]
    pairs = retrieval.contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(wanted, "qid long, query string"))
    assert {tuple(r) for r in pairs.collect()} == {(q, i) for q, s in wanted for i, t in texts if s is not None and t is not None and s in t}


def test_repeated_ids_in_a_list(spark):
    hit = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "qid long, id string, rank int, score double")
    a, b = hit([("x", 1, 0.9), ("y", 2, 0.5), ("x", 3, 0.1)]), hit([("y", 1, 5.0)])
    rows = fusion.weighted(a, b, 0.5, 5).collect()
    assert sorted((r.id, r.score) for r in rows) == [("x", 0.0), ("y", 1.0)]  # the last score of x counts
    both = {r.id: r.score for r in fusion.reciprocal_rank([a, b], 5).collect()}
    assert both["x"] == pytest.approx(1 / 61 + 1 / 63)


def test_checkouts(tmp_path):
    made = []

    def git(*args):
        made.append(args)
        if args[0] == "clone":
            (tmp_path / "probe").mkdir(exist_ok=True)
            __import__("pathlib").Path(args[-1]).mkdir(parents=True)
        return "0123456789abcdef0123"

    url = "https://github.com/some/thing.git"
    first = checkouts.fetch(url, str(tmp_path / "r"), "v1", git)
    assert first.name == "some__thing@0123456789ab" and made[0][:5] == ("clone", "--depth", "1", "--branch", "v1")
    assert checkouts.fetch(url, str(tmp_path / "r"), None, git) == first and [p.name for p in (tmp_path / "r").iterdir()] == [first.name]
    later = tmp_path / "r" / "some__thing@aaaaaaaaaaaa"
    later.mkdir()
    time.sleep(0.02)
    later.touch()
    assert checkouts.newest(str(tmp_path / "r"), url) == later and checkouts.checkouts(str(tmp_path / "r"), url)[0] == first
    with pytest.raises(ValueError):
        checkouts.fetch("ext::sh -c x", str(tmp_path), None, git)
    with pytest.raises(ValueError):
        checkouts.fetch(url, str(tmp_path), "--upload-pack=x", git)
    with pytest.raises(FileNotFoundError):
        checkouts.newest(str(tmp_path / "none"))


def test_reports(spark, tmp_path):
    assert reports.percentiles([3.0, 1.0, 2.0, 4.0]) == {"n": 4, "median": 2.5, "p95": 3.0} and reports.latency(lambda: None, 3)["n"] == 3
    (tmp_path / "x").write_bytes(b"12345")
    assert reports.stored_bytes(spark, f"file://{tmp_path}") == 5
    rows = spark.createDataFrame([("a", 0.5, None)], "n string, x double, y int")
    assert evaluation.markdown(rows) == "| n | x | y |\n| --- | --- | --- |\n| a | 0.500 |  |"
    hits = spark.createDataFrame([("r", 1, 10, 1, 0.5, 2), ("r", 1, 11, 2, 0.25, 0)], "retriever string, qid long, id long, rank int, score double, grade int")
    value = json.loads(evaluation.per_query_json(spark.createDataFrame([("r", 1, 0.5)], "retriever string, qid long, rr double"), hits).first().value)
    assert value["rr"] == 0.5 and [h["id"] for h in value["hits"]] == [10, 11]
    assert "system" not in generation.SYSTEM.lower()[:6] and X.checked_ref("v1.0/x") == "v1.0/x"
    for bad in ("-x", "a b", "", "x" * 300):
        with pytest.raises(ValueError):
            X.checked_ref(bad)


def test_stream_of_snapshots(spark, tmp_path):
    schema = "point_id string, content_hash string, position long, language string, vector array<double>"
    rows = lambda *x: spark.createDataFrame([(p, h, i, "python", [1.0]) for i, (p, h) in enumerate(x)], schema)
    store = collection.Collection(spark, f"file://{tmp_path}/c")
    for batch in (rows(("a", "1"), ("b", "1")), rows(("a", "2"))):
        batch.coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        query = sync.sync_stream(stream, store, lambda c: c, f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert [tuple(r) for r in store.read().select("point_id", "content_hash").collect()] == [("a", "2")]


def test_gold_sets_and_trees_with_links(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.py").write_text("x = 1")
    (tmp_path / "t" / "b.py").symlink_to(tmp_path / "t" / "a.py")
    (tmp_path / "t" / "c.md").write_bytes(b"x" * (512 * 1024))
    (tmp_path / "t" / "d.md").write_bytes(b"x" * (512 * 1024 + 1))
    assert sorted(r.file_path for r in files.load_tree(spark, f"file://{tmp_path}/t").collect()) == ["a.py", "c.md"]


def test_made_vectors_scale_and_experiments(spark):
    from tarnfold.operators import ann

    a = {r.id: r.vector for r in ann.made_vectors(spark, 40, 8).collect()}
    b = {r.id: r.vector for r in ann.made_vectors(spark, 60, 8).repartition(7).collect()}
    assert all(a[i] == b[i] for i in a) and all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in b.values()) and a[0] != a[1]
    rows = reports.ann_scale(spark, (300, 600), 8, 5, 10, 1).collect()
    assert [r.vectors for r in rows] == [300, 600] and all(r.recall >= 0.8 and r.bytes > 0 for r in rows)
    args = __main__.parser().parse_args(["experiments", "/root/testdata/sf0.001", "--only", "strategy_comparison"])
    import os

    if os.path.isdir("/root/testdata/sf0.001"):
        assert "## strategy_comparison" in __main__.run(Engine(spark, "file:///tmp/none"), args)


def test_token_counts_by_a_function(spark):
    from tarnfold.operators import chunking

    rows = spark.createDataFrame([("a b c",), ("",)], "embed_text string")
    assert [r.n_tokens for r in chunking.token_counts(rows, lambda texts: [len(t.split()) for t in texts]).collect()] == [3, 0]
    hits = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 2, 1)], "qid long, id long, rank int")
    counts = spark.createDataFrame([(1, 10), (2, 4)], "id long, n_tokens int")
    assert {r.k: r.mean_tokens for r in chunking.context_cost(hits, counts, (1, 2)).collect()} == {1: 7.0, 2: 9.0}
