"""Nothing is cut: headers, languages and documents beyond the old limits."""

import io
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pyspark.sql import functions as F

import corpus_pipeline
from tarnfold.llm import divergence, ppm, toxicity, warc


def test_warc_keeps_pages_with_long_urls(spark):
    url = "data:" + "x" * 200_000
    pages = spark.createDataFrame([(1, url, "a"), (2, url, "a"), (3, "u", "b")], "page_id long, url string, html string")
    manifest = warc.write_archives(warc.with_leaders(pages), warc.common.new_path(spark, "test-warc"))
    got = {(r.page_id, r.record_type, r.refers_to, r.gap) for r in warc.read_archives(manifest).collect()}
    assert got == {(1, "revisit", 2, None), (2, "response", None, None), (3, "response", None, None)}
    for n in (200_000, warc.WINDOW - 100, 3 * warc.WINDOW):
        data = b"".join(warc.record(i, "x" * n, b"a") for i in range(3))
        found = list(warc.Archive(io.BytesIO(data), len(data)).salvaged())
        assert [len(h["warc-target-uri"]) for _, _, h, _, _ in found] == [n] * 3


def test_every_language_is_learned(spark, monkeypatch):
    rng = random.Random(7)
    vocab = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(12)] for i in range(70)}
    rows = [(i, " ".join(rng.choices(vocab[k], k=20)), k) for i, k in enumerate(k for k in vocab for _ in range(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = lambda: {r.doc_id: (r.lang, r.lang_pred, round(r.score, 6), round(r.bits_per_byte, 4)) for r in ppm.identify(docs, ppm.fit(docs), ["doc_id", "lang"]).collect()}
    in_blocks = found()
    assert all(x[0] == x[1] for x in in_blocks.values()) and len(in_blocks) == len(rows)
    monkeypatch.setattr(ppm, "LANGS_AT_ONCE", 100)
    assert found() == in_blocks


def test_languages_of_long_documents_are_learned(spark, monkeypatch):
    monkeypatch.setattr(ppm, "MOST_BYTES", 300)
    long = [(i, "vesi talo " * 60, "fi") for i in range(9)]
    mixed = [(i, "das haus " * (60 if i < 40 else 9), "de") for i in range(20, 50)]
    docs = spark.createDataFrame([*long, *mixed, (60, None, "en"), (61, "the house " * 9, "en")], "doc_id long, text string, lang string")
    got = ppm.identify(docs.where("text is not null"), ppm.fit(docs, 3), ["lang"]).collect()
    assert len(got) == 40 and all(r.lang == r.lang_pred for r in got)


def test_languages_without_fixed_words_are_judged_by_their_own(spark, monkeypatch):
    rng = random.Random(8)
    words = {k: ["".join(rng.choice(a) for _ in range(rng.randrange(2, 8))) for _ in range(40)] for k, a in (("fi", "aeiklnostu"), ("ru", "абвгдежиклмнопрст"))}
    weights = [1 / (i + 1) for i in range(40)]
    rows = [(i, " ".join(rng.choices(words[k], weights, k=150)), k) for i, k in enumerate(["fi", "ru"] * 30)]
    # rare words only: the characters are right, the common words are not
    rows.append((100, " ".join(rng.choices(words["fi"][20:], k=150)), "fi"))
    nulls = [(200 + i, t, None) for i, t, _ in rows[:20]]
    docs = spark.createDataFrame(rows + nulls, "doc_id long, text string, lang string")
    kept = sorted(r.doc_id for r in divergence.keep_good(docs).collect())
    assert kept == [*range(60), *range(200, 220)]
    monkeypatch.setattr(divergence, "BROADCAST_REFERENCES", 0)
    assert sorted(r.doc_id for r in divergence.keep_good(docs).collect()) == kept


def test_toxicity_learns_from_labels_with_long_documents(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(toxicity, "MOST_BYTES", 300)
    monkeypatch.setattr(toxicity, "PER_LABEL", 30)
    words = ["house", "water", "thing", "stone", "road"]
    # all toxic documents are long; most of the others too, so that the first by hash are
    rows = [(i, " ".join(rng.choices(words, k=80 if i % 3 else 20)) + (" idiot" * 60 if i % 4 == 0 else ""), "en") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")), 20)
    assert net is not None
    got = toxicity.scored(docs, net, ["doc_id"]).collect()
    assert sum((r.score >= toxicity.CUT) == (r.doc_id % 4 == 0) for r in got) >= 228


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(toxicity, "PER_LABEL", 10)
    monkeypatch.setattr(toxicity, "MOST_BYTES", 400)
    monkeypatch.setattr(toxicity, "PART_ROWS", 150)
    words, bad = [f"word{i}" for i in range(30)], [f"bad{i}" for i in range(25)]
    # 25 words mark a toxic row, and rows over MOST_BYTES have five that no other row has: a start on 10 rows a label knows few of them
    rows = []
    for i in range(1200):
        own = bad[:20] if i % 5 else bad[20:]
        rows.append((i, " ".join(rng.choices(words, k=20 if i % 5 else 90) + ([rng.choice(own)] * 2 if i % 4 < 2 else [])), "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 < 2).cast("int").alias("toxic"))
    got = [{r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(d, labels, 20), ["doc_id"]).collect()} for d in (docs, docs.repartition(7))]
    assert sum((s >= toxicity.CUT) == (i % 4 < 2) for i, s in got[0].items()) >= 1140
    # tasks and their order do not matter
    assert got[0] == pytest.approx(got[1], abs=1e-6)
    stored = toxicity.labelled(docs, labels)
    assert stored.count() == len(rows) and stored.select("part").distinct().count() == 8
    found = set(toxicity.vocabulary(stored).tolist())
    texts = [t.encode() for _, t, _ in rows]
    seen = Counter(b for x in toxicity.buckets(texts) for b in set(x.tolist()))
    assert found == {b for b, n in seen.items() if n >= toxicity.LEAST_TEXTS}
    number = toxicity.Net.of(toxicity.vocabulary(stored)).rows
    each = Counter(r for x in toxicity.buckets(texts, number) for r in toxicity.lang_rows(x).tolist())
    assert {i: int(n) for i, n in enumerate(toxicity.language_words(stored, number)["en"]) if n} == dict(each)


def test_toxicity_passes_are_means_over_parts_and_rows_are_tallied(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choices(["house", "water", "stone", "road", "bad"], k=12)), "en") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity, "PART_ROWS", 30)
        stored = toxicity.labelled(docs, docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")))
    net, plain = (toxicity.Net.of(toxicity.vocabulary(stored)) for _ in range(2))
    toxicity.passed(stored, net, 1, (0.75, 1.5), 2)
    parts = {}
    for r in sorted(stored.where("fold != 1").collect(), key=lambda r: (r.part, r.key)):
        parts.setdefault(r.part, []).append(r)
    copies = []
    for part, own in parts.items():
        copies.append(plain.copy())
        drop = np.random.default_rng((2, part))
        for r in own:
            copies[-1].learn(toxicity.dropped(toxicity.padded(plain.rows[np.frombuffer(r.ids, np.int32)]), drop), r.toxic, (0.75, 1.5)[r.toxic])
    assert len(parts) == 3 and net.state() == pytest.approx(np.mean([c.state() for c in copies], 0), abs=1e-4)
    for i in range(len(net.emb)):
        changed = [c.emb[i] for c in copies if (c.emb[i] != plain.emb[i]).any()]
        assert net.emb[i] == pytest.approx(np.mean(changed, 0) if changed else plain.emb[i], abs=1e-4)
    net.learn_languages({"en": np.ones(toxicity.LANG_ROWS)})
    tally = toxicity.tallied(stored, net)
    n0, n1 = (sum(tally.column(c).to_pylist()) for c in ("n0", "n1"))
    assert (n0, n1) == (60, 30)
    z = net.logits([toxicity.padded(net.rows[np.frombuffer(r.ids, np.int32)]) for r in stored.collect()])
    want = Counter(np.rint(z * toxicity.STEPS).astype(int).tolist())
    got = {k: a + b for k, a, b in zip(*(tally.column(c).to_pylist() for c in ("z", "n0", "n1")), strict=True)}
    assert sum(abs(k) * n for k, n in got.items()) == pytest.approx(sum(abs(k) * n for k, n in want.items()), abs=90)


def test_toxicity_forward_in_pieces(monkeypatch):
    net = toxicity.Net.of(np.arange(50))
    ids = toxicity.padded(np.random.default_rng(1).integers(0, 51, 100).astype(np.int32))
    whole = net.forward(ids)
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 7)
    parts = net.forward(ids)
    assert parts[1] == pytest.approx(whole[1], abs=1e-6) and all((a == b).all() for a, b in zip(parts[2], whole[2], strict=True))


def test_near_duplicates_by_row(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(1, a), (None, a + " end"), (None, b), (None, b), (None, b + " end"), (5, a + " more"), (5, c), (7, c), (7, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(x for x in got if x[0] is not None) == [(1, a), (5, c)]
    assert len(got) == 3 and [t[:2] for i, t in got if i is None] == ["b0"]
    plain = spark.createDataFrame([(1, a), (2, a + " end"), (3, b)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, plain, "").collect()) == [1, 3]
