"""What travels to the driver, and what a worker keeps, does not grow with the number of searches."""

import itertools

from test_whole import vectors_of

from tarnfold.operators import ann, blocks, retrieval


def test_a_sweep_fetches_sample_and_queries_once(spark, monkeypatch):
    base = vectors_of(spark, 300, 8)
    asked = base.where("id % 20 = 0").withColumnRenamed("id", "qid")
    exact = retrieval.exact_knn(base, asked, 5).localCheckpoint()
    calls = {"sampled": 0, "fetched": 0}
    for name in calls:
        f = getattr(ann, name)
        monkeypatch.setattr(ann, name, lambda *a, f=f, name=name: (calls.__setitem__(name, calls[name] + 1), f(*a))[1])
    monkeypatch.setattr(blocks, "fetched", lambda q: 1 / 0)
    out = ann.sweep(base, asked, exact, 5, (4, 8), (0.5, 1.0)).collect()
    assert calls == {"sampled": 1, "fetched": 1} and [r.recall for r in out if r.lists == r.probes] == [1.0, 1.0]


def test_names_of_one_part_are_cut_as_by_the_regex():
    for n in range(1, 6):
        for x in map("".join, itertools.product("aZ_1b", repeat=n)):
            parts = [y.lower() for y in retrieval.PART.findall(x)]
            assert retrieval.names_of(x) == ([*parts, "".join(parts)] if len(parts) > 1 else parts)


def test_term_counts_do_not_depend_on_how_many_terms_are_kept(spark, monkeypatch):
    docs = spark.createDataFrame([(f"a{i} b c{i % 3}",) for i in range(50)], "text string").coalesce(1)
    count = lambda: sorted(map(tuple, retrieval.term_stats(docs).collect()))
    want = count()
    monkeypatch.setattr(retrieval, "TERMS_KEPT", 3)
    monkeypatch.setattr(retrieval, "NAMES_KEPT", 2)
    assert count() == want
