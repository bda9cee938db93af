"""What a Python worker that is used again keeps of the stages before: tables of one operator only."""

import gc
from types import SimpleNamespace

import pyarrow as pa
import pytest

from tarnfold.llm import bpe, jaccard_join, ppm

TEXT = "the stone house by the water is old and it was built for the people of that town"


def tries():
    gc.collect()
    return sum(isinstance(x, bpe.Trie) for x in gc.get_objects())


@pytest.fixture
def here(spark, monkeypatch):
    """Runs a stage's function over a batch in this process, as a worker that has run others before."""
    seen = []
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: seen.append(run) or self)

    def run(stage, batch):
        stage(docs)
        return [r for x in seen.pop()([batch]) for r in x.to_pylist()]

    return run


def test_a_worker_keeps_the_tables_of_one_operator_only(spark, here):
    def encoded():
        batch = pa.record_batch({"c0": pa.array([1], pa.int64()), "c1": [TEXT]})
        return here(lambda d: bpe.encode(d, bpe.vocabulary(), ["doc_id"]), batch)

    def language():
        model = SimpleNamespace(value=ppm.Model({"en": [TEXT.encode()]}))
        batch = pa.record_batch({"row": [{"doc_id": 1, "text": TEXT}], "best": pa.array([None], pa.null())})
        return here(lambda d: ppm.identified(d, [model]), batch)

    def sets():
        return here(lambda d: jaccard_join.described(d, 5), pa.record_batch({"doc_id": pa.array([1], pa.int64()), "text": [TEXT]}))

    before = tries()
    first = encoded()
    assert first[0]["n_tokens"] and encoded() == first
    assert tries() <= before + 1  # kept from batch to batch
    assert language()[0]["lang_pred"] == "en"
    assert tries() == 0
    assert encoded() == first and tries() == 1
    assert sets()[0]["n"] == len(TEXT.split()) - 4
    assert tries() == 0
