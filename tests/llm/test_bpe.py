"""BPE against the tokenizers library, over texts and over a whole table."""

import hashlib
import os
import random
import struct

import pytest

from tarnfold.llm import bpe

DATA = "/root/testdata/sf0.01"
TEXTS = [
    "", "It's <|endoftext|> THE end", "ΑΣ ΣΑΣ İ ñandú über-groß 12³", "a\x1cb\xa0c \x1dd", "😀👍🏽 日本語", "x" * 300, "<|endoftext|", "The and attion thanedble anea",
    "don't 've''s !!'s x</w>y", "ab" * 30_000 + " " + "!" * 2_000, "<|startoftext|><|endoftext|> ", "½ Ⅷ ² ǅ́ é", "aaaa aaaaa aaa aaaaaaa",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


def wanted(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    raw = struct.pack(f"<{len(ids)}I", *ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_ids_and_decoded_texts_equal_the_library(library):
    own = bpe.Trie(bpe.vocabulary())
    for text, ids in zip(TEXTS, own.encode_batch(TEXTS), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want and own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_answers_do_not_depend_on_what_is_kept(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdeionrst") for _ in range(rng.randrange(1, 14))) for _ in range(30)) for _ in range(40)]
    at_once = bpe.Trie(bpe.vocabulary()).encode_batch(texts)
    for name in ("CHUNKS_KEPT", "PAIRS_KEPT", "STEPS_KEPT"):
        monkeypatch.setattr(bpe, name, 7)
    few = bpe.Trie(bpe.vocabulary())
    assert [few.encode_batch([t])[0] for t in texts] == at_once


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_whole_table_equals_the_library(spark, library):
    texts = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    got = bpe.op4_trie_bpe(spark, DATA).collect()
    assert len(got) == len(texts)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == wanted(library, texts[r.doc_id]) for r in got)


def test_odd_rows_and_clashing_names(spark, library):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, None, None, None), (0, None, "x", 1), (0, None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, c0 int")
    got = bpe.encode(docs, bpe.vocabulary(), ["doc_id", "c0", "_text"], full=True).collect()
    want = sorted((wanted(library, t)[0], wanted(library, t)[1], x or "") for _, t, x, _ in rows)
    assert sorted((r.n_tokens, r.ids_sha256, r._text or "") for r in got) == want and all(len(r.ids) == r.n_tokens for r in got)
    assert bpe.encode(docs.limit(0), bpe.vocabulary(), ["doc_id"]).count() == 0
