"""BPE encoding and decoding by a trie of words with last-token states.

For any sequence of symbols BPE's result is the one sequence of tokens in which every two
neighbours stay apart when only they are encoded. So the encoding of a prefix ends in one
last token, and what comes before it is the encoding of a shorter prefix. The distinct new words
of a batch form a trie (its depth-first order is their sorted order, its path a stack): each
node finds its last token from those of the nodes above it, once for all words that share
the prefix. The end of a word is a symbol of its own (its last byte plus 256).

The tokens that end a prefix come from a second trie, of the vocabulary, with links to the longest
suffix (an automaton whose state is a part of the path). Two tokens stay apart if no pair of
tokens on their touching edges merges before one of the two is merged within its own token.
Decoding looks the ids up again: it does not know the words they came from.

Memory is bounded by a batch of at most TEXTS texts (one text is never cut, so a very long one takes
a multiple of its own size) and by CHUNKS_KEPT, PAIRS_KEPT and STEPS_KEPT answers a worker.

Edge cases: a null text is empty and gives no ids; special tokens written in a text become
their ids, as the tokenizers library does; repeated rows and null doc_ids are encoded like
others; texts of any length are encoded whole; other columns of the input play no part, whatever
their names (of the columns asked for one with a result's name gives way to it).
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CHUNKS_KEPT, PAIRS_KEPT, STEPS_KEPT = 80_000, 120_000, 120_000
#: Texts encoded together.
TEXTS = 200
END = "</w>"
NAME = "word_bpe_49k.json"
NEVER = 1 << 60
#: Python's str.split() takes these for white space, Unicode does not.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself if it is a visible Latin-1 character, else the next from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(visible))
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


class Merges:
    """How each token is made: its last merge, and which tokens stay apart."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], symbols: dict[int, tuple[int, ...]]):
        n = max(vocab.values()) + 1
        self.pairs: dict[int, int] = {}
        for rank, (x, y) in enumerate(merges):
            self.pairs.setdefault(vocab[x] << 20 | vocab[y], rank)
        self.left, self.right = [0] * n, [0] * n
        self.made = [-2] * n  # rank of the last merge; -1 a single symbol, -2 not reached by merging
        for token, s in symbols.items():
            if len(s) == 1:
                self.made[token] = -1
        for rank, (x, y) in enumerate(merges):
            a, b, z = vocab[x], vocab[y], vocab[x + y]
            if self.made[z] == -2 and self.made[a] > -2 and self.made[b] > -2 and self.apart(a, b, rank):
                if rank < self.made[a] or rank < self.made[b]:
                    raise ValueError(f"merge {rank} comes before its parts")
                self.left[z], self.right[z], self.made[z] = a, b, rank

    def apart(self, a: int, b: int, until: int = NEVER) -> bool:
        """Whether nothing merges across the edge between a and b, before the rank `until`.

        Undoes the later of the two tokens' last merges and looks at the pair on the edge, down to symbols. Of equal
        merges the left one comes first.
        """
        pairs, made, left, right = self.pairs, self.made, self.left, self.right
        ends_a = ends_b = until
        while True:
            rank = pairs.get(a << 20 | b)
            if rank is not None and rank < ends_a and rank <= ends_b:
                return False
            rank_a, rank_b = made[a], made[b]
            if rank_a > rank_b:
                a, ends_a = right[a], rank_a
            elif rank_b >= 0:
                b, ends_b = left[b], rank_b
            else:
                return True


class Suffixes:
    """An automaton over symbols: each state knows all tokens that end there, longest first."""

    def __init__(self, symbols: dict[int, tuple[int, ...]]):
        self.edges: dict[int, int] = {}
        self.steps: dict[int, int] = {}
        depth, ends, came = [0], [-1], [(0, 0)]
        for token, s in symbols.items():
            node = 0
            for x in s:
                key = node << 9 | x
                node = self.edges.get(key, -1)
                if node < 0:
                    node = self.edges[key] = len(depth)
                    depth.append(depth[key >> 9] + 1)
                    ends.append(-1)
                    came.append((key >> 9, x))
            ends[node] = token
        self.link = [0] * len(depth)
        self.tokens: list[tuple[tuple[int, int], ...]] = [()] * len(depth)
        for node in sorted(range(1, len(depth)), key=depth.__getitem__):
            above, x = came[node]
            self.link[node] = to = self.step(self.link[above], x) if above else 0
            self.tokens[node] = ((ends[node], depth[node]), *self.tokens[to]) if ends[node] >= 0 else self.tokens[to]
        self.steps.clear()

    def step(self, node: int, x: int) -> int:
        """The state after one more symbol."""
        start, edges = node << 9 | x, self.edges
        while (to := edges.get(node << 9 | x)) is None and node:
            node = self.link[node]
        if len(self.steps) >= STEPS_KEPT:
            self.steps.clear()
        to = self.steps[start] = to or 0
        return to


class Trie:
    """Encodes texts as token ids and decodes ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in (vocab | self.special).items():
            self.names[i] = t
        of = {s: b for b, s in byte_symbols().items()}
        spelled = {i: self.spelling(t, of) for t, i in vocab.items() if t not in self.special}
        self.merges = Merges(vocab, merges, spelled)
        self.suffixes = Suffixes({i: s for i, s in spelled.items() if self.merges.made[i] > -2})
        self.length = [len(spelled.get(i, ())) for i in range(len(self.names))]
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.blanks = regex.compile(r"\s+")
        self.specials = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.apart: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def spelling(token: str, of: dict[str, int]) -> tuple[int, ...]:
        """A token as bytes, 256 more for the last one of a word."""
        if token.endswith(END) and len(token) > len(END):
            body = [of[c] for c in token[: -len(END)]]
            return (*body[:-1], body[-1] + 256)
        return tuple(of[c] for c in token)

    def fits(self, key: int) -> bool:
        """Whether the two tokens of the key stay apart; answers are kept."""
        if len(self.apart) >= PAIRS_KEPT:
            self.apart.clear()
        found = self.apart[key] = self.merges.apart(key >> 20, key & 0xFFFFF)
        return found

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """words -> ids as little-endian 32-bit bytes. The sorted words are the depth-first walk of their trie."""
        out: dict[bytes, bytes] = {}
        states, path, before = [0], [-1], b""  # of the first i bytes on the way here: the state, the last token
        steps, step, ending, length = self.suffixes.steps, self.suffixes.step, self.suffixes.tokens, self.length
        apart, fits = self.apart, self.fits
        for word in sorted(words):
            n = len(word)
            same, most = 0, min(len(before), n) - 1
            while same < most and before[same] == word[same]:
                same += 1
            del states[same + 1 :], path[same + 1 :]
            node, symbols = states[same], [*word[same:-1], word[-1] + 256]  # the last byte is a symbol of its own
            for at, x in enumerate(symbols, same + 1):
                to = steps.get(node << 9 | x)
                node = step(node, x) if to is None else to
                for token, size in ending[node]:  # noqa: B007
                    if size == at:
                        break
                    key = path[at - size] << 20 | token
                    ok = apart.get(key)
                    if ok or (ok is None and fits(key)):
                        break
                else:
                    raise ValueError("a symbol is missing in the vocabulary")
                states.append(node)
                path.append(token)
            tokens, left = [token], n - size
            while left:
                token = path[left]
                tokens.append(token)
                left -= length[token]
            states.pop()
            path.pop()
            out[word] = array("I", tokens[::-1]).tobytes()
            before = word
        return out

    def normalised(self, text: str) -> str:
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def chunks(self, text: str) -> list[str]:
        """The normalised text between white space; words never cross it."""
        text = self.normalised(text)
        return self.blanks.split(text) if any(x in text for x in SEPARATORS) else text.split()

    def learn(self, chunks: set[str]) -> None:
        """Adds the ids of chunks to the known ones; two generations are kept. A word is a chunk too: of itself alone."""
        if len(self.known) >= CHUNKS_KEPT:
            self.older, self.known = self.known, {}
        known, older, findall = self.known, self.older, self.pieces.findall
        cut, new = {}, {}
        for c in chunks:
            if c in known:
                continue
            found = older.get(c)
            if found is not None:
                known[c] = found
            elif c.isalpha():
                new[c] = c.encode()
            else:
                cut[c] = findall(c)
        for words in cut.values():
            new.update((w, w.encode()) for w in words if w not in known and w not in new)
        ids = self.encode_words(list(new.values()))
        for w, raw in new.items():
            known[w] = ids[raw]
        for c, words in cut.items():
            known[c] = b"".join([known[w] for w in words])

    def segments(self, text: str):
        """Parts of the text between special tokens as lists of chunks; special tokens as ids."""
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            yield self.chunks(text[at : m.start()])
            yield self.special[m[0]].to_bytes(4, "little")
            at = m.end()
        yield self.chunks(text[at:] if at else text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit bytes."""
        cut = [list(self.segments(x)) for x in texts]
        self.learn({c for parts in cut for part in parts if isinstance(part, list) for c in part})
        known = self.known
        return [b"".join([part if isinstance(part, bytes) else b"".join([known[c] for c in part]) for part in parts]) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """The names of the tokens with blanks between them: this vocabulary has no decoder of its own."""
        names = self.names
        return " ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])


def trie(path: str) -> Trie:
    """One for each worker and file, until the worker runs another operator."""
    tries = common.kept_for("bpe")
    if path not in tries:
        tries[path] = Trie(path)
        common.released()  # building takes more than is kept
    return tries[path]


def encode(docs: DataFrame, path: str, keep: list[str], full: bool = False) -> DataFrame:
    """The columns in `keep` with n_tokens, ids_sha256, decoded_sha256 and, if full, ids (array<int>)."""
    common.ship(docs.sparkSession)
    keep = [c for c in keep if c not in ("n_tokens", "ids_sha256", "decoded_sha256", "ids")]
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    schema = schema.add("ids", T.ArrayType(T.IntegerType())) if full else schema

    def coded(batches):
        t = trie(path)
        for part in common.slices(batches, TEXTS):
            raws = t.encode_batch([x or "" for x in part.column(part.num_columns - 1).to_pylist()])
            columns = [
                pa.array([len(raw) // 4 for raw in raws], pa.int64()),
                pa.array([hashlib.sha256(raw).hexdigest() for raw in raws], pa.string()),
                pa.array([hashlib.sha256(t.decode(raw).encode()).hexdigest() for raw in raws], pa.string()),
            ]
            if full:
                columns.append(pa.array([np.frombuffer(raw, "<u4").astype("i4") for raw in raws], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in range(part.num_columns - 1)] + columns, names=schema.names)

    return docs.select(*keep, F.col("text")).toDF(*(f"c{i}" for i in range(len(keep) + 1))).mapInArrow(common.lean(coded), schema)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(NAME)


def op4_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(sf_dir, "documents", spark), vocabulary(), ["doc_id"])
