"""64-bit hashes of the words of many texts at once, in numpy, with no loop over words.

A word is a run of bytes other than ASCII white space, A-Z lower-cased. Its hash is a
polynomial of random values of its bytes modulo 2^64, taken from differences of one running
sum, and then mixed. Equal words have equal hashes in every process.
"""

from __future__ import annotations

import numpy as np

#: Bytes worked on at once; a longer text is cut between words.
CHUNK = 1 << 20
_RNG = np.random.default_rng(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Also ASCII marks end a word here.
_MARKS = _SPACE.copy()
_MARKS[[b for b in range(128) if not chr(b).isalnum()]] = True
_P = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, pow(_P, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _hashes(data: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of data, which must begin and end between words."""
    solid = ~between[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def _pieces(data: np.ndarray):
    """Cuts of one long text, each between words (or the rest, if it has no white space)."""
    at = 0
    while len(data) - at > 2 * CHUNK:
        gap = np.flatnonzero(_SPACE[data[at + CHUNK : at + 2 * CHUNK]])
        if not len(gap):
            break
        yield data[at : (at := at + CHUNK + int(gap[0]))]
    yield data[at:]


def batches(texts, letters_only: bool = False):
    """texts: bytes each -> for packs of about CHUNK bytes: word hashes, and where each text's begin (and the last ends).

    letters_only: words are runs of bytes other than ASCII white space and marks.
    """
    pack, size = [], 0
    between = _MARKS if letters_only else _SPACE

    def done():
        data = np.frombuffer(b"\n".join(pack) + b"\n", np.uint8)
        first = np.cumsum([0, *(len(x) + 1 for x in pack)])
        h, starts = _hashes(data, between)
        return h, np.searchsorted(starts, first)

    for x in texts:
        if len(x) > CHUNK:
            if pack:
                yield done()
                pack, size = [], 0
            h = np.concatenate([_hashes(p, between)[0] for p in _pieces(np.frombuffer(x, np.uint8))])
            yield h, np.array([0, len(h)])
            continue
        if size + len(x) > CHUNK:
            yield done()
            pack, size = [], 0
        pack.append(x)
        size += len(x) + 1
    if pack:
        yield done()


def shingles(h: np.ndarray, first: np.ndarray, words: int):
    """Each text's sorted distinct shingle hashes, and then its number of words; short texts are one shingle."""
    n = len(h) - words + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for j in range(words):
        if n > 0:
            grams = mix(grams + h[j : n + j] * np.uint64(2 * j + 3))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1]), b - a
        elif b > a:
            s = np.zeros(1, np.uint64)
            for j in range(a, b):
                s = mix(s + h[j : j + 1] * np.uint64(2 * (j - a) + 3))
            yield mix(s + np.uint64(b - a)), b - a
        else:
            yield np.zeros(0, np.uint64), 0
