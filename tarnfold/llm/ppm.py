"""Language ID by prediction by partial matching over bytes.

Each language has counts of symbols after contexts of 0 to ORDER bytes. A symbol seen c
times in a context of n symbols, q of them distinct, costs -log2(c / (n + q)) bits; an
unseen one costs the escape, -log2(q / (n + q)), and then what it costs in the context one
byte shorter; an unseen context costs nothing itself; below order 0 each byte costs 8 bits.
Counts are frozen after fitting, so the full cost of every (context, symbol) that any
language has seen is worked out once, for all languages, and scoring is a table lookup a
byte. The text goes to the language with the shortest code.

The fit learns every lang value, from PER_LANG documents each at most, chosen by a hash of
doc_id among those of at most MOST_BYTES, LANG_BYTES in all; a language with fewer than
LONG_PER_LANG of these takes the shortest of its longer ones, LONG_PER_LANG in all. Languages are
learned and scored in blocks of LANGS_AT_ONCE: a text goes through the blocks one after another.

Edge cases: a null text, or one without a letter, is `und` with score 0; ties go to the
first language by name; with nothing to learn from all is `und`; null doc_ids and repeated
rows are scored like others; texts of any length are scored whole, in pieces that know the bytes
before them; other columns of the input play no part, whatever their names (of the columns asked
for one with a result's name gives way to it).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

ORDER = 4
PER_LANG, LONG_PER_LANG, LANGS_AT_ONCE, MOST_BYTES, LANG_BYTES = 250, 5, 64, 50_000, 1_000_000
#: Bytes times languages worked on at once.
CELLS = 1_000_000
LETTER = re.compile(r"[^\W\d_]")


class Table:
    """Maps 64-bit keys to their index: one probe, and a sorted list for keys that lost theirs."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, 2**64 - 1, np.uint64)
        self.index = np.zeros(1 << bits, np.int32)
        at = self.slot(keys)
        self.keys[at] = keys
        self.index[at] = np.arange(len(keys), dtype=np.int32)
        lost = np.flatnonzero(self.keys[at] != keys)
        self.lost, self.lost_index = keys[lost], lost.astype(np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Indices; -1 for keys that it does not have."""
        at = self.slot(keys)
        out = np.where(self.keys[at] == keys, self.index[at], np.int32(-1))
        if len(self.lost):
            miss = np.flatnonzero(out < 0)
            near = np.minimum(np.searchsorted(self.lost, keys[miss]), len(self.lost) - 1)
            found = self.lost[near] == keys[miss]
            out[miss[found]] = self.lost_index[near[found]]
        return out


def grams_of(data: np.ndarray, order: int) -> np.ndarray:
    """Key of each byte and the `order` before it; data begins with ORDER bytes of 0."""
    n = len(data) - ORDER
    out = np.zeros(n, np.uint64)
    for j in range(ORDER - order, ORDER + 1):
        out = (out << np.uint64(8)) | data[j : n + j].astype(np.uint64)
    return out


class Model:
    def __init__(self, texts: dict[str, list[bytes]]):
        self.langs = sorted(k for k, v in texts.items() if any(v))
        if not self.langs:
            return
        n_langs = len(self.langs)
        data = {k: [np.concatenate((np.zeros(ORDER, np.uint8), np.frombuffer(x, np.uint8))) for x in v] for k, v in texts.items()}
        low_keys, low_cost = np.zeros(0, np.uint64), np.full((1, n_langs), 8.0, np.float32)
        self.cost, self.table, self.escape, self.contexts = [], [], [], []
        for order in range(ORDER + 1):
            seen = [np.unique(np.concatenate([grams_of(x, order) for x in data[k]] or [low_keys[:0]]), return_counts=True) for k in self.langs]
            keys = np.unique(np.concatenate([k for k, _ in seen]))
            below = low_cost[np.searchsorted(low_keys, keys & np.uint64((1 << 8 * order) - 1))] if order else np.repeat(low_cost, len(keys), 0)
            contexts = np.unique(keys >> np.uint64(8))
            cost, escape = np.empty((len(keys), n_langs), np.float32), np.zeros((len(contexts), n_langs), np.float32)
            of = np.searchsorted(contexts, keys >> np.uint64(8))
            for i, (own, counts) in enumerate(seen):
                c = np.zeros(len(keys))
                c[np.searchsorted(keys, own)] = counts
                n, q = np.bincount(of, c, len(contexts)), np.bincount(of, c > 0, len(contexts))
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape[:, i] = np.where(n > 0, -np.log2(q / (n + q)), 0)
                    cost[:, i] = np.where(c > 0, -np.log2(c / (n + q)[of]), escape[of, i] + below[:, i])
            self.cost.append(cost)
            self.table.append(Table(keys))
            self.escape.append(escape)
            self.contexts.append(Table(contexts))
            low_keys, low_cost = keys, cost

    def costs(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte after the first ORDER, for each language."""
        keys = grams_of(data, ORDER)
        at = self.table[ORDER].find(keys)
        out = self.cost[ORDER][at]
        todo = np.flatnonzero(at < 0)
        rest, bits = keys[todo], np.zeros((len(todo), len(self.langs)), np.float32)
        for order in range(ORDER, -1, -1):
            if not len(todo):
                break
            context = self.contexts[order].find(rest >> np.uint64(8))
            bits += np.where((context >= 0)[:, None], self.escape[order][context], np.float32(0))
            if not order:
                out[todo] = bits + np.float32(8)
                break
            rest = rest & np.uint64((1 << 8 * order) - 1)
            at = self.table[order - 1].find(rest)
            known = at >= 0
            out[todo[known]] = bits[known] + self.cost[order - 1][at[known]]
            todo, rest, bits = todo[~known], rest[~known], bits[~known]
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        most = max(1024, CELLS // max(1, len(self.langs)))
        total = np.zeros((len(texts), len(self.langs)))
        pad, pack, own = b"\0" * ORDER, [], []

        def flush():
            if pack:
                sizes = np.array([len(x) for x in pack])
                c = self.costs(np.frombuffer(b"".join(pack), np.uint8))
                firsts = np.cumsum([0, *sizes[:-1]])
                edges = np.stack((firsts, firsts + sizes - ORDER), 1).ravel()
                c = np.concatenate((c, np.zeros((1, c.shape[1]), np.float32)))
                np.add.at(total, own, np.add.reduceat(c, edges, 0, np.float64)[::2])
                pack.clear()
                own.clear()

        size = 0
        for i, x in enumerate(texts):
            for a in range(0, len(x), most):
                piece = (pad if not a else x[a - ORDER : a]) + x[a : a + most]
                if size + len(piece) > most + ORDER:
                    flush()
                    size = 0
                pack.append(piece)
                own.append(i)
                size += len(piece)
        flush()
        return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in LETTER.finditer(text))


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> list[Broadcast]:
    """docs (doc_id, text, lang) -> a broadcast model for each block of languages; only rows with a lang are learned from."""
    spark = docs.sparkSession
    size = F.octet_length("text")
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (size > 0)).select("doc_id", "lang", size.alias("size"))
    long = F.col("size") > MOST_BYTES
    # short ones by hash, then long ones by size
    order = [long, F.when(long, F.col("size")), F.xxhash64("doc_id"), F.col("doc_id")]
    placed = labelled.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= per_lang)
    within = F.sum("size").over(Window.partitionBy("lang").orderBy("place")) <= LANG_BYTES
    chosen = common.stored(placed.withColumn("within", within).where((~long & F.col("within")) | (F.col("place") <= LONG_PER_LANG)).select("lang", "doc_id", "size"), "op10-chosen")
    names = [r[0] for r in chosen.select("lang").distinct().orderBy("lang").collect()]
    near = common.small(chosen.distinct(), 64)
    sample = docs.select("lang", "doc_id", size.alias("size"), "text").join(near, ["lang", "doc_id", "size"])
    if len(names) > LANGS_AT_ONCE:
        sample = common.stored(sample, "op10-sample")
    models = []
    for at in range(0, len(names), LANGS_AT_ONCE):
        texts: dict[str, set] = {k: set() for k in names[at : at + LANGS_AT_ONCE]}
        for r in sample.where(F.col("lang").isin(list(texts))).select("lang", "text").distinct().collect():
            texts[r[0]].add(r[1].encode("utf-8", "replace"))
        models.append(spark.sparkContext.broadcast(Model({k: sorted(v) for k, v in texts.items()})))
    return models or [spark.sparkContext.broadcast(Model({}))]


#: What a block leaves for the next: the shortest code so far, its language, and the sum of 2 ** (shortest - code).
STATE = "struct<lang: string, bits: double, mass: double>"


RESULTS = (("lang_pred", "string"), ("score", "double"), ("bits_per_byte", "double"))


def identified(docs: DataFrame, models: list[Broadcast]) -> DataFrame:
    """docs (text, ...) -> (row: the struct of its columns, lang_pred, score, bits_per_byte: null if not scored)."""
    common.ship(docs.sparkSession)
    found = common.packed(docs).withColumn("best", F.lit(None).cast(STATE))
    for i, held in enumerate(models):
        last = i == len(models) - 1
        found = scored_by(found, held, last)
        if not last:
            # a worker holds the model of one block only
            found = common.stored(found, "op10-block")
    return found


def identify(docs: DataFrame, models: list[Broadcast], keep: list[str]) -> DataFrame:
    """The columns in `keep` of each document, with RESULTS."""
    names = [n for n, _ in RESULTS]
    keep = [c for c in keep if c not in names]
    found = identified(docs.select(*dict.fromkeys([*keep, "text"])), models)
    return found.select(*common.unpacked(found, keep), *names)


def scored_by(rows: DataFrame, held: Broadcast, last: bool) -> DataFrame:
    """rows (row, best) with best brought up to date; after the last block (row, RESULTS)."""
    at = rows.schema["row"].dataType.names.index("text")
    schema = rows.select("row").schema if last else rows.schema
    for name, kind in RESULTS if last else ():
        schema = schema.add(name, kind)
    state = pa.struct([("lang", pa.string()), ("bits", pa.float64()), ("mass", pa.float64())])

    def scored(batches):
        common.kept_for("ppm")
        m = held.value
        for batch in common.slices(batches):
            texts = batch.column(0).field(at).to_pylist()
            best = batch.column(1).to_pylist()
            fine = [i for i, x in enumerate(texts) if m.langs and has_letter(x)]
            data = [texts[i].encode("utf-8", "replace") for i in fine]
            bits = m.code_lengths(data)
            for k, i in enumerate(fine):
                j, old = int(bits[k].argmin()), best[i]
                new = {"lang": m.langs[j], "bits": float(bits[k, j])}
                # blocks are in order of name, so the earlier one wins a tie
                if old and old["bits"] <= new["bits"]:
                    new = {"lang": old["lang"], "bits": old["bits"]}
                new["mass"] = float(np.exp2(np.clip(new["bits"] - bits[k], -1000, 0)).sum())
                if old:
                    new["mass"] += old["mass"] * float(np.exp2(max(new["bits"] - old["bits"], -1000.0)))
                best[i] = new
            if last:
                langs = [x["lang"] if x else "und" for x in best]
                score = [1 / x["mass"] if x else 0.0 for x in best]
                rate = [x["bits"] / len(t.encode("utf-8", "replace")) if x else None for x, t in zip(best, texts, strict=True)]
                columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())]
            else:
                columns = [batch.column(0), pa.array(best, state)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(common.lean(scored), schema)


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(sf_dir, "documents", spark).select("doc_id", "text", "lang")
    models = fit(docs.where(common.fold(4) != 2))
    return identify(docs, models, ["doc_id"]).select("doc_id", (common.fold(4) == 2).alias("held_out"), "lang_pred", "score", F.round("bits_per_byte", 4).alias("bits_per_byte"))
