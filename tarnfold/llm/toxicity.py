"""Toxicity by a convolutional text classifier, trained in numpy.

Words (runs without ASCII marks, A-Z lower-cased) are hashed into buckets with an embedding each; filters of several widths slide
over them, each gives its largest value (at least 0) over the text, and a logistic layer
weighs these. Training is by Adagrad, a document at a time; only the embeddings and windows
that won the maximum get a gradient. For scoring, the products of embeddings and filters
are worked out once a bucket, so a text costs a few row lookups a word, in fixed memory.

Every labelled row is learned from: which buckets have an embedding, the words of languages, the weights of labels, the network
and its thresholds come from all of them. Rows are stored as buckets, dealt by a hash into parts of about PART_ROWS; in each of PASSES
passes a task trains a copy of the network on each part, one row after another, and what the copies changed is averaged (an embedding: over the copies
that changed it). Sums are of whole numbers, so neither the order nor the number of tasks matters. Before the passes,
the driver takes the network out of its random start on at most PER_LABEL rows a label of at most MOST_BYTES; a label with fewer
than LONG_PER_LABEL of these takes the shortest of its longer ones, LONG_PER_LABEL in all. The passes hold these rows too.

Thresholds are calibrated by language: FOLDS further networks, trained alike, score each row by one that has
not seen its text, the threshold of each language that is best there is drawn towards that of all rows
(the less, the more toxic rows it has) and shifted to `CUT` on the scale of scores. Logits are counted in steps of 1 / STEPS.
A text's language for this is guessed from its words (counts in the training texts; LANG_ROWS numbers a language); the lang column is never
an input of a score.

Edge cases: null and empty texts are scored as a text of no words; labels that
are null are not learned from; of repeated labels the largest counts; with only one label
to learn from all scores are 0; null doc_ids and repeated rows are scored like others.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, word_hash

BITS, DIM, WIDTHS, FILTERS = 20, 8, (1, 2, 3), 8
#: Buckets in fewer training texts have no embedding of their own: they count as a word that says nothing.
LEAST_TEXTS = 3
PER_LABEL, LONG_PER_LABEL, MOST_BYTES = 4_000, 200, 50_000
EPOCHS, RATE, DROPPED, CUT, FOLDS, MOST_SHIFT = 8, 0.08, 0.15, 0.7, 2, 1.5
#: Passes over all labelled rows, and rows that one copy of the network learns from in a pass.
PASSES, PART_ROWS = 6, 5_000
#: Changes are summed, and logits counted, as whole multiples of one part in these.
FIXED, STEPS = 1 << 20, 1_000
LANG_ROWS = 1 << 16
#: A language with so many toxic rows has a threshold halfway between its own and that of all.
HALFWAY = 12
#: A document with a smaller gradient is passed over in training.
SETTLED = 0.01
PAD = 0


def buckets(texts: list[bytes], rows: np.ndarray | None = None):
    """Word buckets of each text, or their embeddings' rows."""
    for h, first in word_hash.batches(texts, True):
        ids = (h >> np.uint64(64 - BITS)).astype(np.int32)
        ids = ids if rows is None else rows[ids]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield ids[a:b]


def padded(ids: np.ndarray) -> np.ndarray:
    return np.concatenate((ids, np.full(max(WIDTHS) - 1 + (len(ids) == 0), PAD, np.int32)))


@dataclass
class Net:
    rows: np.ndarray
    emb: np.ndarray
    filters: list
    bias: list
    out: np.ndarray
    out_bias: float
    #: Adagrad's sums of squares: of the embeddings, of weights(), of out_bias.
    sq_emb: np.ndarray
    sq: list
    sq_bias: float = 1e-2
    langs: list = field(default_factory=list)
    lang_words: np.ndarray | None = None
    shift: np.ndarray | None = None
    tables: list | None = None

    @classmethod
    def new(cls, texts: list[bytes], seed: int = 3) -> Net:
        """Rows for the buckets of enough texts; PAD for all others."""
        found, n = np.unique(np.concatenate([np.unique(x) for x in buckets(texts)]), return_counts=True)
        return cls.of(found[n >= LEAST_TEXTS], seed)

    @classmethod
    def of(cls, found: np.ndarray, seed: int = 3) -> Net:
        rng = np.random.default_rng(seed)
        rows = np.zeros(1 << BITS, np.int32)
        rows[found] = np.arange(1, len(found) + 1)
        emb = rng.normal(0, 0.1, (len(found) + 1, DIM)).astype(np.float32)
        emb[PAD] = 0
        filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        bias, out = [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        sq = [np.full(x.shape, 1e-2, np.float32) for x in (*filters, *bias, out)]
        return cls(rows, emb, filters, bias, out, 0.0, np.full(len(emb), 1e-2, np.float32), sq)

    def copy(self) -> Net:
        """One to train further."""
        own = replace(self, emb=self.emb.copy(), sq_emb=self.sq_emb.copy(), filters=[None] * len(WIDTHS), bias=[None] * len(WIDTHS), sq=[None] * len(self.sq))
        own.load(self.state())
        return own

    def weights(self) -> list:
        return [*self.filters, *self.bias, self.out]

    def state(self) -> np.ndarray:
        """All numbers but the embeddings and their sums."""
        return np.concatenate([x.ravel() for x in (*self.weights(), *self.sq)] + [[self.out_bias, self.sq_bias]], dtype=np.float64)

    def load(self, state: np.ndarray) -> None:
        shapes = [(w, DIM, FILTERS) for w in WIDTHS] + [(FILTERS,)] * len(WIDTHS) + [(len(WIDTHS) * FILTERS,)]
        sizes = [int(np.prod(x)) for x in shapes * 2]
        found = [x.reshape(k).astype(np.float32) for x, k in zip(np.split(state[:-2], np.cumsum(sizes)[:-1]), shapes * 2, strict=True)]
        n = len(WIDTHS)
        self.filters, self.bias, self.out, self.sq = found[:n], found[n : 2 * n], found[2 * n], found[2 * n + 1 :]
        self.out_bias, self.sq_bias = float(state[-2]), float(state[-1])

    def forward(self, ids: np.ndarray):
        """Embeddings of the windows that won, features of one padded text and where each was largest."""
        n = len(ids) - max(WIDTHS) + 1
        tops, ats = [np.full(FILTERS, -np.inf, np.float32) for _ in WIDTHS], [np.zeros(FILTERS, np.int64) for _ in WIDTHS]
        for a in range(0, n, WORDS_AT_ONCE):
            m = min(n - a, WORDS_AT_ONCE)
            e = self.emb[ids[a : a + m + max(WIDTHS) - 1]]
            for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                c = e[:m] @ f[0]
                for j in range(1, w):
                    c += e[j : m + j] @ f[j]
                at = c.argmax(0)
                top = c[at, np.arange(FILTERS)]
                ats[i] = np.where(top > tops[i], at + a, ats[i])
                tops[i] = np.maximum(top, tops[i])
        won = [[self.emb[ids[at + j]] for j in range(w)] for w, at in zip(WIDTHS, ats, strict=True)]
        return won, np.concatenate([t + b for t, b in zip(tops, self.bias, strict=True)]), ats

    def learn(self, ids: np.ndarray, label: float, weight: float) -> None:
        """One step of Adagrad by one padded text."""
        won, top, ats = self.forward(ids)
        act = np.maximum(top, 0)
        z = float(act @ self.out) + self.out_bias
        g = weight * (1 / (1 + np.exp(-max(-30.0, min(30.0, z)))) - label)
        if abs(g) < SETTLED:
            return
        g_top = np.where(top > 0, g * self.out, 0).astype(np.float32)
        g_out = (g * act).astype(np.float32)
        sq_f, sq_b, sq_out = self.sq[: len(WIDTHS)], self.sq[len(WIDTHS) : -1], self.sq[-1]
        sq_out += g_out * g_out
        self.out -= RATE * g_out / np.sqrt(sq_out)
        self.sq_bias += g * g
        self.out_bias -= RATE * g / self.sq_bias**0.5
        for i, w in enumerate(WIDTHS):
            gf, at = g_top[i * FILTERS : (i + 1) * FILTERS], ats[i]
            if not gf.any():
                continue
            sq_b[i] += gf * gf
            self.bias[i] -= RATE * gf / np.sqrt(sq_b[i])
            for j in range(w):
                g_emb = (self.filters[i][j] * gf).T  # filter by dimension
                g_f = won[i][j].T * gf
                sq_f[i][j] += g_f * g_f
                self.filters[i][j] -= RATE * g_f / np.sqrt(sq_f[i][j])
                real = ids[at + j]
                use = (real != PAD) & (gf != 0)
                np.add.at(self.sq_emb, real[use], (g_emb[use] ** 2).sum(1))
                np.add.at(self.emb, real[use], -RATE * g_emb[use] / np.sqrt(self.sq_emb[real[use]])[:, None])

    def train(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        weight = weights_of(float((labels == 0).sum()), float((labels == 1).sum()))
        for _ in range(epochs):
            for k in rng.permutation(len(docs)).tolist():
                self.learn(dropped(docs[k], rng), float(labels[k]), weight[int(labels[k])])

    def frozen(self) -> Net:
        self.tables = [[(self.emb @ f[j]).astype(np.float32) for j in range(w)] for w, f in zip(WIDTHS, self.filters, strict=True)]
        return self

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        """Logits of padded texts, all at once by table lookup, shifted by the guessed language."""
        if self.tables is None:
            self.frozen()
        ids, edges = joined(docs)
        act = []
        for w, t, b in zip(WIDTHS, self.tables, self.bias, strict=True):
            c = t[0][ids]
            for j in range(1, w):
                c[:-j] += t[j][ids[j:]]
            act.append(np.maximum(np.maximum.reduceat(c, edges, 0)[::2] + b, 0))
        z = np.concatenate(act, 1) @ self.out + self.out_bias
        return z if self.shift is None else z - self.shift[self.guess(ids, edges)]

    def guess(self, ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.lang_words[lang_rows(ids)], edges, 0, np.float64)[::2].argmax(1)

    def learn_languages(self, counts: dict) -> None:
        """counts: by language, how often each of LANG_ROWS was in its texts."""
        self.langs = sorted(counts) or ["*"]
        n = np.stack([counts.get(x, np.zeros(LANG_ROWS)) for x in self.langs], 1) + 0.1
        share = np.log(n / n.sum(0))
        self.lang_words = (share - share.mean(1, keepdims=True)).astype(np.float32)
        self.lang_words[PAD] = 0


def joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Padded texts in one, and where the words of each begin and end."""
    ids = np.concatenate(docs)
    sizes = np.array([len(d) for d in docs])
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return ids, np.minimum(np.stack((begin, begin + sizes - (max(WIDTHS) - 1)), 1).ravel(), len(ids) - 1)


def lang_rows(ids: np.ndarray) -> np.ndarray:
    return np.where(ids == PAD, PAD, 1 + ids % (LANG_ROWS - 1))


def dropped(ids: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return np.where(rng.random(len(ids), np.float32) < DROPPED, PAD, ids)


def weights_of(n0: float, n1: float) -> tuple[float, float]:
    """What a row of each label weighs, so that both labels weigh the same."""
    share = n1 / max(n0 + n1, 1)
    return 0.5 / max(1 - share, 1e-6), 0.5 / max(share, 1e-6)


def best_threshold(z: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> float:
    """Middle of the gap whose cut gives the best F1; z ascending, with rows of each label."""
    z, n0, n1 = z[::-1], n0[::-1], n1[::-1]
    hit = np.cumsum(n1)
    f1 = 2 * hit / (hit + np.cumsum(n0) + n1.sum())
    k = int(f1.argmax())
    low = z[k + 1] if k + 1 < len(z) else z[k] - 1
    return float((z[k] + low) / 2)


def score_of(z: np.ndarray) -> np.ndarray:
    """0 to 1; a logit of 0, the threshold, is CUT."""
    return 1 / (1 + np.exp(-np.clip(z + np.log(CUT / (1 - CUT)), -40, 40)))


ROWS = "part int, key long, fold int, toxic int, lang string, size long, ids binary"


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row with a label, as ROWS: ids are its words' buckets, equal texts are in one fold; stored in the order of training."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    parts = max(1, -(-known.count() // PART_ROWS))
    text = common.text_or_empty()
    rows = docs.select("doc_id", text.alias("text"), "lang").join(common.small(known), "doc_id")
    key = F.xxhash64("doc_id", "text")
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")
    rows = rows.select(F.pmod(key, F.lit(parts)).cast("int"), key, fold, "toxic", F.col("lang").cast("string"), F.octet_length("text").cast("long"), "text")
    schema = T._parse_datatype_string(ROWS)

    def run(batches):
        for batch in common.slices(batches):
            texts = [x.encode("utf-8", "replace") for x in batch.column(batch.num_columns - 1).to_pylist()]
            ids = pa.array([x.tobytes() for x in buckets(texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=schema.names)

    found = rows.toDF(*schema.names[:-1], "text").mapInArrow(run, schema)
    return common.stored(found.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key"), "op7-labelled")


def ids_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column("ids")]


def vocabulary(rows: DataFrame) -> np.ndarray:
    """Buckets in at least LEAST_TEXTS of all rows."""

    def run(batches):
        n = np.zeros(1 << BITS, np.int64)
        for batch in common.slices(batches):
            for ids in ids_of(batch):
                n[np.unique(ids)] += 1
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n[found])], names=["bucket", "n"])

    found = rows.select("ids").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return np.sort(found.where(F.col("n") >= LEAST_TEXTS).select("bucket").toArrow().column(0).to_numpy())


def language_words(rows: DataFrame, number: np.ndarray) -> dict:
    """By language, how often each of LANG_ROWS is in its rows; number: embedding's row by bucket."""
    held = rows.sparkSession.sparkContext.broadcast(number)

    def run(batches):
        counts = {}

        def done():
            for lang, n in counts.items():
                found = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(n[found])], names=["lang", "word", "n"])
            counts.clear()

        for batch in common.slices(batches):
            for lang, ids in zip(batch.column("lang").to_pylist(), ids_of(batch), strict=True):
                if lang not in counts and len(counts) >= 64:
                    yield from done()
                counts.setdefault(lang, np.zeros(LANG_ROWS, np.int64))[:] += np.bincount(lang_rows(held.value[ids]), minlength=LANG_ROWS)
        yield from done()

    found = rows.where("lang is not null").select("lang", "ids").mapInArrow(run, "lang string, word int, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    out = {}
    names = found.column("lang").combine_chunks().dictionary_encode()
    which, word, n = names.indices.to_numpy(), found.column("word").to_numpy(), found.column("n").to_numpy()
    for i, lang in enumerate(names.dictionary.to_pylist()):
        out[lang] = np.zeros(LANG_ROWS)
        out[lang][word[which == i]] = n[which == i]
    return out


def first_rows(rows: DataFrame) -> list:
    """Rows that a network is started on: at most PER_LABEL a label."""
    chosen = []
    long = F.col("size") > MOST_BYTES
    for label in (0, 1):
        own = rows.where(F.col("toxic") == label).select("key", "fold", "toxic", "size", "ids")
        # an ordered limit: each task passes on PER_LABEL rows at most
        found = own.where(~long).orderBy("key", "size").limit(PER_LABEL).collect()
        if len(found) < LONG_PER_LABEL:
            found += own.where(long).orderBy("size", "key").limit(LONG_PER_LABEL - len(found)).collect()
        chosen += found
    return sorted(chosen, key=lambda r: (r.key, r.size))


def changes(base: Net, own: Net) -> pa.RecordBatch:
    """What training changed, in whole numbers: rows of DIM + 1, those of an embedding and its sum, or under negative numbers of state()."""
    found = np.flatnonzero((own.sq_emb != base.sq_emb) | (own.emb != base.emb).any(1))
    emb = np.column_stack((own.emb[found] - base.emb[found], own.sq_emb[found] - base.sq_emb[found])).astype(np.float64)
    state = own.state() - base.state()
    state = np.append(state, np.zeros(-len(state) % (DIM + 1))).reshape(-1, DIM + 1)
    fixed = np.rint(np.concatenate((emb, state)) * FIXED).astype(np.int64)
    number = np.concatenate((found, -1 - np.arange(len(state)))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(number), *(pa.array(x) for x in fixed.T)], names=["row", *(f"v{i}" for i in range(DIM + 1))])


def passed(rows: DataFrame, net: Net, left_out: int, weight: tuple[float, float], number: int) -> None:
    """One pass of training over all rows but those of the fold left out."""
    held = rows.sparkSession.sparkContext.broadcast(net)
    values = [f"v{i}" for i in range(DIM + 1)]

    def run(batches):
        base, own, at = held.value, None, None
        for batch in common.slices(batches):
            for part, toxic, ids in zip(batch.column("part").to_pylist(), batch.column("toxic").to_pylist(), ids_of(batch), strict=True):
                if part != at:
                    if own:
                        yield changes(base, own)
                    own, at, rng = base.copy(), part, np.random.default_rng((number, part))
                own.learn(dropped(padded(base.rows[ids]), rng), toxic, weight[toxic])
        if own:
            yield changes(base, own)

    seen = rows.where(F.col("fold") != left_out).select("part", "toxic", "ids").mapInArrow(run, "row int, " + ", ".join(f"{v} long" for v in values))
    # sums of whole numbers do not depend on their order
    mean = seen.groupBy("row").agg(*((F.sum(v) / F.count(v) / FIXED).alias(v) for v in values)).select("row", *(F.col(v).cast("float").alias(v) for v in values))
    found = mean.toArrow()
    held.destroy()
    row = found.column("row").to_numpy()
    change = np.stack([found.column(v).to_numpy() for v in values], 1)
    emb = row >= 0
    net.emb[row[emb]] += change[emb, :DIM]
    net.sq_emb[row[emb]] += change[emb, DIM]
    state = net.state()
    rest = change[~emb][np.argsort(-row[~emb])].ravel()[: len(state)]
    if len(rest):
        net.load(state + rest)


def trained(rows: DataFrame, first: list, found: np.ndarray, counts: dict, left_out: int, epochs: int) -> Net:
    """A network that has learned from all rows but those of the fold left out; counts: rows by fold and label."""
    n = [sum(c for (f, t), c in counts.items() if t == label and f != left_out) for label in (0, 1)]
    if not all(n):
        return trained(rows, first, found, counts, -1, epochs)
    net = Net.of(found)
    start = [r for r in first if r.fold != left_out]
    net.train([padded(net.rows[np.frombuffer(r.ids, np.int32)]) for r in start], np.array([r.toxic for r in start]), max(1, epochs // 2))
    for number in range(PASSES):
        passed(rows, net, left_out, weights_of(*n), number)
    return net


def tallied(rows: DataFrame, net: Net) -> pa.Table:
    """Rows by guessed language, logit in steps and label."""
    held = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in common.slices(batches):
            toxic, at = batch.column("toxic").to_numpy(), 0
            for pack in packs(padded(held.value.rows[ids]) for ids in ids_of(batch)):
                z = np.rint(np.clip(held.value.logits(pack), -100, 100) * STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(held.value.guess(*joined(pack)).astype(np.int32)), pa.array(z), pa.array(toxic[at : at + len(pack)])], names=["guess", "z", "toxic"])
                at += len(pack)

    found = rows.select("toxic", "ids").mapInArrow(run, "guess int, z long, toxic int")
    found = found.groupBy("guess", "z").agg(F.sum(1 - F.col("toxic")).alias("n0"), F.sum("toxic").alias("n1")).toArrow()
    held.destroy()
    return found


def fit(docs: DataFrame, labels: DataFrame, epochs: int | None = None) -> Net | None:
    """docs (doc_id, text, lang), labels (doc_id, toxic); None if one label only is there to learn from."""
    common.ship(docs.sparkSession)
    epochs = epochs or EPOCHS
    with common.scratch():
        rows = labelled(docs, labels)
        counts = {(r.fold, r.toxic): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
        if len({t for _, t in counts}) < 2:
            return None
        found = vocabulary(rows)
        first = first_rows(rows)
        words = language_words(rows, Net.of(found).rows)
        tallies = []
        for f in range(FOLDS):
            other = trained(rows, first, found, counts, f, epochs)
            other.learn_languages(words)
            tallies.append(tallied(rows.where(F.col("fold") == f), other))
        net = trained(rows, first, found, counts, -1, epochs)
        net.learn_languages(words)
    net.shift = shifts(pa.concat_tables(tallies), len(net.langs))
    net.sq_emb, net.sq = None, None
    return net


def shifts(tally: pa.Table, langs: int) -> np.ndarray:
    """The threshold of each language from rows counted by logit."""
    guess, z, n0, n1 = (tally.column(c).to_numpy() for c in ("guess", "z", "n0", "n1"))

    def best(own: np.ndarray) -> float:
        steps, at = np.unique(z[own], return_inverse=True)
        return best_threshold(steps / STEPS, np.bincount(at, n0[own]), np.bincount(at, n1[own]))

    everywhere = best(np.full(len(z), True))
    out = np.full(langs, everywhere)
    for i in range(langs):
        own = guess == i
        n = n1[own].sum()
        if n and n0[own].sum():
            out[i] = everywhere + np.clip(best(own) - everywhere, -MOST_SHIFT, MOST_SHIFT) * n / (n + HALFWAY)
    return out.astype(np.float32)


#: Words scored together.
WORDS_AT_ONCE = 250_000


def packs(docs):
    """Padded texts in lists of about WORDS_AT_ONCE words."""
    pack, size = [], 0
    for d in docs:
        pack.append(d)
        size += len(d)
        if size >= WORDS_AT_ONCE:
            yield pack
            pack, size = [], 0
    if pack:
        yield pack


def scored(docs: DataFrame, net: Net | None, keep: list[str]) -> DataFrame:
    """The columns in `keep` (one called score gives way) and score."""
    common.ship(docs.sparkSession)
    keep = [c for c in keep if c != "score"]
    schema = docs.select(*keep).schema.add("score", "double")
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        own = held.value
        for batch in common.slices(batches):
            texts = [(x or "").encode("utf-8", "replace") for x in batch.column(batch.num_columns - 1).to_pylist()]
            out = [score_of(own.logits(pack)) for pack in packs(padded(d) for d in buckets(texts, own.rows))] if own else []
            score = np.concatenate(out) if out else np.zeros(len(texts))
            columns = [batch.column(c) for c in range(batch.num_columns - 1)] + [pa.array(score.astype(np.float64), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*keep, F.col("text")).toDF(*(f"c{i}" for i in range(len(keep) + 1))).mapInArrow(run, schema)


def op7_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(sf_dir, "documents", spark).select("doc_id", "text", "lang")
    net = fit(docs, common.table(sf_dir, "labels", spark).where(common.fold(3) != 1))
    return scored(docs, net, ["doc_id"]).select("doc_id", (common.fold(3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
