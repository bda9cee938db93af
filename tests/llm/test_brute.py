"""Operators against brute-force versions in plain Python."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarnfold.llm import common, divergence, fingerprints, mixing, ppm, sharding, toxicity, url_reputation, warc


def texts_of(rng, n, sizes, words=60):
    return [" ".join(f"w{rng.randrange(words)}" for _ in range(rng.choice(sizes))) for _ in range(n)]


# -- op1 -----------------------------------------------------------------------------------


def posterior(groups, up):
    """groups {name: (n, bad)}, up {name: parent's mean} -> {name: (mean, deviation)}."""
    has = [(n, b, up[k]) for k, (n, b) in groups.items() if n > 0]
    free = sum(n - 1 for n, _, _ in has)
    q = sum(n * (b / n - m) ** 2 / (m * (1 - m)) for n, b, m in has)
    rho = min(0.999, max(1e-4, (q - len(has)) / free)) if free > 0 else 1e-4
    strength = 1 / rho - 1
    out = {}
    for k, (n, b) in groups.items():
        mean = (strength * up[k] + b) / (strength + n)
        out[k] = mean, math.sqrt(mean * (1 - mean) / (strength + n + 1))
    return out


def test_host_reputation_against_brute_force(spark):
    rng = random.Random(5)
    hosts = {"bad.spam.co.uk": 0.9, "a.spam.co.uk": 0.8, "www.fine.org": 0.02, "fine.org": 0.05, "x.mixed.com": 0.5, "y.mixed.com": 0.1, "new.spam.co.uk": None, "lone": 0.3}
    pages, labels, number = [], [], 0
    for host, rate in hosts.items():
        for _ in range(60):
            number += 1
            pages.append((number, f"http://{host}/p/{number}"))
            if rate is not None:
                labels.append((number, int(rng.random() < rate)))
    pages += [(1, pages[0][1])] * 3 + [(None, None), (7777, "no url"), (8888, "http://bad.spam.co.uk/none")]
    judged = url_reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "number long, bad int")).collect()
    bad = dict(labels)
    counts = {h: [0, 0] for h in [*hosts, ""]}
    for _, url in pages:
        host = url.split("://")[1].split("/")[0] if url and "://" in url else ""
        last = url.rsplit("/", 1)[1] if host else "x"
        if last.isdigit() and int(last) in bad:
            counts[host][0] += 1
            counts[host][1] += bad[int(last)]
    domain = lambda h: ".".join(h.split(".")[-3 if h.endswith("co.uk") else -2 :])
    suffix = lambda h: ".".join(h.split(".")[-2 if h.endswith("co.uk") else -1 :])

    def summed(key):
        out = defaultdict(lambda: [0, 0])
        for h, (n, b) in counts.items():
            out[key(h)][0] += n
            out[key(h)][1] += b
        return out

    top = (sum(b for _, b in counts.values()) + url_reputation.PRIOR_BAD) / (sum(n for n, _ in counts.values()) + 1)
    by_suffix = posterior(summed(suffix), defaultdict(lambda: top))
    domains = summed(domain)
    of = {domain(h): suffix(h) for h in counts}
    by_domain = posterior(domains, {d: by_suffix[of[d]][0] for d in domains})
    by_host = posterior(counts, {h: by_domain[domain(h)][0] for h in counts})
    assert len(judged) == len(pages)
    for r in judged:
        mean, deviation = by_host[r.host]
        low = max(0.0, mean - url_reputation.Z * deviation)
        assert r.bad_rate == pytest.approx(mean, abs=2e-6) and r.bad_rate_low == pytest.approx(low, abs=2e-6)
        want = "allow" if r.host.endswith(".com") else "block" if low > url_reputation.MOST_BAD else "allow"
        assert r.verdict == want
    verdicts = {r.host: r.verdict for r in judged}
    # a host without any outcome inherits its domain's
    assert verdicts["bad.spam.co.uk"] == verdicts["new.spam.co.uk"] == "block" and verdicts["www.fine.org"] == "allow"


# -- op2 -----------------------------------------------------------------------------------


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def hashed_words(words):
    return [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in words]


def chain(values):
    h = 42
    for v in values:
        h = xxhash.xxh64(struct.pack("<q", v), seed=h).intdigest()
    return signed(h)


def shingle_set(text, n=5):
    h = hashed_words(x for x in text.split() if x)
    return {chain(h[i : i + n]) for i in range(len(h) - n + 1)} if len(h) >= n else ({chain(h)} if h else set())


def likeness(a, b, k):
    u = sorted(a | b)[:k] if a or b else []
    sa, sb = sorted(a)[:k], sorted(b)[:k]
    u = sorted(set(sa) | set(sb))[:k]
    return 1.0 if not u else sum(x in sa and x in sb for x in u) / len(u) if a and b else 0.0


def test_sketches_and_estimates_against_brute_force(spark):
    rng = random.Random(6)
    texts = texts_of(rng, 24, [0, 3, 40, 300, 900], 400)
    texts[5:7] = [texts[4], texts[4]]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(9, texts[1]), (None, "a null id"), (None, "another null id"), (500, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, bucket int, ghost int")
    k = fingerprints.K
    got = fingerprints.edited_pairs(docs).select("*", fingerprints.resemblance(F.col("own"), F.col("changed")).alias("near_edited"), fingerprints.resemblance(F.col("own"), F.col("next_own")).alias("near_next"), fingerprints.distinct_shingles(F.col("own")).alias("about"), fingerprints.containment(F.col("own"), F.col("changed")).alias("inside")).collect()
    tie = {t or "": r for t, r in zip(texts, [0] * len(texts), strict=True)}
    order = spark.createDataFrame([(i, t or "") for i, t in rows], "doc_id long, text string").select("doc_id", "text", F.xxhash64("text").alias("tie")).collect()
    order = sorted(order, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
    assert len(got) == len(order) and tie
    want = Counter()
    for at, r in enumerate(order):
        following = order[(at + 1) % len(order)].text
        cut = len(r.text) // 4
        edited = r.text[: len(r.text) - cut] + following[:cut]
        a, b, c = shingle_set(r.text), shingle_set(edited), shingle_set(following)
        want[(r.doc_id, hashlib.sha256(edited.encode()).hexdigest(), tuple(sorted(a)[:k]), tuple(sorted(b)[:k]), round(likeness(a, b, k), 9), round(likeness(a, c, k), 9))] += 1
    assert Counter((r.doc_id, r.edited_sha256, tuple(r.own), tuple(r.changed), round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    large = [r for r in got if len(r.own) == k]
    assert len(large) > 5
    by_own = {tuple(sorted(shingle_set(t))[:k]): shingle_set(t) for t in texts}
    for r in large:
        true = len(by_own[tuple(r.own)])
        assert abs(r.about - true) < 4 * true / math.sqrt(k)
    merged = spark.createDataFrame([(texts[3] + " " + texts[9], texts[3], texts[9])], "w string, a string, b string")
    one = merged.select(fingerprints.merged(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))).alias("m")).first().m
    assert one == sorted(shingle_set(texts[3]) | shingle_set(texts[9]))[:k]


def test_next_document_across_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 5)
    monkeypatch.setattr(fingerprints, "QUANTILES", 6)
    rng = random.Random(7)
    ids = [*range(100), 10**12, *(rng.randrange(10**6) for _ in range(60)), *([None] * 17), *([50] * 9)]
    rows = [(i, f"t{n} {'x ' * (n % 7)}") for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).collect()
    order = sorted(order, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
    want = Counter()
    for at, r in enumerate(order):
        cut, following = len(r.text) // 4, order[(at + 1) % len(order)].text
        want[(r.doc_id, hashlib.sha256((r.text[: len(r.text) - cut] + following[:cut]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in fingerprints.edited_pairs(docs).collect()) == want
    parts = fingerprints.with_next(docs).where("not ghost").groupBy("at").count().collect()
    assert len(parts) > 25 and max(r["count"] for r in parts) <= 20


# -- op3 -----------------------------------------------------------------------------------


def test_damaged_archives_are_salvaged_logged_and_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "same" if i % 2 else f"page {i} " * 40) for i in range(60)], "page_id long, url string, html string").repartition(3)
    manifest = warc.write_archives(warc.with_leaders(pages), f"file://{tmp_path}/w")
    records, gaps = warc.read_checked(manifest)
    assert records.count() == 60 and gaps.count() == 0
    assert {r.page_id: r.refers_to for r in records.collect()} == {i: 59 if i % 2 and i < 59 else None for i in range(60)}
    path = manifest.first().path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    at = len(data) // 2
    data[at : at + 3] = bytes(3 - x % 2 for x in data[at : at + 3])
    open(path, "wb").write(data)
    found = warc.read_archives(manifest.select("path")).collect()
    lost = [r for r in found if r.gap]
    assert 1 <= len(lost) and 55 <= sum(r.gap is None for r in found) < 60
    for p in {r.path for r in found}:
        own = sorted((r.offset, r.length) for r in found if r.path == p)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
    with pytest.raises(ValueError, match="without some of their records"):
        warc.read_checked(manifest)


# -- op5 -----------------------------------------------------------------------------------


def test_shards_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BLOCK", 7)
    rows = [(i if i % 9 else None, None if i % 50 == 0 else f"text é {i % 300}", 1, 2) for i in range(1003)] + [(5, "again", 1, 2)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int, cell int")
    got = sharding.shuffle_into_shards(docs).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    other = sharding.shuffle_into_shards(docs, seed=77).collect()
    moved = {(r.doc_id, r.text_crc32): r.shard for r in other}
    assert sum(moved[r.doc_id, r.text_crc32] != r.shard for r in got) > 800
    assert sharding.shuffle_into_shards(docs.limit(0)).count() == 0


def test_matrix_follows_the_hypergeometric_law():
    blocks, cells = [30, 50, 20], [40, 60]
    drawn = np.array([sharding.matrix(blocks, cells, s) for s in range(3000)], float)
    mean = np.outer(blocks, cells) / 100
    assert np.abs(drawn.mean(0) - mean).max() < 0.2
    variance = 30 * 0.4 * 0.6 * 70 / 99
    assert abs(drawn[:, 0, 0].var() - variance) < 0.5


# -- op6 -----------------------------------------------------------------------------------


def shannon(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x)
    return math.sqrt(max(0, (half(p, q) + half(q, p)) / 2))


def test_distances_and_guards_against_brute_force(spark):
    rng = random.Random(8)
    words = ["the", "of", "house", "water", "and", "is", "stone", "road", "it"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([30, 120]))) + "\nsame\n\n same \nsame", "en") for i in range(12)]
    rows += [(100, "the " * 10, "en"), (101, "#$ %& " * 80, "en"), (102, None, "en"), (103, "", None), (104, "zu " * 150, "en")]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, lang string, q int, row string")
    got = {r.row.doc_id: r.q for r in divergence.judged_all(docs).collect()}
    own = {i: divergence.COMMON_WORDS[k] for i, _, k in rows if k}
    runs = lambda t: [x for x in "".join(c if "a" <= c <= "z" or c in "ß" or "ö" <= c <= "ø" or "à" <= c <= "ÿ" else " " for c in (t or "").lower()).split() if x]
    hist = {i: [runs(t).count(w) for w in own[i]] + [sum(x not in own[i] for x in runs(t))] for i, t, k in rows if k}
    total = [sum(h[n] for h in hist.values()) for n in range(17)]
    chars = {i: list(got[i].chars) for i, _, k in rows if k}
    total_chars = [sum(c[n] for c in chars.values()) for n in range(len(divergence.CLASSES) + 1)]
    for i, t, k in rows:
        if not k:
            continue
        assert list(got[i].common) == hist[i]
        assert chars[i][0] == sum("a" <= c <= "z" for c in t or "") and chars[i][2] == sum(c in "#*$%&|<>" for c in t or "")
        assert (got[i].word_distance is None) == (sum(hist[i]) < divergence.LEAST_RUNS)
        assert (got[i].char_distance is None) == (sum(chars[i]) < divergence.LEAST_CHARS)
        if got[i].word_distance is not None:
            assert got[i].word_distance == pytest.approx(shannon(hist[i], total), abs=1e-9)
        if got[i].char_distance is not None:
            assert got[i].char_distance == pytest.approx(shannon(chars[i], total_chars), abs=1e-9)
        assert got[i].n_dup_lines == (1 if i < 100 else 0)  # " same " is another line
    assert got[100].base_failed and got[102].base_failed and not got[101].kept


# -- op7 -----------------------------------------------------------------------------------


def test_tables_score_as_the_network_does_and_gradients_are_right():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["good", "house", "idiot", "water", "scum", "road"]) for _ in range(rng.randrange(0, 12))).encode() for _ in range(60)]
    y = np.array([b"idiot" in t for t in texts], np.float32)
    net = toxicity.Net.new(texts)
    data = [toxicity.padded(x) for x in toxicity.buckets(texts, net.rows)]
    net.train(data, y, 3)
    plain = [float(np.maximum(net.forward(d)[1], 0) @ net.out) + net.out_bias for d in data]
    assert net.frozen().logits(data) == pytest.approx(plain, abs=1e-4)

    def loss(d, label):
        z = float(np.maximum(net.forward(d)[1].astype(np.float64), 0) @ net.out.astype(np.float64)) + net.out_bias
        return math.log1p(math.exp(-z)) if label else math.log1p(math.exp(z))

    d, label = next((d, v) for d, v in zip(data, y, strict=True) if v and len(d) > 6)
    _, top, ats = net.forward(d)
    z = float(np.maximum(top, 0) @ net.out) + net.out_bias
    g_top = np.where(top > 0, (1 / (1 + math.exp(-z)) - label) * net.out, 0)
    for i, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            if abs(g_top[i * toxicity.FILTERS + f]) < 1e-4:
                continue
            for j in range(w):
                want = g_top[i * toxicity.FILTERS + f] * net.emb[d[ats[i][f] + j]][0]
                old, step = net.filters[i][j, 0, f], 1e-3
                net.filters[i][j, 0, f] = old + step
                high = loss(d, label)
                net.filters[i][j, 0, f] = old - step
                low = loss(d, label)
                net.filters[i][j, 0, f] = old
                assert (high - low) / (2 * step) == pytest.approx(want, abs=5e-3)


def test_thresholds_by_language_and_held_out_labels(spark, tmp_path):
    rng = random.Random(10)
    vocab = {"en": ["the", "house", "water", "road", "stone"], "de": ["das", "haus", "wasser", "weg", "stein"]}
    bad = {"en": ["scum", "idiot"], "de": ["abschaum", "trottel"]}
    rows = []
    for i in range(900):
        k = "en" if i % 3 else "de"
        rows.append((i, " ".join(rng.choices(vocab[k], k=25) + (rng.choices(bad[k], k=2) if i % 6 == 0 or i % 7 == 0 else [])), k))
    rows += [(2000, None, "en"), (2001, "", "en"), (2002, "water " * 40_000 + "idiot scum", "en")]
    toxic = [(i, int(any(w in (t or "") for w in sum(bad.values(), [])))) for i, t, _ in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = []
    for flip in (False, True):
        labels = [(i, 0, 1 - t if flip and held(i) else t) for i, t in toxic] + [(1, 0, None)]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        out.append({r.doc_id: (r.held_out, round(r.score, 9), r.predicted) for r in toxicity.op7_convolution(spark, str(tmp_path)).collect()})
    assert out[0] == out[1] and len(out[0]) == len(rows) and all(v[0] == held(i) for i, v in out[0].items())
    wrong = [i for i, t in toxic if i < 2000 and held(i) and out[0][i][2] != t]
    assert len(wrong) <= 6 and out[0][2000][1] == out[0][2001][1] and 0 <= out[0][2002][1] <= 1


# -- op9 -----------------------------------------------------------------------------------


def test_mixture_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 6)
    rng = random.Random(11)
    rows = [(i if i % 11 else None, "w " * rng.randrange(0, 9), ["big", "small", None][0 if i < 150 else 1 + i % 2]) for i in range(200)] + [(3, "same text", "small")] * 5
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, epoch int")
    got = mixing.planned_copies(docs).collect()
    size, count = Counter(), Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
        count[s] += 1
    names = sorted(size, key=lambda s: (s is not None, s or ""))
    plan = {p[0]: p for p in mixing.plan_of([(s, size[s], count[s]) for s in names], None, mixing.MOST_REPEATS, None, False)}
    for s in names:
        _, tokens, _, epochs, rest = plan[s]
        own = sorted((r for r in got if r.source == s), key=lambda r: (r.at_token, r.n_tokens))
        # whole epochs hold each row once; the part of one is the start of its permutation
        for e in range(epochs):
            assert sum(r.epoch == e for r in own) == count[s] and sum(r.n_tokens for r in own if r.epoch == e) == tokens
        assert all(0 <= r.at_share <= 1 and (not tokens or abs(r.at_share * (epochs * tokens + rest) - r.at_token) < 1e-6) for r in own)
        last = [r for r in own if r.epoch == epochs]
        at = epochs * tokens
        for r in last:
            assert r.at_token == at
            at += r.n_tokens
        assert at - epochs * tokens <= rest
        if epochs > 1:
            first, second = ([(r.doc_id, r.n_tokens) for r in own if r.epoch == e] for e in (0, 1))
            assert first != second


def test_exponent_meets_an_entropy(spark):
    tokens = [1000, 100, 10]
    a = mixing.solve_exponent(tokens, None, 1.0, False)
    w = [x**a for x in tokens]
    bits = -sum(x / sum(w) * math.log2(x / sum(w)) for x in w)
    assert bits <= 1.0 + 1e-9 and bits > 0.99
    assert mixing.solve_exponent([5, 5], None, 10.0, False) == 0


# -- op10 ----------------------------------------------------------------------------------


def code_length(texts, data):
    """Bits by the definition: longest seen context first, escapes below, 8 bits under order 0."""
    seen = defaultdict(Counter)
    for t in texts:
        padded = b"\0" * 4 + t
        for i in range(4, len(padded)):
            for order in range(5):
                seen[padded[i - order : i]][padded[i]] += 1
    total, padded = 0.0, b"\0" * 4 + data
    for i in range(4, len(padded)):
        for order in range(4, -1, -1):
            c = seen.get(padded[i - order : i])
            if c is None:
                continue
            n, q = sum(c.values()), len(c)
            if padded[i] in c:
                total -= math.log2(c[padded[i]] / (n + q))
                break
            total -= math.log2(q / (n + q))
        else:
            total += 8
    return total


def test_code_lengths_against_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    make = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n)).encode()
    learned = {"aa": [make("abcd ", 300) for _ in range(4)], "bb": [make("cdef ", 300) for _ in range(3)], "cc": ["über öl".encode() * 9]}
    texts = [make("abcdef xyz", n) for n in (1, 5, 40, 700)] + [b"", "日本".encode(), b"\0\0abc"]
    want = [[code_length(v, t) for v in learned.values()] for t in texts]
    model = ppm.Model(learned)
    assert model.langs == ["aa", "bb", "cc"]
    assert model.code_lengths(texts) == pytest.approx(np.array(want), rel=1e-5, abs=1e-3)
    monkeypatch.setattr(ppm, "CELLS", 300)  # pieces of 1024 bytes at least
    long = make("abcdef xyz", 5000)
    assert model.code_lengths([long])[0] == pytest.approx([code_length(v, long) for v in learned.values()], rel=1e-4)
    ties = ppm.Model({"zz": [b"abc"], "yy": [b"abc"]})
    rows = ppm.identify(spark.createDataFrame([(1, "abc"), (2, "ABC 1"), (3, "12 !"), (4, None)], "doc_id long, text string"), [common_broadcast(spark, ties)], ["doc_id"]).collect()
    assert {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in rows} == {1: ("yy", 0.5), 2: ("yy", 0.5), 3: ("und", 0.0), 4: ("und", 0.0)}


def common_broadcast(spark, value):
    common.ship(spark)
    return spark.sparkContext.broadcast(value)


def test_held_out_documents_teach_nothing(spark, tmp_path):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = [(i, ("the house of stone " if i % 2 else "das haus aus stein ") * 5, "en" if i % 2 else "de") for i in range(80)]
    rows = [(i, t, "fi" if held(i) else k) for i, t, k in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = ppm.op10_ppm(spark, str(tmp_path)).collect()
    assert {r.lang_pred for r in got} == {"en", "de"} and all(r.held_out == held(r.doc_id) for r in got)
