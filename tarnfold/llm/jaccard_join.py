"""Exact Jaccard self-join of shingle sets by a token-group matrix.

1.  Documents with equal sets form a class; its least doc_id stands for it from here on.
2.  The tokens of the matrix are parts of sets. In an instance of the join for sizes l to r
    (r = 1.5 l) two linked sets differ in at most d = 2 r (1 - t) / (1 + t) shingles. Hashes
    are dealt to m = d + 1 + slack parts, so linked sets agree in at least slack + 1 parts. A
    part that is not empty is a token (hash of instance, place and content); sets that have so
    many empty parts that these alone might make up the agreement get tokens for them too.
3.  A document stays only if one of its rarest tokens is one of the rarest of another, as for
    any two that are linked (see rarest). Those that stay are partitioned into groups: each
    token has a leader, the least document with it, and a document goes to the least of the
    leaders with which it has many tokens. The matrix has a row for each group and token in the
    union of its documents' rarest tokens.
4.  For each document and group the shared rare tokens are counted; the group is opened for
    the document only if they reach RARE, or what a linked pair shares at least, if that is
    less (slack + 1, or more where chance makes fewer all but impossible: see Parts.agreement;
    less the document's empty parts). Leaving frequent tokens out keeps the count in
    proportion where thousands of half-similar documents share them. A linked pair meets in
    the lesser of their home groups; visits the other way are left out.
5.  Of opened groups the shingles are read again. Within a room (a group and its visitors)
    documents that have too few shingles in the union of the others drop out, and the rest is
    searched breadth first, comparing only with documents not reached yet, so a group of near
    copies costs little more than its size. Rooms over ROOM_DOCS or ROOM_SHINGLES are split
    into blocks that all hold the group's first document; if a split room stays in several
    components, documents outside its largest one are compared with all its blocks, again
    opening only component cells whose union of shingles can reach the threshold.

No pair table is made: rooms return the least document of each local component. The
thresholds are exact integers (100 * intersection >= percent * union). Sets are of 64-bit
hashes.

Edge cases: a null text is empty; a set without words is linked with nothing, not even
another empty one; fewer words than a shingle are one shingle; rows that share a doc_id
count as one document; a row with null doc_id takes part in no link and has no component
unless another document has the same set; texts of any length are read whole; other columns of the
input play no part, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, components, word_hash

WORDS, PERCENT = 4, 85
ROOM_DOCS, ROOM_SHINGLES = 1_000, 1_500_000
#: A token with at least so many rows (or HOT_SHARE of the documents) has them dealt out; how many documents are looked at to tell.
HOT_ROWS, HOT_SAMPLE = 20_000, 64
#: How far below its mean a linked pair's agreement may lie.
DEVIATIONS = 6.5
#: A leader with at least one in so many of the tokens that a document has with its main leader may be its group's.
STRONG = 4
#: Rare tokens that a document must share with a group that it visits.
RARE = 4
SEED = np.uint64(0x5851F42D4C957F2D)


def size_classes(percent: int, most: int) -> list[tuple[int, int, int, int]]:
    """(least size, largest size, d, slack) of each instance up to sets of `most`."""
    out, low = [], 1
    while low <= most:
        high = max(low, low * 3 // 2)
        d = 2 * high * (100 - percent) // (100 + percent)
        out.append((low, high, d, 0 if not d else 2 if d < 3 else 4 + d * 3 // 100))
        low = high + 1
    return out


class Parts:
    """Tokens of a set for the instances that it takes part in."""

    def __init__(self, percent: int):
        self.percent, self.classes = percent, size_classes(percent, 1 << 40)
        self.lows = np.array([c[0] for c in self.classes])

    def agreement(self, n: int, d: int, slack: int, m: int) -> int:
        """Parts in which a set of n agrees with any that it is linked with.

        slack + 1 for certain. But the hashes of the at most n (1 - t) / t shingles in which they
        differ fall into parts at random, some into the same: the number of parts without one has
        a mean and deviation (occupancy of boxes by balls), and it lies DEVIATIONS below its mean with a
        chance under 1e-9, in the worst case of a pair right at the threshold.
        """
        balls = min(d, n * (100 - self.percent) // self.percent)
        load = balls / m
        mean, spread = m * np.exp(-load), m * (np.exp(-load) - (1 + load) * np.exp(-2 * load))
        return max(slack + 1, int(mean - DEVIATIONS * spread**0.5))

    def tokens(self, hashes: np.ndarray):
        """hashes sorted and distinct -> for each instance: its number, how many tokens a document linked there shares at least, tokens."""
        n = len(hashes)
        own = int(np.searchsorted(self.lows, n, "right")) - 1
        wanted = [own] + [own + 1] * (100 * n >= self.percent * self.classes[own + 1][0])
        values = word_hash.mix(hashes ^ SEED)
        for i in wanted:
            _, _, d, slack = self.classes[i]
            if not d:
                continue  # linked sets would be equal
            m = d + 1 + slack
            part = ((hashes >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            place, content = part[begin], np.add.reduceat(values, begin)
            empty = m - len(begin)
            if empty > slack:
                none = np.setdiff1d(np.arange(m, dtype=np.uint64), place)
                place, content = np.concatenate((place, none)), np.concatenate((content, np.zeros(len(none), np.uint64)))
            yield i, max(1, self.agreement(n, d, slack, m) - empty), word_hash.mix(content + word_hash.mix(place + np.uint64(i << 32)))


def sets_of(batches, words: int):
    """Arrow batches (doc_id, text) -> (doc_id, hashes, number of words) of each row."""
    common.kept_for("sets")
    for batch in common.slices(batches):
        ids = batch.column(0).to_pylist()
        at = 0
        for h, first in word_hash.batches((x or "").encode("utf-8", "replace") for x in batch.column(1).to_pylist()):
            for s, n in word_hash.shingles(h, first, words):
                yield ids[at], s, n
                at += 1


def packed(rows, size: int = 2_000):
    pack = []
    for r in rows:
        pack.append(r)
        if len(pack) == size:
            yield pack
            pack = []
    if pack:
        yield pack


def described(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (size of the set), sig (hash of the set; null if empty)."""

    def row(doc_id, s, _n):
        return doc_id, len(s), np.array([word_hash.mix(s ^ SEED).sum(), word_hash.mix(s + SEED).sum()], np.uint64).tobytes() if len(s) else None

    def run(batches):
        for pack in packed(row(*x) for x in sets_of(batches, words)):
            ids, n, sig = zip(*pack, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n", "sig"])

    return docs.select("doc_id", "text").mapInArrow(common.lean(run), "doc_id long, n long, sig binary")


def tokens_of(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(token, doc, kind, need, n): kind is the instance, need what a document linked there shares at least."""

    def run(batches):
        parts = Parts(percent)
        rows = ((doc, kind, need, len(s), t) for doc, s, _ in sets_of(batches, words) if len(s) for kind, need, t in parts.tokens(s))
        for pack in packed(rows, 1_000):
            ids, kinds, needs, sizes, tokens = zip(*pack, strict=True)
            edges = np.cumsum([0, *map(len, tokens)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(tokens).view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.int32()), pa.array(needs, pa.int32()), pa.array(sizes, pa.int32()), lists], names=["doc", "kind", "need", "n", "tokens"])

    found = docs.select("doc_id", "text").mapInArrow(common.lean(run), "doc long, kind int, need int, n int, tokens array<long>")
    return found.select(F.explode("tokens").alias("token"), "doc", "kind", "need", "n")


def placed_sets(docs: DataFrame, places: DataFrame, words: int) -> DataFrame:
    """places (doc, ...) with the set of each doc, read again from its text: one shuffle of sets, to where they meet."""
    rest = [c for c in places.columns if c != "doc"]
    spots = common.stored(places.groupBy("doc").agg(F.collect_list(F.struct(*rest)).alias("spots")), "op8-spots")
    near = F.broadcast(spots) if places.count() * 32 <= common.BROADCAST_BYTES else spots
    texts = docs.select("doc_id", "text").join(near, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "spots")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [s.astype("<u8").tobytes() for _, s, _ in sets_of([part], words)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary()), part.column(2)], names=["doc", "shingles", "spots"])

    schema = f"doc long, shingles binary, spots {spots.schema['spots'].dataType.simpleString()}"
    return texts.mapInArrow(common.lean(run), schema).select("doc", "shingles", F.inline("spots"))


def _loaded(table: pa.Table):
    """Documents of a room: ids, sizes, shingles renumbered from 0, where each document's begin."""
    common.kept_for("sets")
    ids = table.column("doc").to_numpy()
    sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets], np.int64)
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    return ids, sizes, flat, np.concatenate(([0], np.cumsum(sizes))), len(kinds)


def _cut(which: np.ndarray, flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of some documents, one after the other, and where each one's begin."""
    sizes = first[which + 1] - first[which]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    return flat[np.repeat(first[which] - starts[:-1], sizes) + np.arange(starts[-1])], starts[:-1]


def room_components(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """(doc, root) of each document in a local component of two or more; root is its least doc."""
    ids, sizes, flat, first, kinds = _loaded(table)
    shared = np.bincount(flat, minlength=kinds) > 1
    bound = np.add.reduceat(shared[flat].astype(np.int64), first[:-1])
    left = np.flatnonzero(100 * bound >= percent * sizes)
    out, flag = [], np.zeros(kinds, bool)
    left = left[np.argsort(ids[left], kind="stable")]
    tokens, starts = _cut(left, flat, first) if len(left) else (flat[:0], first[:0])
    alive, cut_size = np.ones(len(left), bool), len(left)
    while alive.any():
        seed = int(left[np.flatnonzero(alive)[0]])
        alive[np.flatnonzero(alive)[0]] = False
        members, todo = [seed], [seed]
        while todo and alive.any():
            p = todo.pop()
            if alive.sum() * 2 <= cut_size:  # what has been reached is cut out now and then
                left = left[alive]
                tokens, starts = _cut(left, flat, first)
                alive, cut_size = np.ones(len(left), bool), len(left)
            mine = flat[first[p] : first[p + 1]]
            flag[mine] = True
            both = np.add.reduceat(flag[tokens], starts, dtype=np.int64)
            flag[mine] = False
            near = np.flatnonzero(alive & (100 * both >= percent * (sizes[left] + sizes[p] - both)))
            alive[near] = False
            members += left[near].tolist()
            todo += left[near].tolist()
        if len(members) > 1:
            root = int(ids[members].min())
            out += [(int(d), root) for d in ids[members]]
    return out


def cell_links(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links of `asks` rows to the other components in the block, at most one for each component."""
    ids, sizes, flat, first, kinds = _loaded(table)
    cell_of, asks = table.column("component").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
    order = np.flatnonzero(~asks)
    queries = np.flatnonzero(asks)
    if not len(order) or not len(queries):
        return []
    order = order[np.argsort(cell_of[order], kind="stable")]
    cells = cell_of[order]
    begin = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    tokens, starts = _cut(order, flat, first)
    cell_rank = np.cumsum(np.concatenate(([False], cells[1:] != cells[:-1])))
    unions = np.unique(np.repeat(cell_rank, sizes[order]).astype(np.int64) * kinds + tokens)
    union_starts, union_tokens = np.searchsorted(unions, np.arange(len(begin)) * kinds), unions % kinds
    ends = np.concatenate((begin[1:], [len(order)]))
    out, flag = [], np.zeros(kinds, bool)
    for q in queries.tolist():
        mine = flat[first[q] : first[q + 1]]
        flag[mine] = True
        bound = np.add.reduceat(flag[union_tokens], union_starts, dtype=np.int64)
        for c in np.flatnonzero((100 * bound >= percent * sizes[q]) & (cells[begin] != cell_of[q])).tolist():
            docs = order[begin[c] : ends[c]]
            own, own_starts = _cut(docs, flat, first)
            both = np.add.reduceat(flag[own], own_starts, dtype=np.int64)
            near = np.flatnonzero(100 * both >= percent * (sizes[docs] + sizes[q] - both))
            if len(near):
                out.append((int(ids[q]), int(ids[docs[near[0]]])))
        flag[mine] = False
    return out


def _pairs_table(pairs: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.table({"doc": pa.array(a, pa.int64()), "root": pa.array(b, pa.int64())})


def hot_tokens(docs: DataFrame, words: int, percent: int) -> DataFrame | None:
    """Tokens that so many documents seem to have that one task should not get all their rows; None if there are none.

    Guessed from one document in HOT_SAMPLE. At most some thousands, as a document has few tokens and a hot one is in a share of
    all documents. The list decides how a token's rows are dealt out, not what becomes of them.
    """
    least = max(HOT_ROWS, docs.count() * common.HOT_SHARE) / HOT_SAMPLE
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0)
    found = common.stored(tokens_of(sample, words, percent).groupBy("token").count().where(F.col("count") >= 0.6 * least).select("token"), "op8-hot")
    return None if found.isEmpty() else found


def with_facts(rows: DataFrame, hot: DataFrame | None, **facts: str) -> DataFrame:
    """rows (token, ...) with aggregates over the rows of a token: by window, for hot tokens by partial sums and a broadcast."""

    def by_window(df: DataFrame) -> DataFrame:
        return df.withColumns({name: F.expr(f"{what} over (partition by token)") for name, what in facts.items()})

    if hot is None:
        return by_window(rows)
    own = rows.join(F.broadcast(hot), "token")
    sums = own.groupBy("token").agg(*(F.expr(what).alias(name) for name, what in facts.items()))
    cold = by_window(rows.join(F.broadcast(hot), "token", "left_anti"))
    return cold.unionByName(own.join(F.broadcast(sums), "token"))


def in_several(tokens: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """The rows of tokens that two documents or more have, with each one's leader."""
    return with_facts(tokens, hot, leader="min(doc)", last="max(doc)").where("leader != last").drop("last")


def rarest(shared: DataFrame, common_ones: int, hot: DataFrame | None = None) -> DataFrame:
    """Of shared (token, doc, kind, need, ...) the rows of tokens that are rare for their document.

    Of the tokens that two linked documents share in an instance the k-th in order of rarity
    comes, for either of them, before at least need - k others: so the first common_ones (or
    need, if that is less) are among the rarest all - need + common_ones of both.
    """
    ranked = with_facts(shared, hot, seen="count(*)").withColumn("rank", F.expr("row_number() over (partition by doc, kind order by seen, token)"))
    whole = ranked.withColumn("all", F.expr("count(*) over (partition by doc, kind)")).withColumn("least", F.expr("min(need) over (partition by doc, kind)"))
    return whole.where(F.col("rank") <= F.col("all") - F.col("least") + common_ones).drop("seen", "rank", "all", "least")


def that_may_link(shared: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """The doc of each document that has a rare token in common with another."""
    return in_several(rarest(shared, 1, hot).select("token", "doc"), hot).select("doc").distinct()


def opened_groups(shared: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """shared (token, doc, kind, need, n, leader) -> (room, doc, n): each group with its members and the visitors it opens for."""
    enough = shared.groupBy("doc", "kind").agg(F.count("*").alias("all"), F.min("need").alias("least")).where("all >= least").select("doc", "kind")
    shared = common.stored(shared.join(enough, ["doc", "kind"]), "op8-enough")
    ties = shared.groupBy("doc", "leader").agg(F.count("*").alias("ties"), F.max("n").alias("n"))
    most = ties.groupBy("doc").agg(F.max("ties").alias("most"))
    home = ties.join(most, "doc").where(STRONG * F.col("ties") >= F.col("most")).groupBy("doc").agg(F.min("leader").alias("room"), F.max("n").alias("n"))
    placed = shared.drop("n").join(home.withColumnRenamed("room", "own"), "doc")
    placed = common.stored(rarest(placed, RARE, hot), "op8-rarest")
    matrix = placed.select("token", F.col("own").alias("room")).distinct()
    # of two groups only the one with the larger name visits the other: either meeting would do
    meets = placed.join(matrix, "token").where("room < own").groupBy("doc", "room", "kind").agg(F.count("*").alias("both"), F.min("need").alias("need"), F.max("n").alias("n"))
    return meets.where(F.col("both") >= F.least("need", F.lit(RARE))).select("room", "doc", "n").unionByName(home.select("room", "doc", "n")).distinct()


def rooms_in_blocks(opened: DataFrame) -> DataFrame:
    """(room, block, blocks, doc): rooms of two or more, the large ones in blocks."""
    sizes = opened.groupBy("room").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).where("docs > 1")
    blocks = F.greatest(F.ceil(F.col("docs") / ROOM_DOCS), F.ceil(F.col("shingles") / ROOM_SHINGLES)).cast("int")
    sized = common.join_on_hot_key(opened.select("room", "doc"), sizes.select("room", "docs", blocks.alias("blocks")), "room", "docs", F.col("doc"))
    placed = sized.where("blocks is not null").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    firsts = sizes.where(blocks > 1).select("room", blocks.alias("blocks"), F.col("room").alias("doc"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    return placed.unionByName(firsts).distinct()


def links_between_blocks(rooms: DataFrame, docs: DataFrame, words: int, found: DataFrame, percent: int) -> DataFrame | None:
    """Links of documents outside the largest component of a split room to documents in all its blocks."""
    split = rooms.where("blocks > 1").join(found, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    per_part = split.groupBy("room", "component").agg(F.count("*").alias("docs"))
    largest = per_part.groupBy("room").agg(F.max_by("component", F.struct("docs", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    open_rooms = common.stored(split.join(largest.select("room", "main"), "room"), "op8-open")
    if open_rooms.isEmpty():
        return None
    asking = open_rooms.where("component != main").select("room", "block", "blocks", "doc", "component")
    # every block of the room with the askers of each block in turn
    all_blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ask = asking.select("room", F.col("block").alias("from"), all_blocks.alias("block"), "doc", "component", F.lit(True).alias("asks"))
    targets = open_rooms.join(asking.select("room", F.col("block").alias("from")).distinct(), "room").select("room", "from", "block", "doc", "component", F.lit(False).alias("asks"))
    both = placed_sets(docs, common.stored(ask.unionByName(targets), "op8-asked"), words)
    return both.groupBy("room", "from", "block").applyInArrow(lambda t: _pairs_table(cell_links(t, percent)), "doc long, root long")


def components_of(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id for each row."""
    common.ship(docs.sparkSession)
    facts = common.stored(described(docs, words), "op8-sets")
    classes = facts.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    classes = common.stored(classes, "op8-classes")
    # documents that another one stands for
    members = common.join_on_hot_key(facts.where("doc_id is not null").select("doc_id", "sig"), classes.where("copies > 1"), "sig", "copies", F.col("doc_id"))
    copies = common.stored(members.where("doc_id != first").select("doc_id").distinct(), "op8-copies")
    # hashed again rather than stored: only one shuffle of tokens is on disk
    stand = common.by_ids(docs.select("doc_id", "text").where("doc_id is not null"), copies, "doc_id", "left_anti")
    tokens = tokens_of(stand, words, percent)
    hot = hot_tokens(stand, words, percent)
    shared = common.stored(in_several(tokens, hot).drop("leader").distinct(), "op8-shared")
    linked = common.stored(that_may_link(shared, hot), "op8-linked")
    shared = in_several(common.by_ids(shared, linked, "doc", "left_semi"), hot)

    rooms = common.stored(rooms_in_blocks(common.stored(opened_groups(shared, hot), "op8-opened")), "op8-rooms")
    edges = placed_sets(docs, rooms.select("doc", "room", "block"), words).groupBy("room", "block")
    edges = common.stored(edges.applyInArrow(lambda t: _pairs_table(room_components(t, percent)), "doc long, root long").distinct(), "op8-edges")
    found = common.stored(components.of_stars(edges), "op8-components")
    more = links_between_blocks(rooms, docs, words, found, percent)
    if more is not None:
        more = common.stored(more.distinct(), "op8-more")
        turned = more.select(F.greatest("doc", "root").alias("doc"), F.least("doc", "root").alias("root"))
        own = turned.select(F.col("root").alias("doc"), "root")
        found = common.stored(components.of_stars(edges.unionByName(turned).unionByName(own).distinct()), "op8-components")
    named = classes.join(found.select(F.col("doc").alias("first"), "component"), "first", "left").select("sig", "copies", F.coalesce("component", "first").alias("component"))
    done = common.join_on_hot_key(facts.select("doc_id", "n", "sig"), named, "sig", "copies", F.coalesce("doc_id", F.lit(0)))
    return done.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def op8_token_group_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(common.table(sf_dir, "documents", spark).select("doc_id", "text"))
