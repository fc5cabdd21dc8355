"""MinHash near-duplicates with b-bit signatures.

Bands of minima give candidates. Of each minimum the low bits stay, packed into a signature; the similarity of two
signatures is counted in bits and corrected for chance collisions. Documents whose buckets meet form clusters; within
a cluster, in blocks of bounded size, every pair of signatures above a safe estimate is confirmed on the full shingle
sets, unless the two are linked already. Only links that join something are kept, so a group of copies costs rows in
proportion to its size. Then all signatures of each bucket are compared, except those in one group by then, and pairs
above the safe estimate are confirmed too: whatever the clusters are, no pair that shares a bucket is left out. A pair
that shares several buckets is compared in the first; the estimate is made finer by a second signature, of one
permutation cut into bins. Pairs never are rows: a task hands on each document with its possible partners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, hash_arrays
from .components import connected_components, join_one
from .hash_arrays import groups

#: Minima, bands and rows of a band: two documents with similarity 0.8 share no band once in 2*10**7 pairs.
MINIMA, BANDS, ROWS = 128, 32, 4
#: Low bits that stay of each minimum, and the packed signature's 64-bit words.
LOW_BITS = 4
SIGNATURE_WORDS = MINIMA * LOW_BITS // 64
#: Estimates from which buckets join a cluster, and from which a pair is compared further and confirmed. At 0.8 the
#: signature's deviation is 0.037, the finer one's 0.019 at most: the bounds are four deviations below.
CLUSTER_FROM, COMPARE_FROM, CONFIRM_FROM = 0.5, 0.65, 0.72
#: Bins of the finer signature, of 4 bits each: 0 for an empty bin, else 1 to 15.
BINS, FINE_WORDS = 512, 32
#: Documents and shingles that one block holds, and the central documents that every block of a cluster gets.
BLOCK_DOCS, BLOCK_SHINGLES, CENTRES = 500, 1_000_000, 8
#: Signatures of a part of a crowded bucket; its parts are compared two by two.
BUCKET_DOCS = 500
_CHANCE = 2.0**-LOW_BITS
_rng = np.random.default_rng(0xB17)
_A = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)
_NIBBLE = 0x1111111111111111


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingle hashes in order; a shorter text is one shingle, a text without words none."""
    if not len(words):
        return np.empty(0, np.uint64)
    s = np.sort(common.rolled(words, min(width, len(words))))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 2048):
        np.minimum(best, (x[None, a : a + 2048] * _A[:, None] + _B[:, None]).min(axis=1), out=best)
    return best


def signature(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, packed into 64-bit words."""
    low = (least & np.uint32((1 << LOW_BITS) - 1)).astype(np.uint64).reshape(SIGNATURE_WORDS, -1)
    return np.bitwise_or.reduce(low << (np.arange(low.shape[1], dtype=np.uint64) * np.uint64(LOW_BITS)), axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    v = least.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = common.mix(key * np.uint64(0x9E3779B97F4A7C15) + v[:, r])
    return key


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of a signature, or of each row of ``one``, to each row of ``many``."""
    apart = one ^ many
    x = apart
    for s in range(1, LOW_BITS):
        x = x | (apart >> np.uint64(s))
    differ = np.bitwise_count(x & np.uint64(_NIBBLE)).sum(axis=1)
    return ((1 - differ / MINIMA) - _CHANCE) / (1 - _CHANCE)


def fine(shingles: np.ndarray) -> np.ndarray:
    """The finer signature of a sorted set: the top bits of a hash name its bin, the least hash of a bin stays."""
    where = (shingles >> np.uint64(55)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else where
    out = np.zeros(BINS, np.uint8)
    out[where[first]] = common.mix(shingles[first]) % np.uint64(15) + np.uint64(1)
    return (out[::2] | (out[1::2] << 4)).view(np.uint64)


def _filled(x: np.ndarray) -> np.ndarray:
    x = x | (x >> np.uint64(1))
    return (x | (x >> np.uint64(2))) & np.uint64(_NIBBLE)


def fine_estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of finer signatures, row by row: bins that agree over bins that either fills."""
    a, b = _filled(one), _filled(many)
    either = np.bitwise_count(a | b).sum(axis=1, dtype=np.int64)
    both = np.bitwise_count(a & b).sum(axis=1, dtype=np.int64)
    differ = np.bitwise_count(_filled(one ^ many) & a & b).sum(axis=1, dtype=np.int64)
    return (both - differ * (15 / 14)) / np.maximum(either, 1)


def estimate_column(a: Column, b: Column) -> Column:
    """The same, of two array<long> columns."""
    differ = F.lit(0)
    for i in range(SIGNATURE_WORDS):
        x = a[i].bitwiseXOR(b[i])
        y = x
        for s in range(1, LOW_BITS):
            y = y.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = differ + F.bit_count(y.bitwiseAND(F.lit(_NIBBLE).cast("long")))
    return ((1 - differ / MINIMA) - _CHANCE) / (1 - _CHANCE)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * shared >= percent * united, on full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


class Links:
    """Union-find over the members of a block that starts from the groups known so far."""

    def __init__(self, labels: list):
        first: dict = {}
        self.up = [first.setdefault(label, i) for i, label in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)


def link_block(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members that join two groups; the most central members come first."""
    marks = np.array([fine(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    state, found = Links(list(range(len(sets)))), []
    for i in range(len(sets)):
        fits = (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])) & (fine_estimates(marks[i : i + 1], marks) >= CONFIRM_FROM)
        for j in np.flatnonzero(fits[:i]).tolist():
            if state.find(i) != state.find(j) and alike(sets[i], sets[j], percent):
                state.join(i, j)
                found.append((i, j))
    return found


def digests(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set: the first names its node, unless other sets have it too; then the second does."""
    raw = shingles.tobytes()
    return xxhash.xxh3_64_intdigest(raw) - 2**63, xxhash.xxh3_64_intdigest(raw, 0xB17) - 2**63


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.text_bytes(batch["text"])
            for a, b in common.blocks(offsets):
                h, counts = common.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
                ends = np.concatenate([[0], np.cumsum(counts)]).tolist()
                n, nodes, others, marks, fines, bands, lows = [], [], [], [], [], [], []
                for i, j in zip(ends, ends[1:]):
                    s = shingle_set(h[i:j], width)
                    n.append(len(s))
                    if len(s):
                        least = minima(s)
                        node, other = digests(s)
                        nodes.append(node)
                        others.append(other)
                        marks.append(signature(least).view(np.int64))
                        fines.append(fine(s).tobytes())
                        bands.append((keys := band_keys(least)).view(np.int64))
                        lows.append(keys.astype(np.uint32).tobytes())
                    else:
                        nodes.append(None)
                        others.append(None)
                        marks.append(None)
                        fines.append(None)
                        bands.append(None)
                        lows.append(None)
                long = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(others, pa.int64()), pa.array(marks, long), pa.array(fines, pa.binary()), pa.array(bands, long), pa.array(lows, pa.binary())], names=["doc_id", "n_shingles", "node", "other", "mark", "fine", "bands", "low_bands"])

    return run


def _linker(width: int, percent: int):
    """Rows (key, node, rank, text) with equal keys together; links (a, b) come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, "key"):
            members: dict[int, tuple] = {}
            for r in rows:
                s = shingle_set(common.text_word_hashes(r["text"], lower=True), width)
                if len(s) and r["node"] in digests(s):
                    members[r["node"]] = (s, (-r["rank"], r["node"]))
            nodes = sorted(members, key=lambda x: members[x][1])
            found = link_block([members[x][0] for x in nodes], percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], names=["a", "b"])

    return run


def _comparer(percent: int):
    """Rows (key, band, side, node, label, n_shingles, mark, fine, low_bands) with equal keys together; each node that may be
    linked with others comes out once for a key, as (key, node, partners), a pair being with one of its two nodes. Rows
    of one label are not compared, nor those of one side unless it is negative, nor those that share an earlier band."""

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, band, side, node, label, size = (rows[c].to_numpy() for c in ("key", "band", "side", "node", "label", "n_shingles"))
        wide = lambda c, n, t: np.frombuffer(b"".join(rows[c].to_pylist()), t).reshape(-1, n)
        mark = rows["mark"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SIGNATURE_WORDS)
        finer, bands = wide("fine", FINE_WORDS, np.uint64), wide("low_bands", BANDS, np.int32)
        earlier = np.arange(BANDS)[None, :]
        step, at, found = 1, np.flatnonzero(key[1:] == key[:-1]), []
        while len(at):
            to = at + step
            fits = (label[at] != label[to]) & ((side[at] != side[to]) | (side[at] < 0)) & (100 * np.minimum(size[at], size[to]) >= percent * np.maximum(size[at], size[to]))
            i, j = at[fits], to[fits]
            near = estimates(mark[i], mark[j]) >= COMPARE_FROM
            i, j = i[near], j[near]
            near = ((bands[i] == bands[j]) & (earlier < band[i][:, None])).any(axis=1)
            i, j = i[~near], j[~near]
            near = fine_estimates(finer[i], finer[j]) >= CONFIRM_FROM
            found.append((i[near], j[near]))
            step += 1
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
        i, j = (np.concatenate(x) if found else np.empty(0, np.int64) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
        if len(i):
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            whose, first = np.unique(i, return_index=True)
            alone = np.setdiff1d(j, i)
            ends = np.concatenate([first, np.full(len(alone) + 1, len(i))]).astype(np.int32)
            who = np.concatenate([whose, alone])
            yield pa.RecordBatch.from_arrays([pa.array(key[who]), pa.array(node[who]), pa.ListArray.from_arrays(pa.array(ends), pa.array(node[j]))], names=["key", "node", "partners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch["key"].to_numpy()
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # from here on the last key, of which more may follow
            if cut:
                yield from compare(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from compare(pa.Table.from_batches(held))

    return run


def possible_partners(seats: DataFrame, marks: DataFrame, percent: int, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """(key, node, partners): the nodes that share a bucket, differ in label and are estimated from CONFIRM_FROM on; each
    pair stands once, in the first bucket that its two nodes share.

    ``seats`` has bucket, band and node, ``marks`` node, label, n_shingles, mark, fine and low_bands. The members of a
    crowded bucket are dealt over parts of bounded documents and shingles; those in its largest group are compared with
    the others only.
    """
    seated = seats.select("bucket", "band", "node").join(marks.select("node", "label", "n_shingles"), "node")
    most = seated.groupBy("bucket", "label").agg(F.count("*").alias("count"), F.sum("n_shingles").alias("shingles"))
    most = most.groupBy("bucket").agg(F.sum("count").alias("docs"), F.sum("shingles").alias("shingles"), F.max(F.struct("count", "label", "shingles")).alias("most")).where("docs > most.count")
    parts = lambda docs, shingles: F.greatest(F.ceil(docs / bucket_docs), F.ceil(shingles / BLOCK_SHINGLES))
    most = most.select("bucket", F.col("docs").alias("n"), F.col("most.label").alias("main"), parts(F.col("docs") - F.col("most.count"), F.col("shingles") - F.col("most.shingles")).alias("others"), parts(F.col("most.count"), F.col("most.shingles")).alias("mains"), (parts(F.col("docs"), F.col("shingles")) <= 1).alias("small"))
    most = common.written(most, "open-buckets")
    total = most.agg(F.sum("n")).first()[0] or 0
    seated = join_one(seated.drop("n_shingles"), most, "bucket", total).withColumn("other", F.col("label") != F.col("main"))
    seated = seated.withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), F.when(F.col("other"), F.col("others")).otherwise(F.col("mains"))))
    zero, small = F.lit(0).cast("long"), F.col("small")
    last = F.when(F.col("other"), F.col("others") + F.col("mains")).otherwise(F.col("others")) - 1
    seated = seated.withColumn("meets", F.explode(F.when(small, F.array(zero)).otherwise(F.sequence(zero, last))))
    # parts 0 to others - 1 are the others', those that follow the largest group's
    own = F.when(F.col("other"), F.col("part")).otherwise(F.col("others") + F.col("part"))
    low, high = F.when(small, zero).otherwise(F.least(own, "meets")), F.when(small, zero).otherwise(F.greatest(own, "meets"))
    side = F.when(small | (own == F.col("meets")), -1).when(own < F.col("meets"), 0).otherwise(1).cast("long")
    marks = marks.select("node", "n_shingles", "mark", "fine", "low_bands")
    tasks = seated.select(F.xxhash64("bucket", low, high).alias("key"), F.col("band").cast("long").alias("band"), side.alias("side"), "node", "label").join(marks, "node")
    return _dealt(tasks).mapInArrow(_comparer(percent), "key long, node long, partners array<long>")


def _confirmer(width: int, percent: int):
    """Rows (key, node, label, partners, text) with equal keys together; links (a, b) of partners that join two groups
    come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, "key"):
            members: dict[int, tuple] = {}
            for r in rows:
                s = shingle_set(common.text_word_hashes(r["text"], lower=True), width)
                if len(s) and r["node"] in digests(s):
                    members[r["node"]] = (s, r["label"], r["partners"])
            nodes = list(members)
            place, state, found = {x: i for i, x in enumerate(nodes)}, Links([members[x][1] for x in nodes]), []
            for a in nodes:
                for b in members[a][2]:
                    if state.find(place[a]) != state.find(place[b]) and alike(members[a][0], members[b][0], percent):
                        state.join(place[a], place[b])
                        found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return run


def told_apart(sketch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``sketch`` (doc_id, node, other, n_shingles and more) with a node of its own for every set, and (node, head): the
    smallest doc_id of each. Where sets that differ in the second digest or in size share a node, which happens to about
    one pair in 2**64, the second digest becomes their node."""
    met = sketch.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("head"), F.min("other").alias("low"), F.max("other").alias("high"), F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    met = common.written(met, "node-heads")
    shared = met.where("low <> high or least <> most").select("node", F.lit(True).alias("shared"))
    if shared.limit(1).count():
        sketch = sketch.join(shared, "node", "left").withColumn("node", F.when(F.col("shared"), F.col("other")).otherwise(F.col("node")))
        sketch = common.written(sketch.drop("shared"), "sketch")
        met = sketch.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("head"))
    return sketch, met.where("head is not null").select("node", "head")


def in_blocks(cluster: DataFrame, nodes: DataFrame, block_docs: int) -> DataFrame:
    """node, cluster, head, n_shingles, n_blocks, block: the members of each cluster (node, root) dealt over its blocks."""
    member = common.written(cluster.withColumnRenamed("root", "cluster").join(nodes.select("node", "head", "n_shingles"), "node"), "cluster-members")
    room = member.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    room = room.select("cluster", "n", F.greatest(F.ceil(F.col("n") / block_docs), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("n_blocks"))
    return join_one(member, room, "cluster", member.count()).withColumn("block", F.pmod(F.xxhash64("node"), "n_blocks"))


def confirmed(partners: DataFrame, nodes: DataFrame, labels: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) among ``partners`` (key, node, partners). A text is moved once for each key that it has partners in."""
    member = common.written(partners.select("node").distinct().join(nodes.select("node", "head"), "node").join(labels, "node"), "pair-members")
    text = docs.where(hash_arrays.member("doc_id", hash_arrays.id_set(member.select("head"), "pair-ids")))
    member_text = member.join(text.withColumnRenamed("doc_id", "head"), "head").select("node", "label", "text")
    tasks = partners.join(member_text, "node").select("key", "node", "label", "partners", "text")
    return _dealt(tasks).mapInArrow(_confirmer(width, percent), "a long, b long")


@common.in_small_batches
def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, block_docs: int = BLOCK_DOCS, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text; other columns are ignored).

    Documents with 100 * shared >= percent * united distinct shingles are linked (``percent`` 80 or more: the bands are
    made for that); component_id is the smallest doc_id reachable. A null or wordless text has no shingles and is linked
    with nothing; one with fewer words than a shingle is a single shingle. Rows with equal doc_id are documents of their
    own with that id. A row with a null doc_id is linked with nothing: component_id null, kept true. An empty table
    gives an empty result.

    Equal sets are one node, so exact copies never meet in a bucket; sets count as equal if two digests, 128 bits in all,
    and their sizes are. Of a cluster only the most central documents are
    compared with all others, block by block. What that leaves in different groups is compared by signatures, bucket by
    bucket, and only the texts of pairs that may be linked are moved again.
    """
    if percent < 80:
        raise ValueError("the bands are made for a similarity of 80 percent or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = common.written(docs.mapInArrow(_sketch(shingle_words), "doc_id long, n_shingles long, node long, other long, mark array<long>, fine binary, bands array<long>, low_bands binary"), "sketch")
    sketch, heads = told_apart(sketch)
    named = sketch.where("node is not null and doc_id is not null")
    # one row of each node: that of its head; equal rows of the same head fall together
    nodes = named.join(heads, [named["node"] == heads["node"], named["doc_id"] == heads["head"]], "left_semi")
    nodes = common.written(nodes.groupBy("node").agg(F.min("doc_id").alias("head"), F.first("n_shingles").alias("n_shingles"), F.first("mark").alias("mark"), F.first("fine").alias("fine"), F.first("bands").alias("bands"), F.first("low_bands").alias("low_bands")), "nodes")

    banded = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    crowded = common.written(banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "crowded")
    total = crowded.agg(F.sum("size")).first()[0] or 0
    seats = common.written(join_one(banded, crowded.withColumn("n", F.col("size")), "bucket", total), "seats")
    rank = seats.groupBy("node").agg(F.sum("size").alias("rank"))  # the more company, the more central
    centre = seats.join(rank, "node").groupBy("bucket").agg(F.max(F.struct("rank", "node")).alias("top"), F.count("*").alias("n")).select("bucket", "n", F.col("top.node").alias("centre"))
    pairs = join_one(seats, common.written(centre, "centres"), "bucket", total).where("node <> centre").select("node", "centre").distinct()
    pairs = pairs.join(nodes.select("node", F.col("mark").alias("mark_a")), "node").join(nodes.select(F.col("node").alias("centre"), F.col("mark").alias("mark_b")), "centre")
    near = pairs.where(estimate_column(F.col("mark_a"), F.col("mark_b")) >= CLUSTER_FROM).select(F.col("node").alias("a"), F.col("centre").alias("b"))
    cluster = connected_components(near, "clusters")

    member = common.written(in_blocks(cluster, nodes, block_docs).join(rank, "node"), "members")
    # only the members' texts are moved from here on
    text = docs.where(hash_arrays.member("doc_id", hash_arrays.id_set(member.select("head"), "member-ids")))
    member_text = common.written(member.join(text.withColumnRenamed("doc_id", "head"), "head"), "member-texts")

    order = Window.partitionBy("cluster").orderBy(F.desc("rank"), "node")
    central = member.where("n_blocks > 1").select("cluster", "node", "rank", "n_blocks").withColumn("k", F.row_number().over(order)).where(F.col("k") <= CENTRES)
    guests = member_text.join(central.select("node"), "node", "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    task = ["cluster", "block"]
    first = member_text.unionByName(guests).select(F.xxhash64(*task).alias("key"), "node", "rank", "text")
    linked = common.written(_dealt(first).mapInArrow(_linker(shingle_words, percent), "a long, b long"), "links")

    root = connected_components(linked, "first-groups")
    marks = nodes.select("node", "n_shingles", "mark", "fine", "low_bands").join(root, "node", "left").withColumn("label", F.coalesce("root", "node"))
    left = common.written(possible_partners(seats, marks, percent, bucket_docs), "partners")
    if left.limit(1).count():
        more = common.written(confirmed(left, nodes, marks.select("node", "label"), docs, shingle_words, percent), "bucket-links")
        root = connected_components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "groups")
    component = nodes.select("node", "head").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = component.groupBy("root").agg(F.min("head").alias("component_id"))
    component = component.join(least, "root").select("node", "component_id")
    own = F.when(F.col("node").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = sketch.select("doc_id", "n_shingles", "node").join(component, "node", "left").withColumn("component_id", own)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key")
