"""SimHash near-duplicates, found by comparing fingerprints tile by tile.

A fingerprint's 64 bits are majority votes of its shingles' hashes. Fingerprints with equal population counts in each of
their four quarters form a cell, and a cell is cut into tiles of bounded size. The quarters' counts of two fingerprints
differ by no more than the number of their differing bits in sum, so tiles whose counts are farther apart than the
radius are skipped; all pairs of the other tiles are compared exactly, by exclusive-or and bit counts in numpy. Of the
links that a pair of tiles holds, only those that join two groups come out, so groups of copies cost rows in proportion
to their size.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components, join_one

SEED = 42
QUARTERS, QUARTER_BITS = 4, 16
#: A cell's number has a digit of this base for each quarter: counts are 16 at most, so that a sum of one and a difference
#: within the radius never carries into a valid digit of the next quarter.
CELL_BASE = 32
#: Fingerprints that a tile holds, in the mean of its cell; a pair of tiles is compared within one task.
TILE = 1 << 15
#: Comparisons of one numpy step.
STEP = 1 << 20
_LOWER = bytes(common._LOWER)
_GAP = re.compile(rb"[\x20\x09-\x0d]")


def _word_runs(raw: bytes, width: int) -> Iterator[list[bytes]]:
    """The words of a text in runs of bounded size; each run begins with the last ``width`` - 1 words of the one before."""
    held, at = [], 0
    while at < len(raw):
        end = at + common.BLOCK_BYTES
        gap = _GAP.search(raw, end) if end < len(raw) else None
        end = gap.start() if gap else len(raw)
        words = held + raw[at:end].split()
        yield words
        held, at = words[max(0, len(words) - width + 1) :], end


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of ``width`` words, repeats included, in runs; fewer words are one shingle, no words none."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    words, met = [], False
    for words in _word_runs(raw, width):
        if len(words) >= width:
            met = True
            joined = b" ".join(words)
            end = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
            begin = [0, *(e + 1 for e in end[: len(words) - width])]
            yield np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begin, end[width - 1 :])], np.uint64)
    if words and not met:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """A bit is 1 if it is set in over half of the hashes; without words the fingerprint is zero."""
    votes, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, width):
        votes += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), width) for t in batch["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(marks.view(np.int64))], names=["doc_id", "mark"])

    return run


def joining_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs of ``a`` and ``b`` (``same``: the two are one tile) within the radius, those that join two groups."""
    both = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    up = list(range(len(both)))
    label = np.arange(len(both))
    found: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    rows = max(1, STEP // max(1, len(b)))
    for first in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a[first : first + rows, None] ^ b[None, :]) <= radius)
        i, j = i + first, j + shift
        new = label[i] != label[j]
        if new.any():
            for x, y in zip(i[new].tolist(), j[new].tolist()):
                if (p := find(x)) != (q := find(y)):
                    up[p] = q
                    found.append((x, y))
            label = np.array(up)
            while not np.array_equal(further := label[label], label):
                label = further
    i, j = (np.array(x, np.int64) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
    return both[i], both[j]


def _compare(radius: int):
    """Rows (same, left, right) of two tiles' fingerprints; links (a, b) come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, left, right in zip(batch["same"].to_pylist(), batch["left"], batch["right"]):
                a, b = (x.values.to_numpy().view(np.uint64) for x in (left, right))
                x, y = joining_links(a, b, same, radius)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    return run


def cell_column(mark: Column) -> Column:
    cell = F.lit(0)
    for q in range(QUARTERS):
        quarter = F.shiftrightunsigned(mark, q * QUARTER_BITS).bitwiseAND(F.lit((1 << QUARTER_BITS) - 1).cast("long"))
        cell = cell + F.bit_count(quarter) * CELL_BASE**q
    return cell.cast("int")


def cell_steps(radius: int) -> list[int]:
    """What leads from a cell to each cell within the radius, each pair of cells once."""
    near = [s for s in itertools.product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, s)) <= radius]
    return sorted(n for s in near if (n := sum(x * CELL_BASE**q for q, x in enumerate(s))) >= 0)


@common.in_batches_of(64)
def links(marks: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Links (a, b) among the distinct fingerprints ``marks`` (mark long) that connect all that are within the radius."""
    marks = marks.select("mark", cell_column(F.col("mark")).alias("cell"))
    # (16 + 1) ** 4 cells at most, so that the table of cells can be broadcast whatever the input
    cells = common.written(marks.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "cells")
    dealt = marks.join(F.broadcast(cells), "cell").withColumn("tile", F.pmod(F.xxhash64("mark", F.lit(3)), F.col("tiles")).cast("int"))
    tiles = common.written(dealt.groupBy("cell", "tile").agg(F.collect_list("mark").alias("marks")), "tiles")

    step = F.explode(F.array(*(F.lit(s) for s in cell_steps(radius))))
    pairs = cells.withColumn("step", step).withColumn("other", F.col("cell") + F.col("step"))
    pairs = pairs.join(F.broadcast(cells.select(F.col("cell").alias("other"), F.col("tiles").alias("other_tiles"))), "other")
    pairs = pairs.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    start = F.when(F.col("step") == 0, F.col("tile")).otherwise(0)
    pairs = pairs.withColumn("other_tile", F.explode(F.sequence(start, F.col("other_tiles") - 1)))
    pairs = pairs.select("cell", "tile", "other", "other_tile")
    left = tiles.select("cell", "tile", F.col("marks").alias("left"))
    right = tiles.select(F.col("cell").alias("other"), F.col("tile").alias("other_tile"), F.col("marks").alias("right"))
    same = ((F.col("cell") == F.col("other")) & (F.col("tile") == F.col("other_tile"))).alias("same")
    met = pairs.join(left, ["cell", "tile"]).join(right, ["other", "other_tile"]).select(same, "left", "right")
    return common.written(met.mapInArrow(_compare(radius), "a long, b long"), "mark-links")


@common.in_small_batches
def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 3, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of ``docs`` (doc_id, text; other columns, whatever their names, are
    ignored).

    fingerprint is in 16 hexadecimal digits; documents whose fingerprints differ in ``radius`` bits or fewer are linked, and
    component_id is the smallest doc_id reachable, the document's own included. A null, empty or wordless text has
    fingerprint zero and is linked like any other; very long texts are hashed whole, in parts. Rows with equal doc_id are
    documents of their own with that id, equal texts are always linked. A row with a null doc_id links nothing, and its
    component_id is null. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = common.written(docs.mapInArrow(_sketch(shingle_words), "doc_id long, mark long"), "prints")
    heads = common.written(prints.groupBy("mark").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")), "print-heads")
    root = connected_components(links(heads.where("head is not null").select("mark"), radius, tile), "print-groups")
    member = common.written(heads.join(root.withColumnRenamed("node", "mark"), "mark", "left").withColumn("root", F.coalesce("root", "mark")), "print-members")
    least = member.groupBy("root").agg(F.min("head").alias("component_id"), F.count("*").alias("n"))
    n_docs, n_marks = (x.count() for x in (prints, member))
    one = join_one(member, least, "root", n_marks).select("mark", "component_id", "n")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return join_one(prints, common.written(one, "print-components"), "mark", n_docs).select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), own)
