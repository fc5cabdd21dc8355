"""Best-fit packing with certified bin counts.

Each partition packs its pieces best-fit decreasing. Dual-feasible functions bound from below how many bins its
pieces need; a partition that needs no more than its bound is certified. Partitions with a gap give the documents
of their badly filled bins, certified ones those of their least filled bin, to an exchange: other, fewer partitions,
which pack and certify them again, until all are certified, one partition has all that is left, or an exchange has saved
no bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import Vocabulary, encoder


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Bins that pieces need at least; counts[l] pieces have length l. The best of the bound by volume and of two
    families of dual-feasible functions: one drops short pieces and fills up long ones, one rounds to unit fractions."""
    total = int(counts.sum())
    if not total:
        return 0
    lengths = np.arange(len(counts), dtype=np.int64)
    best = -(-int((counts * lengths).sum()) // size)
    amount, number = np.cumsum(counts * lengths), np.cumsum(counts)
    for low in range(1, size // 2 + 1):  # pieces over size-low count as size, those under low as nothing
        top = size - low
        value = int(number[-1] - number[top]) * size + int(amount[top] - amount[low - 1])
        best = max(best, -(-value // size))
    for k in range(1, 33):  # x -> x where (k+1)x/size is whole, else floor((k+1)x/size)/k
        scaled = (k + 1) * lengths
        value = int((counts * np.where(scaled % size == 0, k * lengths, scaled // size * size)).sum())
        best = max(best, -(-value // (k * size)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and what each bin holds; lengths in descending order. Bins wait by room left,
    and a bit mask of the rooms in use finds the tightest fit in one step."""
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    used = 0
    fill: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fits = used >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                used ^= 1 << room
        else:
            room, b = size, len(fill)
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += n
        if (room := room - n) > 0:
            rooms[room].append(b)
            used |= 1 << room
    return where, offset, np.array(fill, np.int64)


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, vocabulary: Vocabulary, end_id: int, size: int) -> DataFrame:
    """The pieces of each document of ``docs`` (doc_id, text): its ids and ``end_id``, cut only if longer than ``size``
    into pieces of ``size``, of which the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            for a, b, ids, counts in e.encode(batch["text"]):
                upto = np.cumsum(counts)
                wide = memoryview(np.insert(ids, upto, np.uint16(end_id)).astype("<u4").tobytes())
                counts = counts + 1
                pieces = -(-counts // size)
                doc = np.repeat(np.arange(b - a), pieces)
                k = np.arange(len(doc)) - (np.cumsum(pieces) - pieces)[doc]
                short = counts - (pieces - 1) * size  # of the first piece
                start = np.where(k, short[doc] + (k - 1) * size, 0)
                length = np.where(k, size, short[doc])
                at = (4 * ((np.cumsum(counts) - counts)[doc] + start)).tolist()
                crc = [zlib.crc32(wide[i:j]) for i, j in zip(at, [*at[1:], len(wide)])]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()).slice(a, b - a).take(pa.array(doc)), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, _PIECE)


def _packer(k: int, last: bool, size: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = int(group["group"].iloc[0])
        group = group.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True]).reset_index(drop=True)
        lengths = group["length"].to_numpy(np.int64)
        where, offset, fill = best_fit(lengths, size)
        certified = len(fill) <= lower_bound(np.bincount(lengths, minlength=size + 1), size)
        group["sequence_id"] = (np.int64(k) << 56) + (np.int64(g) << 24) + where
        group["offset"], group["certified"] = offset, certified
        free = np.zeros(len(fill), bool)
        if not last:
            free[np.argsort(fill, kind="stable")[:1]] = True  # the least filled bin may fit in with those of others
            if not certified:
                free |= fill < size
        group["released"] = free[where]
        return group.drop(columns="group")

    return run


@common.in_small_batches
def pack(docs: DataFrame, vocabulary: Vocabulary, end_id: int = 2, size: int = 1024, pieces_per_partition: int = 20_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified for each piece of ``docs`` (doc_id, text;
    other columns are ignored).

    A null text is empty and has the end id alone. Very long texts are encoded a step after the other. Repeated rows are
    packed each. A null doc_id is kept. An empty table gives an empty result. Pieces of the full size are sequences of
    their own; the others are dealt over partitions of about ``pieces_per_partition`` by a hash of the piece, so no key
    or source can fill one. ``certified`` tells whether the partition that packed the piece last met its lower bound.
    An exchange that does not save a bin is not taken, and ends the work.
    """
    pieces = common.written(cut(docs, vocabulary, end_id, size), "pieces")
    full = pieces.where(F.col("length") == size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("certified", F.lit(True))
    waiting = pieces.where(F.col("length") < size)
    n, bins, held, done, k = waiting.count(), None, None, [full], 0
    while n:
        groups = -(-n // pieces_per_partition)
        key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start", F.lit(k)), F.lit(groups)).cast("int")
        out = common.written(waiting.withColumn("group", key).groupBy("group").applyInPandas(_packer(k, groups == 1, size), f"{_PIECE}, sequence_id long, offset long, certified boolean, released boolean"), f"packed-{k}")
        # each bin has one piece at offset 0
        used, again, n = out.agg(F.count_if(F.col("offset") == 0), F.count_if((F.col("offset") == 0) & F.col("released")), F.count_if(F.col("released"))).first()
        if bins is not None and used >= bins:
            done.append(held)
            break
        done.append(out.where("not released").drop("released"))
        held, bins, k = out.where("released").drop("released"), again, k + 1
        waiting = held.select("doc_id", "piece", "start", "length", "ids_crc32")
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result
