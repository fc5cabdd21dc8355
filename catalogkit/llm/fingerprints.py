"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text. A chunk ends where the hash meets a mask: a strict one before
the normal length, a loose one after it (normalised chunking), never before the shortest and always at the
longest length. Boundaries depend on nearby bytes only, so an insertion shifts no chunk but those it touches.
The fingerprint is the sorted set of (digest, bytes) of the chunks; likeness of two fingerprints is the share
of bytes in common chunks.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk: shortest, normal, longest.
SHORTEST, NORMAL, LONGEST = 8, 32, 128
#: Bits of the gear hash that must be 0 before and after the normal length.
STRICT_BITS, LOOSE_BITS = 5, 3
_GEAR = np.random.default_rng(0x6EA2).integers(0, 2**32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum of the last 32 bytes' gear values, each shifted by its age."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):  # sums over 2, 4, ... 32 bytes
        if len(h) > step:
            h[step:] += h[:-step].copy() << np.uint32(step)
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    n = len(data)
    h = gear_hashes(data) >> np.uint32(32 - STRICT_BITS)
    loose = np.flatnonzero(h < (1 << (STRICT_BITS - LOOSE_BITS)))
    strict = (h[loose] == 0).tolist()
    loose = loose.tolist()
    ends, begin, i, m = [], 0, 0, len(loose)
    while begin < n:
        low, mid, high = begin + SHORTEST, begin + NORMAL, begin + LONGEST
        end = min(high, n)
        while i < m:
            at = loose[i] + 1
            if at >= end:
                break
            if at >= low and (strict[i] or at >= mid):
                end = at
                break
            i += 1
        ends.append(end)
        begin = end
    return ends


def chunk_set(text: str) -> np.ndarray:
    """The distinct chunks in order, each a number: the high 6 bytes of its digest and 2 bytes of size. The empty text
    has no chunk."""
    raw = text.encode("utf-8", "surrogatepass")
    ends = chunk_ends(np.frombuffer(raw, np.uint8))
    digest, view = xxhash.xxh3_64_intdigest, memoryview(raw)
    begins = [0, *ends[:-1]]
    digests = np.fromiter((digest(view[i:j]) for i, j in zip(begins, ends)), np.uint64, len(ends))
    return np.unique((digests & np.uint64(0xFFFFFFFFFFFF0000)) | (np.array(ends, np.uint64) - np.array(begins, np.uint64)))


def encode(chunks: np.ndarray) -> str:
    """A fingerprint as text: base64 of its numbers, high bytes first."""
    return base64.b64encode(chunks.astype(">u8").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Bytes in common chunks over the bytes of the smaller chunk set (containment); two empty sets are alike, and
    an empty and a full one are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    size = lambda x: int((x & np.uint64(0xFFFF)).sum())
    return size(np.intersect1d(a, b, assume_unique=True)) / min(size(a), size(b))


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, rows_per_bucket: int = 20_000, most_cuts: int = 20_000) -> DataFrame:
    """Fingerprint every row of ``docs`` (doc_id, text; other columns are ignored) and its edited text, which ends as the
    next row begins.

    Rows follow each other in ascending doc_id; rows with equal doc_id in the order of their texts (null first), so
    that repeated rows have a defined order. The next of the last row is the first; a single row follows itself. A
    null text is empty, and an empty text has an empty fingerprint. A null doc_id sorts first. Texts of any length are
    read whole. An empty table gives an empty result.

    Neighbours meet without a global window: quantiles of doc_id cut the rows into ranges (equal ids always share one),
    and the first row of each range also goes to the range before it. A range is sorted by Spark and read in a stream,
    two rows at a time, so its length does not matter; ``most_cuts`` bounds what passes through the driver: the cuts
    and the range heads (one id each).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, low = docs.agg(F.count("*"), F.min("doc_id")).first()
    buckets = int(min(most_cuts, max(1, n // rows_per_bucket, docs.rdd.getNumPartitions() if n >= rows_per_bucket else 1)))
    cuts = []
    if buckets > 1 and low is not None:
        q = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], buckets * 20)).first()[0]
        cuts = sorted(set(q))
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        at = np.zeros(len(ids), np.int32)
        at[known] = np.searchsorted(bounds, ids[known].astype("int64").to_numpy(), "right")
        return pd.Series(at)

    lowest = F.coalesce("doc_id", F.lit(-(2**63)))
    placed = docs.withColumn("bucket", bucket_of("doc_id"))
    heads = sorted((r["bucket"], r["head"]) for r in placed.groupBy("bucket").agg(F.min(lowest).alias("head")).collect())
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}  # the head of the first goes to the last
    previous = F.lit(None).cast("int")
    if before:
        lookup = placed.sparkSession.createDataFrame(list(before.items()), "head long, previous int")
        placed = placed.join(F.broadcast(lookup), lowest == F.col("head"), "left")  # at most most_cuts rows
        previous = F.col("previous")
    seats = F.array_compact(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest")), F.when(previous.isNotNull(), F.struct(previous.alias("b"), F.lit(True).alias("guest")))))
    seated = placed.select("doc_id", "text", F.explode(seats).alias("seat")).select("doc_id", "text", "seat.b", "seat.guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []
        for batch in batches:
            for doc_id, text, b, guest in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "b", "guest"))):
                chunks = None
                if last is not None and last[2] == b and not last[4]:
                    old, old_text, _, old_chunks, _ = last
                    chunks, new = chunk_set(text), edited(old_text, text)
                    new_chunks = chunk_set(new)
                    out.append((old, len(old_text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), encode(old_chunks), encode(new_chunks), likeness(old_chunks, new_chunks), likeness(old_chunks, chunks)))
                    if len(out) == 500:
                        yield _batch(out)
                        out = []
                # of several guests (rows equal in doc_id with the head) the first is the next row
                last = doc_id, text, b, (chunk_set(text) if chunks is None and not guest else chunks), guest
        if out:
            yield _batch(out)

    order = ["b", "guest", F.asc_nulls_first("doc_id"), "text"]
    return seated.repartition(len(heads) or 1, "b").sortWithinPartitions(*order).mapInArrow(run, _SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
