"""Sorted arrays of 64-bit hashes with counts, built by Spark, kept in the shared folder, memory-mapped by workers.

Tasks emit packed rows (bucket, hashes, counts); the bucket is the top bits of the hash, so buckets are of even size
whatever the words are, and the sorted shards of all buckets are one sorted array. A task writes all its shards to one
file; workers map files when they first need them and hold a bounded number of them.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PACKED = "bucket int, hashes binary, counts binary"


def buckets_for(docs: DataFrame) -> int:
    """A power of two that follows the size of the input: as many buckets as it has partitions, 16 at least. ``docs`` is
    a scan, so that counting its partitions runs nothing."""
    return 1 << max(4, min(18, (docs.rdd.getNumPartitions() - 1).bit_length()))


def finer_buckets(docs: DataFrame, n_buckets: int, text_bytes: int = 4 << 20) -> int:
    """A larger power of two, so that a bucket holds what about ``text_bytes`` of text give, however large partitions are."""
    size = docs.sparkSession.conf.get("spark.sql.files.maxPartitionBytes").lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    most = int(size[:-1]) * units[size[-1]] if size[-1] in units else int(size)
    return min(1 << 18, n_buckets << max(0, (-(-most // text_bytes) - 1).bit_length()))


def packed_rows(values: np.ndarray, counts: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct ascending hashes and their counts as rows of the shuffle."""
    if not len(values):
        return
    bits = n_buckets.bit_length() - 1
    cuts = np.searchsorted(values, np.arange(n_buckets, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
    cuts = np.append(cuts, len(values)).tolist()
    rows = [(b, common.pack(values[i:j], True), common.pack(counts[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "hashes", "counts"])


class Tally:
    """Counts hashes within a task; memory stays bounded, since what has gathered is handed out when it is too much."""

    def __init__(self, n_buckets: int, most: int = 3_000_000):
        self.n_buckets, self.most = n_buckets, most
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(common.sorted_counts(hashes))
        self.size += len(self.parts[-1][0])
        if self.size > self.most:
            self._merge()
            if self.size > self.most // 2:
                yield from self.finish()

    def _merge(self) -> None:
        if len(self.parts) > 1:
            self.parts = [common.sorted_counts(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))]
            self.size = len(self.parts[0][0])

    def finish(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        if self.parts:
            yield from packed_rows(*self.parts[0], self.n_buckets)
        self.parts, self.size = [], 0


PAIRS = "bucket int, keys binary, beside binary, counts binary"


def counted_pairs(keys: np.ndarray, beside: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, value beside it) in order with their sums of ``n``."""
    order = np.lexsort((beside, keys))
    keys, beside, n = keys[order], beside[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (beside[1:] != beside[:-1])])) if len(keys) else np.empty(0, np.int64)
    return keys[new], beside[new], np.add.reduceat(n, new) if len(new) else n


class PairTally:
    """Counts pairs of a key and a value within a task; what has gathered is handed out when it is too much."""

    def __init__(self, n_buckets: int, most: int = 1_200_000):
        self.n_buckets, self.most, self.parts, self.size = n_buckets, most, [], 0

    def add(self, keys: np.ndarray, beside: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(counted_pairs(keys, beside.astype(np.uint64), np.ones(len(keys), np.int64)))
        self.size += len(self.parts[-1][0])
        if self.size > self.most:
            yield from self.finish()

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            keys, beside, n = counted_pairs(*(np.concatenate(x) for x in zip(*self.parts)))
            bits = self.n_buckets.bit_length() - 1
            cuts = np.append(np.searchsorted(keys, np.arange(self.n_buckets, dtype=np.uint64) << np.uint64(64 - bits)), len(keys)).tolist()
            rows = [(b, common.pack(keys[i:j], True), common.pack(beside[i:j]), common.pack(n[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
            types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["bucket", "keys", "beside", "counts"])
        self.parts, self.size = [], 0


def merged_pairs(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, beside, n = counted_pairs(*(np.concatenate([common.unpack(r[x], x == "keys") for r in rows]) for x in ("keys", "beside", "counts")))
    return keys, beside, n.astype(np.int64)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Rows of each key, from batches in which equal keys follow each other."""
    held, at = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != at:
                yield at, held
                held = []
            at = row[key]
            held.append(row)
    if held:
        yield at, held


def by_bucket(packed: DataFrame, n_buckets: int) -> DataFrame:
    return packed.repartition(n_buckets, "bucket").sortWithinPartitions("bucket")


def merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    values = np.concatenate([common.unpack(r["hashes"], True) for r in rows])
    counts = np.concatenate([common.unpack(r["counts"]) for r in rows]).astype(np.int64)
    return common.sorted_counts(values, counts)


#: Where a shard is: its bucket, its file's place in the list of files, how many hashes it has and how many the shards
#: before it have, and the bytes at which its hashes, the values beside them and the large counts begin.
_SHARD = np.dtype([(x, "<i8") for x in ("bucket", "file", "size", "first", "hashes", "beside", "large", "n_large")])
_LARGE = 255


class Writer:
    """Writes the sorted shards of a task's buckets to one file."""

    def __init__(self, uri: str, label: str):
        self.uri, self.label, self.out, self.rows, self.total = uri, label, None, [], 0

    def add(self, bucket: int, hashes: np.ndarray, counts: np.ndarray | None, second: np.ndarray | None = None) -> None:
        """A count takes a byte; from 255 on, it stands in a list of its own. ``second`` stands in place of counts."""
        if not len(hashes):
            return
        self.out = self.out or common.ArrayFile(self.uri, self.label)
        large = np.flatnonzero(counts >= _LARGE) if counts is not None else np.empty(0, np.int64)
        at = [self.out.put(hashes), self.out.put(second if counts is None else np.minimum(counts, _LARGE).astype(np.uint8))]
        at.append(self.out.put(np.concatenate([large, counts[large]]).astype(np.int64)) if len(large) else 0)
        self.rows.append((bucket, 0, len(hashes), 0, *at, len(large)))
        self.total += int(counts.sum()) if counts is not None else 0

    def close(self) -> tuple[str, bytes, int] | None:
        """The file's name, its shards and the sum of their counts, for ``record``; nothing if there is no shard."""
        if self.out is None:
            return None
        self.out.close()
        return self.out.name, np.array(self.rows, _SHARD).tobytes(), self.total


FILES = "file string, shards binary, total long"


def file_batch(closed: tuple[str, bytes, int] | None) -> Iterator[pa.RecordBatch]:
    if closed:
        yield pa.RecordBatch.from_arrays([pa.array([closed[0]]), pa.array([closed[1]], pa.binary()), pa.array([closed[2]], pa.int64())], names=["file", "shards", "total"])


def record(uri: str, n_buckets: int, files: list[tuple[str, bytes, int]], counted: bool = True) -> dict:
    """What workers need to find the shards of all files: some bytes for each shard, whatever it holds."""
    parts = []
    for i, (_, raw, _) in enumerate(files):
        parts.append(np.frombuffer(raw, _SHARD).copy())
        parts[-1]["file"] = i
    shards = np.concatenate(parts) if parts else np.empty(0, _SHARD)
    shards = shards[np.argsort(shards["bucket"], kind="stable")]
    shards["first"] = np.cumsum(shards["size"]) - shards["size"]
    return {"uri": uri, "n_buckets": n_buckets, "files": [f[0] for f in files], "shards": shards, "counted": counted, "size": int(shards["size"].sum()), "total": sum(f[2] for f in files)}


def store(packed: DataFrame, n_buckets: int, label: str) -> dict:
    """Merge packed rows and write a shard per bucket; the record of all shards comes back."""
    uri = common.scratch(packed.sparkSession, label)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(uri, label)
        for bucket, rows in groups(batches, "bucket"):
            writer.add(bucket, *merged(rows))
        yield from file_batch(writer.close())

    return record(uri, n_buckets, [tuple(r) for r in by_bucket(packed, n_buckets).mapInArrow(write, FILES).collect()])


def store_repeated(pairs: DataFrame, n_buckets: int, label: str) -> dict:
    """The pairs of two hashes that were met twice or more: a record as that of ``store``, with the second hash in place
    of a count. Where repeated pairs differ in the second hash only, those after the first are in the record itself."""
    uri = common.scratch(pairs.sparkSession, label)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, ties = Writer(uri, label), []
        for bucket, rows in groups(batches, "bucket"):
            keys, second, n = merged_pairs(rows)
            keys, second = keys[n > 1], second[n > 1]
            again = np.concatenate([[False], keys[1:] == keys[:-1]]) if len(keys) else np.empty(0, bool)
            ties += zip(keys[again].view(np.int64).tolist(), second[again].view(np.int64).tolist())
            writer.add(bucket, keys[~again], None, second[~again])
        for batch in file_batch(writer.close()):
            yield batch.append_column("ties", pa.array([ties], pa.list_(pa.list_(pa.int64()))))

    found = by_bucket(pairs, n_buckets).mapInArrow(write, f"{FILES}, ties array<array<long>>").collect()
    return record(uri, n_buckets, [tuple(r)[:3] for r in found], counted=False) | {"ties": {tuple(x) for r in found for x in r.ties}}


class HashArrays:
    """The stored arrays. A shard is mapped when a hash within its range is first looked up."""

    def __init__(self, record: dict):
        self.record, self.shards = record, record["shards"]
        shift = np.uint64(64 - record["n_buckets"].bit_length() + 1)
        self.lows = self.shards["bucket"].astype(np.uint64) << shift if record["n_buckets"] > 1 else np.zeros(len(self.shards), np.uint64)
        self.highs = self.lows + ((np.uint64(1) << shift) - np.uint64(1) if record["n_buckets"] > 1 else np.uint64(2**64 - 1))

    def _part(self, shard: np.void, field: str, size: int, dtype) -> np.ndarray:
        return common.array_part(self.record["uri"], self.record["files"][shard["file"]], int(shard[field]), size, dtype)

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the whole sorted array (-1: absent) and count (0: absent) of each hash. The queries are sorted
        first, so that the binary search walks through each shard once."""
        order = np.argsort(hashes)
        asked = hashes[order]
        place, count = np.full(len(asked), -1, np.int64), np.zeros(len(asked), np.int64)
        begins, ends = np.searchsorted(asked, self.lows, "left"), np.searchsorted(asked, self.highs, "right")
        for k in np.flatnonzero(ends > begins).tolist():
            shard, i, j = self.shards[k], int(begins[k]), int(ends[k])
            size = int(shard["size"])
            values = self._part(shard, "hashes", size, np.uint64)
            at = np.searchsorted(values, asked[i:j])
            at[at == size] = 0
            hit = np.flatnonzero(values[at] == asked[i:j])
            at = at[hit]
            place[i + hit] = int(shard["first"]) + at
            if not self.record["counted"]:
                count[i + hit] = self._part(shard, "beside", size, np.int64)[at]
                continue
            n = self._part(shard, "beside", size, np.uint8)[at].astype(np.int64)
            large = np.flatnonzero(n == _LARGE)
            if len(large):
                where, full = self._part(shard, "large", 2 * int(shard["n_large"]), np.int64).reshape(2, -1)
                n[large] = full[np.searchsorted(where, at[large])]
            count[i + hit] = n
        out_place, out_count = np.empty_like(place), np.empty_like(count)
        out_place[order], out_count[order] = place, count
        return out_place, out_count


_open: OrderedDict[str, HashArrays] = OrderedDict()


def opened(record: dict) -> HashArrays:
    """The worker's view of a record; the last two stay from task to task."""
    if record["uri"] not in _open:
        _open[record["uri"]] = HashArrays(record)
        while len(_open) > 2:
            _open.popitem(last=False)
    return _open[record["uri"]]


def id_set(ids: DataFrame, label: str) -> dict:
    """The distinct non-null values of the one long column of ``ids`` as sorted hash arrays; the hash is a bijection,
    so membership is exact."""
    ids = common.written(ids, f"{label}-rows")
    n_buckets = buckets_for(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(n_buckets)
        for batch in batches:
            yield from tally.add(common.mix(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
        yield from tally.finish()

    return store(ids.mapInArrow(run, PACKED), n_buckets, label)


def member(column: str, record: dict) -> Column:
    """Whether a long column's value is in a stored set; null is in none. Rows are filtered where they are read, so
    that a join moves only those it needs."""

    @F.pandas_udf("boolean")
    def found(values: pd.Series) -> pd.Series:
        known = values.notna().to_numpy()
        out = np.zeros(len(values), bool)
        out[known] = opened(record).lookup(common.mix(values[known].astype("int64").to_numpy().view(np.uint64)))[1] > 0
        return pd.Series(out)

    return found(F.col(column))
