"""Shared helpers of the training-data operators: scratch space, Arrow text blocks, word hashes."""

from __future__ import annotations

import ctypes
import functools
import mmap
import os
import sys
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- workers' memory


def _return_freed_memory() -> None:
    """Make arrays of a megabyte or more go back to the system when they are freed. By default glibc keeps freed blocks of
    up to 32 MB, and Arrow's own pool keeps some more, so that every worker stays as large as its largest step."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass
    pa.set_memory_pool(pa.system_memory_pool())


if TaskContext.get() is not None:  # in a worker
    _return_freed_memory()

# ---------------------------------------------------------------- tables and scratch space


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets a temporary
    one; on a cluster that is an error, since executors could not see such a folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="catalogkit-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/catalogkit/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in a folder for each value of the column ``by`` if it is given, and read it
    back; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch: a worker holds a batch of texts several times over.
BATCH_ROWS = 1000


def in_batches_of(rows: int) -> Callable:
    """What the decorated function runs at once gets Arrow batches of ``rows`` rows at most; the session's own setting
    comes back after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def decorate(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(first: DataFrame | SparkSession, *args, **kw):
            conf = (first.sparkSession if isinstance(first, DataFrame) else first).conf
            old = conf.get(key)
            try:
                if not 0 < int(old) <= rows:
                    conf.set(key, str(rows))
                return f(first, *args, **kw)
            finally:
                conf.set(key, old)

        return run

    return decorate


in_small_batches = in_batches_of(BATCH_ROWS)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` gave and that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/catalogkit/" in path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def put_array(uri: str, name: str, array: np.ndarray) -> str:
    """Store an array in the shared folder as a raw little-endian file. The name carries a random part, so
    a second attempt of the same task never disturbs the first; only the returned name is recorded."""
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    name = f"{name}-{uuid.uuid4().hex[:12]}.bin"
    with fs.open_output_stream(f"{path}/{name}") as out:
        out.write(np.ascontiguousarray(array).data if array.size else b"")
    return name


def map_array(uri: str, name: str, dtype) -> np.ndarray:
    """Memory-map an array of the shared folder. A local or mounted folder is mapped in place; from another
    store the file is first copied into an unlinked temporary file, so nothing stays behind. For arrays of bounded size;
    those that grow with the input are read by ``array_part``."""
    fs, path = open_fs(f"{uri}/{name}")
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    with tempfile.TemporaryFile() as local, fs.open_input_stream(path) as src:
        while block := src.read(1 << 22):
            local.write(block)
        local.flush()
        return np.memmap(local, dtype=dtype, mode="r") if local.tell() else np.empty(0, dtype)


class ArrayFile:
    """A file of the shared folder to which a task appends its arrays, one after the other. Its name is random, so that a
    second attempt of a task never disturbs the first."""

    def __init__(self, uri: str, label: str):
        fs, path = open_fs(uri)
        fs.create_dir(path, recursive=True)
        self.name, self.at = f"{label}-{uuid.uuid4().hex[:12]}.bin", 0
        self.out = fs.open_output_stream(f"{path}/{self.name}")

    def put(self, array: np.ndarray) -> int:
        """The byte at which the array begins, a multiple of 8."""
        at, array = self.at, np.ascontiguousarray(array)
        if array.size:
            self.out.write(array.data)
        self.out.write(bytes(-array.nbytes % 8))
        self.at += array.nbytes + -array.nbytes % 8
        return at

    def close(self) -> None:
        self.out.close()


#: Files that a worker holds mapped, and bytes of arrays that it holds from a store that cannot be mapped.
MOST_MAPPED, MOST_READ_BYTES = 256, 64 << 20
_mapped: OrderedDict[str, np.ndarray] = OrderedDict()
_read: OrderedDict[tuple, np.ndarray] = OrderedDict()


def array_part(uri: str, name: str, at: int, size: int, dtype) -> np.ndarray:
    """An array of ``size`` items that begins at byte ``at`` of a file. A mounted file is mapped when it is first used,
    without a file descriptor where Python can do so, and the least recently used ones are let go; from another store
    only the range is read, into memory."""
    dtype = np.dtype(dtype)
    if not size:
        return np.empty(0, dtype)
    whole = _mapped.get(f"{uri}/{name}")
    if whole is not None:
        _mapped.move_to_end(f"{uri}/{name}")
        return whole[at : at + size * dtype.itemsize].view(dtype)
    key = (uri, name, at, size)
    if key in _read:
        _read.move_to_end(key)
        return _read[key].view(dtype)
    fs, path = open_fs(f"{uri}/{name}")
    if isinstance(fs, pafs.LocalFileSystem):
        with open(path, "rb") as f:
            own = {"trackfd": False} if sys.version_info >= (3, 13) else {}
            whole = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **own), np.uint8)
        _mapped[f"{uri}/{name}"] = whole
        while len(_mapped) > MOST_MAPPED:
            _mapped.popitem(last=False)
        return whole[at : at + size * dtype.itemsize].view(dtype)
    with fs.open_input_file(path) as f:
        part = np.frombuffer(f.read_at(size * dtype.itemsize, at), np.uint8)
    _read[key] = part
    while len(_read) > 1 and sum(x.nbytes for x in _read.values()) > MOST_READ_BYTES:
        _read.popitem(last=False)
    return part.view(dtype)


def fold_mod(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; a null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


# ---------------------------------------------------------------- Arrow text

#: Bytes of text that one vectorised step holds; a longer document is a step of its own, hashed in parts of this size.
BLOCK_BYTES = 1 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    if data is None or len(offsets) < 2:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = last


# ---------------------------------------------------------------- words as 64-bit hashes

_rng = np.random.default_rng(0x5EED)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OTHER_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers of the hash base (or of its inverse), modulo 2**64. No more are kept than a step needs."""
    key = "inverse" if inverse else "base"
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), _UNBASE if inverse else _BASE, np.uint64)
        steps[0] = 1
        steps = np.multiply.accumulate(steps)
        if n > BLOCK_BYTES + 1:  # a single word of that length
            return steps[:n]
        _powers[key] = steps
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def rolled(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive 64-bit values."""
    n = len(values) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out, step = np.empty(n, np.uint64), max(1, BLOCK_BYTES - width)
    for at in range(0, n, step):
        part = values[at : at + step + width - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(len(part)), out=total[1:])
        out[at : at + step] = mix((total[width:] - total[:-width]) * powers(len(part) - width + 1, inverse=True))
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every run of bytes other than 0x20 and 0x09-0x0D, and words per document."""
    solid = ~_SPACE[data]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    begin[first] = solid[first]
    stop[last] = solid[last]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word and the words per document, in numpy throughout. The hash is a polynomial
    in random values of the bytes; equal words have equal hashes, and collisions are of the order n**2/2**64. ``other``
    gives a second, independent hash."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    if lower:
        data = _LOWER[data]
    start, end, counts = word_spans(data, offsets)
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):  # parts of whole words, of about BLOCK_BYTES
        first = start[i]
        j = max(i + 1, int(np.searchsorted(end, first + BLOCK_BYTES, "right")))
        part = data[first : end[j - 1]]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((_OTHER_VALUE if other else _VALUE)[part] * powers(len(part)), out=total[1:])
        h = (total[end[i:j] - first] - total[start[i:j] - first]) * powers(len(part) + 1, inverse=True)[start[i:j] - first]
        out[i:j] = mix(h + (end[i:j] - start[i:j]).astype(np.uint64))
        i = j
    return out, counts


def text_word_hashes(text: str | None, lower: bool) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return word_hashes(data, np.array([0, len(data)], np.int64), lower)[0]


def sorted_counts(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, with how often each occurs (or the sum of its weights)."""
    if not len(values):
        return values, np.empty(0, np.int64)
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
    new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    if weights is None:
        return values[new], np.diff(np.append(new, len(values)))
    return values[new], np.add.reduceat(weights, new)


# ---------------------------------------------------------------- packed integer arrays for shuffles


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Unsigned integers as bytes, each as narrow as the largest (of the differences, if ascending) needs."""
    values = np.ascontiguousarray(values, np.uint64)
    if not len(values):
        return b""
    if ascending:
        values = np.concatenate([values[:1], np.diff(values)])
    head, values = (values[:1], values[1:]) if ascending else (values[:0], values)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + head.tobytes() + values.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(packed: bytes, ascending: bool = False) -> np.ndarray:
    if not packed:
        return np.empty(0, np.uint64)
    width, at = packed[0], 1 + 8 * ascending
    raw = np.frombuffer(packed, np.uint8, offset=at).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    out = out.view(np.uint64).ravel()
    return np.cumsum(np.concatenate([np.frombuffer(packed, np.uint64, 1, 1), out])) if ascending else out


def struct_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
