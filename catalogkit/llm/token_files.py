"""Token-id files: static range asymmetric numeral systems (rANS) over interleaved lanes.

One frequency table, shared by all files, gives each id a share of 2**TABLE_BITS. A file holds blocks of whole
documents in ascending doc_id order. A block is coded on its own: token i belongs to lane i mod LANES, all lanes
share one stream of 32-bit words, so that numpy codes a step of all lanes at once. The footer holds for each block a
checkpoint (place in the file, first token, first document) and checksums of the coded words and of the ids, so
blocks can be decoded in parallel and in any order.

File: b"RANS1\\n", blocks, footer (JSON), footer length (8 bytes, little-endian).
Block: lane states (uint64 x LANES), words (uint32), doc_ids (int64), tokens of each document (uint32).
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import Vocabulary, encoder

TABLE_BITS, LANES, BLOCK_TOKENS = 18, 1024, 1 << 18
_LOW = np.uint64(1 << 31)
_BITS, _WORD, _MASK = np.uint64(TABLE_BITS), np.uint64(32), np.uint64((1 << TABLE_BITS) - 1)
MAGIC = b"RANS1\n"


def shares(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**TABLE_BITS; each id that occurs has at least 1."""
    total, size = int(counts.sum()), 1 << TABLE_BITS
    if not total:
        return np.zeros(len(counts), np.uint32)
    f = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * size / total), 0).astype(np.int64)
    over = int(f.sum()) - size
    for i in np.argsort(-f, kind="stable"):  # the most frequent ids bear the rounding
        if not over:
            break
        take = min(over, int(f[i]) - 1) if over > 0 else over
        take = min(take, max(1, int(f[i]) // 4)) if over > 0 else take
        f[i] -= take
        over -= take
    return f.astype(np.uint32)


class Coder:
    def __init__(self, frequencies: np.ndarray):
        self.f = frequencies.astype(np.uint64)
        self.c = np.concatenate([[0], np.cumsum(self.f)])[:-1].astype(np.uint64)
        self.slot = np.repeat(np.arange(len(self.f)), frequencies).astype(np.uint16)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lane states and words."""
        n = len(ids)
        x = np.full(LANES, _LOW, np.uint64)
        parts = []
        for start in range((n - 1) // LANES * LANES, -1, -LANES) if n else ():
            s = ids[start : start + LANES]
            f, c, state = self.f[s], self.c[s], x[: len(s)]
            full = state >= (f << np.uint64(31 - TABLE_BITS + 32))
            if full.any():
                parts.append(state[full].astype(np.uint32))
                state = np.where(full, state >> _WORD, state)
            q = state // f
            x[: len(s)] = (q << _BITS) + (state - q * f) + c
        return x, np.concatenate(parts[::-1]) if parts else np.empty(0, np.uint32)

    def decode(self, x: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        ids, x, at = np.empty(n, np.uint16), x.copy(), 0
        for start in range(0, n, LANES):
            state = x[: min(LANES, n - start)]
            low = state & _MASK
            s = self.slot[low]
            ids[start : start + len(s)] = s
            state = self.f[s] * (state >> _BITS) + low - self.c[s]
            short = np.flatnonzero(state < _LOW)
            if len(short):
                state[short] = (state[short] << _WORD) | words[at : at + len(short)]
                at += len(short)
            x[: len(s)] = state
        if at != len(words) or not (x == _LOW).all():
            raise ValueError("a block's words don't end where its tokens do")
        return ids


class Writer:
    """One file; whole documents are added in order."""

    def __init__(self, uri: str, coder: Coder):
        fs, path = common.open_fs(uri)
        fs.create_dir(path, recursive=True)
        self.name = f"tokens-{uuid.uuid4().hex}.rans"
        self.out, self.coder = fs.open_output_stream(f"{path}/{self.name}"), coder
        self.out.write(MAGIC)
        self.place, self.tokens, self.docs, self.blocks = len(MAGIC), 0, 0, []
        self.held: list[np.ndarray] = []
        self.ids: list[int] = []
        self.waiting = 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.ids.append(doc_id)
        self.waiting += len(ids)
        if self.waiting >= BLOCK_TOKENS:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        ids = np.concatenate(self.held)
        x, words = self.coder.encode(ids)
        raw = x.tobytes() + words.tobytes() + np.array(self.ids, np.int64).tobytes() + np.array([len(h) for h in self.held], np.uint32).tobytes()
        self.out.write(raw)
        self.blocks.append({"at": self.place, "first_token": self.tokens, "first_doc": self.docs, "tokens": len(ids), "docs": len(self.held), "words": len(words), "crc": zlib.crc32(raw), "ids_crc": zlib.crc32(ids.tobytes())})
        self.place += len(raw)
        self.tokens += len(ids)
        self.docs += len(self.held)
        self.held, self.ids, self.waiting = [], [], 0

    def close(self) -> None:
        self.flush()
        foot = json.dumps(self.blocks).encode()
        self.out.write(foot + len(foot).to_bytes(8, "little"))
        self.out.close()


def read_blocks(uri: str, name: str, coder: Coder) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """(checkpoint, doc_ids, tokens of each, ids) block by block; a wrong checksum is an error."""
    fs, path = common.open_fs(f"{uri}/{name}")
    with fs.open_input_file(path) as src:
        size = src.size()
        foot = int.from_bytes(src.read_at(8, size - 8), "little")
        if src.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{name} is not a token file")
        for b in json.loads(src.read_at(foot, size - 8 - foot)):
            sizes = (8 * LANES, 4 * b["words"], 8 * b["docs"], 4 * b["docs"])
            raw = src.read_at(sum(sizes), b["at"])
            if zlib.crc32(raw) != b["crc"]:
                raise ValueError(f"a block of {name} is damaged")
            cuts = np.cumsum((0, *sizes)).tolist()
            x, words, docs, lengths = (np.frombuffer(raw[i:j], t) for i, j, t in zip(cuts, cuts[1:], (np.uint64, np.uint32, np.int64, np.uint32)))
            ids = coder.decode(x, words, b["tokens"])
            if zlib.crc32(ids.tobytes()) != b["ids_crc"]:
                raise ValueError(f"a block of {name} decodes to other ids")
            yield b, docs, lengths, ids


#: Stands for a null doc_id in the files.
NULL_ID = -(2**63)


@common.in_small_batches
def write_tokens(docs: DataFrame, vocabulary: Vocabulary, end_id: int) -> dict:
    """Encode ``docs`` (doc_id, text; others are ignored) into files of the shared folder; a small record of them comes back.

    Each text gets ``end_id`` appended; a null text is empty. Rows go in ascending doc_id (null first), rows with equal
    doc_id in the order of their compressed ids. The frequency table (one row per id of the vocabulary) and a record per
    file pass through the driver; texts and ids don't. An empty table gives no file.
    """
    spark = docs.sparkSession

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, counts, squeeze = encoder(vocabulary), np.zeros(1 << 16, np.int64), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for a, b, ids, sizes in e.encode(batch["text"]):
                ids = np.insert(ids, np.cumsum(sizes), np.uint16(end_id))
                counts += np.bincount(ids, minlength=1 << 16)
                raw, ends = memoryview(ids.tobytes()), (2 * np.cumsum(sizes + 1)).tolist()
                packed = [squeeze.compress(raw[i:j]) for i, j in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()).slice(a, b - a), pa.array(packed, pa.binary()), pa.array([False] * (b - a))], names=["doc_id", "ids", "is_count"])
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([None], pa.int64()), "ids": [counts.tobytes()], "is_count": [True]})

    path = common.scratch(spark, "token-rows")
    docs.select("doc_id", "text").mapInArrow(tokenise, "doc_id long, ids binary, is_count boolean").write.option("compression", "uncompressed").parquet(path)
    rows = spark.read.parquet(path)

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for raw in batch["ids"].to_pylist():
                total += np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_pydict({"id": np.flatnonzero(total).astype(np.int64), "n": total[total > 0]})

    found = rows.where("is_count").select("ids").mapInArrow(unfold, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most one row per id
    counts = np.zeros(1 << 16, np.int64)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    frequencies = shares(counts)
    uri = common.scratch(spark, "token-files")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, first, unsqueeze = None, None, zstandard.ZstdDecompressor()
        for batch in batches:
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist()):
                doc_id = NULL_ID if doc_id is None else doc_id
                if writer is None:
                    writer, first = Writer(uri, Coder(frequencies)), doc_id
                writer.add(doc_id, np.frombuffer(unsqueeze.decompress(raw), np.uint16))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"name": [writer.name], "first": pa.array([first], pa.int64()), "tokens": pa.array([writer.tokens], pa.int64()), "docs": pa.array([writer.docs], pa.int64())})

    placed = rows.where("not is_count").select("doc_id", "ids").repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids")
    files = sorted((r.asDict() for r in placed.mapInArrow(store, "name string, first long, tokens long, docs long").collect()), key=lambda r: r["first"])
    start = 0
    for f in files:
        f["start"], start = start, start + f["tokens"]
    return {"uri": uri, "files": files, "frequencies": frequencies}


def read_documents(spark, record: dict) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files: a task for each file."""
    uri, frequencies = record["uri"], record["frequencies"]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequencies)
        for batch in batches:
            for name, at in zip(batch["name"].to_pylist(), batch["start"].to_pylist()):
                for b, docs, lengths, ids in read_blocks(uri, name, coder):
                    cuts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                    wide = memoryview(ids.astype("<u4").tobytes())
                    ends = (4 * cuts).tolist()
                    crc = [zlib.crc32(wide[i:j]) for i, j in zip(ends, ends[1:])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(docs, pa.int64(), mask=docs == NULL_ID), pa.array(at + b["first_token"] + cuts[:-1], pa.int64()),
                        pa.array(lengths, pa.int64()), pa.array(crc, pa.int64()),
                    ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame([(f["name"], f["start"]) for f in record["files"]], "name string, start long")
    return files.repartition(max(1, len(record["files"]))).mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")
