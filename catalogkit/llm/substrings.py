"""Exact repeated passages by fixed-block anchors.

Every full block of ceil(window/2) words at a multiple of its length is indexed by its hash; a window always holds one
such block whole. All rolling blocks probe the index. A hit that is not just the block itself is extended to all windows
around it, which are counted by two independent 64-bit hashes of their words; windows met twice or more, anywhere, are
repeats, and runs of consecutive repeated windows are the maximal exact repeats. At 10**13 windows two different ones
have both hashes in common with a chance of one in 10**12. Index and repeats are sorted hash arrays in the shared
folder, of which a worker touches what it looks up; texts are never moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, hash_arrays


class _Words:
    """Word hashes of a run of documents, with the place and the words left of each word in its document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.hashes, self.counts = common.word_hashes(data, offsets, lower=False)
        self.ends = np.cumsum(self.counts)
        begins = self.ends - self.counts
        at = np.arange(len(self.hashes))
        self.place = at - np.repeat(begins, self.counts)
        self.left = np.repeat(self.ends, self.counts) - at

    def runs(self, width: int, longer_than: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``width`` words, and which runs stay in a document of ``longer_than`` words at least."""
        h = common.rolled(self.hashes, width)
        n = len(h)
        return h, (self.left[:n] >= width) & (self.place[:n] + self.left[:n] >= longer_than)


    def second(self, width: int, at: np.ndarray) -> np.ndarray:
        """The second hash of the runs of ``width`` words at these places."""
        return common.rolled(common.word_hashes(self.data, self.offsets, lower=False, other=True)[0], width)[at] if len(at) else np.empty(0, np.uint64)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, _Words]]:
    for batch in batches:
        data, offsets = common.text_bytes(batch["text"])
        for a, b in common.blocks(offsets):
            yield batch, a, b, _Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


@common.in_small_batches
def find_repeats(docs: DataFrame, window: int) -> dict:
    """The windows that start at two places or more, as a record of sorted hash arrays."""
    block = (window + 1) // 2
    n_buckets = hash_arrays.buckets_for(docs)
    texts = docs.select("text")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = hash_arrays.Tally(n_buckets)
        for _, _, _, words in _each(batches):
            h, whole = words.runs(block, window)
            yield from tally.add(h[whole & (words.place[: len(h)] % block == 0)])
        yield from tally.finish()

    index = hash_arrays.store(texts.mapInArrow(anchors, hash_arrays.PACKED), n_buckets, "anchors")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored, tally = hash_arrays.opened(index), hash_arrays.PairTally(n_buckets)
        for _, _, _, words in _each(batches):
            h, whole = words.runs(block, window)
            at = np.flatnonzero(whole)
            _, count = stored.lookup(h[at])
            hit = np.zeros(len(h) + 1, np.int64)
            hit[at] = count > (words.place[at] % block == 0)  # an anchor always meets itself
            met = np.cumsum(hit) - hit  # hits before each place
            full, fits = words.runs(window, window)
            reach = np.minimum(np.arange(len(full)) + window - block + 1, len(h))
            around = np.flatnonzero(fits & (met[reach] > met[: len(full)]))
            yield from tally.add(full[around], words.second(window, around))
        yield from tally.finish()

    return hash_arrays.store_repeated(texts.mapInArrow(probe, hash_arrays.PAIRS), n_buckets, "repeats")


def judged(batches: Iterator[pa.RecordBatch], repeats: dict, window: int) -> Iterator[tuple]:
    """(batch, first row, last row, words, kept text, words removed, spans removed) for runs of rows of a batch."""
    stored = hash_arrays.opened(repeats)
    for batch, a, b, words in _each(batches):
        full, fits = words.runs(window, window)
        at = np.flatnonzero(fits)
        place, second = stored.lookup(full[at])
        at, second = at[place >= 0], second[place >= 0]
        own = words.second(window, at).view(np.int64)
        same = own == second
        if repeats["ties"]:
            same |= np.array([(int(k), int(x)) in repeats["ties"] for k, x in zip(full[at].view(np.int64), own)], bool)
        step = np.zeros(len(words.hashes) + 1, np.int64)
        start = at[same]
        step[start] += 1
        step[start + window] -= 1
        gone = np.cumsum(step)[:-1] > 0
        ends = words.ends.tolist()
        kept, removed, spans = [], [], []
        for i, (text, n) in enumerate(zip(batch["text"][a:b].to_pylist(), words.counts.tolist())):
            split = (text or "").encode("utf-8", "surrogatepass").split()
            mine = gone[ends[i] - n : ends[i]]
            k = int(mine.sum())
            spans.append([])
            if k:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))).tolist()
                spans[-1] = [{"first_word": x, "n_words": y - x} for x, y in zip(edge[::2], edge[1::2])]
                split = [w for w, g in zip(split, mine.tolist()) if not g]
            removed.append(k)
            kept.append(b" ".join(split).decode("utf-8", "surrogatepass"))
        yield batch, a, b, words.counts, kept, removed, spans


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, spans for each row of ``docs`` (doc_id, text; other columns, whatever their
    names, are ignored).

    A word goes if a window of ``window`` consecutive words over it starts anywhere else too, in the same document or
    another; all windows are judged on the input. Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged.
    kept_text joins the words that stay by one space; spans are the removed runs (first word, words). A null or empty
    text has no words; texts shorter than a window stay whole; very long ones are read whole. Repeated rows repeat each other. An empty table gives an
    empty result.
    """
    repeats = find_repeats(docs, window)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, counts, kept, removed, spans in judged(batches, repeats, window):
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"][a:b].cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()),
                pa.array(spans, pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))),
            ], names=["doc_id", "n_words", "n_removed", "kept_text", "spans"])

    return docs.select("doc_id", "text").mapInArrow(mark, "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<first_word:long,n_words:long>>")
