"""An interpolated modified Kneser-Ney model of word n-grams, of order 2 by default or 3, counted in Spark.

Words, bigrams and trigrams are sorted hash arrays in the shared folder, which workers memory-map to score texts. A
word's id is its place in the sorted word array; a bigram's key is a bijective mix of its two ids, so shards of keys
are of even size whatever words are frequent, and both ids can be had back from a key. With order 3, trigrams are
counted with their bigram as the key and the word before it beside it, which gives every count that the model needs in
one pass. A key's bucket is that of its shard, so the tasks that count bigrams write their arrays at once.

All n-grams are stored. Lower orders use continuation counts (how many words stand before), but after the beginning of a
text, which nothing stands before, plain ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, hash_arrays

#: Stands for the end of a text among the word hashes.
END = common.mix(np.array([0xE2D], np.uint64))
_UNMIX = [np.uint64(pow(c, -1, 2**64)) for c in (0xC4CEB9FE1A85EC53, 0xFF51AFD7ED558CCD)]
#: What is kept of each word as a context (count, types met once, twice, oftener) and as a follower (types before it).
_WORD = np.dtype([("total", "<u8"), ("once", "<u4"), ("twice", "<u4"), ("more", "<u4"), ("before", "<u4")])


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of common.mix."""
    x = x ^ (x >> np.uint64(32))
    x = x * _UNMIX[0]
    x = x ^ (x >> np.uint64(29)) ^ (x >> np.uint64(58))
    x = x * _UNMIX[1]
    return x ^ (x >> np.uint64(33))


def discounts(n: list[int]) -> list[float]:
    """The three discounts from how many types were met once, twice, three and four times; where too few were met to
    tell, half a count for each."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]


def discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """Tokens of a run of documents, each document's with an end, and tokens per document."""
    for batch in batches:
        data, offsets = common.text_bytes(batch["text"])
        for a, b in common.blocks(offsets):
            h, counts = common.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
            yield batch, a, b, np.insert(h, np.cumsum(counts), END), counts + 1


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _before(ids: np.ndarray, counts: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids two before and before each token; ``start`` stands in front of a document."""
    first = np.cumsum(counts) - counts
    one, two = np.empty_like(ids), np.empty_like(ids)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    one[first] = two[first] = start
    second = (first + 1)[counts > 1]
    two[second] = start
    return two, one


def _bigram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return common.mix((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))


def _trigram(bigram: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The key of a trigram, by its last two words' key and the id before them."""
    return common.mix(bigram ^ common.mix(before.astype(np.uint64) * _STEP + np.uint64(1)))


def _lookup(stored: hash_arrays.HashArrays, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and count of each key; equal keys are looked up once."""
    distinct, back = np.unique(keys, return_inverse=True)
    place, count = stored.lookup(distinct)
    return place[back], count[back]


@common.in_small_batches
def fit(docs: DataFrame, order: int = 2) -> dict:
    """Count the model (``order`` 2 or 3) on all rows of ``docs`` (text; a null one is empty). Records of the shards come
    back, with the model's totals; what passes through the driver grows with the number of shards only. More than 2**32
    different words are an error, since an id takes 32 bits."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    n_buckets = hash_arrays.buckets_for(docs)
    n_fine = hash_arrays.finer_buckets(docs, n_buckets)  # n-grams are many; a task takes one bucket after the other
    texts, spark = docs.select("text"), docs.sparkSession

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = hash_arrays.Tally(n_buckets)
        for *_, tokens, _ in _texts(batches):
            yield from tally.add(tokens)
        yield from tally.finish()

    vocabulary = hash_arrays.store(texts.mapInArrow(words, hash_arrays.PACKED), n_buckets, "words")
    start = vocabulary["size"]
    if start >= 2**32:
        raise ValueError("ids of words take 32 bits")
    span = -(-(start + 1) // n_buckets)  # ids that one shard of contexts holds

    def ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, known = hash_arrays.PairTally(n_fine), hash_arrays.opened(vocabulary)
        for *_, tokens, counts in _texts(batches):
            ids = _lookup(known, tokens)[0]
            two, one = _before(ids, counts, start)
            yield from tally.add(_bigram(one, ids), two if order == 3 else np.zeros(len(ids), np.int64))
        yield from tally.finish()

    def sums(kind: str, who: np.ndarray, values: list[np.ndarray]) -> Iterator[tuple]:
        cuts = np.searchsorted(who, np.arange(n_buckets + 1, dtype=np.uint64) * np.uint64(span)).tolist()
        for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if j > i:
                yield b, kind, common.pack(who[i:j], True), b"".join(len(p).to_bytes(4, "little") + p for p in (common.pack(v[i:j]) for v in values))

    def hashed(kind: str, keys: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
        keys, n = common.sorted_counts(keys, n)
        for batch in hash_arrays.packed_rows(keys, n, n_buckets):
            yield from ((r["bucket"], kind, r["hashes"], r["counts"]) for r in batch.to_pylist())

    bigrams = common.scratch(spark, "bigrams")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, writer = np.zeros((2, 5), np.int64), hash_arrays.Writer(bigrams, "bigrams")

        def rows(out: list[tuple]) -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.string(), pa.binary(), pa.binary()))], names=["bucket", "kind", "hashes", "counts"])

        for bucket, held in hash_arrays.groups(batches, "bucket"):
            k, u, c = hash_arrays.merged_pairs(held)
            new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            keys, raw, behind = k[new], np.add.reduceat(c, new), np.diff(np.append(new, len(k)))
            first, second = (x := unmix(keys)) >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
            n = np.where(first == start, raw, behind) if order == 3 else raw  # what the bigram counts for
            types[0] += [*(int((n == i).sum()) for i in (1, 2, 3, 4)), len(keys)]
            writer.add(bucket, keys, n)
            by = np.argsort(first, kind="stable")
            at, m = first[by], n[by]
            edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            out = [*sums("context", at[edge], [np.add.reduceat(v, edge) for v in (m, (m == 1).astype(np.int64), (m == 2).astype(np.int64), (m > 2).astype(np.int64))])]
            out += sums("follower", *(lambda w, t: (w, [t]))(*common.sorted_counts(second)))
            if order == 3:
                inner = np.flatnonzero(np.repeat(first != start, np.diff(np.append(new, len(k)))))
                c, u, k = c[inner], u[inner], k[inner]
                types[1, :4] += [int((c == i).sum()) for i in (1, 2, 3, 4)]
                context = _bigram(u, unmix(k) >> np.uint64(32))
                out += hashed("trigram", _trigram(k, u), c)
                out += hashed("total", context, c)
                out += hashed("once", context[c == 1], c[c == 1])
                out += hashed("more", context[c > 1], np.where(c[c > 1] == 2, 1, 1 << 32))  # met twice, and oftener
            yield from rows(out)
        closed = writer.close()
        out = [(0, "file", closed[0].encode(), closed[1])] if closed else []
        yield from rows([*out, (0, "types", types.tobytes(), b"")])

    shuffled = texts.mapInArrow(ngrams, hash_arrays.PAIRS)
    partial = common.written(hash_arrays.by_bucket(shuffled, n_buckets).mapInArrow(reduce, "bucket int, kind string, hashes binary, counts binary"), "ngrams", by="kind")
    files = [(bytes(r.hashes).decode(), bytes(r.counts), 0) for r in partial.where("kind = 'file'").select("hashes", "counts").collect()]
    arrays = {"bigram": hash_arrays.record(bigrams, n_fine, files)}
    if order == 3:
        arrays |= {k: hash_arrays.store(partial.where(f"kind = '{k}'").select("bucket", "hashes", "counts"), n_buckets, k) for k in ("trigram", "total", "once", "more")}
    uri = common.scratch(spark, "contexts")

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, done, before = None, [], np.zeros(5, np.int64)
        for bucket, rows in hash_arrays.groups(batches, "bucket"):
            out = np.zeros(min(span, start + 1 - bucket * span), _WORD)
            for r in rows:
                ids = (common.unpack(r["hashes"], True) - np.uint64(bucket * span)).astype(np.int64)
                raw, at = r["counts"], 0
                for name in ("total", "once", "twice", "more") if r["kind"] == "context" else ("before",):
                    n = int.from_bytes(raw[at : at + 4], "little")
                    out[name][ids] += common.unpack(raw[at + 4 : at + 4 + n]).astype(out[name].dtype)
                    at += 4 + n
            file = file or common.ArrayFile(uri, "contexts")
            done.append((bucket, file.put(out), len(out)))
            before += [*(int((out["before"] == k).sum()) for k in (1, 2, 3, 4)), int((out["before"] > 0).sum())]
        if file:
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([file.name]), pa.array([done], pa.list_(pa.list_(pa.int64()))), pa.array([before.tolist()], pa.list_(pa.int64()))], names=["file", "done", "before"])

    rows = hash_arrays.by_bucket(partial.where("kind in ('context', 'follower')"), n_buckets).mapInArrow(dense, "file string, done array<array<long>>, before array<long>").collect()
    types = sum((np.frombuffer(r["hashes"], np.int64).reshape(2, 5) for r in partial.where("kind = 'types'").select("hashes").collect()), np.zeros((2, 5), np.int64))
    before = sum((np.array(r["before"]) for r in rows), np.zeros(5, np.int64)).tolist()
    return {
        "order": order, "words": vocabulary, "arrays": arrays, "uri": uri, "span": span, "start": start, "contexts": {b: (r["file"], at, n) for r in rows for b, at, n in r["done"]},
        "discounts": {3: discounts(types[1, :4].tolist()), 2: discounts(types[0, :4].tolist()), 1: discounts(before[:4])}, "before": before, "types": int(types[0, 4]), "tokens": vocabulary["total"],
    }


class Model:
    """A fitted model, mapped by a worker."""

    def __init__(self, record: dict):
        self.r = record
        self.words = hash_arrays.HashArrays(record["words"])
        self.arrays = {k: hash_arrays.HashArrays(a) for k, a in record["arrays"].items()}
        d, n = record["discounts"][1], record["before"]
        self.left_over = (d[0] * n[0] + d[1] * n[1] + d[2] * (n[4] - n[0] - n[1])) if record["types"] else 1.0

    def facts(self, ids: np.ndarray) -> np.ndarray:
        """The context record of each id; an unknown word (-1) has none."""
        out = np.zeros(len(ids), _WORD)
        which = np.where(ids >= 0, ids // self.r["span"], -1)
        for b in np.unique(which[which >= 0]).tolist():
            at = np.flatnonzero(which == b)
            if b in self.r["contexts"]:
                out[at] = common.array_part(self.r["uri"], *self.r["contexts"][b], _WORD)[ids[at] - b * self.r["span"]]
        return out

    def count(self, name: str, keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Counts of keys; 0 where not asked."""
        out, at = np.zeros(len(keys), np.int64), np.flatnonzero(asked)
        out[at] = _lookup(self.arrays[name], keys[at])[1]
        return out

    def score(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each token's probability, and its count in training (0: unknown)."""
        r = self.r
        distinct, back = np.unique(tokens, return_inverse=True)
        place, known = self.words.lookup(distinct)
        ids, known = place[back], known[back]
        two, one = _before(ids, counts, r["start"])

        types = max(1, r["types"])
        facts = self.facts(place)
        met = facts["before"].astype(np.int64)
        low = (np.maximum(met - discounted(met, r["discounts"][1]), 0) / types + self.left_over / types / (r["start"] + 1))[back]

        d = r["discounts"][2]
        here, which = np.unique(one, return_inverse=True)
        context = self.facts(here)[which]
        total = context["total"].astype(np.float64)
        full = np.maximum(total, 1)
        spared = total - d[0] * context["once"] - d[1] * context["twice"] - d[2] * context["more"]  # what bigrams keep
        keys = _bigram(one, ids)
        asked = (ids >= 0) & (one >= 0)
        n = self.count("bigram", keys, asked)
        p = np.maximum(n - discounted(n, d), 0) / full + (1 - spared / full) * low
        if r["order"] == 3:
            d = r["discounts"][3]
            inner = np.ones(len(ids), bool)
            inner[np.cumsum(counts) - counts] = False
            before = np.roll(keys, 1)  # the context is the bigram of the token before
            total = self.count("total", before, inner & np.roll(asked, 1)).astype(np.float64)
            known_context = total > 0
            once, more = (self.count(k, before, known_context) for k in ("once", "more"))
            full = np.maximum(total, 1)
            spared = total - d[0] * once - d[1] * (more & 0xFFFFFFFF) - d[2] * (more >> 32)
            n = self.count("trigram", _trigram(keys, two), known_context & (ids >= 0))
            p = np.maximum(n - discounted(n, d), 0) / full + (1 - spared / full) * p
        return np.log10(p), known


_models: dict[str, Model] = {}


def opened(record: dict) -> Model:
    if record["uri"] not in _models:
        _models.clear()
        _models[record["uri"]] = Model(record)
    return _models[record["uri"]]


@common.in_small_batches
def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row of ``docs`` (doc_id, text).

    Other columns, whatever their names, are ignored; texts of any length are scored whole. A null or wordless text is
    its end alone. score is the model's log10 probability of the text with its end; base_score
    that of single tokens with 0.1 added to each count. With an empty training table every word is unknown. Repeated rows
    get equal scores; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(model)
        n, v = model["tokens"], model["start"]
        for batch, a, b, tokens, counts in _texts(batches):
            logs, known = m.score(tokens, counts)
            base = np.log10((known + 0.1) / (n + 0.1 * (v + 1)))
            first = np.cumsum(counts) - counts
            total, base, met = (np.add.reduceat(x, first) for x in (logs, base, (known > 0).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"][a:b].cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(met, pa.int64()), pa.array(np.full(b - a, n), pa.int64()),
                pa.array(base, pa.float64()), pa.array(total, pa.float64()), pa.array(10 ** (-total / counts), pa.float64()),
            ], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    # a few numbers for each row are written, so that batches are small whatever follows
    return common.written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"), "scores")
