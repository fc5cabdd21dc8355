"""Two tokenizers' tokens of the same text aligned by their bytes.

Both tokenizers give tokens whose bytes join to a space and the text. Where a token of each ends at the same byte, a
group ends; tokens whose bytes overlap are linked. A two-pointer merge of the two lists of ends gives both. No token of
either side reaches across a single space between two letters or marks, so the text is cut there, and each distinct
stretch is encoded and merged once; other white space stays inside a stretch. Tasks hand on each document's groups and
distinct linked id pairs; Spark counts in how many documents a pair stands, and joins the counts, with the highest one of
each first id, back to the documents' links.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common
from .components import join_one

#: White space of either library; where a single space stands between two other letters, both begin a new token.
_CUT = re.compile("(?<=[^\\s\u180e\ufeff]) (?=[^\\s\u180e\ufeff])")
#: Letters that one step cuts into stretches, and the longest stretch that is kept for later texts.
STEP_CHARS, KEPT_CHARS = 1 << 20, 100
#: Pairs of ids that are broadcast at most (16 bytes each); more are joined by shuffles.
BROADCAST_PAIRS = 500_000
_ID_BITS = 16


@dataclass
class Pair:
    """The files of a byte-level BPE (a, of the tokenizers library) and a sentencepiece model (b)."""

    a: str
    b: str
    most_stretches: int = 300_000


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1 for itself, the others in turn from
    U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


#: Letters of which Latin-1 has one class with both libraries, and marks that end a word.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_MARKS = "!,.:;?"
_PLAIN = re.compile(f"([{_LETTERS}]+)([{_MARKS}]*)")


class Aligner(dict):
    """The merged stretches met so far: tokens of either side, groups, groups as text, links as packed id pairs; None for a
    stretch whose bytes the tokens do not give back."""

    def __init__(self, pair: Pair):
        super().__init__()
        self.pair, self.older = pair, {}
        self.a = Tokenizer.from_file(pair.a)
        self.a.encode_special_tokens = True
        self.model = self.a.model
        self.b = sentencepiece.SentencePieceProcessor(model_file=pair.b)
        letters = byte_letters()
        spelled = {b: c for c, b in letters.items()}
        self.spelling = {i: "".join(spelled[b] for b in chr(i).encode()) for i in range(0x20, 0x100)}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for t, i in vocabulary.items():
            if all(c in letters for c in t):
                self.bytes_a[i] = bytes(letters[c] for c in t)
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << _ID_BITS:
            raise ValueError("ids take 16 bits")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size()) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)]
        self.apart = not any(re.search(f"[{_MARKS}]", p) and re.search(f"[{_LETTERS}]", p) for p in pieces)
        self.marks: dict[str, tuple] = {}
        self.digits = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]

    def _ids_a(self, stretch: str) -> list[int]:
        """Tokens of a space and a stretch. A plain word and the marks after it are the pretokens of the vocabulary, so that
        its model alone gives their ids; anything else goes through the whole library."""
        plain = _PLAIN.fullmatch(stretch)
        if not plain:
            return self.a.encode(" " + stretch, add_special_tokens=False).ids
        ids = [t.id for t in self.model.tokenize((" " + plain[1]).translate(self.spelling))]
        return ids + [t.id for t in self.model.tokenize(plain[2])] if plain[2] else ids

    def learn(self, stretches: list[str]) -> list[str]:
        """Meet stretches that are new; those too long to be kept come back. A word with marks after it is the word's
        tokens and the marks', if no token of the second side has both letters and marks."""
        again, marked = [], []
        for s in stretches:
            if s in self.older:
                self[s] = self.older[s]
            elif self.apart and s[-1] in _MARKS and (plain := _PLAIN.fullmatch(s)):
                marked.append((s, plain[1], plain[2]))
            else:
                again.append(s)
        words = {w for _, w, _ in marked if w not in self}
        for w in words:
            if w in self.older:
                self[w] = self.older[w]
            else:
                again.append(w)
        again = list(dict.fromkeys(again))
        for s, b in zip(again, self.b.encode(again, num_threads=1) if again else []):
            self[s] = self.align(s, self._ids_a(s), b)
        for s, word, marks in marked:
            after = self.marks.get(marks)
            if after is None:
                skip = len(self.b.encode("a"))
                after = self.marks[marks] = self.align(marks, [t.id for t in self.model.tokenize(marks)], self.b.encode("a" + marks)[skip:], "")
            one = self[word]
            self[s] = (one[0] + after[0], one[1] + after[1], one[2] + after[2], f"{one[3]};{after[3]}", one[4] + after[4]) if one and after else None
        return [s for s in stretches if len(s) > KEPT_CHARS]

    def align(self, stretch: str, a: list[int], b: list[int], before: str = " ") -> tuple | None:
        """Two pointers walk over the ends of both sides' tokens: each step is a link, and where both ends meet a group ends."""
        bytes_a, bytes_b, digits = self.bytes_a, self.bytes_b, self.digits
        want = (before + stretch).encode()
        of_a, of_b = [bytes_a[x] for x in a], [bytes_b[x] for x in b]
        if b"".join(of_a) != want or b"".join(of_b) != want:
            return None
        links, text, whole = array("I"), [], len(want)
        i = j = first_a = first_b = 0
        end_a, end_b = len(of_a[0]), len(of_b[0])
        while True:
            links.append(a[i] << _ID_BITS | b[j])
            if end_a == end_b:
                if i == first_a and j == first_b:
                    text.append(f"{digits[a[i]]}|{digits[b[j]]}")
                else:
                    text.append(",".join([digits[x] for x in a[first_a : i + 1]]) + "|" + ",".join([digits[x] for x in b[first_b : j + 1]]))
                if end_a == whole:
                    break
                i, j = i + 1, j + 1
                first_a, first_b = i, j
                end_a, end_b = end_a + len(of_a[i]), end_b + len(of_b[j])
            elif end_a < end_b:
                i += 1
                end_a += len(of_a[i])
            else:
                j += 1
                end_b += len(of_b[j])
        return len(a), len(b), len(text), ";".join(text), links.tobytes()

    def document(self, text: str | None) -> tuple:
        """(n_a, n_b, n_groups, n_links, groups_sha256, distinct pairs, times of each)."""
        nothing = (0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int32))
        if not text:
            return nothing
        digest, n_a, n_b, n_groups, n_links, at = hashlib.sha256(), 0, 0, 0, 0, 0
        pairs, times = np.empty(0, np.uint32), np.empty(0, np.int64)
        while at < len(text):
            cut = _CUT.search(text, at + STEP_CHARS) if len(text) - at > STEP_CHARS else None
            end = cut.start() if cut else len(text)
            stretches = _CUT.split(text[at:end])
            new = [s for s in set(stretches) if s not in self]
            long = self.learn(new) if new else []
            met = [self[s] for s in stretches]
            for s in long:
                del self[s]
            if None in met:
                return nothing
            of_a, of_b, of_groups, groups, links = zip(*met)
            digest.update(((";" if at else "") + ";".join(groups)).encode())
            n_a, n_b, n_groups = n_a + sum(of_a), n_b + sum(of_b), n_groups + sum(of_groups)
            links = np.frombuffer(b"".join(links), np.uint32)
            n_links += len(links)
            own = common.sorted_counts(links)
            pairs, times = common.sorted_counts(np.concatenate([pairs, own[0]]), np.concatenate([times, own[1]])) if at else own
            at = end + 1
            if len(self) > self.pair.most_stretches:
                self.older = dict(self)
                self.clear()
        return n_a, n_b, n_groups, n_links, digest.hexdigest(), pairs.astype(np.int64), times.astype(np.int32)


_aligners: dict[tuple, Aligner] = {}


def aligner(pair: Pair) -> Aligner:
    """The worker's aligner; it stays with the worker from task to task."""
    key = (pair.a, pair.b, pair.most_stretches)
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(pair)
    return _aligners[key]


@common.in_small_batches
def aligned(docs: DataFrame, pair: Pair) -> DataFrame:
    """A written table with a row for each row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, pairs and times (the distinct linked id pairs, the first id in the upper bits, and how often each)."""
    columns = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            mine = aligner(pair)
            rows = [mine.document(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64")} | {c: [r[k] for r in rows] for k, c in enumerate(columns)})

    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return common.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, kinds), "aligned")


def pair_counts(found: DataFrame) -> DataFrame:
    """A written table: pair, count (documents that hold it), best (whether no pair of its first id has a higher count)."""
    counts = common.written(found.select(F.explode("pairs").alias("pair")).groupBy("pair").count(), "pair-counts")
    first = F.shiftright("pair", _ID_BITS).alias("first")
    highest = counts.groupBy(first).agg(F.max("count").alias("highest"))  # a row for each id of a vocabulary
    best = counts.withColumn("first", first).join(F.broadcast(highest), "first")
    return common.written(best.select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "pair-counts")


def align(docs: DataFrame, pair: Pair, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of ``docs`` (doc_id, text; other
    columns, whatever their names, are ignored).

    Each side's tokens are those of a space and the text, names of special tokens being plain text. A null or empty text,
    and one whose bytes a side's tokens do not give back, has no tokens: zeros, and '' for the digest. n_links counts
    pairs of token places whose bytes overlap, n_best those whose count is the highest of their first id, ties included;
    count_sum adds up the counts. Very long texts are read whole, step by step. Repeated rows and rows with equal or null
    doc_id are documents of their own. An empty table gives an empty result.
    """
    found = aligned(docs, pair).withColumn("row", F.monotonically_increasing_id())
    counts = pair_counts(found)
    linked = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    if counts.count() <= broadcast_pairs:
        joined = linked.join(F.broadcast(counts), "pair")
    else:  # a frequent pair stands in most documents: its rows stay where they are
        total = counts.agg(F.sum("count")).first()[0]
        joined = join_one(linked, counts.withColumn("n", F.col("count")), "pair", total)
    times = F.col("times").cast("long")
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(times * F.col("count")).alias("count_sum"))
    out = found.drop("pairs", "times").join(sums, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
