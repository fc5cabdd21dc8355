"""Benchmark decontamination by BM25 with block-max WAND.

The test items form inverted indexes, one for each class of item lengths (up to 8, 16, 32, ... words), so that the
passages that a class is searched with fit its items. In each, a term has its postings in item order, cut into blocks
with the largest impact of each. Impacts are divided by the item's score for itself, so one threshold holds for all
items. Every passage of every text is a query. Most are ruled out at once by the sums of their terms' largest impacts,
in which frequent terms together add no more than any item has of them. The others are walked through by WAND: the
cursors of the terms stand in item order, the pivot is the first item whose terms can reach the threshold together, the
largest impacts of the blocks at the pivot are tried next, and cursors jump over whatever cannot reach it. Whatever
reaches it is found. Hits are verified by the overlap of the item's question and of its answer with the passage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K1, B = 1.2, 0.75
#: Postings of a block.
BLOCK = 16
#: Groups of items with bounds of their own, and the bounds that they may come to.
GROUPS, MOST_BOUNDS = 64, 1 << 24
#: Words of the shortest class of items.
SHORTEST = 8
#: Terms in more than this share of the items count as frequent.
FREQUENT = 0.05
#: The share of its own score that an item must get from a passage, and of its question's and answer's three-word
#: runs that the passage must hold.
THRESHOLD, QUESTION, ANSWER, RUN = 0.6, 0.7, 0.7, 3
#: Room for the rounding of sums of bounds.
SLACK = 1e-9

_BYTES = np.array([c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters and digits, in lower case) and words per text."""
    data, offsets = common.text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    return common.word_hashes(_BYTES[data], offsets, lower=False)


def text_terms(text: str | None) -> np.ndarray:
    return terms_of(pa.array([text or ""], pa.large_string()))[0]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the answer is the last sentence, or of a single sentence the last third of the words."""
    parts = [p for p in _SENTENCE.split(text.strip()) if p]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = len(words) - len(words) // 3
    return " ".join(words[:cut]), " ".join(words[cut:])


def runs(terms: np.ndarray, width: int = RUN) -> np.ndarray:
    """Distinct hashes of runs of ``width`` words."""
    return np.unique(common.rolled(terms, width))


def part_runs(text: str) -> tuple[int, np.ndarray]:
    """Words of a run and the distinct runs of a question or answer; one of fewer words than RUN is a single run."""
    terms = text_terms(text)
    width = min(RUN, len(terms))
    return width, runs(terms, width) if width else terms


def overlap(part: tuple[int, np.ndarray], passage: np.ndarray) -> float:
    """Share of a part's runs that the words of a passage hold; a part without words is held by any."""
    width, wanted = part
    return float(np.isin(wanted, runs(passage, width)).mean()) if width else 1.0


#: Arrays of a class: distinct terms, their largest impacts, whether they are frequent, and where their postings begin;
#: postings (item and impact); per block of postings the largest impact; the items' ids, and the widths and runs of
#: their questions and answers. ``first_block`` has a term's first block; ``coarse`` the largest impact of each term in
#: each of up to GROUPS groups of items.
NAMES = {
    "terms": np.uint64, "bound": np.float64, "frequent": np.uint8, "at": np.int64, "item": np.int64, "impact": np.float64, "first_block": np.int64, "block_bound": np.float64, "coarse": np.float32, "item_id": np.int64,
    "question_width": np.int64, "question_at": np.int64, "question": np.uint64, "answer_width": np.int64, "answer_at": np.int64, "answer": np.uint64,
}


class Part:
    """The items of one length class; a worker maps its arrays."""

    def __init__(self, arrays: dict, stride: int, often: float):
        for name in NAMES:
            setattr(self, name, arrays[name])
        self.stride, self.often = stride, often
        self.coarse = self.coarse.reshape(len(self.terms), -1)
        self.items, self.impacts, self.ats, self.block_bounds = (memoryview(np.ascontiguousarray(x)) for x in (self.item, self.impact, self.at, self.block_bound))

    def parts(self, item: int) -> tuple[tuple[int, np.ndarray], tuple[int, np.ndarray]]:
        """Width and runs of an item's question and of its answer."""
        q, a = self.question_at[item : item + 2], self.answer_at[item : item + 2]
        return (int(self.question_width[item]), self.question[q[0] : q[1]]), (int(self.answer_width[item]), self.answer[a[0] : a[1]])

    def retrieve(self, terms: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(text, passage, item, score) of all passages and items with a score of THRESHOLD or more.

        Passage k of a text is its words from k * stride on, twice the stride long, so an item of up to a stride's words
        is whole in some passage."""
        if not len(terms):
            return
        ends = np.cumsum(counts)
        doc = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(terms)) - (ends - counts)[doc]
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == terms)
        term, doc, k = at[known], doc[known], place[known] // self.stride
        passages = -(-counts // self.stride)
        first = np.cumsum(passages) - passages
        here = first[doc] + k
        size = len(self.terms)
        pairs = np.concatenate([here * size + term, (here[k > 0] - 1) * size + term[k > 0]])  # each word is in two passages
        pairs.sort()
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
        passage, term = pairs // size, pairs % size
        total = int(passages.sum())
        # frequent terms give an item no more than their largest impacts, nor more than any item has of them
        often = self.frequent[term] == 1
        base, rare = (np.bincount(passage[x], self.bound[term[x]], total) for x in (often, ~often))
        spare = np.minimum(base, self.often)
        likely = np.flatnonzero(rare + spare >= THRESHOLD - SLACK)
        likely = likely[self._grouped(passage, term, often, likely, spare) >= THRESHOLD - SLACK]
        begin, end = np.searchsorted(passage, likely), np.searchsorted(passage, likely, "right")
        owner = np.searchsorted(np.cumsum(passages), likely, "right")
        for where, i, j, d in zip(likely.tolist(), begin.tolist(), end.tolist(), owner.tolist()):
            here, more = term[i:j], often[i:j]
            rest = float(spare[where])
            if rest >= THRESHOLD - SLACK:  # frequent terms alone may do
                more, rest = np.zeros(j - i, bool), 0.0
            for item, score in self.wand(here[~more].tolist(), here[more].tolist(), rest):
                yield d, where - int(first[d]), item, score

    def _grouped(self, passage: np.ndarray, term: np.ndarray, often: np.ndarray, likely: np.ndarray, spare: np.ndarray) -> np.ndarray:
        """A closer bound for these passages: the largest sum within a group of items."""
        rare, term = passage[~often], term[~often]
        begin, end = np.searchsorted(rare, likely), np.searchsorted(rare, likely, "right")
        best, step = np.zeros(len(likely)), 4096
        for a in range(0, len(likely), step):
            i, j = begin[a : a + step], end[a : a + step]
            full = np.flatnonzero(j > i)
            if len(full):  # rows of a passage follow each other
                at = np.repeat(i[full] - np.concatenate([[0], np.cumsum((j - i)[full])[:-1]]), (j - i)[full]) + np.arange(int((j - i)[full].sum()))
                best[a + full] = np.add.reduceat(self.coarse[term[at]], np.concatenate([[0], np.cumsum((j - i)[full])[:-1]]), axis=0).max(axis=1)
        return best + spare[likely] + 1e-5

    def wand(self, terms: list[int], more: list[int], spare: float) -> list[tuple[int, float]]:
        """(item, score) of the items that reach the threshold for a passage with these terms. Only ``terms`` have
        cursors; ``more`` are terms that add no more than ``spare`` to any item, and are looked up for items reached."""
        item, impact, ats, found, least = self.items, self.impacts, self.ats, [], THRESHOLD - SLACK - spare
        # a cursor: its item, its place, the end of its postings, its largest impact, its first posting and block
        cursors = [[item[a], a, b, u, a, f] for a, b, u, f in zip(self.at[terms].tolist(), self.at[[t + 1 for t in terms]].tolist(), self.bound[terms].tolist(), self.first_block[terms].tolist())]

        def jump(c: list, target: int) -> bool:
            c[1] = bisect_left(item, target, c[1], c[2])
            if c[1] < c[2]:
                c[0] = item[c[1]]
            return c[1] < c[2]

        while cursors:
            cursors.sort()
            total, pivot = 0.0, None
            for n, c in enumerate(cursors):
                total += c[3]
                if total >= least:
                    pivot = n
                    break
            if pivot is None:
                break
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            # the blocks that hold the pivot, or what follows it, bound more tightly
            total, after = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 62
            for c in cursors[: pivot + 1]:
                place = bisect_left(item, target, c[1], c[2])
                if place < c[2]:
                    block = (place - c[4]) // BLOCK
                    total += self.block_bounds[c[5] + block]
                    last = min(c[4] + (block + 1) * BLOCK, c[2]) - 1
                    after = min(after, item[last] + 1)
            if total < least:  # nothing up to the next block's begin can reach it
                moved = max(after, target + 1)
                cursors = [c for c in cursors[: pivot + 1] if jump(c, moved)] + cursors[pivot + 1 :]
            elif cursors[0][0] == target:
                score = sum(impact[c[1]] for c in cursors[: pivot + 1])
                for x in more if score >= least else ():
                    i = bisect_left(item, target, ats[x], ats[x + 1])
                    if i < ats[x + 1] and item[i] == target:
                        score += impact[i]
                if score >= THRESHOLD:
                    found.append((target, score))
                cursors = [c for c in cursors[: pivot + 1] if jump(c, target + 1)] + cursors[pivot + 1 :]
            else:
                cursors = [c for c in cursors[: pivot + 1] if jump(c, target)] + cursors[pivot + 1 :]
        return found


def build(items: list[tuple[int, str]]) -> list[tuple[dict, int, float]]:
    """(arrays, stride, most that an item has of frequent terms) of each length class of items (item_id, text with words)."""
    words = [text_terms(t) for _, t in items]
    n = len(items)
    if not n:
        return []
    length = np.array([len(w) for w in words], float)
    counted = [common.sorted_counts(w) for w in words]
    terms, which, df = np.unique(np.concatenate([c[0] for c in counted]), return_inverse=True, return_counts=True)
    tf, item = np.concatenate([c[1] for c in counted]).astype(float), np.repeat(np.arange(n), [len(c[0]) for c in counted])
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    impact = idf[which] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / length.mean()))
    impact /= np.bincount(item, impact, n)[item]
    frequent = df > max(4, FREQUENT * n)
    classes = np.maximum(SHORTEST, 1 << np.ceil(np.log2(length)).astype(np.int64))
    runs_of = [tuple(map(part_runs, split_item(t))) for _, t in items]
    out = []
    for stride in np.unique(classes).tolist():
        mine = np.flatnonzero(classes == stride)
        own = np.flatnonzero(classes[item] == stride)
        order = own[np.lexsort((item[own], which[own]))]
        met, at = np.unique(which[order], return_index=True)
        at = np.append(at, len(order))
        sizes = -(-np.diff(at) // BLOCK)
        first_block = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        starts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(at[:-1], at[1:])])
        groups = max(1, min(GROUPS, len(mine), MOST_BOUNDS // len(met)))
        coarse = np.zeros((len(met), groups), np.float32)
        np.maximum.at(coarse, (np.searchsorted(met, which[order]), np.searchsorted(mine, item[order]) * groups // len(mine)), impact[order].astype(np.float32))
        sides = {}
        for k, name in enumerate(("question", "answer")):
            these = [runs_of[i][k] for i in mine.tolist()]
            sides |= {f"{name}_width": np.array([w for w, _ in these]), f"{name}_at": np.concatenate([[0], np.cumsum([len(r) for _, r in these])]), name: np.concatenate([r for _, r in these]).astype(np.uint64)}
        arrays = {
            "terms": terms[met], "bound": np.maximum.reduceat(impact[order], at[:-1]), "frequent": frequent[met], "at": at, "item": np.searchsorted(mine, item[order]), "impact": impact[order],
            "first_block": first_block, "block_bound": np.maximum.reduceat(impact[order], starts), "coarse": coarse.ravel(), "item_id": np.array([items[i][0] for i in mine.tolist()]), **sides,
        }
        often = np.bincount(np.searchsorted(mine, item[own]), np.where(frequent[which[own]], impact[own], 0.0), len(mine)).max()
        out.append(({c: np.ascontiguousarray(arrays[c], t) for c, t in NAMES.items()}, stride, float(often)))
    return out


def index_items(benchmark: DataFrame, most_items: int = 1_000_000) -> dict:
    """Write the index of ``benchmark`` (item_id, text) to the shared folder. Null or wordless items are left out; of
    items with equal text the smallest item_id stays. The benchmark, not the corpus, passes through the driver, and more than
    ``most_items`` items are an error."""
    items = benchmark.where("item_id is not null and text is not null").groupBy("text").agg(F.min("item_id").alias("item_id")).orderBy("item_id").limit(most_items + 1).collect()
    if len(items) > most_items:
        raise ValueError(f"more than {most_items} test items; index them in parts")
    uri = common.scratch(benchmark.sparkSession, "items")
    classes = build([(r["item_id"], r["text"]) for r in items if len(text_terms(r["text"]))])
    return {"uri": uri, "classes": [({n: common.put_array(uri, n, a) for n, a in arrays.items()}, stride, often) for arrays, stride, often in classes]}


_open: dict[str, list[Part]] = {}


def _opened(record: dict) -> list[Part]:
    if record["uri"] not in _open:
        _open.clear()
        _open[record["uri"]] = [Part({n: np.asarray(common.map_array(record["uri"], names[n], t)) for n, t in NAMES.items()}, stride, often) for names, stride, often in record["classes"]]
    return _open[record["uri"]]


def _hits(batch: pa.RecordBatch, index: list[Part]) -> Iterator[tuple[int, int, int, float, float, float]]:
    """(row, item_id, passage, score, question overlap, answer overlap) of the verified hits of a batch, an item once a row."""
    data, offsets = common.text_bytes(pc.utf8_lower(batch["text"].cast(pa.large_string())))
    data = _BYTES[data]
    for a, b in common.blocks(offsets):
        terms, counts = common.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=False)
        begins = (np.cumsum(counts) - counts).tolist()
        best: dict[tuple[int, int], tuple] = {}
        for part in index:
            for text, passage, item, score in part.retrieve(terms, counts):
                low = passage * part.stride
                held = terms[begins[text] + low : begins[text] + min(int(counts[text]), low + 2 * part.stride)]
                question, answer = (overlap(p, held) for p in part.parts(item))
                if question >= QUESTION and answer >= ANSWER:
                    key = text, int(part.item_id[item])
                    best[key] = max(best.get(key, (-1.0,)), (score, question + answer, -passage, question, answer))
        for (text, item), (score, _, passage, question, answer) in sorted(best.items()):
            yield a + text, item, -passage, score, question, answer


def find_contaminated(docs: DataFrame, record: dict) -> DataFrame:
    """doc_id, item_id, passage, score, question_overlap, answer_overlap: a row for each row of ``docs`` (doc_id, text)
    and item found in it, with the best passage (its number, counted in strides of the item's length class). Other
    columns, whatever their names, are ignored. A null or wordless text holds nothing; very long texts are searched
    whole; repeated rows give repeated hits; an empty table of documents or items gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _opened(record)
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            rows = [(ids[r], i, p, s, q, a) for r, i, p, s, q, a in _hits(batch, index)]
            c = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:3]), *(pa.array(x, pa.float64()) for x in c[3:])], names=["doc_id", "item_id", "passage", "score", "question_overlap", "answer_overlap"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, passage long, score double, question_overlap double, answer_overlap double")


def without_contaminated(docs: DataFrame, record: dict) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _opened(record)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[r for r, *_ in _hits(batch, index)]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
