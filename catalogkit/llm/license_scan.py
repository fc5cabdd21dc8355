"""Fuzzy search for short license notices.

A notice of n characters may differ in k edits. Cut into k+1 pieces, at least one piece of any such variant is
unchanged (pigeonhole), so exact search for the pieces finds every candidate place; there the regex library's
bounded-error matching verifies the edits and reports the span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: The notices of the query and their labels.
NOTICES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
ARTICLES = ("a", "an", "the")

_WORD_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if c > 127 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def normal(text: str | None) -> bytes:
    """The words of a text, A-Z lower-cased, each with one space before and after it."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split(b" ")
    words = [w for w in words if w]
    return b" " + b" ".join(words) + b" " if words else b" "


@dataclass
class Notice:
    phrase: str
    label: str
    #: Edits that a variant may have: one in so many characters.
    chars_per_edit: int = 10
    edits: int = field(init=False)

    def __post_init__(self):
        self.exact = f" {self.phrase} ".encode()
        self.edits = len(self.phrase) // self.chars_per_edit if len(self.phrase) >= 2 * self.chars_per_edit else 0
        #: Short words and numbers other than articles tell one license from another: a variant must have them unchanged.
        self.fixed = [w for w in self.phrase.split() if len(w) <= 3 and w not in ARTICLES]
        #: A phrase of such words alone may differ in one space.
        self.spaces_only = self.fixed == self.phrase.split()
        self.edits = max(self.edits, int(self.spaces_only))
        raw, n = self.phrase.encode(), self.edits + 1
        cuts = [len(raw) * i // n for i in range(n + 1)]
        self.seeds = [(raw[a:b], a) for a, b in zip(cuts, cuts[1:])]
        self.pattern = regex.compile(rf"(?be)(?<=\ )(?:{regex.escape(self.phrase)}){{e<={self.edits}}}(?=\ )".encode())

    def tells(self, found: bytes) -> bool:
        """Whether a variant has the words that tell the license, in order."""
        if self.spaces_only:
            return found.replace(b" ", b"") == self.phrase.replace(" ", "").encode()
        it = iter(found.decode("utf-8", "replace").split())
        return all(w in it for w in self.fixed)

    def places(self, text: bytes) -> list[int]:
        """Byte positions of the first word of each exact place, overlapping ones too."""
        found, at = [], text.find(self.exact)
        while at >= 0:
            found.append(at + 1)
            at = text.find(self.exact, at + 1)
        return found

    def variants(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) in bytes of the verified variants, exact ones too, without overlaps. Each candidate place
        is verified in a span of its own, of bounded length; of variants that overlap the one with fewer edits stays."""
        near: set[int] = set()
        for seed, offset in self.seeds:
            at = text.find(seed)
            while at >= 0:
                near.add(at - offset)
                at = text.find(seed, at + 1)
        found = set()
        for at in sorted(near):
            # one letter more on both sides, so that the borders of words are seen
            m = self.pattern.search(text, max(0, at - self.edits - 1), min(len(text), at + len(self.phrase) + self.edits + 2))
            if m and self.tells(m.group()):
                found.add((sum(m.fuzzy_counts), m.start(), m.end()))
        taken, kept = np.zeros(len(text) if found else 0, bool), []
        for edits, start, end in sorted(found):
            if not taken[start:end].any():
                taken[start:end] = True
                kept.append((start, end, edits))
        return sorted(kept)


def scan(text: str | None, notices: list[Notice]) -> dict:
    words = normal(text)
    base, labels, best, spans = [], set(), 0.0, []
    base_labels, spaces = set(), None
    for n in notices:
        places = n.places(words)
        near = n.variants(words) if n.edits and any(seed in words for seed, _ in n.seeds) else []
        if spaces is None and (places or near):
            spaces = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
        if places:
            base_labels.add(n.label)
            base += [int(np.searchsorted(spaces, at)) - 1 for at in places]
            best = 1.0
        for start, end, edits in near:
            labels.add(n.label)
            first, after = np.searchsorted(spaces, (start, end)).tolist()
            spans.append({"label": n.label, "first_word": first - 1, "n_words": after - first + 1, "edits": edits})
            best = max(best, 1.0 - edits / len(n.phrase))
        spans += [{"label": n.label, "first_word": int(np.searchsorted(spaces, at)) - 1, "n_words": n.phrase.count(" ") + 1, "edits": 0} for at in places if not n.edits]
    return {
        "n_words": words.count(b" ") - 1,
        "n_base": len(base),
        "first_word": min(base, default=None),
        "last_word": max(base, default=None),
        "base_labels": ",".join(sorted(base_labels)),
        "labels": ",".join(sorted(labels | base_labels)),
        "score": best,
        "spans": sorted(spans, key=lambda s: (s["first_word"], s["label"])),
    }


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,n_words:long,edits:int>>"


def scan_licenses(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored).

    n_base counts the exact places of all notices; labels adds the notices of which a variant within the
    allowed edits was verified; spans lists the verified places. A null text is empty: no words, no places,
    empty labels, score 0. Repeated rows give repeated results; an empty table an empty one. Texts of any
    length are searched whole, in time linear in their length.
    """
    notices = notices or NOTICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [Notice(*x) for x in notices.items()]
        types = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32())])))])
        for batch in batches:
            rows = [scan(t, compiled) for t in batch["text"].to_pylist()]
            columns = [pa.array([r[f.name] for r in rows], f.type) for f in types]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *columns], names=["doc_id", *types.names])

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)
