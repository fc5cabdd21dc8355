"""Token ids by the tokenizers library, with the library asked once for each distinct piece of text.

Both vocabularies split a text into pretokens before any merge, and no pretoken reaches across white space but for
one leading space. So a text cut at those places gives the same ids piece by piece as a whole. Arrow cuts a block of
texts at spaces and finds its distinct parts. Those of Latin-1 letters, which most are, are cut into the pretokens of the
vocabulary here, all of a block at once by the classes of their bytes; the library's model gets each distinct pretoken
once, and the ids are dealt to all places at once. Other parts go through the whole library. Each worker keeps the ids of
the pretokens and other parts that it has met, up to a bound.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from . import common

#: White space for Python but not for the tokenizers: texts with it are encoded whole.
_ODD = re.compile("[\x1c-\x1f\x85᠎﻿]")
_PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Bytes of text of one vectorised step.
STEP_BYTES = 4 << 20
#: Printable Latin-1 is in normal form, and Python and the tokenizers agree on its classes and lower case.
_LATIN = re.compile("[\x20-\x7e\xa1-\xff]*[\x21-\x7e\xa1-\xff]")
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: How the two kinds of vocabulary cut a piece into pretokens.
_SPACED = re.compile(f"{_ENDINGS}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^ {_LETTER}{_NUMBER}]+")
_UNSPACED = re.compile(f"{_ENDINGS}|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")

#: Classes of the bytes of printable Latin-1 and ASCII white space in UTF-8; other letters have none.
_L, _N, _O, _W = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _O
_CLASS[[0x20, *range(0x09, 0x0E)]] = _W
#: By the second byte, after 0xC2 and after 0xC3.
_CLASS_C2, _CLASS_C3 = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
_CLASS_C2[0xA1:0xC0] = _CLASS_C3[0x80:0xC0] = _O
for _c, _letters in ((_L, re.compile(f"[{_LETTER}]")), (_N, re.compile(f"[{_NUMBER}]"))):
    for _i in filter(lambda i: _letters.match(chr(i)), range(0x100)):
        (_CLASS if _i < 0x80 else _CLASS_C2 if _i < 0xC0 else _CLASS_C3)[chr(_i).encode()[-1]] = _c
#: What lower-casing adds to the second byte after 0xC3.
_DOWN_C3 = np.array([0x20 if 0x80 <= i <= 0x9E and i != 0x97 else 0 for i in range(256)], np.uint8)
_SHORT_ENDINGS, _LONG_ENDINGS = np.frombuffer(b"stmd", np.uint8), ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C))


@dataclass
class Vocabulary:
    """path: a tokenizers file. spaced: pieces keep white space (byte-level BPE); else white space only separates."""

    path: str
    spaced: bool
    most_pieces: int = 120_000


class Encoder(dict):
    """Ids of each pretoken and piece met so far, as bytes; what is missing is looked up in the library."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.older: dict[str, bytes] = {}  # what was met before the last time that there were too many pieces
        self.v = vocabulary
        self.tokenizer = Tokenizer.from_file(vocabulary.path)
        self.model = self.tokenizer.model
        self.cut = (_SPACED if vocabulary.spaced else _UNSPACED).findall
        self.split = _PIECE.findall if vocabulary.spaced else str.split
        letters = [chr(i) for i in (*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA1, 0x100))]
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in letters}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self._new(piece)
        self[piece] = ids
        return ids

    def _new(self, piece: str) -> bytes:
        low = piece if self.v.spaced else piece.lower()
        if not _LATIN.fullmatch(piece):
            pieces = self.split(piece)  # a part that ends at a space may hold other white space
            return self._whole(piece) if pieces == [piece] else b"".join(map(self.__getitem__, pieces))
        cut = self.cut(low)  # a pretoken has the same ids when it is a piece
        return self._pretoken(low.translate(self.spelling)) if cut == [low] else b"".join(map(self.__getitem__, cut))

    def _pretoken(self, spelled: str) -> bytes:
        return array("H", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()

    def _pretokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of pieces (lower-cased where the vocabulary does so), the first byte of each pretoken, and which pretokens
        are a whole piece with a letter outside Latin-1. A space in a piece stands first or among white space only."""
        size = np.diff(offsets)
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        kind, low = _CLASS[data], data if self.v.spaced else common._LOWER[data]
        for lead, classes in ((0xC2, _CLASS_C2), (0xC3, _CLASS_C3)):
            at = np.flatnonzero(data == lead)
            kind[at] = kind[at + 1] = classes[data[at + 1]]
            if lead == 0xC3 and not self.v.spaced:
                low[at + 1] += _DOWN_C3[data[at + 1]]
        start = begins[:-1].copy()
        start[1:] |= kind[1:] != kind[:-1]
        if self.v.spaced:
            gap = kind == _W
            if gap.any():  # the last of some white space stands alone before a word; a leading space belongs to the word
                last = np.flatnonzero(gap[:-1] & ~gap[1:] & ~begins[1:-1])
                start[last] = True
                start[last[begins[last] & (data[last] == 0x20)] + 1] = False
        else:
            start |= (kind == _N) & (data & 0xC0 != 0x80)
        at = np.flatnonzero(low == 0x27)
        if len(at):  # endings: not after other signs or a space, which take the apostrophe
            before = at - 1
            at = at[begins[at] | (kind[before] != _O) & (data[before] != 0x20)]
            room = np.concatenate([low, np.zeros(2, np.uint8)])
            one, two = room[at + 1], room[at + 2]
            short = np.isin(one, _SHORT_ENDINGS) & ~begins[at + 1]
            long = np.zeros(len(at), bool)
            for x, y in _LONG_ENDINGS:
                long |= (one == x) & (two == y)
            long &= ~(begins[at + 1] | begins[np.minimum(at + 2, len(data))])
            start[at[short | long] + 1] = False
            after = np.concatenate([at[short] + 2, at[long] + 3])
            start[after[after < len(data)]] = True
        strange = kind == 0
        if strange.any():
            whole = np.zeros(len(size), bool)
            whole[np.searchsorted(offsets, np.flatnonzero(strange), "right") - 1] = True
            inside = np.repeat(whole, size)
            start &= ~inside | begins[:-1]
            low = np.where(inside, data, low)
            first = np.flatnonzero(start)
            return low, first, np.flatnonzero(inside[first])
        return low, np.flatnonzero(start), np.empty(0, np.int64)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, and how many each has."""
        data, offsets = common.text_bytes(pieces)
        if not len(data):
            return np.empty(0, np.uint16), np.zeros(len(pieces), np.int64)
        data, first, whole = self._pretokens(data, offsets)
        bounds = pa.py_buffer(np.append(first, len(data)).astype(np.int64))
        coded = pa.LargeStringArray.from_buffers(len(first), bounds, pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        which, units = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        strange = np.zeros(len(units), bool)
        strange[which[whole]] = True
        raw = list(map(self.get, units))
        for i in [i for i, ids in enumerate(raw) if ids is None]:
            unit = units[i]
            ids = self.older.get(unit)
            if ids is None:
                ids = self._new(unit) if strange[i] else self._pretoken(unit if unit.isascii() and unit.isalnum() else unit.translate(self.spelling))
            raw[i] = self[unit] = ids
        ids, n = _gathered(np.frombuffer(b"".join(raw), np.uint16), np.fromiter(map(len, raw), np.int64, len(raw)) // 2, which)
        return ids, np.diff(np.concatenate([[0], np.cumsum(n)])[np.searchsorted(first, offsets)])

    def _texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts: as a whole if one has a letter that the two sides see differently, else piece by piece."""
        whole = [bool(_ODD.search(t)) or any(s in t for s in self.special) for t in texts]
        split = [[] if w else self.split(t) for t, w in zip(texts, whole)]
        coded = pa.array([p for pieces in split for p in pieces], pa.large_string()).dictionary_encode()
        ids, n = _gathered(*self._pieces(coded.dictionary), coded.indices.to_numpy())
        each = np.split(ids, np.concatenate([[0], np.cumsum(n)])[np.cumsum([len(x) for x in split])[:-1]])
        return [np.frombuffer(self._whole(t), np.uint16) if w else x for t, w, x in zip(texts, whole, each)]

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts, and how many each has."""
        alone = pc.match_substring_regex(texts, _ODD.pattern)
        for s in self.special:
            alone = pc.or_(alone, pc.match_substring(texts, s))
        alone = alone.to_numpy(zero_copy_only=False)
        # in front of a space that white space does not follow a piece always begins
        parts = pc.split_pattern(texts, " ") if self.v.spaced else pc.ascii_split_whitespace(texts)
        ends = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        which, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        if self.v.spaced:
            none = pa.scalar("", pa.large_string())
            first = ends[:-1]  # the first part of a text has no space before it
            heads = pc.utf8_slice_codeunits(pieces, 0, 1).to_numpy(zero_copy_only=False).tolist()
            odd = np.fromiter((not c or c.isspace() for c in heads), bool, len(pieces))
            at = odd[which]
            at[first] = False
            alone = alone | (np.diff(np.concatenate([[0], np.cumsum(at)])[ends]) > 0)
            begun = pieces.take(pa.array(which[first]))
            which[first] = len(pieces) + np.arange(len(first))
            pieces = pa.concat_arrays([pc.if_else(pa.array(odd), none, pc.binary_join_element_wise(none, pieces, pa.scalar(" ", pa.large_string()))), begun])
        ids, n = _gathered(*self._pieces(pieces), which)
        counts = np.diff(np.concatenate([[0], np.cumsum(n)])[ends])
        if alone.any():
            each, places = np.split(ids, np.cumsum(counts)[:-1]), np.flatnonzero(alone).tolist()
            for i, found in zip(places, self._texts([texts[i].as_py() for i in places])):
                each[i] = found
            ids, counts = np.concatenate(each), np.array([len(x) for x in each], np.int64)
        if len(self) > self.v.most_pieces:
            self.older = dict(self)
            self.clear()
        return ids, counts

    def _long(self, text: str) -> np.ndarray:
        """A very long text, a step after the other; each step but the first begins with a space before a word."""
        out, at = [], 0
        while at < len(text):
            end = at + STEP_BYTES // 2
            cut = re.compile(r" (?=\S)").search(text, end) if end < len(text) else None
            end = cut.start() if cut else len(text)
            out.append(self._block(pa.array([text[at:end]], pa.large_string()))[0])
            at = end
        return np.concatenate(out)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row, ids as uint16, ids of each text) of a column, by blocks of rows; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        for a, b in common.blocks(common.text_bytes(texts)[1], STEP_BYTES):
            part = texts.slice(a, b - a)
            if b - a == 1 and part.nbytes > 2 * STEP_BYTES and not _ODD.search(text := part[0].as_py()) and not any(s in text for s in self.special):
                ids = self._long(text)
                yield a, b, ids, np.array([len(ids)])
            else:
                yield a, b, *self._block(part)


def _gathered(ids: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of runs, which stand one after the other with these sizes, at the places that name a run each; their counts."""
    n = size[which]
    upto = np.cumsum(n)
    shift = (np.cumsum(size) - size)[which] - (upto - n)
    return ids[np.repeat(shift, n) + np.arange(upto[-1] if len(upto) else 0)], n


_encoders: dict[tuple, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder; it stays with the worker from task to task."""
    key = (vocabulary.path, vocabulary.spaced, vocabulary.most_pieces)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]
