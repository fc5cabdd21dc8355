"""Bit fingerprints, vector codes and token alignment against brute-force versions."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from catalogkit.llm import alignment, common, queries, simhash, vector_codes
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import brute
from .conftest import sentence

SF = "/root/testdata/sf0.001"


def rows_of(df, *columns) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]


# ---------------------------------------------------------------- 11 simhash


@pytest.mark.parametrize("tile", [2, 1 << 15])
def test_simhash_is_the_brute_force_version(awkward, tile):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    assert rows_of(simhash.near_duplicates(awkward, tile=tile), "doc_id", "fingerprint", "component_id") == brute.simhash_groups(rows, 3, 3)


def test_simhash_query_on_whole_table(spark, documents):
    got = queries.op11_simhash(spark, SF)
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == brute.simhash_groups(documents, 3, 3)


def test_simhash_of_nothing(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []


def test_fingerprint_of_a_text_in_parts(monkeypatch):
    text = sentence(random.Random(3), 900) + " \x0b" + "y" * 700 + " \t\n end Of it"
    whole = simhash.fingerprint(text)
    assert whole == brute.simhash(text, 3)
    monkeypatch.setattr(common, "BLOCK_BYTES", 50)
    assert simhash.fingerprint(text) == whole
    assert simhash.fingerprint("one two") == brute.simhash("one two", 3) and simhash.fingerprint(" \n") == simhash.fingerprint(None) == 0


@pytest.mark.parametrize("tile", [7, 100])
def test_links_connect_all_within_the_radius(spark, tile):
    """Balls of fingerprints around few centres, chains among them, and fingerprints at either end of the counts."""
    rng = random.Random(9)
    marks = {0, 1, 2**64 - 1, 2**64 - 8}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(30):
            marks.add(at)
            for k in rng.sample(range(64), rng.randrange(5)):
                at ^= 1 << k
    rows = sorted(marks)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    found = simhash.links(spark.createDataFrame([(signed(m),) for m in rows], "mark long"), 3, tile).collect()
    group = {m: m for m in map(signed, rows)}
    for a, b in found:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3
        old, new = group[a], group[b]
        group = {m: new if g == old else g for m, g in group.items()}
    for i, a in enumerate(rows):
        for b in rows[:i]:
            assert (a ^ b).bit_count() > 3 or group[signed(a)] == group[signed(b)]
    assert len(found) < 200 * len(rows)


def test_a_dense_tile_gives_links_in_proportion():
    base = np.arange(4096, dtype=np.uint64)
    a, b = simhash.joining_links(base, base, True, 3)
    assert len(a) == len(b) == len(base) - 1


# ---------------------------------------------------------------- 12 vector codes


def embedding_rows(seed: int, n: int, size: int = 16) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, [rng.choice((-1, 1)) * rng.randrange(6) / 8 for _ in range(size)], rng.choice((None, 1, 2))) for i in range(n)]
    odd = [(n, None, 1), (n + 1, [], 1), (n + 2, [None] * size, None), (n + 3, [float("nan")] + [0.0] * (size - 1), 2), (n + 4, [float("-inf")] + [0.0] * (size - 1), 2)]
    return rows + odd + rows[:5] + [(None, [0.25] * size, 2)]


@pytest.mark.parametrize("n", [3, 60])
def test_codes_are_the_brute_force_codes(spark, n):
    rows = embedding_rows(n, n)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    clash = df.withColumns({c: F.lit("clash") for c in ("code", "vector", "error", "n", "sums", "label_key", "label_error")})
    got = vector_codes.encode_vectors(clash, parts=4, entries=8, rounds=5)
    assert rows_of(got, "vec_id", "code", "error", "label_error", "codebooks_sha256") == brute.vector_codes(rows, 4, 8, 5)


def test_codes_query_on_whole_table(spark):
    rows = [tuple(r) for r in common.table(spark, SF, "embeddings").select("vec_id", "embedding", "label").collect()]
    got = queries.op12_vector_codes(spark, SF)
    assert rows_of(got, "vec_id", "code", "error", "label_error", "codebooks_sha256") == brute.vector_codes(rows, 8, 16, 6)


def test_codes_of_nothing_and_of_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.encode_vectors(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1.0] * 7, 1), (2, [0.0] * 8, 1), (3, [0.0] * 16, 1), (4, [3e38] * 8, None)]
    got = {r.vec_id: r for r in vector_codes.encode_vectors(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {2, 4}  # one has no eight parts, one is longer than the first
    assert got[4].error == got[2].error == 0 and got[4].code != got[2].code


@pytest.mark.parametrize("seed", range(5))
def test_search_from_any_entry_finds_the_nearest(seed):
    rng = np.random.default_rng(seed)
    entries, points = rng.integers(-3, 4, (16, 3)), rng.integers(-4, 5, (200, 3))
    want = [min((int(((p - e) ** 2).sum()), k) for k, e in enumerate(entries)) for p in points]
    for previous in (np.zeros(200, np.uint8), rng.integers(0, 16, 200).astype(np.uint8)):
        best, least = vector_codes.nearest(points, entries, previous)
        assert list(zip(least.tolist(), best.tolist())) == want
        few = vector_codes.nearest(points[:9], entries, previous[:9])
        assert few[0].tolist() == best[:9].tolist()


# ---------------------------------------------------------------- 13 alignment

PAIR = alignment.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def whole_text_encoders():
    a, b = Tokenizer.from_file(PAIR.a), sentencepiece.SentencePieceProcessor(model_file=PAIR.b)
    a.encode_special_tokens = True
    spelled = {v: k for k, v in {k: chr(v) for k, v in byte_spelling().items()}.items()}

    def encode_a(text):
        e = a.encode(" " + text, add_special_tokens=False)
        return [(i, bytes(spelled[c] for c in t)) for i, t in zip(e.ids, e.tokens)]

    def encode_b(text):
        return [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in zip(b.encode(text), b.encode(text, out_type=str))]

    return encode_a, encode_b


def byte_spelling() -> dict[int, int]:
    """The code point that stands for each byte: its own where it can be printed, else one from 256 on, in order."""
    out, more = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = b
        else:
            out[b], more = more, more + 1
    return out


TEXTS = [
    "plain words here", "two  spaces   and\ttabs\n\n lines ", " leading", "trailing ", "a", " ", "", None, "don't can't they'll", "Straße naïve 漢字 \U0001f600 é", "x▁y", "▁", "<|endoftext|> <s> </s> <unk> <0x41>",
    "a b   c", "᠎ ᠎y", "﻿start ﻿", "\x00\x01 \x1c x", "　wide　 space", "1234567 890", "x" * 300, "https://example.com/a?b=c#d", "é combining", "plain words here",
]


def test_alignment_is_the_brute_force_alignment(spark):
    rng = random.Random(4)
    alphabet = ["a", "B", "the", " ", "  ", "\n", "é", "漢", "\U0001f600", "'s", "1", ".", " ", "\t", "᠎", "-"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(150)]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("pair", "pairs", "row", "times", "n_a", "n", "best", "count", "first")})
    want = brute.alignment(rows, *whole_text_encoders())
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert rows_of(alignment.align(df, PAIR), *columns) == want
    assert rows_of(alignment.align(df, PAIR, broadcast_pairs=0), *columns) == want


def test_alignment_query_on_whole_table(spark, documents):
    """Each side's tokens, groups and links of whole texts; counts by a plain tally."""
    got = queries.op13_alignment(spark, SF)
    short = [r for r in documents if len(r[1] or "") < 1500]
    encoders = whole_text_encoders()
    counted = {r[0]: r for r in brute.alignment(short, *encoders)}
    mine = {r.doc_id: r for r in got.collect()}
    assert len(mine) == len(documents)
    for d, r in counted.items():
        assert (mine[d].n_a, mine[d].n_b, mine[d].n_groups, mine[d].n_links, mine[d].groups_sha256) == (r[1], r[2], r[3], r[4], r[7])
        assert mine[d].n_best <= mine[d].n_links <= mine[d].count_sum


def test_alignment_of_a_long_text_in_steps(monkeypatch):
    text = "\n\n".join(sentence(random.Random(k), 40) + "  x" for k in range(10))
    mine = alignment.Aligner(PAIR)
    whole = mine.document(text)
    monkeypatch.setattr(alignment, "STEP_CHARS", 60)
    parts = mine.document(text)
    assert whole[:5] == parts[:5] and (whole[5] == parts[5]).all() and (whole[6] == parts[6]).all()
    assert mine.document("a▁b " + text)[0] == 0
    fresh = alignment.Aligner(PAIR)
    fresh.apart = False  # every stretch by itself gives the same
    marked = "word, word. Word?! naïve; été: x. ... a,b ,c"
    assert fresh.document(marked)[:5] == mine.document(marked)[:5]


def test_alignment_of_nothing(no_docs):
    assert alignment.align(no_docs, PAIR).collect() == []
