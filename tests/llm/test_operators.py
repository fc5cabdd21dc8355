"""Each operator against a brute-force version, on awkward rows and on the smallest tables."""

from __future__ import annotations

import base64
import random
import resource
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from catalogkit.llm import common, components, decontamination, fingerprints, hash_arrays, license_scan, near_dedup, ngram_lm, packing, queries, substrings, token_files, tokens, toxicity, url_filter
from catalogkit.llm.tokens import Encoder, Vocabulary, encoder
from tokenizers import Tokenizer

from . import brute
from .conftest import sentence

SF = "/root/testdata/sf0.001"
WORD_BPE, BYTE_BPE = Vocabulary(public_tokenizers.path("word_bpe_49k.json"), spaced=False), Vocabulary(public_tokenizers.path("byte_bpe_50k.json"), spaced=True)


def rows_of(df, *columns) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").collect()]


def pairs(df) -> list[tuple]:
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- 1 fingerprints


def edited_want(rows: list[tuple]) -> list[tuple]:
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        half, following = len(t) // 2, rows[(i + 1) % len(rows)][1]
        out.append((d, len(t), brute.sha(t[: len(t) - half] + following[:half])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("per_bucket", [3, 1000])
def test_fingerprints_edit_follows_the_next_document(awkward, per_bucket):
    got = fingerprints.fingerprint_documents(awkward, rows_per_bucket=per_bucket)
    assert rows_of(got, "doc_id", "n_chars", "edited_sha256") == edited_want(pairs(awkward))


def test_fingerprint_query_on_whole_table(spark, documents):
    got = queries.op1_fingerprints(spark, SF).toPandas()
    assert sorted(zip(got.doc_id, got.n_chars, got.edited_sha256), key=repr) == edited_want(documents)
    assert got[["near_edited", "near_next"]].stack().between(0, 1).all()
    text = dict(documents)
    by_text: dict = {}
    for d, f in zip(got.doc_id, got.fingerprint):
        assert by_text.setdefault(text[d], f) == f
    assert got.near_edited.median() > got.near_next.median() + 0.3


def test_fingerprints_tell_their_likeness(awkward):
    """The likenesses are those of the fingerprints that are returned."""
    rows = fingerprints.fingerprint_documents(awkward, rows_per_bucket=3).collect()
    read = lambda f: {(x & ~np.uint64(0xFFFF), int(x & np.uint64(0xFFFF))) for x in np.frombuffer(base64.b64decode(f), ">u8").astype(np.uint64)}
    for r in rows:
        a, b = read(r.fingerprint), read(r.edited_fingerprint)
        size = lambda x: sum(n for _, n in x)
        want = size(a & b) / min(size(a), size(b)) if a and b else float(bool(a) == bool(b))
        assert r.near_edited == pytest.approx(want)
        assert size(a) <= r.n_chars * 4


@pytest.mark.parametrize("per_bucket", [3, 1000])
def test_fingerprints_are_likened_to_the_next_document(awkward, per_bucket):
    rows = sorted(((d, t or "") for d, t in pairs(awkward)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    sets = [fingerprints.chunk_set(t) for _, t in rows]
    want = sorted(((d, len(t), round(fingerprints.likeness(sets[i], sets[(i + 1) % len(rows)]), 9)) for i, (d, t) in enumerate(rows)), key=repr)
    got = fingerprints.fingerprint_documents(awkward, rows_per_bucket=per_bucket).select("doc_id", "n_chars", "near_next").collect()
    assert sorted(((r.doc_id, r.n_chars, round(r.near_next, 9)) for r in got), key=repr) == want


def plain_chunks(raw: bytes) -> list[bytes]:
    """The chunks of a text, byte by byte."""
    out, begin, h = [], 0, 0
    for i, c in enumerate(raw):
        h = ((h << 1) + int(fingerprints._GEAR[c])) & 0xFFFFFFFF
        n, top = i + 1 - begin, h >> 27
        if n >= fingerprints.LONGEST or (n >= fingerprints.SHORTEST and (top == 0 or n >= fingerprints.NORMAL and top < 4)):
            out.append(raw[begin : i + 1])
            begin = i + 1
    return out + [raw[begin:]] * (begin < len(raw))


def test_chunks_are_those_of_a_byte_by_byte_walk(documents):
    for _, t in documents[:60]:
        raw = (t or "").encode()
        ends = fingerprints.chunk_ends(np.frombuffer(raw, np.uint8))
        assert [raw[a:b] for a, b in zip([0, *ends], ends)] == plain_chunks(raw)


def test_chunks_survive_a_shift():
    text = sentence(random.Random(1), 2000)
    a, b = fingerprints.chunk_set(text), fingerprints.chunk_set("an inserted start " + text)
    assert fingerprints.likeness(a, b) > 0.98
    assert fingerprints.likeness(a, fingerprints.chunk_set(sentence(random.Random(2), 2000))) < 0.05
    sizes = np.diff([0, *fingerprints.chunk_ends(np.frombuffer(text.encode(), np.uint8))])
    assert sizes.max() <= fingerprints.LONGEST and sizes[:-1].min() >= fingerprints.SHORTEST
    empty = fingerprints.chunk_set("")
    assert fingerprints.likeness(empty, empty) == 1 and fingerprints.likeness(empty, a) == 0


# ---------------------------------------------------------------- 2 language model


@pytest.mark.parametrize("order", [2, 3])
def test_model_is_the_brute_force_model(spark, awkward, order):
    rows = pairs(awkward)
    train = [t for d, t in rows if d is None or d % 2]
    got = ngram_lm.score(awkward, ngram_lm.fit(awkward.where("doc_id is null or doc_id % 2 = 1"), order))
    score, p, known = brute.kneser_ney(train, order)
    n = sum(known.values())
    want = sorted(((d, len(brute.tokens(t)), sum(x in known for x in brute.tokens(t)), n, round(score(t), 6)) for d, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.score, 6)) for r in got.collect()), key=repr) == want
    w = brute.tokens(rows[0][1])
    for context in (("one",), ("<s>",), ("never seen",), ("<s>", "one"), (w[3], w[4]), ("x", w[4])):
        assert abs(sum(p(context, b) for b in [*known, "unknown"]) - 1) < 1e-9


def test_language_model_query(spark, documents):
    got = {r.doc_id: r for r in queries.op2_ngram_lm(spark, SF).collect()}
    train = [t for d, t in documents if brute.fold(d, 10)]
    score, _, known = brute.kneser_ney(train)
    n, v = sum(known.values()), len(known)
    for d, t in documents:
        r, toks = got[d], brute.tokens(t)
        base = sum(np.log10((known[x] + 0.1) / (n + 0.1 * (v + 1))) for x in toks)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (brute.fold(d, 10) == 0, len(toks), sum(x in known for x in toks), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base) and abs(r.score - score(t)) < 1e-6 * max(1, -base)


def test_model_of_nothing(spark, awkward, no_docs):
    got = ngram_lm.score(awkward, ngram_lm.fit(no_docs)).collect()
    assert len(got) == awkward.count() and all(np.isfinite(r.score) and r.n_known == 0 and r.train_tokens == 0 for r in got)
    assert ngram_lm.score(no_docs, ngram_lm.fit(awkward)).count() == 0


# ---------------------------------------------------------------- 3 toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op3_toxicity(spark, sf).join(common.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    precision, recall = hit / max(1, (got.predicted == 1).sum()), hit / (got.toxic == 1).sum()
    print(f"held-out rows {len(got)}, precision {precision:.3f}, recall {recall:.3f}")
    assert precision > 0.9 and recall > 0.9
    assert got.score.between(0, 1).all()


def test_toxicity_query_on_whole_table(spark):
    """The query's rows are those of the model's features and weights, computed text by text."""
    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents")
    model = toxicity.fit(docs, common.table(spark, sf, "labels"), held_out_fold=2, folds=4)
    assert model["lexicon"] and model["odds"].keys() == model["lexicon"].keys()
    scorer, want = toxicity.Scorer(model["lexicon"], model["exceptions"], model["odds"]), []
    for d, t in docs.select("doc_id", "text").collect():
        weight, density, most, n = scorer.features(t)
        z = model["weights"][0] + np.dot([np.log1p(weight), np.sqrt(density), most], model["weights"][1:])
        score = 1 / (1 + np.exp(-z))
        want.append((d, brute.fold(d, 4) == 2, round(score, 9), int(score >= 0.3)))
    got = [(r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in queries.op3_toxicity(spark, sf).collect()]
    assert sorted(got) == sorted(want)


def test_toxicity_of_awkward_rows(spark, awkward, no_docs):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.fit(awkward, labels)
    assert toxicity.score_documents(awkward, model).where("score between 0 and 1").count() == awkward.count()
    assert toxicity.score_documents(no_docs, toxicity.fit(no_docs, labels)).count() == 0


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_accepts_what_the_distance_allows():
    rng, letters = random.Random(3), "abcd"
    lexicon = {"".join(rng.choice(letters) for _ in range(rng.randrange(4, 11))): False for _ in range(30)}
    matcher = toxicity.Matcher(lexicon)
    for _ in range(3000):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(3, 12)))
        # edits begin after the first letter
        fits = [(distance(word[1:], t[1:]), t) for t in lexicon if t[0] == word[0] and distance(word[1:], t[1:]) <= toxicity.allowed(t, False)]
        best = min(fits, default=None)
        assert matcher.match(word) == (best and (best[1], best[0])), word


def test_quotation_weighs_less():
    scorer = toxicity.Scorer({"villain": False})
    plain, quoted = scorer.features("you are a villain and worse")[0], scorer.features('she read out "a villain indeed" to us')[0]
    assert 0 < quoted < plain
    assert scorer.features("a vilain")[0] == pytest.approx(0.8)


# ---------------------------------------------------------------- 4 licenses


def test_licenses_against_brute_force(spark, documents):
    got = rows_of(queries.op4_license_scan(spark, SF), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted(((d, *brute.licenses(t, license_scan.NOTICES)) for d, t in documents), key=repr)


def test_licenses_of_awkward_rows(spark, awkward, no_docs):
    extra = spark.createDataFrame([(20, "cc by nc CC-BY-NC cc by nc-cc by nc"), (21, "Under the MIT licence, unter the mit license"), (22, "Apache License, Version 2.0"), (23, "apache lisense version 2")], "doc_id long, text string")
    df = awkward.select("doc_id", "text").union(extra)
    found = license_scan.scan_licenses(df)
    assert rows_of(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(((d, *brute.licenses(t, license_scan.NOTICES)) for d, t in pairs(df)), key=repr)
    by = {r.doc_id: r for r in found.collect()}
    assert by[21].labels == "mit" and by[21].base_labels == "" and len(by[21].spans) == 2 and 0 < by[21].score < 1
    assert by[23].labels == "apache-2" and by[23].n_base == 0
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in by.values())
    assert license_scan.scan_licenses(no_docs).count() == 0


def test_license_variants_with_a_misspelled_article_or_before_an_exact_notice():
    notices = [license_scan.Notice(*x) for x in license_scan.NOTICES.items()]
    for text, label in (("under teh mit license", "mit"), ("under th mit license", "mit"), ("under the mip license", ""), ("apache license version 3", "")):
        assert license_scan.scan(text, notices)["labels"] == label
    two = license_scan.scan("under the mit licens under the mit license", notices)["spans"]
    assert [(s["first_word"], s["n_words"], s["edits"]) for s in two] == [(0, 4, 1), (4, 4, 0)]


def plain_labels(text: str | None) -> str:
    """Labels of every run of words that a notice's pattern takes as a whole, run by run."""
    words, found = brute.license_words(text), set()
    for phrase, label in license_scan.NOTICES.items():
        n = license_scan.Notice(phrase, label)
        whole = regex.compile(rf"(?:{regex.escape(phrase)}){{e<={n.edits}}}".encode())
        for size in range(max(1, phrase.count(" ") - n.edits + 1), phrase.count(" ") + n.edits + 2):
            for i in range(len(words) - size + 1):
                run = b" ".join(words[i : i + size])
                if abs(len(run) - len(phrase)) <= n.edits and whole.fullmatch(run) and n.tells(run):
                    found.add(label)
    return ",".join(sorted(found))


def test_license_labels_against_every_run_of_words(spark):
    rng = random.Random(31)
    rows = []
    for d in range(150):
        phrase = list(rng.choice(list(license_scan.NOTICES)))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(phrase))
            phrase[i : i + rng.randrange(2)] = rng.choice(["", "x", " ", "e"])
        rows.append((d, f"{sentence(rng, 5)} {''.join(phrase)} {sentence(rng, 5)}"))
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    want = sorted((d, plain_labels(t)) for d, t in rows)
    assert rows_of(got, "doc_id", "labels") == sorted(want, key=repr) and len({x for _, x in want}) > 3


def test_licenses_of_a_long_text_of_repeats():
    notices = [license_scan.Notice(*x) for x in license_scan.NOTICES.items()]
    times = []
    for n in (1250, 5000):  # 5,000 and 20,000 words
        began = time.process_time()
        found = license_scan.scan("under the mit licence " * n, notices)
        times.append(time.process_time() - began)
        assert found["n_words"] == 4 * n and len(found["spans"]) == n and found["labels"] == "mit"
    assert times[1] < 10 * times[0] + 0.5  # four times the text


# ---------------------------------------------------------------- 5 near-duplicates


def test_near_duplicates_of_awkward_rows(awkward, no_docs):
    for width in (4, 5):
        assert rows_of(near_dedup.near_duplicates(awkward, width), "doc_id", "n_shingles", "component_id", "kept") == brute.near_duplicates(pairs(awkward), width)
    assert near_dedup.near_duplicates(no_docs).count() == 0


def drifting(rng: random.Random, n: int) -> list[tuple]:
    """Copies that drift away from the first one, so that links form chains."""
    out = []
    for group in range(3):
        w = sentence(rng, 150).split()
        for _ in range(n):
            out.append((len(out) + 1, " ".join(w)))
            if rng.random() < 0.7:
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    rng.shuffle(out)
    return out


def test_near_duplicates_in_chains_and_small_blocks(spark):
    rows = drifting(random.Random(11), 40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_duplicates(rows, 4)
    for block in (7, 500):
        assert rows_of(near_dedup.near_duplicates(df, 4, block_docs=block), "doc_id", "n_shingles", "component_id", "kept") == want


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(None, 3), (4, 4)] + [(1000, 1000 + i) for i in range(300)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted((x, find(x)) for x in up if any(find(y) == find(x) for y in up if y != x))
    assert sorted(tuple(r) for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()) == want


def marked(text: str):
    least = near_dedup.minima(near_dedup.shingle_set(common.text_word_hashes(text, lower=True), 4))
    return near_dedup.band_keys(least), near_dedup.signature(least)


def outshone(rng: random.Random, copies: int) -> list[tuple]:
    """Two near-copies of a passage, and documents that hold the passage among others: each bucket of the two has a more
    central document that is far from both."""
    passage = sentence(rng, 100)
    near = " ".join(passage.split()[:-18] + ["changed"] * 2 + passage.split()[-16:])
    (one, mark), (two, _) = marked(passage), marked(near)
    shared, texts = sorted(set(one[one == two].tolist())), [passage, near]
    for i in range(0, len(shared), 4):
        text, kept = passage, set(shared[i : i + 4])
        while near_dedup.estimates(mark, marked(text)[1][None, :])[0] > 0.4:
            longer = text + " " + sentence(rng, 6)
            if kept <= set(marked(longer)[0].tolist()):
                text = longer
        texts += [text] + [f"{text} more{k}" for k in range(copies)]
    return list(enumerate(texts))


def test_near_duplicates_that_are_far_from_the_centres_of_their_buckets(spark):
    rows = outshone(random.Random(23), 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_duplicates(rows, 4)
    assert want[0][2] == want[1][2]
    for size in (7, 1000):
        assert rows_of(near_dedup.near_duplicates(df, 4, bucket_docs=size), "doc_id", "n_shingles", "component_id", "kept") == want


def test_near_duplicates_move_few_texts_of_a_cluster_without_links(spark, monkeypatch):
    rng = random.Random(29)
    passages = [sentence(rng, 60) for _ in range(12)]
    rows = list(enumerate(" ".join(rng.sample(passages, 6)) for _ in range(200)))
    dealt, moved = near_dedup._dealt, []
    monkeypatch.setattr(near_dedup, "_dealt", lambda df: moved.append(df.count() if "text" in df.columns else 0) or dealt(df))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, block_docs=5)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == brute.near_duplicates(rows, 4)
    # 200 in a first block, 8 in each of 40 blocks, and those of pairs that may be linked
    assert 200 <= sum(moved) < 2000


def test_sets_with_one_digest_are_told_apart(spark):
    rows = [(1, 5, 50, 3), (2, 5, 60, 3), (3, 5, 50, 3), (4, 6, 70, 9), (5, None, None, 0), (None, 6, 70, 9)]
    sketch, heads = near_dedup.told_apart(spark.createDataFrame(rows, "doc_id long, node long, other long, n_shingles long"))
    assert rows_of(sketch, "doc_id", "node") == sorted([(1, 50), (2, 60), (3, 50), (4, 6), (5, None), (None, 6)], key=repr)
    assert rows_of(heads, "node", "head") == [(50, 1), (6, 4), (60, 2)]


def test_signature_estimate_is_near_the_truth():
    rng = np.random.default_rng(4)
    for share in (0.2, 0.5, 0.8):
        base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
        k = int(2 * 3000 * share / (1 + share))
        a, b = np.sort(base), np.sort(np.concatenate([base[:k], rng.integers(0, 2**63, 3000 - k, dtype=np.uint64)]))
        got = near_dedup.estimates(near_dedup.signature(near_dedup.minima(a)), near_dedup.signature(near_dedup.minima(b))[None, :])[0]
        assert abs(got - share) < 0.15
        assert abs(near_dedup.fine_estimates(near_dedup.fine(a)[None, :], near_dedup.fine(b)[None, :])[0] - share) < 0.08


# ---------------------------------------------------------------- 6 repeated passages


def test_repeats_against_brute_force(spark, awkward, no_docs, documents):
    assert rows_of(substrings.remove_repeats(awkward, 20), "doc_id", "n_words", "n_removed", "kept_text") == brute.remove_repeats(pairs(awkward), 20)
    assert substrings.remove_repeats(no_docs).count() == 0
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60)))) for i in range(60)]  # repeats within and across texts
    for window in (1, 2, 7, 12):
        got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window)
        assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_text") == brute.remove_repeats(rows, window)
    want = sorted(((d, n, k, brute.sha(t)) for d, n, k, t in brute.remove_repeats(documents, 35)), key=repr)
    assert rows_of(queries.op6_substring_dedup(spark, SF), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_windows_with_equal_first_hashes_are_told_apart(spark):
    key, n = 1 << 60, 16
    tally, batches = hash_arrays.PairTally(n), []
    for second in (7, 7, 9, 9, 11):
        batches += list(tally.add(np.array([key], np.uint64), np.array([second], np.uint64)))
    batches += list(tally.finish())
    rows = [(r["bucket"], r["keys"], r["beside"], r["counts"]) for b in batches for r in b.to_pylist()]
    record = hash_arrays.store_repeated(spark.createDataFrame(rows, hash_arrays.PAIRS), n, "told")
    place, second = hash_arrays.HashArrays(record).lookup(np.array([key, key + 1], np.uint64))
    assert place.tolist() == [0, -1] and second[0] == 7 and record["ties"] == {(key, 9)}


def test_many_shards_take_few_descriptors(tmp_path):
    """20,000 shards in as many files, looked up while 1,024 files may be open."""
    files, bits, rng = [], 15, np.random.default_rng(1)
    hashes = np.sort(rng.integers(0, 20_000, 60_000).astype(np.uint64) << np.uint64(64 - bits) | rng.integers(0, 2**40, 60_000).astype(np.uint64))
    hashes = np.unique(hashes)
    counts = rng.integers(1, 600, len(hashes))
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=2**bits))
    for i, j in zip(edges, edges[1:]):
        writer = hash_arrays.Writer(str(tmp_path), "many")
        writer.add(int(bucket[i]), hashes[i:j], counts[i:j])
        files.append(writer.close())
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (1024, hard))
    try:
        stored = hash_arrays.HashArrays(hash_arrays.record(str(tmp_path), 1 << bits, files))
        place, count = stored.lookup(np.concatenate([hashes[::-1], hashes + np.uint64(1)]))
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    n = len(hashes)
    assert len(files) > 18_000 and len(common._mapped) <= common.MOST_MAPPED
    assert place[:n].tolist() == list(range(n))[::-1] and (count[:n] == counts[::-1]).all()
    assert ((place[n:] >= 0) == np.isin(hashes + np.uint64(1), hashes)).all()


def test_arrays_of_another_store_are_read_by_ranges(tmp_path, monkeypatch):
    writer = hash_arrays.Writer(str(tmp_path), "far")
    for b in range(4):
        writer.add(b, (np.arange(100, dtype=np.uint64) * np.uint64(3)) + (np.uint64(b) << np.uint64(62)), np.arange(100) * 7)
    record = hash_arrays.record(str(tmp_path), 4, [writer.close()])
    monkeypatch.setattr(common.pafs, "LocalFileSystem", type("none", (), {}))
    monkeypatch.setattr(common, "MOST_READ_BYTES", 1000)
    place, count = hash_arrays.HashArrays(record).lookup(np.array([3, 4, (3 << 62) + 297], np.uint64))
    assert place.tolist() == [1, -1, 399] and count.tolist() == [7, 0, 693] and len(common._read) <= 2


# ---------------------------------------------------------------- 7 urls


def test_urls_against_brute_force(spark, no_docs):
    urls = [None, "", "nothing", "http://", "https://EXAMPLE.net/en/a?b#c", "https://www.example.net/en", "x://example.net", "ftp://example.com/de/x", "http://a.org/fr/://b.net/", "http://org/fr/", "http://net//", "http://a.b.example.com/de/", "HTTP://É.Net/É", "http://examplenet/en/", "a#://x.net/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, *urls])], "page_id long, url string, rule string")
    index = url_filter.build_index(spark.createDataFrame(queries.URL_RULES, "rule string, verdict string"))
    want = sorted(((i, *brute.judge(u, queries.URL_RULES)) for i, u in enumerate([*urls, *urls])), key=repr)
    assert rows_of(url_filter.apply(df, index), "page_id", "host", "path", "rule", "verdict") == want
    assert url_filter.build_index(spark.createDataFrame([], "rule string, verdict string")) == []
    assert url_filter.apply(df.limit(0), index).count() == 0


def test_equal_digests_do_not_decide(monkeypatch, spark):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda _: 7)
    shard = url_filter._Shard.__new__(url_filter._Shard)
    shard.digests, shard.ends, shard.strings, shard.blocked = np.array([7, 7], np.uint64), np.array([3, 6]), np.frombuffer(b"a/bc/d", np.uint8), np.array([1, 0], np.uint8)
    assert list(shard.probe([b"c/d", b"e/f", b"a/b"], np.array([7, 7, 7], np.uint64))) == [(0, False), (2, True)]


# ---------------------------------------------------------------- 8 decontamination


def bm25_hits(rows: list[tuple], items: list[tuple]) -> set:
    """All (doc_id, item_id, passage) that reach the threshold, from full scores of every passage and item."""
    words = {i: decontamination.text_terms(t).tolist() for i, t in items}
    n, average = len(items), sum(map(len, words.values())) / len(items)
    df = {}
    for w in words.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    k1, b = decontamination.K1, decontamination.B
    impact = {}
    for i, w in words.items():
        for x in set(w):
            tf = w.count(x)
            impact[i, x] = np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / average))
    own = {i: sum(impact[i, x] for x in set(w)) for i, w in words.items()}
    found = set()
    for d, t in rows:
        w = decontamination.text_terms(t).tolist()
        for i, mine in words.items():
            stride = 8
            while stride < len(mine):
                stride *= 2
            for k in range(-(-len(w) // stride)):
                here = set(w[k * stride : (k + 2) * stride])
                if sum(impact[i, x] for x in set(mine) & here) / own[i] >= decontamination.THRESHOLD:
                    found.add((d, i, k))
    return found


def retrieved(rows: list[tuple], items: list[tuple]) -> set:
    terms = [decontamination.text_terms(t) for _, t in rows]
    parts = [decontamination.Part(*x) for x in decontamination.build(items)]
    counts = np.array([len(t) for t in terms])
    return {(rows[d][0], int(p.item_id[i]), k) for p in parts for d, k, i, _ in p.retrieve(np.concatenate(terms), counts)}


def test_wand_finds_all_that_full_scores_find(spark):
    items = [tuple(r) for r in common.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    texts = [tuple(r) for r in common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").orderBy("doc_id").collect()]
    held = [r for r in texts if any(t in (r[1] or "") for _, t in items)]
    rows = held[:12] + [r for r in texts[:40] if len(r[1] or "") < 4000] + [(-1, items[0][1] + " and more"), (-2, " ".join(items[1][1].split()[:-2]))]
    want = bm25_hits(rows, items)
    assert want and {-1, -2} <= {d for d, *_ in want}
    assert retrieved(rows, items) == want


def test_wand_with_ties_lengths_and_frequent_terms():
    rng = random.Random(77)
    some = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(some if rng.random() < 0.6 else [f"own{i}x{k}" for k in range(5)]) for _ in range(rng.choice((1, 5, 9, 20, 70, 300))))) for i in range(150)]
    items += [(1000 + i, items[i][1]) for i in range(10)]
    rows = [(d, " ".join([rng.choice(some) for _ in range(rng.randrange(200))] + rng.choice(items)[1].split()[: rng.choice((3, 30, 400))] + [rng.choice(some) for _ in range(30)])) for d in range(40)]
    want = bm25_hits(rows, items)
    assert len(want) > 40 and retrieved(rows, items) == want


def test_contaminated_documents(spark, awkward, no_docs):
    rng = random.Random(21)
    item = f"What does the {sentence(rng, 12)} do? It {sentence(rng, 9)} again."
    items = spark.createDataFrame([(1, item), (2, f"Why is {sentence(rng, 15)} so? Because {sentence(rng, 10)}."), (3, None), (4, ""), (5, item)], "item_id long, text string")
    record = decontamination.index_items(items)
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame([(30, sentence(rng, 700) + " " + item.upper() + " " + sentence(rng, 700)), (31, item.split("?")[0])], "doc_id long, text string"))
    assert [(r.doc_id, r.item_id) for r in decontamination.find_contaminated(docs, record).collect()] == [(30, 1)]
    left = decontamination.without_contaminated(docs, record)
    assert rows_of(left, "doc_id", "text") == rows_of(docs.where("doc_id is null or doc_id <> 30"), "doc_id", "text")
    assert decontamination.find_contaminated(no_docs, record).count() == 0
    assert decontamination.find_contaminated(docs, decontamination.index_items(items.limit(0))).count() == 0


# ---------------------------------------------------------------- 9 token files


def plain_ids(path: str, text: str | None) -> list[int]:
    t = Tokenizer.from_file(path)
    return t.encode(text or "", add_special_tokens=False).ids


def encoded(mine: Encoder, texts: list) -> list[list[int]]:
    return [x.tolist() for _, _, ids, counts in mine.encode(pa.array(texts, pa.string())) for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_encoder_gives_the_librarys_ids(documents):
    odd = ["", " ", "\n", "a\n\n b", "x\x1cy\x85z", "\ue000 a", " \ue000 ", "é  \t漢字", "tail ", " lead", "<|endoftext|> x", "</s>", "a\r\nb\u3000c", "it's we'll I'd", "1234567 a1b2", "\u180e \ufeff x", "don 't", "\u00a0x\u2028y"]
    for v in (WORD_BPE, BYTE_BPE):
        t = Tokenizer.from_file(v.path)
        t.encode_special_tokens = False
        texts = [*odd, *(t for _, t in documents), None]
        want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
        for text, a, b in zip(texts, encoded(encoder(v), texts), want, strict=True):
            assert a == b, repr(text)[:80]


def test_encoder_takes_long_texts_in_steps(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(tokens, "STEP_BYTES", 500)
    texts = [sentence(rng, 900).replace("river", "\n\n  fl\u00fc\u00dfe\u3000"), "x" * 3000, "a  b   c\t d " * 300, None]
    for v in (WORD_BPE, BYTE_BPE):
        assert encoded(Encoder(v), texts) == [plain_ids(v.path, t) for t in texts]


@pytest.mark.parametrize("vocabulary", [WORD_BPE, BYTE_BPE])
def test_ids_equal_the_librarys(vocabulary):
    rng = random.Random(5)
    letters = [chr(i) for i in range(1, 256)] + list("  \n\t''''sstdmrevl") + list("\u2019\u201c\u2026\u4e2d\u6587e\u0301\u02bc\u03a3\u03c2\u200b\u3000")
    texts = [None, "", "   ", "a  b", "x\n\n y", "it's IT'S we'LL ''s '", "a<|endoftext|>b <|startoftext|>"]
    texts += ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(2000)]
    texts += ["".join(rng.choices("aB'sStTlLvVeE 1\xb2\xbd\xaa\xba\xb5\xc0\xdf\xff\xd7\xa1\xad!.\n\t", k=rng.randint(0, 40))) for _ in range(2000)]
    mine = Encoder(Vocabulary(vocabulary.path, vocabulary.spaced, most_pieces=500))  # a small bound, so pieces go and come back
    wanted = mine.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert encoded(mine, texts) == [x.ids for x in wanted]


@pytest.mark.parametrize("vocabulary", [WORD_BPE, BYTE_BPE])
def test_encoder_keeps_pretokens_and_not_their_spellings_in_texts(vocabulary):
    rng = random.Random(14)
    words = ["".join(rng.choices("abcdefgh\xe9\xfc", k=7)) for _ in range(150)]
    around = ["{}", "{},", "{}.", "({})", "{}'s", "{}!?", '"{}"', "{}%%", "-{}-", "{}:", "[{}", "{}7"]
    texts = [" ".join(rng.sample([a.format(w) for w in words for a in around], 300)) for _ in range(40)]
    mine = Encoder(Vocabulary(vocabulary.path, vocabulary.spaced))
    assert encoded(mine, texts) == [e.ids for e in mine.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len(mine) <= 2 * (len(words) + len(around))  # with a space before them and without


@pytest.mark.parametrize("vocabulary", [WORD_BPE, BYTE_BPE])
def test_pretokens_are_cut_as_the_library_cuts(vocabulary):
    rng = random.Random(15)
    signs = ("a'''SsdrevlmT  \n\n1!", "a1\xb2\xe9\xc9\xd7!'s \n\t\r\x0b", "a's中　\xa0 \n")
    texts = ["".join(rng.choices(s, k=rng.randint(0, 30))) for s in signs for _ in range(3000)]
    mine = Encoder(Vocabulary(vocabulary.path, vocabulary.spaced, most_pieces=500))
    assert encoded(mine, texts) == [e.ids for e in mine.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_files_round_trip(spark, awkward, no_docs):
    got = rows_of(token_files.read_documents(spark, token_files.write_tokens(awkward, WORD_BPE, 2)), "doc_id", "n_tokens", "ids_crc32")
    want = []
    for d, t in pairs(awkward):
        ids = [*plain_ids(WORD_BPE.path, t), 2]
        want.append((d, len(ids), brute.ids_crc(ids)))
    assert got == sorted(want, key=repr)
    assert token_files.read_documents(spark, token_files.write_tokens(no_docs, WORD_BPE, 2)).count() == 0


def test_token_query(spark, documents):
    got = queries.op9_token_ids(spark, SF).orderBy("doc_id").collect()
    start = 0
    t = Tokenizer.from_file(WORD_BPE.path)
    for r, (d, text), e in zip(got, documents, t.encode_batch([x or "" for _, x in documents], add_special_tokens=False), strict=True):
        ids = [*e.ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), brute.ids_crc(ids))
        start += len(ids)


def test_a_damaged_block_is_seen(tmp_path):
    ids = np.random.default_rng(1).integers(0, 500, 5000).astype(np.uint16)
    coder = token_files.Coder(token_files.shares(np.bincount(ids, minlength=1 << 16)))
    w = token_files.Writer(str(tmp_path), coder)
    w.add(1, ids[:2000])
    w.flush()
    w.add(2, ids[2000:])
    w.close()
    read = list(token_files.read_blocks(str(tmp_path), w.name, coder))
    assert np.concatenate([b[3] for b in read]).tolist() == ids.tolist() and [b[1].tolist() for b in read] == [[1], [2]]
    raw = bytearray((tmp_path / w.name).read_bytes())
    raw[9000] ^= 1
    (tmp_path / w.name).write_bytes(raw)
    with pytest.raises(ValueError, match="damaged"):
        list(token_files.read_blocks(str(tmp_path), w.name, coder))


# ---------------------------------------------------------------- 10 packing


def check_packing(rows: list, docs: list[tuple], size: int, end_id: int = 2) -> int:
    """Every document is whole, cut only if too long; sequences are gapless. The number of sequences."""
    want = []
    for d, t in docs:
        ids = [*plain_ids(BYTE_BPE.path, t), end_id]
        begin, k = 0, 0
        while begin < len(ids):
            length = (len(ids) - begin) % size or size if k == 0 else size
            want.append((d, k, begin, length, brute.ids_crc(ids[begin : begin + length])))
            begin, k = begin + length, k + 1
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_packing_of_awkward_rows(awkward, no_docs):
    for per_partition in (5, 20_000):
        check_packing(packing.pack(awkward, BYTE_BPE, 2, 256, pieces_per_partition=per_partition).collect(), pairs(awkward), 256)
    assert packing.pack(no_docs, BYTE_BPE).count() == 0


def test_packing_query_is_near_its_bound(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op10_best_fit_packing(spark, sf).collect()
    docs = [tuple(r) for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()]
    bins = check_packing(rows, docs, 1024)
    bound = packing.lower_bound(np.bincount([r.length for r in rows], minlength=1025), 1024)
    print(f"sequences {bins}, lower bound {bound}")
    assert bound <= bins <= bound * 1.02 + 1


def test_lower_bound_holds():
    rng = random.Random(4)
    for _ in range(300):
        size = rng.randrange(5, 40)
        lengths = sorted((rng.randrange(1, size + 1) for _ in range(rng.randrange(0, 7))), reverse=True)
        bound = packing.lower_bound(np.bincount(lengths, minlength=size + 1), size)

        def least(rest: list[int], bins: list[int]) -> int:
            if not rest:
                return len(bins)
            return min(least(rest[1:], bins[:i] + [b + rest[0]] + bins[i + 1 :]) for i, b in [*enumerate(bins), (len(bins), 0)] if b + rest[0] <= size)

        exact = least(lengths, [])
        assert bound <= exact
        where, offset, fill = packing.best_fit(np.array(lengths, np.int64), size)
        assert len(fill) >= exact and (fill <= size).all()


# ---------------------------------------------------------------- shared helpers


def test_packed_arrays_come_back():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 1000):
        x = rng.integers(0, 2**64, n, dtype=np.uint64)
        assert (common.unpack(common.pack(x)) == x).all() and (common.unpack(common.pack(np.sort(x), True), True) == np.sort(x)).all()
    assert zlib.crc32(common.mix(np.arange(3, dtype=np.uint64)).tobytes()) == zlib.crc32(common.mix(ngram_lm.unmix(common.mix(np.arange(3, dtype=np.uint64)))).tobytes())


def test_word_hashes_are_of_words():
    texts = ["a b  a\tB\n", "", "b\u00a0c a", None, "é É"]
    import pyarrow as pa

    data, offsets = common.text_bytes(pa.array(texts))
    for lower in (False, True):
        h, counts = common.word_hashes(data, offsets, lower)
        want = [brute.words(brute.lower(t) if lower else t) for t in texts]
        assert counts.tolist() == [len(w) for w in want]
        flat = [w for ws in want for w in ws]
        assert [[a == b for b in flat] for a in flat] == [[a == b for b in h.tolist()] for a in h.tolist()]
