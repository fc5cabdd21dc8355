"""The corpus pipeline: planted cases go, clean documents stay, and each stage does what its operator says."""

from __future__ import annotations

import random
import zlib

import corpus_pipeline
import pytest
from catalogkit.llm import common, stages, toxicity

from . import brute
from .conftest import sentence
from .test_operators import check_packing, rows_of


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables with planted cases; the ids of each kind."""
    rng = random.Random(17)
    bad = ["villain", "rascal", "scoundrel"]
    docs, labels = {}, []
    for i in range(1, 161):
        docs[i] = sentence(rng, rng.randrange(80, 160))
        labels.append((i, 1, 0))
    for i in range(161, 241):
        w = sentence(rng, 90).split()
        for _ in range(8):
            w[rng.randrange(len(w))] = rng.choice(bad)
        docs[i] = " ".join(w)
        if i % 2:
            labels.append((i, 0, 1))
    w = docs[1].split()
    w[40] = "changed"
    docs[301], docs[302] = " ".join(w), docs[2]
    passage = sentence(rng, 60)
    docs[303], docs[304] = f"{sentence(rng, 70)} {passage} {sentence(rng, 70)}", f"{sentence(rng, 80)} {passage} {sentence(rng, 60)}"
    item = f"What does the {sentence(rng, 14)} hold? It holds {sentence(rng, 12)}."
    docs[305] = f"{sentence(rng, 90)} {item} {sentence(rng, 90)}"
    docs[306], docs[307] = None, ""
    at = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in sorted(docs.items())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, f"Where is {sentence(rng, 12)}? In {sentence(rng, 11)}.")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), docs, passage


def test_stages_take_effect(spark, corpus):
    at, texts, passage = corpus
    docs = common.table(spark, at, "documents")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, at), name)
        assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    toxic, near, repeats, clean = seen
    assert not set(range(161, 241)) & set(toxic) and set(range(1, 161)) <= set(toxic)
    assert set(toxic) - set(near) == {301, 302}
    assert set(repeats) == set(near)
    assert repeats[303] == texts[303].replace(passage + " ", "") and repeats[304] == texts[304].replace(passage + " ", "")
    assert all(repeats[i] == texts[i] for i in repeats if i not in (303, 304))
    assert set(repeats) - set(clean) == {305}
    lengths = {r.doc_id: r.n_chars for r in docs.collect()}
    assert all(n == len(clean[i] or "") for i, n in lengths.items())
    check_packing(stages.pack_documents(spark, docs, at).collect(), list(clean.items()), 1024)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, at).select("doc_id").distinct().collect()) == sorted(clean)


def test_toxicity_stage_learns_from_all_labels(spark, tmp_path):
    rng = random.Random(31)
    bad = {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}  # the fold that op3 holds out
    rows = [(i, sentence(rng, 80) + (" villain rascal scoundrel" * 4 if i in bad else "")) for i in range(400)]
    spark.createDataFrame([(i, int(i in bad)) for i, _ in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = stages.drop_toxic(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(range(400)) - bad


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    model = toxicity.fit(docs, common.table(spark, sf, "labels"))
    score = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    kept = stages.drop_toxic(spark, docs, sf)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, s in score.items() if s < stages.TOXIC_FROM}
    rows = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    near = stages.drop_near_copies(spark, kept, sf)
    want = {d for d, _, _, stays in brute.near_duplicates(rows, 5) if stays}
    assert {r.doc_id for r in near.select("doc_id").collect()} == want
    rows = [r for r in rows if r[0] in want]
    texts = {d: t for d, t in rows}
    passages = {(d, texts[d] if not k else t) for d, _, k, t in brute.remove_repeats(rows, stages.PASSAGE_WORDS) if not k or t}
    assert set(rows_of(stages.drop_repeated_passages(spark, near, sf), "doc_id", "text")) == passages


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_awkward_and_empty_tables(spark, awkward, corpus, stage):
    at = corpus[0]
    docs = awkward.selectExpr("*", "'en' as lang", "cast(null as string) as source", "cast(length(text) as long) as n_chars")
    got = stage(spark, docs, at)
    assert got.count() > 0
    assert stage(spark, docs.limit(0), at).count() == 0
    if stage is not stages.pack_documents:
        assert got.columns == docs.columns
