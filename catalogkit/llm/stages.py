"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> documents, each by one operator.

All keep the columns that they are given, whatever their names, and read texts of any length whole. An empty table gives
an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontamination, hash_arrays, near_dedup, packing, substrings, toxicity
from .tokens import Vocabulary

TOXIC_FROM = 0.3
#: Words of a passage that must not repeat.
PASSAGE_WORDS = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under TOXIC_FROM. The model is learned from all labels of these documents. A null
    text is scored as the empty one, equal texts alike, so repeated rows stay or go together; without a toxic or a clean
    label the score is the share of toxic labels, and a score of exactly TOXIC_FROM goes."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), held_out_fold=None)
    return toxicity.below(docs, model, TOXIC_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: that with the smallest doc_id. A null doc_id is never dropped; of
    rows with equal doc_id all stay or go. Null and empty texts are near-copies of nothing and stay."""
    found = near_dedup.near_duplicates(docs, shingle_words=5, percent=80)
    dropped = hash_arrays.id_set(found.where("not kept").select("doc_id"), "near-copies")
    return docs.where(~hash_arrays.member("doc_id", dropped))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages. A document keeps its text unless it loses words; then the
    words left are joined by one space, n_chars (if there is such a column) follows, and it goes if no word is left. Null
    and empty texts have no words to lose and stay as they are. Rows that repeat each other, or tie in all their windows,
    lose the same words."""
    repeats = substrings.find_repeats(docs, PASSAGE_WORDS)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, _, kept, removed, _ in substrings.judged(batches, repeats, PASSAGE_WORDS):
            part = batch.slice(a, b - a)
            old = part["text"].to_pylist()
            text = [k if n else t for t, k, n in zip(old, kept, removed)]
            part = part.set_column(columns.index("text"), "text", pa.array(text, pa.string()))
            if "n_chars" in columns:
                i = columns.index("n_chars")
                chars = [len(t) if n else c for t, n, c in zip(text, removed, part["n_chars"].to_pylist())]
                part = part.set_column(i, "n_chars", pa.array(chars, part.schema.field(i).type))
            yield part.filter(pa.array([not n or bool(t) for t, n in zip(text, removed)]))

    return docs.mapInArrow(run, docs.schema)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Null and wordless texts hold none; repeated rows stay or go together;
    without items all stay."""
    return decontamination.without_contaminated(docs, decontamination.index_items(common.table(spark, sf_dir, "benchmark")))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents: each row's, repeated ones too; a null text is its end id alone, and a null
    doc_id is kept. Pieces of equal length are placed in the order of doc_id, piece, start and checksum."""
    packed = packing.pack(docs, Vocabulary(public_tokenizers.path("byte_bpe_50k.json"), spaced=True), end_id=2, size=1024)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
