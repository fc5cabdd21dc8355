"""A corpus pipeline of the training-data operators, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalogkit.llm import common, stages

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_dedup", stages.drop_near_copies),
    ("substring_dedup", stages.drop_repeated_passages),
    ("decontamination", stages.drop_contaminated),
    ("best_fit_packing", stages.pack_documents),
]

#: The toxicity model and the tokenizer have no SQL form.
ORACLE_SQL = None


@common.in_small_batches
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder and read again as the next one's documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
