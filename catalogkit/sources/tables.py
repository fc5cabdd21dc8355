"""Readers and writers of catalogs, event logs and dictionaries."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType([T.StructField(n, T.StringType()) for n in ("t", "type", "uid", "anon", "ip", "id", "cat", "q", "channel")] + [T.StructField("on", T.IntegerType())])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_catalog(spark: SparkSession, path: str, item: T.StructType, items: str) -> DataFrame:
    """The list of a catalog document, with each item's position. A corrupt file is an error, never an empty catalog."""
    schema = T.StructType([T.StructField(items, T.ArrayType(item))])
    doc = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc.select(F.posexplode(items).alias("ord", "x")).select("ord", "x.*")


def read_events(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The event log and its rotated generations; malformed lines are skipped."""
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(paths).where("t is not null")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A word list: ``#`` begins a comment, ``!`` marks a hard word."""
    w = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("w")).where("w <> ''")
    return w.select(F.regexp_replace("w", "^!", "").alias("word"), F.when(F.startswith("w", F.lit("!")), "hard").otherwise("soft").alias("severity"))


def replace_table(df: DataFrame, root: str) -> str:
    """Write a new version of a table beside the old ones, then append a pointer to it. A pointer is never overwritten and
    appears by the rename of a finished file, so a reader sees the old version or the new one, whole."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{root}/v-{version}")
    turn = (_latest(spark, root) or {"turn": 0})["turn"] + 1
    spark.createDataFrame([(turn, version)], "turn long, version string").coalesce(1).write.mode("append").json(f"{root}/current")
    return version


def _latest(spark: SparkSession, root: str) -> dict | None:
    try:
        row = spark.read.schema("turn long, version string").json(f"{root}/current").orderBy(F.desc("turn"), "version").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row.asDict() if row else None


def read_table(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest version; None if there is none yet."""
    at = _latest(spark, root)
    return spark.read.parquet(f"{root}/v-{at['version']}") if at else None


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("day").json(path)


def snapshot(df: DataFrame, root: str, name: str) -> str:
    """A copy of a table before a write that destroys it."""
    path = f"{root}/snapshots/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path
