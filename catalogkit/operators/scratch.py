"""Tables fixed in the checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed(df: DataFrame) -> DataFrame:
    """The rows as they are now, written to spark.checkpoint.dir: what reads them twice reads the same. Where that is
    unset, a local session (tests) gets a temporary folder; on a cluster it is an error."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.conf.get("spark.master", "").startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="catalogkit-")
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """The same rows. A later filter is not moved before what computed its columns, which would compute them anew for it, or
    for each row before an aggregate."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))
