"""Running values of a key's rows in order, whatever a key's size.

Rows are sorted by key and order over all tasks, which cuts a large key into ranges, and fixed in the checkpoint folder. A
window then runs within (key, range) only. What a range hands on is one row with its summary (a sum, a largest or a
smallest value); those of a key are few, and a window over them gives what each range begins with. So no task holds more
than a range of a key, and the values are those of a window over the whole key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import fixed

_SUMMARY = {"sum": F.sum, "max": F.max, "min": F.min}


def in_ranges(df: DataFrame, key: str | list[str], order: list, ranges: int | None = None) -> DataFrame:
    """The rows with ``_range``, the part of the sorted table that each is in; ``order`` should leave no ties."""
    keys = [key] if isinstance(key, str) else key
    by = [*(F.col(k) for k in keys), *(F.col(o) if isinstance(o, str) else o for o in order)]
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return fixed(dealt).withColumn("_range", F.spark_partition_id())


def running(ranged: DataFrame, key: str | list[str], order: list, **values: tuple) -> DataFrame:
    """``ranged`` (of ``in_ranges``) with a column for each of ``values``: name = (kind, column) or (kind, column,
    "before"). kind is sum, max or min of the key's rows up to each row, itself included, or only of those before it; a sum of
    nothing is 0, a largest or smallest value of nothing null."""
    keys = [key] if isinstance(key, str) else key
    parts, held = [F.col(k) for k in keys], ranged.columns
    inputs = {n: f"_in_{n}" for n in values}
    ranged = ranged.withColumns({inputs[n]: v[1] for n, v in values.items()})
    totals = ranged.groupBy(*keys, "_range").agg(*(_SUMMARY[v[0]](inputs[n]).alias(f"_of_{n}") for n, v in values.items()))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), *(_SUMMARY[v[0]](f"_of_{n}").over(earlier).alias(f"_carried_{n}") for n, v in values.items()))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    out = ranged.join(carried, same & (F.col("_range") == F.col("_r")))
    within = Window.partitionBy(*parts, "_range").orderBy(*order)
    for n, v in values.items():
        own = _SUMMARY[v[0]](inputs[n]).over(within.rowsBetween(Window.unboundedPreceding, -1 if v[2:] == ("before",) else 0))
        before = F.col(f"_carried_{n}")
        both = F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0)) if v[0] == "sum" else F.greatest(own, before) if v[0] == "max" else F.least(own, before)
        out = out.withColumn(n, both)
    return out.select(*held, *values)
