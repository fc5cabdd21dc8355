"""Analytics of the event log. A day is a Beijing calendar day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import beijing_day
from . import scan


def daily_funnel(events: DataFrame, kinds: list[str], as_of: str, days: int = 14) -> DataFrame:
    """A row for each of the ``days`` ending at ``as_of``: a counter per kind and distinct visitors over all kinds; days
    without events are zero. Counts come from one pass with partial sums, distinct visitors from a second grouping."""
    e = events.withColumn("day", beijing_day(F.col("ts"))).where(F.col("day").between(F.date_sub(F.to_date(F.lit(as_of)), days - 1), F.to_date(F.lit(as_of))))
    per = e.groupBy("day", F.coalesce(F.col("user_id").cast("string"), F.lit("?")).alias("who")).agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))
    n = per.groupBy("day").agg(*(F.sum(k).alias(k) for k in kinds), F.count("*").alias("visitors"))
    spine = events.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.to_date(F.lit(as_of)), days - 1), F.to_date(F.lit(as_of)))).alias("day"))
    return spine.join(n, "day", "left").select("day", *(F.coalesce(k, F.lit(0)).alias(k) for k in [*kinds, "visitors"]))


def top_counts(df: DataFrame, key: str, n: int, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), F.asc(key)).limit(n)


def visitors_two_level(events: DataFrame, who: str, region: str) -> DataFrame:
    """Visitors and events of each day and region, by way of one row for each visitor."""
    per = events.groupBy("day", region, who).agg(F.count("*").alias("n"))
    return per.groupBy("day", region).agg(F.count("*").alias("visitors"), F.sum("n").alias("events"))


def rolling_count(events: DataFrame, key: str, ts: str, hours: int, id_: str = "event_id", ranges: int | None = None) -> DataFrame:
    """``events`` with ``recent``: rows of the key in the last ``hours``, those of the row's own second included. ``id_`` is
    a row's own. The count is a difference of two places in the key's order, asked by two probes for each row that are
    sorted among the rows, so that a running sum answers them and no task holds all rows of a key."""
    e = events.withColumn("_s", F.unix_seconds(F.col(ts).cast("timestamp")))
    probe = lambda at, kind, sign: F.struct(at.alias("at"), F.lit(kind).alias("kind"), F.lit(sign).alias("sign"))
    # before the rows of its second, a row itself, after them
    three = F.explode(F.array(probe(F.col("_s") - hours * 3600, 0, -1), probe(F.col("_s"), 1, 0), probe(F.col("_s"), 2, 1)))
    p = e.where("_s is not null").select(F.col(key).alias("_key"), F.col(id_).alias("_id"), three.alias("p")).select("_key", "_id", "p.at", "p.kind", "p.sign")
    p = scan.running(scan.in_ranges(p, "_key", ["at", "kind", "_id"], ranges), "_key", ["at", "kind", "_id"], met=("sum", (F.col("sign") == 0).cast("long")))
    n = p.where("sign <> 0").groupBy("_id").agg(F.sum(F.col("met") * F.col("sign")).alias("recent"))
    return events.join(n, events[id_] == n["_id"], "left").drop("_id")


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int, id_: str = "event_id", ranges: int | None = None) -> DataFrame:
    """Runs of a key's events of which each follows within the gap: begin, end and events. A row's predecessor is the
    latest before it, and a run's number a running sum of the starts of runs; no task holds all rows of a key."""
    e = events.select(key, F.col(ts).alias("_ts"), F.col(id_).alias("_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"))
    e = scan.running(scan.in_ranges(e, key, ["_at", "_id"], ranges), key, ["_at", "_id"], _last=("max", F.col("_at"), "before"))
    e = e.withColumn("_new", F.coalesce((F.col("_at") - F.col("_last") >= gap_seconds * 1_000_000).cast("int"), F.lit(1)))
    e = scan.running(e, key, ["_at", "_id"], session=("sum", F.col("_new")))
    return e.groupBy(key, "session").agg(F.min("_ts").alias("begin"), F.max("_ts").alias("end"), F.count("*").alias("events"))


def share(df: DataFrame, key: str, cond: Column, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(cond) / F.count("*"), 1).alias(name))


def prefix_counts(df: DataFrame, column: str, classes: dict[str, list[str]]) -> DataFrame:
    """One row: for each class the rows whose text begins with one of its prefixes, and all rows (``total``)."""
    hit = lambda ps: reduce(Column.__or__, (F.startswith(column, F.lit(p)) for p in ps))
    return df.agg(*(F.count_if(hit(ps)).alias(name) for name, ps in classes.items()), F.count("*").alias("total"))


def sent_stats(sends: DataFrame, issue: str) -> DataFrame:
    """Successful and all sends of each issue, and how many addresses it reached."""
    return sends.groupBy(issue).agg(F.coalesce(F.sum("ok"), F.lit(0)).alias("ok"), F.count("*").alias("total"), F.count_distinct(F.when(F.col("ok") == 1, F.col("address"))).alias("reached"))


def budget_use(calls: DataFrame, day: str, source: str, who: str, cached: str) -> DataFrame:
    """Paid calls of each day and source, in all and by caller, and calls answered from a cache."""
    n = calls.groupBy(day, source, F.coalesce(who, F.lit("other")).alias("_who")).agg(F.count_if(~F.col(cached)).alias("_n"), F.count_if(F.col(cached)).alias("_hits"))
    by = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("_n") > 0, F.struct(F.col("_who"), F.col("_n"))))))
    return n.groupBy(day, source).agg(F.sum("_n").alias("used"), F.sum("_hits").alias("hits"), by.alias("by"))


def score_cards(shifts: DataFrame, key: str, order: Column, last: int = 12) -> DataFrame:
    """Shifts, probes, finds and failures of each manager, and the last shifts, newest first; these are limited in each
    partition before they meet."""
    from .ordering import top

    total = shifts.groupBy(key).agg(F.count("*").alias("shifts"), F.sum("probed").alias("probed"), F.sum("added").alias("added"), F.count_if(~F.col("ok")).alias("fails"))
    recent = top(shifts, [key], [order.desc()], last).groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-order).alias("_o"), F.col("id")))).alias("_r"))
    return total.join(recent, key).select(key, "shifts", "probed", "added", "fails", F.transform("_r", lambda s: s["id"]).alias("recent"))


def declared_and_actual(declared: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """For each channel the count it states and the one it has, and whether they agree."""
    n = actual.groupBy(key).agg(F.count("*").alias("actual"))
    return declared.join(n, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0))).withColumn("agrees", F.col("declared") == F.col("actual"))


def recent_hits(cache: DataFrame, key: str, ts: str, as_of: str, days: int = 7, most: int = 600) -> DataFrame:
    """Cached answers that still hold: the latest of each query, not older than ``days``, the ``most`` newest."""
    from .ordering import top

    fresh = cache.where(F.col(ts) > F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days)))
    return top(fresh, [key], [F.desc(ts), F.desc("id")]).orderBy(F.desc(ts), F.desc("id")).limit(most)
