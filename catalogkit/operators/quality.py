"""Inspection of a catalog: expired, duplicate and long-dead records, probes, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import calendar_date
from ..functions.text import apply_signal


def newly_expired(df: DataFrame, as_of: str) -> Column:
    return F.coalesce((calendar_date(F.col("deadline")) < F.to_date(F.lit(as_of))) & (F.col("status") == "open"), F.lit(False))


def days_over(field: Column, as_of: str) -> Column:
    return F.datediff(F.to_date(F.lit(as_of)), calendar_date(field))


def archive_reason(kind: str, as_of: str, duplicate: Column, expired_days: int = 365, news_days: int = 730, job_days: int = 60, job_stale_days: int = 120) -> Column:
    """Why a record is to be archived, null if it is not: a duplicate, or too long over or too old for its kind. Records
    that people verified are never archived."""
    if kind == "opportunity":
        late = F.when(days_over(F.col("deadline"), as_of) > expired_days, "long-expired")
    elif kind == "job":
        added = F.coalesce(*(F.when(calendar_date(F.substring(c, 1, 10)).isNotNull(), F.substring(c, 1, 10)) for c in ("added_at", "posted_at", "updated_at")))
        late = F.when(calendar_date(F.col("deadline")).isNotNull(), F.when(days_over(F.col("deadline"), as_of) > job_days, "job-expired")).when(days_over(added, as_of) > job_stale_days, "job-stale")
    else:
        shown = F.coalesce(*(F.when(calendar_date(F.substring(c, 1, 10)).isNotNull(), F.substring(c, 1, 10)) for c in ("published_at", "added_at", "updated_at")))
        late = F.when(days_over(shown, as_of) > news_days, "news-too-old")
    safe = F.coalesce(F.col("trust") == "verified", F.lit(False))
    return F.when(~safe, F.when(duplicate, "duplicate").otherwise(late))


def marked_duplicates(df: DataFrame, key: str, score: str, ord_: str) -> DataFrame:
    """Every row with ``keeper`` (the best row of its key, if the key has others) and whether it is another's duplicate.
    The best comes from an aggregate with partial results; only keys of two rows or more are joined back."""
    best = df.groupBy(key).agg(F.count("*").alias("_n"), F.max_by(ord_, F.struct(F.col(score), -F.col(ord_))).alias("keeper")).where("_n > 1").drop("_n")
    return df.join(best, key, "left").withColumn("duplicate", F.coalesce(F.col("keeper") != F.col(ord_), F.lit(False)))


def after_probe(df: DataFrame, as_of: str, most_fails: int = 3) -> DataFrame:
    """Records with their latest probe's verdict (dead, alive, unknown or null): the new fail streak, status, whether they
    are revived, and the day they were last seen. An unknown verdict changes nothing."""
    dead, alive = F.col("verdict") == "dead", F.col("verdict") == "alive"
    streak = F.when(dead, F.coalesce("fail_streak", F.lit(0)) + 1).when(alive, 0).otherwise(F.col("fail_streak"))
    over = calendar_date(F.col("deadline")) < F.to_date(F.lit(as_of))
    back = F.when(F.coalesce(over, F.lit(False)), "expired").otherwise("open")
    status = F.when(dead & (streak >= most_fails), "dead").when(alive & (F.col("status") == "dead"), back).otherwise(F.col("status"))
    revived = F.coalesce(alive & (F.col("status") == "dead"), F.lit(False))
    return df.withColumns({"new_streak": streak, "new_status": status, "revived": revived, "seen": F.when(alive, F.lit(as_of)).otherwise(F.col("last_seen"))})


def no_signal(page: Column, stored: list[str]) -> Column:
    """Whether neither a page of some length nor the stored fields have a word of applying."""
    return F.coalesce((F.length(page) > 200) & ~apply_signal(page) & ~apply_signal(F.concat_ws(" ", *stored)), F.lit(False))


def audit_sample(df: DataFrame, audited: str, order: list, n: int = 6) -> DataFrame:
    """The records that were audited least recently, never-audited ones first."""
    return df.orderBy(F.coalesce(audited, F.lit("")), *order).limit(n)


def capped_lists(df: DataFrame, kind: str, ord_: str, caps: dict[str, int]) -> DataFrame:
    """A row for each kind of finding with its count and the first ids in order, no more than its cap; ranks are limited
    in each partition before they meet."""
    from .ordering import top

    most = max(caps.values())
    n = df.groupBy(kind).agg(F.count("*").alias("n"))
    cap = F.create_map(*(F.lit(x) for kv in caps.items() for x in kv))[F.col(kind)]
    first = top(df, [kind], [ord_], most).groupBy(kind).agg(F.sort_array(F.collect_list(ord_)).alias("ids"))
    return n.join(first, kind).withColumn("ids", F.slice("ids", F.lit(1), F.coalesce(cap, F.lit(most))))


def visibility_funnel(df: DataFrame, url: str, official: Column) -> DataFrame:
    """One row: all records, those alive, those with an url, with one of the organiser's own, and those shown."""
    alive, user = F.coalesce(F.col("status") != "dead", F.lit(True)), F.coalesce(F.col("trust") == "user", F.lit(False))
    return df.agg(F.count("*").alias("total"), F.count_if(alive).alias("alive"), F.count_if(F.col(url).isNotNull()).alias("with_url"), F.count_if(official.isNotNull()).alias("official"), F.count_if(alive & (official.isNotNull() | user)).alias("shown"))
