"""Dates. ``as_of`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def beijing_day(ts: Column) -> Column:
    return F.to_date(ts + F.expr("INTERVAL 8 HOURS"))


def calendar_date(x: Column) -> Column:
    """The date of a strict YYYY-MM-DD text, else null."""
    return F.when(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(x, "yyyy-MM-dd"))


def status(deadline: Column, as_of: str) -> Column:
    """A missing deadline is open; the deadline's own day still is."""
    return F.when(deadline < F.to_date(F.lit(as_of)), "expired").otherwise("open")


def expired(deadline: Column, as_of: str, grace_days: int = 0) -> Column:
    """Whether a YYYY-MM-DD text lies before the day, less the days of grace; no deadline never does."""
    return F.coalesce(F.substring(deadline, 1, 10) < F.date_sub(F.to_date(F.lit(as_of)), grace_days).cast("string"), F.lit(False))


def matches_evidence(iso: Column, evidence: Column) -> Column:
    """Whether a date is told by a text: as it is or without its dashes, or its day, its month (a number or an English
    name) and, where the text has years, its year are among the text's numbers."""
    ev, part = F.coalesce(evidence, F.lit("")), F.split(iso, "-")
    numbers = F.transform(F.regexp_extract_all(ev, F.lit(r"([0-9]+)"), F.lit(1)), lambda n: n.try_cast("decimal(38,0)"))
    has = lambda n: F.array_contains(numbers, n.cast("decimal(38,0)"))
    years = F.filter(numbers, lambda n: n.between(2000, 2099))
    month = F.lower(F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "MMM"))
    named = F.regexp_like(F.lower(ev), F.concat(F.lit(r"(?:^|[^a-z0-9_])"), month))
    loose = has(part[2]) & (has(part[1]) | named) & ((F.size(years) == 0) | F.array_contains(years, part[0].cast("decimal(38,0)")))
    return F.coalesce((ev != "") & (F.contains(ev, iso) | F.contains(ev, F.replace(iso, F.lit("-"), F.lit(""))) | loose), F.lit(False))


def cadence(title: Column) -> Column:
    """Years between two editions, by the title; null for an event that does not come again."""
    return F.when(title.rlike("(?i)三年展|triennial"), 3).when(title.rlike("(?i)双年展|雙年展|biennial|biennale"), 2)


def item_state(status: Column, days_left: Column, every: Column) -> Column:
    """open, upcoming (over, but an edition follows) or past."""
    over = F.coalesce(status == "expired", F.lit(False)) | F.coalesce(days_left < 0, F.lit(False))
    return F.when(~over, "open").when(every.isNotNull(), "upcoming").otherwise("past")


def iso_week(day: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))


def next_edition(deadline: Column, every: Column, as_of: str) -> Column:
    """Year of the next edition of an event held ``every`` so many years."""
    today = F.to_date(F.lit(as_of))
    gap = F.year(today) - F.year(deadline) + (F.date_format(today, "MMdd") > F.date_format(deadline, "MMdd")).cast("int")
    return F.year(deadline) + every * F.greatest(F.lit(0), F.ceil(gap / every)).cast("int") + F.when(deadline >= today, every).otherwise(0)


def deadline_band(days: Column) -> Column:
    return F.when(days.isNull(), "rolling").when(days < 0, "past").when(days == 0, "today").when(days <= 7, "week").when(days <= 30, "month").otherwise("later")
