"""Crawl rules and per-key state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def parse_robots(bodies: DataFrame, agent: str) -> DataFrame:
    """(site, allow, path, ord) of the first group with a name that ours holds, else of the first for ``*``. Agents on
    consecutive lines share a group; any other field ends a run of them, and rules before all agents are those of ``*``.
    A site's file is parsed within its row: a line's group is the number of group starts up to it."""
    lines = F.transform(F.split("body", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    pairs = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, "^([^:]*):", 1))).alias("field"), F.trim(F.regexp_extract(x, "(?s)^[^:]*:(.*)$", 1)).alias("value")))
    rows = bodies.select("site", F.monotonically_increasing_id().alias("file"), pairs.alias("pairs"))
    before = F.when(F.col("i") > 0, F.col("pairs")[F.col("i") - 1]["field"])
    rows = rows.select("site", "file", "pairs", F.posexplode("pairs").alias("i", "p")).select("site", "file", F.col("i").alias("ord"), "p.field", "p.value", (F.col("p.field").isin("user-agent") & ~before.eqNullSafe("user-agent")).alias("starts"))
    w = Window.partitionBy("site", "file").orderBy("ord")  # the lines of one file
    rows = rows.withColumn("group", F.sum(F.col("starts").cast("int")).over(w)).where("field in ('user-agent', 'allow', 'disallow')")
    name = F.lower("value")
    rank = F.when(F.col("field") == "user-agent", F.when((name != "*") & F.contains(F.lit(agent.lower()), name), 0).when(name == "*", 1)).when(F.col("group") == 0, 1)
    chosen = rows.withColumn("rank", rank).where("rank is not null").groupBy("site", "file").agg(F.min(F.struct("rank", "group")).alias("c")).select("site", "file", F.col("c.group").alias("group"))
    return rows.join(chosen, ["site", "file", "group"]).where("field <> 'user-agent' and value <> ''").select("site", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"), "ord")


def robots_allowed(urls: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """``urls`` with whether each (site, path) may be fetched: the longest matching rule wins, allow among equals; no rule
    allows. A site's rules, which are few, come as one list to each of its rows, so equal rows stay and none are
    multiplied; the rows of a site need not meet in one task beyond that join."""
    escaped = F.regexp_replace("path", r"([.+?^(){}\[\]|\\])", r"\\$1")
    # a dollar stands for the end wherever it is, a star for anything
    pattern = F.concat(F.lit("^"), F.regexp_replace(escaped, r"\*", ".*"))
    r = rules.withColumn("rule", F.struct(pattern.alias("pattern"), F.length(F.replace(F.col("path"), F.lit("*"), F.lit(""))).alias("n"), "allow"))
    r = r.groupBy(F.col("site").alias("_site")).agg(F.collect_set("rule").alias("_rules"))
    hit = urls.join(r, F.col("site") == F.col("_site"), "left").drop("_site")
    fits = F.filter(F.coalesce("_rules", F.array().cast(r.schema["_rules"].dataType)), lambda x: F.regexp_like(F.col(path), x["pattern"]))
    longest = lambda allow: F.array_max(F.transform(F.filter(fits, lambda x: x["allow"] == allow), lambda x: x["n"]))
    d = longest(False)
    return hit.withColumn("allowed", d.isNull() | (F.coalesce(longest(True), F.lit(-1)) >= d)).drop("_rules")


def fail_streak(probes: DataFrame, key: str, at: list, dead: Column, unknown: Column | None = None, ranges: int | None = None) -> DataFrame:
    """Length of the run of dead probes up to each probe; an alive probe resets it, unknown ones are not counted. The run
    is the number of dead probes so far without those up to the last alive one; no task holds all probes of a key."""
    p = probes if unknown is None else probes.where(~unknown)
    p = scan.in_ranges(p.withColumn("dead", dead.cast("int")), key, at, ranges)
    p = scan.running(p, key, at, _dead=("sum", F.col("dead")))
    p = scan.running(p, key, at, _reset=("max", F.when(F.col("dead") == 0, F.col("_dead"))))
    return p.withColumn("streak", F.col("_dead") - F.coalesce("_reset", F.lit(0))).drop("_dead", "_reset", "_range")


def source_tier(polls: DataFrame, key: str, at: list, added: Column, high: int = 5, low: int = 14, ranges: int | None = None) -> DataFrame:
    """high from ``high`` finds on, low after ``low`` empty polls in a row without any find, else normal."""
    p = scan.in_ranges(polls.withColumn("found", added.cast("long")), key, at, ranges)
    p = scan.running(p, key, at, **{"yield": ("sum", F.col("found")), "_empty": ("sum", (F.col("found") == 0).cast("long"))}).drop("_range")
    # without any find, all polls so far are empty ones in a row
    return p.withColumn("tier", F.when(F.col("yield") >= high, "high").when((F.col("_empty") >= low) & (F.col("yield") == 0), "low").otherwise("normal")).drop("_empty")


def trusted_lastmod(pages: DataFrame, site: str, lastmod: str, as_of: str, since: str, fresh_days: int = 90) -> DataFrame:
    """Pages changed since a day, where the site's newest lastmod is fresh enough to be believed; else all pages. A page
    without a lastmod stays. The newest day is an aggregate with partial sums; only sites that are believed and have
    changed pages can lose any, so a large site fills no task."""
    trust = pages.groupBy(site).agg((F.datediff(F.to_date(F.lit(as_of)), F.max(lastmod)) <= fresh_days).alias("trusted"))
    return pages.join(trust, pages[site].eqNullSafe(trust[site])).drop(trust[site]).withColumn("trusted", F.coalesce("trusted", F.lit(False))).where(~F.col("trusted") | F.col(lastmod).isNull() | (F.col(lastmod) >= F.to_date(F.lit(since))))


def unchanged(pages: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Pages with whether they answered 304 or hash as before; a page without state has changed."""
    return pages.join(state.select(key, F.col("hash").alias("before")), key, "left").withColumn("unchanged", F.coalesce(F.col("status") == 304, F.lit(False)) | (F.col("before").isNotNull() & F.col("hash").eqNullSafe(F.col("before")))).drop("before")


def polled_today(sources: DataFrame, as_of: str) -> DataFrame:
    """Sources to be asked on a day: those not known to be out of reach; low-yield ones on every third day of a month."""
    rest = (F.col("tier") == "low") & (F.dayofmonth(F.to_date(F.lit(as_of))) % 3 != 0)
    return sources.where(F.coalesce("reachable", F.lit(True)) & ~F.coalesce(rest, F.lit(False)))


def extracted(pages: DataFrame, extractions: DataFrame, key: str) -> DataFrame:
    """Pages with what was extracted from them beforehand. A page without an extraction is an error of the row."""
    missing = F.raise_error(F.concat(F.lit("no extraction for "), F.col(key).cast("string")))
    return pages.join(extractions.withColumn("_found", F.lit(True)), key, "left").where(F.when(F.col("_found").isNull(), missing.cast("boolean")).otherwise(F.lit(True))).drop("_found")


def early_stop(candidates: DataFrame, query: str, order: list, added: Column, target: int, most: int = 16) -> DataFrame:
    """The candidates of a query that are probed: the first ``most`` in order, until ``target`` have been added."""
    w = Window.partitionBy(query).orderBy(*order)
    c = candidates.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    before = F.coalesce(F.sum(added.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("_before", before).where(F.col("_before") < target).drop("_rn", "_before")
