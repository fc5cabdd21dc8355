"""What goes into a weekly issue, and clues to new records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_cjk, present
from .ordering import interleave, top
from .scratch import fixed


def day_before(as_of: str, days: int) -> Column:
    return F.date_sub(F.to_date(F.lit(as_of)), days).cast("string")


def weekly_opportunities(df: DataFrame, as_of: str, official: Column, most: int = 40) -> DataFrame:
    """Reachable, not over, and new within a week or due within three; the next deadline first, those without one last."""
    over = F.coalesce(F.col("deadline") < as_of, F.lit(False))
    new = F.greatest(F.coalesce("updated_at", F.lit("")), F.coalesce("last_seen", F.lit(""))) >= day_before(as_of, 7)
    soon = F.coalesce(F.col("deadline") <= day_before(as_of, -21), F.lit(False))
    return df.where(official.isNotNull() & ~over & (new | soon)).orderBy(F.asc_nulls_last("deadline"), "ord").limit(most)


def weekly_news(df: DataFrame, as_of: str, domestic: Column, most: int = 30) -> DataFrame:
    """News of the last ten days, international and domestic in turns, newest first."""
    day = F.coalesce(present(F.col("published_at")), present(F.col("added_at")), F.lit(""))
    home = domestic | has_cjk(F.coalesce("title", F.lit("")))
    n = df.where(day >= day_before(as_of, 10))
    return interleave(n, F.when(home, 1).otherwise(0), [F.desc(F.coalesce("published_at", F.lit(""))), "ord"], most)


def weekly_jobs(df: DataFrame, as_of: str, most: int = 30) -> DataFrame:
    """Open jobs, those of the last two weeks first, then in given order."""
    over = F.coalesce(F.col("deadline").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (F.col("deadline") < as_of), F.lit(False))
    fresh = F.coalesce(present(F.col("posted_at")), F.col("added_at"), F.lit("")) >= day_before(as_of, 14)
    return df.where(~over).withColumn("fresh", fresh).orderBy(F.desc("fresh"), "ord").limit(most)


def kept_issues(issues: DataFrame, week: str, most: int = 120) -> DataFrame:
    """The newest issues; of a week published twice the later one."""
    return top(issues, [week], [F.desc("ord")]).orderBy(F.desc(week)).limit(most)


def clue_text(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"[\s《》「」【】'\"·・\-—()（）“”‘’]", "")


def _told(wanted: DataFrame, lines: DataFrame, by: list[str]) -> DataFrame:
    """The different (*by, x) of ``wanted`` whose text stands in a line (*by, line) of the same ``by``. Texts that are whole lines
    are settled first. Of the others only the lengths, which are few, meet the lines: a line's runs of these lengths are
    looked up as they are, so that no text is compared with every line, however much the texts or lines have in common."""
    lines, wanted = fixed(lines.distinct()), wanted.distinct()
    key = [*by, "x"]
    whole = fixed(wanted.join(lines.withColumnRenamed("line", "x").withColumn("_whole", F.lit(True)), key, "left"))
    rest = whole.where("_whole is null").select(key)
    lengths = rest.groupBy(*by).agg(F.collect_set(F.length("x")).alias("_lengths"))
    runs = F.flatten(F.transform("_lengths", lambda n: F.when(n <= F.length("line"), F.transform(F.sequence(F.lit(1), F.length("line") - n + 1), lambda i: F.substr("line", i, n))).otherwise(F.array().cast("array<string>"))))
    met = lines.join(lengths, by) if by else lines.crossJoin(F.broadcast(lengths))  # without ``by`` one row
    within = met.select(*by, F.explode_outer(F.array_distinct(runs)).alias("x")).join(rest, key).distinct()
    return whole.where("_whole").select(key).unionByName(within)


def clue_verdicts(clues: DataFrame, hits: DataFrame, history: DataFrame, library: DataFrame) -> DataFrame:
    """What becomes of each clue (batch, ord, name): invented (no hit of its batch has the name, in its title, its snippet or
    both in a line), short, tried before, known (a title of the library holds it), or fresh. Neither the hits of a batch nor
    the titles of the library are compared with each clue."""
    c = clues.withColumn("fp", clue_text(F.col("name")))
    named = c.where(F.length("name") >= 4).select("batch", F.col("name").alias("x"))
    parts = F.array_distinct(F.array_compact(F.array("title", "snippet", F.concat_ws(" ", "title", "snippet"))))
    told = _told(named, hits.select("batch", F.explode(parts).alias("line")), ["batch"])
    c = c.join(told.select("batch", F.col("x").alias("name"), F.lit(True).alias("told")), ["batch", "name"], "left")
    c = c.join(history.select("fp", F.lit(True).alias("tried")).distinct(), "fp", "left")
    titles = library.select(clue_text(F.col("title")).alias("line")).where(F.length("line") >= 4)
    known = _told(c.where(F.length("fp") >= 4).select(F.col("fp").alias("x")), titles, [])
    c = c.join(known.select(F.col("x").alias("fp"), F.lit(True).alias("known")), "fp", "left")
    verdict = F.when((F.length("name") < 4) | ~F.coalesce("told", F.lit(False)), "invented").when(F.col("tried"), "tried").when((F.length("fp") < 4) | F.coalesce("known", F.lit(False)), "known").otherwise("fresh")
    return c.withColumn("verdict", verdict).drop("told", "tried", "known")
