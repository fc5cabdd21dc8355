"""Bounded ordered assemblies: what a person keeps as a numbered list, what is triaged in a round, who is on duty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import present
from .ordering import ranked

#: Kinds in order, how many of each count, and the headings of their lists.
KINDS = [("opp", 30, "【机会(用户收藏的展览征集/驻留/奖项)】"), ("news", 25, "【资讯(用户收藏的艺术新闻)】"), ("job", 12, "【招聘(用户收藏的岗位)】")]
FEWEST = 2


def candidate_line(n: Column, kind: Column, covered: Column) -> Column:
    """An item in one line: its number, title, and by kind what is known of it; absent facts are left out. Columns: title,
    org, city, country, deadline, region, source, published_at, location, summary."""
    has = lambda c: present(F.col(c))
    with_ = lambda label, c: F.concat(F.lit(label), has(c))
    place = present(F.concat_ws(" ", has("city"), has("country")))
    own = F.when(kind == "opp", F.array(has("org"), place, with_("截止", "deadline")))
    own = own.when(kind == "news", F.array(F.concat(F.lit("【"), has("region"), F.lit("】")), with_("来源:", "source"), has("published_at")))
    own = own.otherwise(F.array(has("org"), has("location"), with_("截止", "deadline")))
    bits = F.concat(F.array(F.coalesce("title", F.lit(""))), F.array_compact(own), F.array_compact(F.array(has("summary"), F.when(covered, F.lit("[有配图]")))))
    return F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.array_join(bits, " | "))


def personal_lists(kept: DataFrame, person: str, order: str) -> DataFrame:
    """(person, items, error, text): of what each person keeps (kind and the columns of ``candidate_line``, cover) the first
    of each kind, numbered across kinds from 0, as one text under headings; ``too_few`` instead of a text for less than
    two. Each task keeps no more of a person than the largest number that counts, before rows meet."""
    of_kind = F.col("kind")
    caps, place = F.lit(0), F.lit(len(KINDS))
    for i, (name, most, _) in enumerate(KINDS):
        caps, place = F.when(of_kind == name, most).otherwise(caps), F.when(of_kind == name, i).otherwise(place)
    most = max(m for _, m, _ in KINDS)
    best = ranked(kept.where(of_kind.isin([n for n, *_ in KINDS])), [person, "kind"], [order], "_rn").where(F.col("_rn") <= most).where(F.col("_rn") <= caps)
    numbered = best.withColumn("_place", place).withColumn("n", F.row_number().over(Window.partitionBy(person).orderBy("_place", "_rn")) - 1)  # 67 rows at most
    line = F.struct("n", "_place", candidate_line(F.col("n"), of_kind, F.coalesce(present(F.col("cover")).isNotNull(), F.lit(False))).alias("line"))
    whole = numbered.groupBy(person).agg(F.count("*").cast("int").alias("items"), F.array_sort(F.collect_list(line)).alias("lines"))

    def listed(i: int, heading: str) -> Column:
        lines = F.transform(F.filter("lines", lambda x: x["_place"] == i), lambda x: x["line"])
        # the first heading stands even over an empty list, the others only over items
        return F.when((F.size(lines) > 0) | F.lit(i == 0), F.array_join(F.concat(F.array(F.lit(heading)), lines), "\n"))

    lists = [listed(i, heading) for i, (_, _, heading) in enumerate(KINDS)]
    few = F.col("items") < FEWEST
    everyone = kept.select(person).distinct().join(whole, person, "left").withColumn("items", F.coalesce("items", F.lit(0)))
    return everyone.select(person, "items", F.when(few, "too_few").alias("error"), F.when(~few, F.concat_ws("\n\n", *lists)).alias("text"))


def taken_while(df: DataFrame, order: list[str], good: Column) -> DataFrame:
    """The rows before the first that is not ``good`` (a null is not), in the order of columns without ties. The first bad
    place is an aggregate with partial results, one row, so nothing is sorted."""
    ok = F.coalesce(good, F.lit(False))
    bad = df.where(~ok).agg(F.min(F.struct(*order)).alias("at")).first()["at"]
    if bad is None:
        return df
    before, equal = F.lit(False), F.lit(True)
    for c in order:
        value = F.lit(bad[c])
        before, equal = before | (equal & (F.col(c) < value)), equal & (F.col(c) == value)
    return df.where(before)


def triaged(pending: DataFrame, comments: DataFrame, works: DataFrame, most: int = 30, quotas: tuple[int, int] = (6, 4)) -> DataFrame:
    """(kind, id, answer) of a round of triage: the oldest ``most`` pending notes (id, answer) in order until one gets no
    answer; if none failed, the most reported comments and works (id, reports, answer), six and four of them, the same way."""
    notes = pending.orderBy("id").limit(most).withColumn("kind", F.lit("feedback"))
    judged = taken_while(notes, ["id"], F.col("answer").isNotNull())
    whole = notes.where("answer is null").limit(1).count() == 0
    targets = []
    for place, (kind, df, n) in enumerate((("comment", comments, quotas[0]), ("work", works, quotas[1]))):
        t = df.where("reports > 0").orderBy(F.desc("reports"), F.desc("id")).limit(n)
        targets.append(t.select(F.lit(place).alias("place"), (-F.col("reports")).alias("rank"), (-F.col("id")).alias("last"), F.lit(kind).alias("kind"), "id", "answer"))
    advised = taken_while(targets[0].unionByName(targets[1]), ["place", "rank", "last"], F.col("answer").isNotNull())
    out = judged.select("kind", "id", "answer")
    return out.unionByName(advised.select("kind", "id", "answer")) if whole else out


def duty_roster(managers: DataFrame, now: str, picks: int = 3) -> DataFrame:
    """Managers (id, kind, slot, hour, tz, queries) with whether each is on duty, in how many days next, the UTC hour of a shift,
    whether that is now, and the shift's queries. Residents are always on duty; the others of a kind, who are few, take turns
    by slot and id, a day each. A shift starts at a place of the list that the day and the id give."""
    at = F.to_timestamp(F.lit(now))
    day = F.floor((F.unix_seconds(at) + 8 * 3600) / 86400)
    w = Window.partitionBy("kind")
    m = managers.withColumn("_place", F.row_number().over(w.orderBy("slot", "id")) - 1).withColumn("_size", F.count("*").over(w))
    resident, current = F.col("kind") == "resident", F.pmod(day, F.col("_size"))
    wait = F.when(resident, 0).otherwise(F.pmod(F.col("_place") - current, F.col("_size"))).cast("int")
    utc_hour = F.pmod(F.floor(F.col("hour") - F.col("tz") + 0.5), F.lit(24)).cast("int")
    seed = F.aggregate(F.split("id", ""), day.cast("long"), lambda s, c: F.when(c == "", s).otherwise(F.pmod(s * 31 + F.ascii(c), F.lit(2**32))))
    n = F.size("queries")
    m = m.withColumn("next_in_days", wait).withColumn("on_duty", wait == 0).withColumn("utc_hour", utc_hour).withColumn("due_now", (wait == 0) & (utc_hour == F.hour(at)))
    start = F.pmod(seed, F.greatest(n, F.lit(1)).cast("long")).cast("int")
    drawn = F.slice(F.concat(F.slice("queries", start + 1, F.greatest(n - start, F.lit(0))), F.slice("queries", F.lit(1), start)), F.lit(1), F.lit(picks))
    return m.withColumn("picks", F.when(n > 0, drawn).otherwise(F.array().cast("array<string>"))).drop("_place", "_size")
