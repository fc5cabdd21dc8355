"""Threads, follows, blocks and favourites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feed(works: DataFrame, follows: DataFrame, author: str, viewer: str) -> DataFrame:
    return works.join(follows.where(F.col("follower") == viewer).select(F.col("followee").alias(author)).distinct(), author)


def flagged(df: DataFrame, marks: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Every row with whether it is marked; a row is never repeated."""
    return df.join(marks.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def flatten_threads(comments: DataFrame) -> DataFrame:
    """A reply to a reply hangs on the reply's parent."""
    parents = comments.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
    return comments.join(parents, "parent", "left").withColumn("parent", F.coalesce("grand", "parent")).drop("grand")


def resolve(keys: DataFrame, channels: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Items of mixed channels for keys ``channel:id`` (pos, key), in order; keys without an item are left out.
    channels: name -> (table, id column, title column)."""
    k = keys.withColumn("channel", F.substring_index("key", ":", 1)).withColumn("id", F.substring_index("key", ":", -1))
    items = reduce(DataFrame.unionByName, (t.select(F.lit(n).alias("channel"), F.col(i).cast("string").alias("id"), F.col(title).alias("title")) for n, (t, i, title) in channels.items()))
    return k.join(items, ["channel", "id"]).select("pos", "key", "channel", "title")


def without_blocked(comments: DataFrame, blocks: DataFrame, viewer: str, author: str) -> DataFrame:
    gone = blocks.where(F.col("blocker") == viewer).select(F.col("blocked").alias(author))
    return comments.join(gone.distinct(), author, "left_anti")


def visible_comments(comments: DataFrame, viewer: str) -> DataFrame:
    """Approved ones and the viewer's own pending ones."""
    return comments.where((F.col("status") == "approved") | ((F.col("status") == "pending") & (F.col("uid") == viewer)))


def follow_info(people: DataFrame, follows: DataFrame, uid: str, viewer: int) -> DataFrame:
    """Followers and followed of each person, and whether the viewer follows them."""
    n = lambda side, name: follows.groupBy(F.col(side).alias(uid)).agg(F.count("*").alias(name))
    mine = follows.where(F.col("follower") == viewer).select(F.col("followee").alias(uid)).distinct()
    p = flagged(people.join(n("followee", "followers"), uid, "left").join(n("follower", "following"), uid, "left"), mine, [uid], "is_following")
    return p.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("followers", "following")})


def people_named(people: DataFrame, name: str, text: str, complete: Column, order: list, most: int = 12) -> DataFrame:
    """Complete profiles whose name, case and white space aside, holds the text."""
    flat = lambda x: F.regexp_replace(F.lower(x), r"(?U)\s+", "")
    return people.where(complete & F.contains(flat(F.col(name)), F.lit("".join(text.lower().split())))).orderBy(*order).limit(most)


def audience(people: DataFrame, sent: DataFrame, issue: int) -> DataFrame:
    """Those who still are to get an issue: subscribed, not yet sent to with success; verified addresses first."""
    done = sent.where((F.col("issue") == issue) & (F.col("ok") == 1)).select("address").distinct()
    return people.where("subscribed").join(done, "address", "left_anti").orderBy(F.desc("verified"), "id")


def titles_by_id(ids: DataFrame, channels: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """The title of each id from the first of the channels that has it."""
    out, found = ids, []
    for i, (df, key, title) in enumerate(channels):
        out = out.join(df.select(F.col(key).cast("string").alias("id"), F.col(title).alias(f"_t{i}")), "id", "left")
        found.append(F.col(f"_t{i}"))
    return out.select("id", F.coalesce(*found).alias("title"))


def translations(batches: DataFrame, rows: DataFrame) -> DataFrame:
    """Translations (batch, pos, id, text) for rows (batch, pos, id): by id; by position in a batch none of whose ids is
    known; a batch that has an id twice is left out."""
    known = batches.join(rows.select("batch", "id", F.lit(1).alias("_hit")), ["batch", "id"], "left")
    b = known.groupBy("batch").agg((F.count("id") == F.count_distinct("id")).alias("sound"), (F.count("_hit") == 0).alias("by_pos"))
    b = batches.join(b.where("sound"), "batch")
    by_id = rows.join(b.where("not by_pos").select("batch", "id", "text"), ["batch", "id"])
    by_pos = rows.join(b.where("by_pos").select("batch", "pos", "text"), ["batch", "pos"])
    return by_id.select("batch", "pos", "id", "text").unionByName(by_pos.select("batch", "pos", "id", "text"))
