"""Catalog merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import top


def upsert(base: DataFrame, new: DataFrame, key: str, inherit: list[str]) -> DataFrame:
    """New rows replace base rows of the same key unless those are verified; ``inherit`` fields of the base fill gaps.
    Both have key, verified, ord and the same other columns. Adds action: kept, skipped, updated or added."""
    cols = [c for c in base.columns if c != key]
    j = base.select(key, F.struct(*cols).alias("b")).join(new.select(key, F.struct(*cols).alias("n")), key, "full_outer")
    old = F.col("b").isNotNull() & (F.col("n").isNull() | F.coalesce(F.col("b.verified"), F.lit(False)))
    pick = lambda c: F.when(old, F.col(f"b.{c}")).otherwise(F.coalesce(f"n.{c}", f"b.{c}") if c in inherit else F.col(f"n.{c}"))
    action = F.when(F.col("n").isNull(), "kept").when(F.col("b").isNull(), "added").when(old, "skipped").otherwise("updated")
    # a replaced row keeps its place in the base
    out = [F.coalesce("b.ord", "n.ord").alias("ord") if c == "ord" else pick(c).alias(c) for c in cols]
    return j.select(key, *out, action.alias("action"))


def two_way(local: DataFrame, remote: DataFrame, key: str, stamp: str, graft: list[str], url: str | None = None) -> DataFrame:
    """Merge two copies: the verified side wins, else the newer stamp, else the local one; ``graft`` fields that the
    winner lacks come from the loser. With ``url``, of rows with an equal one the first stays, remote order first."""
    cols = [c for c in local.columns if c != key]
    j = local.select(key, F.struct(*cols).alias("l")).join(remote.select(key, F.struct(*cols).alias("r")), key, "full_outer")
    lv, rv = (F.coalesce(F.col(f"{s}.verified"), F.lit(False)) for s in "lr")
    newer = F.coalesce(F.col(f"r.{stamp}").cast("string"), F.lit("")) > F.coalesce(F.col(f"l.{stamp}").cast("string"), F.lit(""))
    remote_wins = F.col("l").isNull() | (F.col("r").isNotNull() & F.when(lv != rv, rv).otherwise(newer))
    j = j.withColumn("side", F.when(remote_wins, "remote").otherwise("local"))
    out = []
    for c in cols:
        if c == "ord":
            continue
        win, lose = F.when(F.col("side") == "remote", F.col(f"r.{c}")).otherwise(F.col(f"l.{c}")), F.when(F.col("side") == "remote", F.col(f"l.{c}")).otherwise(F.col(f"r.{c}"))
        out.append((F.coalesce(win, lose) if c in graft else win).alias(c))
    merged = j.select(key, *out, F.when(F.col("r").isNotNull(), 0).otherwise(1).alias("far"), F.coalesce("r.ord", "l.ord").alias("ord"), "side")
    if url is None:
        return merged
    alone = merged.where(F.coalesce(F.col(url), F.lit("")) == "")
    return alone.unionByName(top(merged.where(F.coalesce(F.col(url), F.lit("")) != ""), [url], ["far", "ord", key]))


def minus(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no tombstone; a null key never has."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def backfill(result: DataFrame, live: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """The result, and the live rows that appeared since the baseline."""
    return result.unionByName(minus(minus(live, baseline, key), result, key).select(result.columns))


def latest_by_identity(df: DataFrame, keys: list[str], order: list, owner: str, retain: int) -> DataFrame:
    """Of rows with equal keys (null equals null) the latest; of each owner the ``retain`` latest of these."""
    return top(top(df, keys, order), [owner], order, retain)


def toggled(df: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs that were toggled an odd number of times."""
    return df.groupBy(*keys).agg(F.count("*").alias("times")).where("times % 2 = 1")


def split_archive(df: DataFrame, reason: Column) -> DataFrame:
    """Rows with the reason why each is archived; null for those that stay."""
    return df.withColumn("reason", reason).withColumn("archived", F.col("reason").isNotNull())


def archive(df: DataFrame, key: str, reason: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows that stay, those that go to the recycle bin with their reason, and the tombstones (key) of these."""
    marked = split_archive(df, reason)
    gone = marked.where("archived")
    return marked.where("not archived").drop("reason", "archived"), gone.drop("archived"), gone.select(key)


def restore(live: DataFrame, bin_: DataFrame, tombs: DataFrame, key: str, which: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the bin come back to the live ones, unless these have the key again; their tombstones go."""
    back = bin_.where(which)
    return live.unionByName(minus(back.drop("reason"), live, key), allowMissingColumns=True), bin_.where(~F.coalesce(which, F.lit(False))), minus(tombs, back, key)


def purge(bin_: DataFrame, tombs: DataFrame, which: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of the bin go for good; their tombstones stay, so that no copy brings them back."""
    return bin_.where(~F.coalesce(which, F.lit(False))), tombs


def append_new(base: DataFrame, new: DataFrame, key: str, url: str) -> DataFrame:
    """New rows whose key and url the base does not have; a null or empty url matches none. Rows of one batch are not
    compared with each other."""
    fresh = minus(new, base, key)
    with_url = base.where(F.coalesce(F.col(url), F.lit("")) != "")
    return fresh.join(with_url.select(url).distinct(), url, "left_anti").select(new.columns)


def tombstone_union(sides: list[DataFrame], key: list[str], at: str) -> DataFrame:
    """Tombstones of all sides; of a key that several have, the last side's time."""
    marked = [s.select(*key, at).withColumn("_side", F.lit(i)) for i, s in enumerate(sides)]
    both = marked[0]
    for m in marked[1:]:
        both = both.unionByName(m)
    return both.groupBy(*key).agg(F.max_by(at, F.col("_side")).alias(at))


def unseen(streams: list[DataFrame], key: str, ord_: str, seen: DataFrame) -> DataFrame:
    """Keys of several streams, one after the other, each at its first place, without those seen before."""
    marked = [s.select(key, F.col(ord_).cast("long").alias(ord_)).withColumn("_side", F.lit(i)) for i, s in enumerate(streams)]
    both = marked[0]
    for m in marked[1:]:
        both = both.unionByName(m)
    first = both.groupBy(key).agg(F.min(F.struct("_side", ord_)).alias("_at"))
    return minus(first, seen, key).select(key, F.col("_at._side").alias("stream"), F.col(f"_at.{ord_}").alias(ord_))


def last_action(df: DataFrame, keys: list[str], order: str, action: str) -> DataFrame:
    """The last action of each pair, by an aggregate."""
    return df.groupBy(*keys).agg(F.max_by(action, F.col(order)).alias(action), F.max(order).alias(order))


def follows_after_blocks(follows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Follows (follower, followee, at) without those that a later block (blocker, blocked, at) of either side has ended."""
    b = blocks.select(F.col("blocker").alias("follower"), F.col("blocked").alias("followee"), F.col("at").alias("_at"))
    both = b.unionByName(b.select(F.col("followee").alias("follower"), F.col("follower").alias("followee"), "_at"))
    last = both.groupBy("follower", "followee").agg(F.max("_at").alias("_at"))
    return follows.join(last, ["follower", "followee"], "left").where(F.col("_at").isNull() | (F.col("_at") < F.col("at"))).drop("_at")


def running(df: DataFrame, keys: list, order: list, value: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))
