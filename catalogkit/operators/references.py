"""References in an issue's text to its numbered items: loose forms repaired, segments, numbers by first use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import bound
from .ordering import ranked
from .scratch import fixed

#: A mark, the loose forms of one, and how long a title must be to stand for its item.
MARK = r"\[\[([0-9]+)[:：]([^\]]{1,60})\]\]"
_BARE, _SINGLE, _TITLE = r"\[\[?[0-9]{1,3}\]\]?", r"(?:^|[^\[])\[[0-9]{1,3}[:：][^\]]{1,60}\](?!\])", r"【[^】]{4,60}】"
LEAST_TITLE = 4
#: Items that a loose mark can name: its number has three digits at most.
LOOSE = 1000


def title_index(items: DataFrame) -> DataFrame:
    """(issue, key, n): titles, with and without their marks, that name one item of an issue only; items (issue, n, title)."""
    whole = F.trim(F.coalesce("title", F.lit("")))
    keys = items.select("issue", "n", F.explode(F.array_distinct(F.array(whole, F.trim(F.regexp_replace(whole, "[《》]", ""))))).alias("key")).where(F.length("key") >= LEAST_TITLE)
    return keys.groupBy("issue", "key").agg(F.min("n").alias("n"), F.max("n").alias("last")).where("n = last").drop("last")


def _pieces(text: Column, form: str, change) -> Column:
    """The text with each part of that form changed, read from left to right."""
    parts = lambda x: F.regexp_extract_all(x, F.lit(f"({form})"), F.lit(1))
    return bound(text, lambda x: F.array_join(F.zip_with(F.split(x, form), parts(x), lambda a, b: F.concat(a, F.when(b.isNull(), "").otherwise(change(b)))), ""))


def numbered_marks(text: Column, names: Column, size: Column) -> Column:
    """``[3]`` and ``[[3]]`` become ``[[3:title]]``, ``[3:words]`` gets its second brackets; what names no item stays. names: array
    of the short titles of the first LOOSE items by number; size: how many items there are."""
    number = lambda p: F.regexp_extract(p, "([0-9]{1,3})", 1).cast("int")
    known = lambda n: n < size
    bare = lambda p: F.when(known(number(p)), F.concat(F.lit("[["), number(p).cast("string"), F.lit(":"), F.get(names, number(p)), F.lit("]]"))).otherwise(p)
    text = _pieces(text, _BARE, bare)
    parts = lambda p, i: F.regexp_extract(p, r"(?s)^(.?)\[([0-9]{1,3})[:：]([^\]]{1,60})\]$", i)
    single = lambda p: F.when(known(parts(p, 2).cast("int")), F.concat(parts(p, 1), F.lit("[["), parts(p, 2), F.lit(":"), parts(p, 3), F.lit("]]"))).otherwise(p)
    return _pieces(text, _SINGLE, single)


def _inner(p: Column) -> Column:
    return F.trim(F.substr(p, F.lit(2), F.length(p) - 2))


def named_marks(text: Column, titles: Column) -> Column:
    """``【title】`` becomes the mark of the one item that has it (titles: a map); what names no item stays."""
    named = lambda p: F.when(titles[_inner(p)].isNotNull(), F.concat(F.lit("[["), titles[_inner(p)].cast("string"), F.lit(":"), _inner(p), F.lit("]]"))).otherwise(p)
    return _pieces(text, _TITLE, named)


def _segments_of(text: Column, size: Column) -> Column:
    """A text in order: plain text (t), and references (n, label) or, for marks without an item, their labels as plain text."""

    def both(x: Column) -> Column:
        marks = F.regexp_extract_all(x, F.lit(f"({MARK})"), F.lit(1))
        return F.flatten(F.transform(F.zip_with(F.split(x, MARK), marks, lambda a, b: F.struct(a.alias("plain"), b.alias("mark"))), pair))

    def pair(p: Column, k: Column) -> Column:
        mark = lambda i: F.regexp_extract(p["mark"], MARK, i)
        n, label = mark(1).try_cast("int"), F.trim(mark(2))
        valid = F.coalesce(n < size, F.lit(False))
        plain = F.struct((k * 2).alias("at"), p["plain"].alias("t"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("label"))
        return F.array(plain, F.struct((k * 2 + 1).alias("at"), F.when(~valid, label).alias("t"), F.when(valid, n).alias("n"), F.when(valid, label).alias("label")))

    return F.filter(bound(text, both), lambda x: x["n"].isNotNull() | (x["t"] != "") | (x["t"].isNotNull() & (x["at"] % 2 == 1)))


def loose_names(items: DataFrame) -> DataFrame:
    """(issue, _n, _names): how many items an issue has, and the short titles of the first LOOSE."""
    short = F.substring(F.regexp_replace(F.coalesce("title", F.lit("")), "[《》]", ""), 1, 40)
    short = F.when(short == "", F.concat(F.lit("条目"), "n")).otherwise(short)
    loose = F.when(F.col("n") < LOOSE, F.struct("n", short.alias("name")))
    names = items.groupBy("issue").agg(F.array_sort(F.collect_list(loose)).alias("_items"), F.count("*").cast("int").alias("_n"))
    return names.select("issue", "_n", F.transform("_items", lambda x: x["name"]).alias("_names"))


def segments(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(issue, ord, seg, t, ref, oid, kind, url, label) of texts (issue, ord, text): plain text and references in order. A
    reference is numbered by its item's first use in the issue; a mark without such an item is plain text without its
    brackets. items (issue, n from 0, title, oid, kind, url): the numbered items of an issue. A text meets the names that a
    loose mark can have, LOOSE at most, and by joins the titles that stand in it, so an issue may have any number of items."""
    names = loose_names(items)
    t = texts.join(names, "issue", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    t = t.select("issue", "ord", "_n", numbered_marks(F.coalesce("text", F.lit("")), F.coalesce("_names", F.array().cast("array<string>")), F.col("_n")).alias("_text"))
    told = F.array_distinct(F.transform(F.regexp_extract_all("_text", F.lit(f"({_TITLE})"), F.lit(1)), _inner))
    told = t.select("issue", "ord", F.explode_outer(told).alias("key")).where(F.length("key") >= LEAST_TITLE)
    titles = told.join(title_index(items), ["issue", "key"]).groupBy(F.col("issue").alias("_issue"), F.col("ord").alias("_ord")).agg(F.map_from_entries(F.collect_set(F.struct("key", "n"))).alias("_titles"))
    t = t.join(titles, (F.col("issue") == F.col("_issue")) & F.col("ord").eqNullSafe(F.col("_ord")), "left")
    t = t.withColumn("_text", named_marks(F.col("_text"), F.coalesce("_titles", F.create_map().cast("map<string,int>"))))
    t = fixed(t.select("issue", "ord", _segments_of(F.col("_text"), F.col("_n")).alias("_segs")))
    s = t.select("issue", "ord", F.posexplode("_segs").alias("seg", "x")).select("issue", "ord", "seg", "x.*")
    marks = s.where("n is not null")
    first = marks.groupBy("issue", "n").agg(F.min(F.struct("ord", "at")).alias("first"))
    used = ranked(first, ["issue"], ["first"], "ref").select("issue", "n", F.col("ref").cast("int").alias("ref"))
    used = used.join(items.select("issue", "n", "oid", "kind", "url", "title"), ["issue", "n"])
    url = F.when(F.col("kind") != "opp", F.nullif(F.col("url"), F.lit("")))
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("title"))
    marks = marks.join(used, ["issue", "n"], "left").select("issue", "ord", "seg", "t", "ref", "oid", "kind", url.alias("url"), label.alias("label"))
    return s.where("n is null").select("issue", "ord", "seg", "t").unionByName(marks, allowMissingColumns=True)  # plain text needs no item
