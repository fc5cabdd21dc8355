"""Browse queries: facets, order, pages, tags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import bound
from .scratch import fixed


@dataclass
class CatalogQuery:
    """A browse state. any: column -> values of which one must match; holds: list column -> a value that it must hold; every:
    boolean columns that must all be true; keyword: text that the searched columns hold; pinned: ids that pass all facets
    but ``visible`` and ``favourites``, the ids to which the view is bounded, if given."""

    visible: Column | None = None
    favourites: DataFrame | None = None
    any: dict[str, list] = field(default_factory=dict)
    holds: dict[str, object] = field(default_factory=dict)
    every: list[str] = field(default_factory=list)
    keyword: str = ""
    searched: list[str] = field(default_factory=list)
    pinned: list = field(default_factory=list)
    id: str = "id"

    def apply(self, df: DataFrame) -> DataFrame:
        cond = F.lit(True)
        for c, values in self.any.items():
            if values:
                cond = cond & F.col(c).isin(values)
        for c, value in self.holds.items():
            cond = cond & F.coalesce(F.array_contains(c, value), F.lit(False))
        for c in self.every:
            cond = cond & F.coalesce(F.col(c), F.lit(False))
        if self.keyword:
            cond = cond & keyword(self.searched, self.keyword)
        if self.pinned:
            cond = cond | F.col(self.id).isin(self.pinned)
        if self.visible is not None:
            df = df.where(self.visible)
        if self.favourites is not None:
            df = df.join(self.favourites.select(self.id).distinct(), self.id, "left_semi")
        return df.where(cond).withColumn("pinned", F.col(self.id).isin(self.pinned) if self.pinned else F.lit(False))


def keyword(columns: list[str], text: str) -> Column:
    """Whether the columns, joined by spaces, hold the text, whatever the case; null and empty ones are left out."""
    return F.contains(F.lower(F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in columns))), F.lit(text.lower()))


def deadline_rank(state: Column, days: Column) -> Column:
    """Open ones by days left, rolling ones after them, upcoming ones, past ones last and oldest first."""
    n = F.coalesce(days, F.lit(0)).cast("long")
    return F.when(state == "open", F.when(days.isNull(), F.lit(500_000_000)).otherwise(n)).when(state == "upcoming", F.lit(1_000_000_000) + n).otherwise(F.lit(2_000_000_000) + n).cast("long")


def page(df: DataFrame, order: list, number: int, size: int = 30) -> DataFrame:
    """A page by position; offset and limit keep all but the first pages' rows out of the sort's output."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def tags(text: Column, dictionary: list[tuple[str, list[str], list[str]]]) -> Column:
    """Labels whose substring terms stand anywhere or whose word terms stand as whole ASCII words, in any case. The text
    is lower-cased once; a plain search comes first, and only a text that holds a word's letters is searched by a pattern."""

    def held(t: Column, anywhere: list[str], words: list[str]) -> Column:
        found = F.lit(False)
        for term in anywhere:
            found = found | F.contains(t, F.lit(term))
        for word in words:
            w = _literal(word).replace(" ", "[ -]")
            found = found | (F.contains(t, F.lit(max(word.split(" "), key=len))) & t.rlike(rf"{w}(?<![a-z0-9_]{w})(?![a-z0-9_])"))
        return found

    return bound(F.lower(F.coalesce(text, F.lit(""))), lambda t: F.array_compact(F.array(*(F.when(held(t, a, w), F.lit(label)) for label, a, w in dictionary))))


def _literal(term: str) -> str:
    return "".join("\\" + c if c in ".^$*+?()[]{}|\\" else c for c in term)


def tag_counts(df: DataFrame, column: str) -> DataFrame:
    # outer: else a filter computes the tags a second time
    return df.select(F.posexplode_outer(column).alias("pos", "tag")).where("pos is not null").groupBy("tag").agg(F.count("*").alias("n"))


def numbered(df: DataFrame, order: list, size: int) -> DataFrame:
    """Each row's page. The position is counted in two steps, per range and then over ranges, so no task sorts all. The
    ranges are fixed once, in the checkpoint folder: planned twice, they need not be the same."""
    ranged = fixed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    within = ranged.withColumn("_p", F.shiftright("_m", 33)).withColumn("_rn", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_m")
    sizes = within.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row per partition
    return within.join(F.broadcast(before), "_p").withColumn("position", F.col("_rn") + F.col("_before")).withColumn("page", F.ceil(F.col("position") / size)).drop("_p", "_rn", "_before")


def official_url(df_url: str, df_official: str, third_party: list[str], trusted: list[str]) -> Column:
    """Where a record leads: its official url, then its own, if the organiser's; then either on a trusted platform."""
    from ..functions.urls import host_of, suffixes

    def found(r: Column) -> Column:
        within = lambda domains, of: F.coalesce(F.arrays_overlap(of, F.array(*map(F.lit, domains))), F.lit(False))
        foreign = [*third_party, *trusted]
        own = F.when(~within(foreign, r["b_hosts"]), r["b"])
        return F.coalesce(F.when(~within(foreign, r["a_hosts"]), r["a"]), own, F.when(within(trusted, r["a_hosts"]), r["a"]), F.when(within(trusted, r["b_hosts"]), r["b"]))

    hosts = lambda url: suffixes(host_of(url))
    official, own = F.nullif(F.col(df_official), F.lit("")), F.nullif(F.col(df_url), F.lit(""))
    return bound(F.struct(official.alias("a"), own.alias("b"), hosts(official).alias("a_hosts"), hosts(own).alias("b_hosts")), found)


def fully_free(apply_free: Column, fee_required: Column) -> Column:
    """Applying costs nothing, and taking part is known to cost nothing."""
    return F.coalesce(apply_free & ~fee_required, F.lit(False))


def badges(conditions: list[tuple[str, Column]]) -> Column:
    """The names whose condition is known to hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions)))


def search_text(columns: list[str]) -> Column:
    return F.lower(F.concat_ws(" ", *(F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns)))


def suggestions(df: DataFrame, title: list[str], text: str, order: list, n: int = 5) -> DataFrame:
    """The first records, in order, whose title (the first that is not empty) holds the text."""
    shown = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in title), F.lit(""))
    return df.withColumn("shown", shown).where(F.contains(F.lower("shown"), F.lit(text.lower()))).orderBy(*order).limit(n)


def provenance(via: Column, trust: Column, platform: Column) -> Column:
    """Where a record comes from: user, search, platform or official."""
    return F.when((F.coalesce(via, F.lit("")) == "submit") | (F.coalesce(trust, F.lit("")) == "user"), "user").when(via == "search", "search").when(platform.isNotNull(), "platform").otherwise("official")
