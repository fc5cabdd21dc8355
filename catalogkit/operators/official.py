"""The official page of an item: candidates from its page and from searches, probed within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import bound, host_of, suffixes
from .ordering import ranked
from .scratch import settled

#: Social sites, by any part of an address, and words by which a link says that it leads to an own site.
SOCIAL = r"(?i)facebook|instagram|twitter|x\.com|linkedin|youtube|pinterest|t\.me|tiktok|vimeo|flickr|mailto"
_BEFORE = r"(?i)(?:官方网站|官\s*网|官方|主办方网站|website|official\s*site|apply\s*here|organiser|organizer|visit\s*(?:the\s*)?site|external\s*link)[^<]{0,30}<a[^>]+href=\"(https?://[^\"]+)\""
_WITHIN = r"(?i)<a[^>]+href=\"(https?://[^\"]+)\"[^>]*>[^<]{0,40}(?:官方网站|官\s*网|官方|website|official|apply|visit\s*site|外部链接)[^<]{0,10}</a>"
_LD = r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"
#: Letters that a page needs to be judged, and pages that are probed for an item.
LEAST_TEXT, MOST_PROBES = 120, 6


def _ld_urls(block: Column) -> Column:
    """The addresses of a JSON-LD block in order: of each of its objects (a list's, a graph's, or itself) the url, the main
    page and what it is the same as, as a text or an object's ``@id``. The block is parsed once."""

    def named(x: Column) -> Column:
        return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.try_variant_get(x, "$.@id", "string"))

    def of_node(n: Column) -> Column:
        same = F.try_variant_get(n, "$.sameAs", "variant")
        many = F.coalesce(F.try_variant_get(same, "$", "array<variant>"), F.array(same))
        values = F.concat(F.array(F.try_variant_get(n, "$.url", "variant"), F.try_variant_get(n, "$.mainEntityOfPage", "variant")), many)
        return F.transform(F.filter(values, lambda x: x.isNotNull()), named)

    def of_block(v: Column) -> Column:
        graph = F.try_variant_get(v, "$.@graph", "variant")
        nodes = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(graph, "$", "array<variant>"), F.when(graph.isNotNull(), F.array(graph)), F.array(v))
        return F.flatten(F.transform(F.filter(nodes, lambda n: n.isNotNull()), of_node))

    return bound(F.try_parse_json(F.trim(block)), of_block)


def is_listed(host: Column, listed: list[str]) -> Column:
    """Whether a host is one of a list of hosts or below one; the list is a parameter."""
    return F.coalesce(F.arrays_overlap(suffixes(host), F.array(*map(F.lit, listed)).cast("array<string>")), F.lit(False))


def own_links(pages: DataFrame, key: str, url: str, html: str, third_party: list[str]) -> DataFrame:
    """(key, pos, link): addresses of other sites that a page gives as the official one: in its JSON-LD, then in links after and
    around words that say so; without fragments, each once at its first place. Third parties and social sites are left out."""
    blocks = F.regexp_extract_all(html, F.lit(_LD), F.lit(1))
    links = F.concat(F.coalesce(F.flatten(F.transform(blocks, _ld_urls)), F.array().cast("array<string>")), F.regexp_extract_all(html, F.lit(_BEFORE), F.lit(1)), F.regexp_extract_all(html, F.lit(_WITHIN), F.lit(1)))
    x = pages.select(key, F.coalesce(host_of(F.col(url)), F.lit("")).alias("_base"), F.posexplode_outer(links).alias("pos", "link"))  # outer: else a filter computes the links a second time
    x = x.where(F.col("link").rlike("(?i)^https?://")).withColumn("_host", host_of(F.col("link")))
    x = x.where(F.col("_host").isNotNull() & (F.col("_host") != F.col("_base")) & ~is_listed(F.col("_host"), third_party) & ~F.col("link").rlike(SOCIAL))
    return x.groupBy(key, F.regexp_replace("link", "#.*$", "").alias("link")).agg(F.min("pos").alias("pos")).select(key, "pos", "link")


def _place(query: Column, rank: Column) -> Column:
    """Where a candidate stands, as one number: by query, then by rank, nulls first."""
    return F.coalesce(query.cast("int"), F.lit(-1)).cast("long") * (1 << 33) + F.coalesce(rank.cast("int").cast("long") + ((1 << 31) + 1), F.lit(0))


def located(links: DataFrame, searches: DataFrame, hits: DataFrame, pages: DataFrame, key: str, third_party: list[str], most: int = MOST_PROBES) -> DataFrame:
    """(key, url, level, probed): the official page of each item that has a candidate. links (key, pos, link) of its own page come
    first, then the hits (search, query, rank, url) of the search that it takes (searches: key, search); an address counts
    once. Of the first ``most`` that are probed, the first ``specific`` page is taken, else the first of the organisation
    (``org``); pages (url, text, level: the judgement) that are missing or too short are probed in vain. Items share a
    search: its hits are judged once, and no more than ``most`` addresses of it come to each of its items."""

    def firsts(df: DataFrame, of: str) -> DataFrame:
        return ranked(df.groupBy(of, "url").agg(F.min("place").alias("place")), [of], ["place", "url"], "probe").where(F.col("probe") <= most)

    def fit(df: DataFrame) -> DataFrame:
        return df.where((F.col("url") != "") & ~is_listed(F.coalesce(host_of(F.col("url")), F.lit("")), third_party) & ~F.col("url").rlike(SOCIAL))

    # links come before all hits, so that each of them takes away one hit at most: the first ``most`` hits are enough
    each = hits.groupBy("search", "url").agg(F.min(_place(F.col("query") + 1, F.col("rank"))).alias("place"))
    heard = firsts(fit(settled(each).withColumn("url", F.regexp_replace("url", "#.*$", ""))), "search").select("search", "url", "place")
    own = fit(links.select(key, F.col("link").alias("url"), _place(F.lit(0), F.col("pos")).alias("place")))
    probes = firsts(own.unionByName(searches.join(heard, "search").select(key, "url", "place")), key)
    judged = probes.join(pages.where(F.length("text") >= LEAST_TEXT).select("url", "level"), "url", "left")
    first = lambda level: F.min(F.when(F.col("level") == level, F.struct("probe", "url")))
    found = judged.groupBy(key).agg(first("specific").alias("s"), first("org").alias("o"), F.max("probe").alias("n"))
    level = F.when(F.col("s").isNotNull(), "specific").when(F.col("o").isNotNull(), "org")
    return found.select(key, F.coalesce("s.url", "o.url").alias("url"), level.alias("level"), F.coalesce("s.probe", "n").alias("probed"))
