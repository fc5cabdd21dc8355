"""Scans of landed pages, feeds and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_entities, squeeze
from ..functions.urls import host_of, resolve, same_site
from ..operators.ordering import top

_ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+)[^>]*>.*?</a>"
#: What the path and query of a page of details look like.
DETAIL = "|".join([
    r"/[0-9]{4,}[/_-]", r"(?i:[0-9]{6,}\.s?html?$)", r"(?i:[?&][a-z0-9_]*id=[0-9]+)", r"(?i:[?&]n=[0-9]+)", r"(?i:/t[0-9]{6,})", r"(?i:info/[0-9]+/[0-9]+\.s?html?)", r"(?i:/art/[0-9]+)",
    r"(?i:/(?:h-nd|h-pd)-[0-9]+)", r"(?i:[_-][0-9]{4,}\.(?:s?html?|aspx|jsp|action)$)", r"(?i:/[0-9]{5,}\.(?:aspx|jsp|shtml|html?)$)", r"/announcements/[0-9]+", r"/opportunity/[A-Za-z0-9_-]{6,}",
    r"/opportunities/detail/[^/]+/[0-9]+", r"(?i:/(?:residency|residencies|open-call|call-for|announcement|opportunity|apply|application|programme)s?/[a-z0-9_%-]{4,})",
])
#: The same of news and of job pages.
NEWS_DETAIL = r"(?i)/[0-9]{4}[/-][0-9]{1,2}/|content_[0-9]+|/n[0-9]{6,}|/[0-9]{8}/|[0-9]{5,}\.s?html?$|/(?:news|article|articles|story|post|feature|review|exhibitions?)/[a-z0-9_%-]{3,}"
JOB_DETAIL = r"(?i)/jobs?/[a-z0-9_%-]{2,}|/job-postings/[a-z0-9_%-]{2,}|/careers?/[a-z0-9_%-]{3,}|/positions?/[a-z0-9_%-]{2,}|/vacanc(?:y|ies)/[a-z0-9_%-]{2,}|/openings?/[a-z0-9_%-]{2,}"
#: Files and sections that are no content.
NO_CONTENT_FILE = r"(?i)\.(?:jpg|jpeg|png|gif|svg|webp|css|js|pdf|zip|ico|xml|json|mp4|mp3)$"
NO_CONTENT_SECTION = r"(?i)^/(?:tag|tags|category|categories|author|authors|page|search|cart|checkout|login|register|account|wp-json|wp-content|feed|sitemap|privacy|terms|cookie|accessibility|contact|about|team|staff)(?:/|$)"
#: Labels of links that only lead around, and words of an announcement's title.
NAV_NOISE = r"(?i)首页|关于|简介|章程|登录|注册|下载|地图|留言|隐私|版权|联系我们|english|返回|上一页|下一页|首\s*页|末\s*页|more|列表|index\.(?:s?html?|htm)$"
CALL_TITLE = r"(?i)征集|徵集|征稿|徵稿|徵件|徵選|征选|招募|徵求|驻留|駐留|駐村|驻地|驻校|工作坊|开放课题|開放課題|奖学金|獎學金|大奖|大獎|双年展|雙年展|三年展|open\s*call|call\s+for|补助|補助|资助|資助|奖助|獎助|徵展|徵稿|甄選|遴選|计划征|計劃徵|作品征|作品徵"


def anchors(pages: DataFrame, key: str, html: str = "html", carry: list[str] = []) -> DataFrame:
    """(key, pos, href, text) of each link with an address, in order; ``carry`` names columns of the page to keep."""
    a = pages.select(key, *carry, F.posexplode(F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(0))).alias("pos", "a"))
    g = lambda p: F.nullif(F.trim(F.regexp_extract("a", p, 1)), F.lit(""))
    href = F.coalesce(g(r"(?is)^<a\s[^>]*?href\s*=\s*\"([^\"]*)\""), g(r"(?is)^<a\s[^>]*?href\s*=\s*'([^']*)'"), g(r"(?is)^<a\s[^>]*?href\s*=\s*([^\s>\"']+)"))
    text = squeeze(F.regexp_replace(F.regexp_extract("a", r"(?is)^<a[^>]*>(.*)</a>$", 1), r"(?s)<[^>]+>", " "))
    return a.select(key, *carry, "pos", href.alias("href"), text.alias("text")).where("href is not null")


def path_query(url: Column) -> Column:
    """Path and query of an absolute url; the bare host has the path ``/``."""
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"^https?://[^/?#]*", "")
    return F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))


def is_detail(url: Column) -> Column:
    return path_query(url).rlike(DETAIL)


def is_content(url: Column) -> Column:
    """Whether a url of a sitemap may be content: no home page, file, section of a site's own, or page of a list."""
    rest = path_query(url)
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"(\?.*)$", 1)
    return (path != "/") & ~path.rlike(NO_CONTENT_FILE) & ~path.rlike(NO_CONTENT_SECTION) & ~query.rlike(r"(?i)[?&]page=[0-9]+")


def detail_links(pages: DataFrame, key: str, url: str = "url", most: int | None = None) -> DataFrame:
    """(key, u, pos, text): links of a page to pages of details of its own site, each once, at its first place."""
    base = F.col(url)
    a = anchors(pages, key, carry=[url]).where(~F.col("href").rlike("(?i)^(?:javascript:|mailto:|tel:|#)"))
    a = a.where(~(F.col("text").rlike(NAV_NOISE) & (F.length("text") < 8)))
    a = a.withColumn("full", resolve(F.col("href"), base)).where(same_site(host_of(F.col("full")), host_of(base)) & (F.col("full") != base))
    by_text = (F.length("text") >= 8) & F.col("text").rlike(CALL_TITLE) & F.regexp_extract(path_query(F.col("full")), r"^([^?]*)", 1).rlike("/[^/]")
    a = a.where(is_detail(F.col("full")) | by_text).withColumn("u", F.regexp_replace("full", "#.*$", ""))
    out = a.groupBy(key, "u").agg(F.min(F.struct("pos", "text")).alias("first")).select(key, "u", F.col("first.pos").cast("long").alias("pos"), F.col("first.text").alias("text"))
    return out if most is None else top(out, [key], ["pos"], most)


def feed_items(feeds: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, pos, title, link, published, summary) of RSS items and Atom entries; absent fields are empty."""
    items = feeds.select(key, F.posexplode(F.regexp_extract_all(body, F.lit(r"(?is)(?:<item.*?</item>|<entry.*?</entry>)"), F.lit(0))).alias("pos", "x"))

    def pick(*names: str) -> Column:
        found = []
        for n in names:
            inner = F.regexp_replace(F.regexp_extract("x", rf"(?is)<{n}[^>]*>(.*?)</{n}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
            found.append(F.nullif(squeeze(decode_entities(F.regexp_replace(inner, r"<[^>]+>", " "))), F.lit("")))
        return F.coalesce(*found, F.lit(""))

    link = F.coalesce(F.nullif(pick("link"), F.lit("")), F.regexp_extract("x", r'(?i)<link[^>]*href="([^"]+)"', 1))
    return items.select(key, "pos", pick("title").alias("title"), link.alias("link"), pick("pubDate", "updated", "published").alias("published"), pick("description", "summary", "content").alias("summary"))


def feed_links(feeds: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, pos, link): the links of a feed without fragments, each once, at its first place."""
    links = feed_items(feeds, key, body).withColumn("link", F.regexp_replace("link", "#.*$", "")).where("link rlike '^https?://'")
    return links.groupBy(key, "link").agg(F.min("pos").alias("pos"))


def feed_text(items: DataFrame, key: str) -> DataFrame:
    """(key, text): a feed as one text, an item after the other, of each the fields that are there."""
    line = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(label), c))
    one = F.concat_ws("\n", line("标题: ", "title"), line("链接: ", "link"), line("日期: ", "published"), line("摘要: ", "summary"))
    whole = items.withColumn("one", one).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "one"))).alias("all"))
    return whole.select(key, F.array_join(F.transform("all", lambda s: s["one"]), "\n\n---\n\n").alias("text"))


def first_items(texts: DataFrame, key: str, most: int = 8) -> DataFrame:
    """(key, pos, item): the first items of such a text."""
    return texts.select(key, F.posexplode(F.slice(F.split("text", "\n\n---\n\n"), 1, most)).alias("pos", "item"))


def feed_alternates(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """(key, feed): absolute addresses of the feeds that a page's head names, each once."""
    tags = pages.select(key, url, F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<link[^>]*>"), F.lit(0))).alias("x"))
    tags = tags.where(F.col("x").rlike(r"(?i)application/(?:rss|atom)\+xml"))
    href = F.regexp_extract("x", r"(?i)href\s*=\s*[\"']([^\"']+)[\"']", 1)
    return tags.select(key, resolve(href, F.col(url)).alias("feed")).where(href != "").distinct()


def sitemap_urls(maps: DataFrame, key: str, most: int = 5000, body: str = "body") -> DataFrame:
    """(key, pos, loc, lastmod) of the first ``most`` entries of each sitemap."""
    x = maps.select(key, F.posexplode(F.slice(F.regexp_extract_all(body, F.lit(r"(?is)<url>.*?</url>"), F.lit(0)), 1, most)).alias("pos", "x"))
    g = lambda n: F.nullif(F.trim(F.regexp_extract("x", rf"(?is)<{n}>(.*?)</{n}>", 1)), F.lit(""))
    return x.select(key, "pos", g("loc").alias("loc"), F.substring(g("lastmod"), 1, 10).alias("lastmod")).where("loc is not null")


def sitemap_children(maps: DataFrame, key: str, most: int = 3, body: str = "body") -> DataFrame:
    """(key, pos, loc): the first ``most`` sitemaps that an index names."""
    x = maps.select(key, F.posexplode(F.slice(F.regexp_extract_all(body, F.lit(r"(?is)<sitemap>.*?</sitemap>"), F.lit(0)), 1, most)).alias("pos", "x"))
    loc = F.trim(F.regexp_extract("x", r"(?is)<loc>(.*?)</loc>", 1))
    return x.select(key, "pos", loc.alias("loc")).where(loc != "")


def site_urls(bodies: DataFrame) -> DataFrame:
    """(site, map, pos, loc, lastmod) of each site's sitemap, or, if that is an index, of its first children.
    ``bodies`` has site, url and body of all sitemaps fetched, the site's own under the url ``root``."""
    root = bodies.where("url = 'root'")
    index = F.col("body").rlike("(?i)<sitemapindex")
    child = sitemap_children(root.where(index), "site").select("site", F.col("loc").alias("url"), (F.col("pos") + 1).alias("map"))
    maps = root.where(~index).select("site", F.lit(0).alias("map"), "body").unionByName(bodies.join(child, ["site", "url"]).select("site", "map", "body"))
    return sitemap_urls(maps.withColumn("k", F.struct("site", "map")), "k").select("k.site", "k.map", "pos", "loc", "lastmod")


def path_score(url: Column, weights: dict[str, int]) -> Column:
    """Sum of the weights of the words that the url holds."""
    score = F.lit(0)
    for word, n in weights.items():
        score = score + F.when(F.contains(F.lower(url), F.lit(word)), n).otherwise(0)
    return score


def json_ld_urls(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, url) of the JSON-LD blocks' url, mainEntityOfPage and sameAs, also in @graph; broken blocks are skipped."""
    blocks = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))).alias("pos", "raw"))
    v = blocks.withColumn("v", F.try_parse_json("raw")).where("v is not null")
    one = v.select(key, "pos", "v").unionByName(v.select(key, "pos", F.explode(F.coalesce(F.try_variant_get("v", "$.@graph", "array<variant>"), F.array())).alias("v")))
    urls = F.array_compact(F.concat(F.array(F.try_variant_get("v", "$.url", "string"), F.try_variant_get("v", "$.mainEntityOfPage", "string")), F.coalesce(F.try_variant_get("v", "$.sameAs", "array<string>"), F.array().cast("array<string>"))))
    return one.select(key, "pos", F.explode(urls).alias("url")).where(F.col("url").rlike("^https?://")).distinct()
