"""Pictures of pages: what a page names, what it holds, what is of no use, and a repair that gives each item one of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import present
from ..functions.urls import resolve
from .scratch import fixed

#: Where a page names its picture, in order.
NAMED = [
    r"(?i)<meta[^>]+property=[\"']og:image:secure_url[\"'][^>]+content=[\"']([^\"']+)[\"']", r"(?i)<meta[^>]+content=[\"']([^\"']+)[\"'][^>]+property=[\"']og:image:secure_url[\"']",
    r"(?i)<meta[^>]+property=[\"']og:image[\"'][^>]+content=[\"']([^\"']+)[\"']", r"(?i)<meta[^>]+content=[\"']([^\"']+)[\"'][^>]+property=[\"']og:image[\"']",
    r"(?i)<meta[^>]+name=[\"']twitter:image(?::src)?[\"'][^>]+content=[\"']([^\"']+)[\"']", r"(?i)<meta[^>]+content=[\"']([^\"']+)[\"'][^>]+name=[\"']twitter:image(?::src)?[\"']",
    r"(?i)<meta[^>]+itemprop=[\"']image[\"'][^>]+content=[\"']([^\"']+)[\"']", r"(?i)<link[^>]+rel=[\"']image_src[\"'][^>]+href=[\"']([^\"']+)[\"']",
]
#: Pictures of a text, names that tell a picture is no content, and the sizes under which one is none.
IMAGE = r"(?i)<img\b[^>]*?\b(?:data-src|data-original|src)\s*=\s*[\"'][^\"']+[\"'][^>]*>"
_SOURCE = r"(?i)^<img\b[^>]*?\b(?:data-src|data-original|src)\s*=\s*[\"']([^\"']+)[\"']"
NO_CONTENT = r"(?i)logo|favicon|sprite|avatar|placeholder|blank|spacer|pixel|1x1|loading|icon|button|social|share[-_]|wechat|weixin|qrcode|erweima|footer|header[-_]bg"
LEAST_WIDTH, LEAST_HEIGHT, MOST_IMAGES = 200, 150, 8
#: What generic pictures are called, and file names that are no poster.
GENERIC = r"logo_fb|favicon|placeholder|sprite|og[_-]default|share[_-]default|default[_-](?:og|share)|/logos?/"
_LOGO, _UPLOADED = r"\blogo\b", r"upload|files|media|photo|img|image|cdn"
JUNK_NAME = r"(?i)logo|qrcode|qr_|ewm|erweima|shipinhao|weibo|wechat|weixin|icon|favicon|share|seal|avatar|badge|watermark|placeholder|default"


def named_picture(html: Column, base: Column) -> Column:
    """The picture that a page names first, by kind of place, as an absolute http address; null if that is none."""
    found = F.coalesce(*(present(F.trim(F.regexp_extract(html, p, 1))) for p in NAMED))
    return F.transform(F.array(resolve(found, base)), lambda u: F.when(u.rlike("(?i)^https?://"), u))[0]


def content_pictures(html: Column, base: Column, most: int = MOST_IMAGES) -> Column:
    """The first pictures of a page's text, absolute and each once, without those whose address or stated size tells that
    they are no content."""
    tags = F.regexp_extract_all(html, F.lit(f"({IMAGE})"), F.lit(1))
    pairs = F.transform(tags, lambda t: F.struct(F.trim(F.regexp_extract(t, _SOURCE, 1)).alias("src"), F.regexp_extract(t, r"(?i)\bwidth\s*=\s*[\"']?([0-9]+)", 1).try_cast("long").alias("w"), F.regexp_extract(t, r"(?i)\bheight\s*=\s*[\"']?([0-9]+)", 1).try_cast("long").alias("h")))
    large = lambda v, least: v.isNull() | (v >= least)
    kept = F.filter(pairs, lambda p: (p["src"] != "") & ~F.startswith(p["src"], F.lit("data:")) & ~p["src"].rlike(NO_CONTENT) & large(p["w"], LEAST_WIDTH) & large(p["h"], LEAST_HEIGHT))
    absolute = F.filter(F.transform(kept, lambda p: resolve(p["src"], base)), lambda u: u.rlike("(?i)^https?://"))
    return F.slice(F.array_distinct(absolute), 1, most)


def is_generic(url: Column) -> Column:
    """Whether an address is a site's own sign or a picture for all pages; a missing one is."""
    u = F.lower(F.coalesce(url, F.lit("")))
    return (u == "") | u.rlike(GENERIC) | (u.rlike(_LOGO) & ~u.rlike(_UPLOADED))


def is_junk_name(url: Column) -> Column:
    """Whether a file's name tells that it is no poster."""
    return F.substring_index(url, "/", -1).rlike(JUNK_NAME)


def audited(items: DataFrame, third_party: Column) -> DataFrame:
    """items (cover) with the ``fault`` of each cover: ``shared`` with other items, ``third_party``, or null. The number of
    items with a cover is an aggregate with partial sums; only covers that are shared, few rows, come back to the items."""
    shared = items.where("cover is not null").groupBy("cover").count().where("count > 1").select("cover", F.lit(True).alias("_shared"))
    out = items.join(shared, "cover", "left")
    return out.withColumn("fault", F.when(F.col("_shared"), "shared").when(F.col("cover").isNotNull() & third_party, "third_party")).drop("_shared").select(*items.columns, "fault")


def repaired(items: DataFrame, order: str, most_rounds: int = 10_000) -> DataFrame:
    """(order, cover): items (order: unique, cover, fault, candidates: array) after a repair. Sound covers stay. In their
    order, items with a fault take the first of their candidates that nobody has; an item without one has null.

    All items ask at once for the next candidate that has not been refused to them, and a picture stays with the first in
    order that has asked, until nobody is refused; that gives what going through the items one by one gives. A round is an
    aggregate by picture, written to the checkpoint folder."""
    good = items.where("cover is not null and fault is null").select("cover").distinct()
    asking = items.where("fault is not null").select(order, F.posexplode("candidates").alias("k", "url"))
    asking = fixed(asking.join(good.withColumnRenamed("cover", "url"), "url", "left_anti"))  # what is in good use is refused at once
    refused = asking.select(order, "k").limit(0)
    for _ in range(most_rounds):
        now = asking.join(refused, [order, "k"], "left_anti").groupBy(order).agg(F.min(F.struct("k", "url")).alias("c")).select(order, "c.k", "c.url")
        now = fixed(now)
        winners = now.groupBy("url").agg(F.min(order).alias(order))
        losers = fixed(now.join(winners.select(order), order, "left_anti").select(order, "k"))
        if not losers.limit(1).count():
            break
        refused = fixed(refused.unionByName(losers))
    else:
        raise RuntimeError("covers did not settle")
    kept = items.where("fault is null").select(order, "cover")
    return kept.unionByName(items.where("fault is not null").select(order).join(now.select(order, F.col("url").alias("cover")), order, "left"))
