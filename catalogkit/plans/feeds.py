"""Queries over feeds, sitemaps, structured data and crawl state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import crawl, merge, ordering
from ..sources import html
from .base import derived, plain, query, rows, values
from .derived import FEEDS

# what the feeds are made to hold, told without reading them
_ITEMS = """SELECT page_id, 0 AS pos, 'Call no ' || page_id::VARCHAR AS title, coalesce(url, '') || '#top' AS link, '2026-01-0' || (page_id % 9)::VARCHAR AS published, 'A & b é' AS summary FROM pages
UNION ALL SELECT page_id, 1, 'two “x”', coalesce(url, ''), '', 's' FROM pages
UNION ALL SELECT page_id, 2, 'three', 'https://a.example.org/' || (page_id % 5)::VARCHAR, '2026-02-0' || (page_id % 9)::VARCHAR, '' FROM pages"""


@query(f"SELECT page_id, pos::INTEGER AS pos, title, link, published, summary FROM ({_ITEMS})")
def feed_items(t):
    return html.feed_items(derived(t, FEEDS), "page_id")


@query(f"SELECT page_id, link, min(pos)::INTEGER AS pos FROM (SELECT page_id, pos, regexp_replace(link, '#.*$', '') AS link FROM ({_ITEMS})) WHERE regexp_matches(link, '^https?://') GROUP BY ALL")
def feed_links(t):
    return html.feed_links(derived(t, FEEDS), "page_id")


@query(f"""SELECT page_id, pos::INTEGER AS pos, concat_ws(chr(10), '标题: ' || title, '链接: ' || nullif(link, ''), '日期: ' || nullif(published, ''), '摘要: ' || nullif(summary, '')) AS item FROM ({_ITEMS}) WHERE pos < 2""")
def feed_first_items(t):
    return html.first_items(html.feed_text(html.feed_items(derived(t, FEEDS), "page_id"), "page_id"), "page_id", 2)


_MAPS = """SELECT page_id % 40 AS site, CASE WHEN page_id < 40 THEN 'root' ELSE 'https://s' || CAST(page_id % 40 AS STRING) || '/m' || CAST(page_id AS STRING) END AS url, page_id,
CASE WHEN page_id < 40 AND page_id % 2 = 0 THEN '<?xml?><sitemapindex><sitemap><loc> https://s' || CAST(page_id AS STRING) || '/m' || CAST(page_id + 40 AS STRING) || ' </loc></sitemap><sitemap><loc>https://s' || CAST(page_id AS STRING) || '/gone</loc></sitemap><sitemap><loc>https://s' || CAST(page_id AS STRING) || '/m' || CAST(page_id + 80 AS STRING) || '</loc></sitemap><sitemap><loc>https://s' || CAST(page_id AS STRING) || '/m' || CAST(page_id + 120 AS STRING) || '</loc></sitemap></sitemapindex>'
ELSE '<urlset><url><loc>' || coalesce(url, '') || '</loc><lastmod>2026-07-0' || CAST(page_id % 9 AS STRING) || 'T00:00:00Z</lastmod></url><url><loc>https://x.example.org/a/' || CAST(page_id AS STRING) || '</loc></url></urlset>' END AS body FROM {pages}"""


@query(f"""WITH m AS ({plain(_MAPS)}), s AS (SELECT site, 0 AS map, page_id FROM m WHERE url = 'root' AND page_id % 2 = 1 UNION ALL SELECT r.site, k.map, r.page_id + 40 * k.step FROM m r, (VALUES (1, 1), (3, 2)) k(map, step) WHERE r.url = 'root' AND r.page_id % 2 = 0)
SELECT s.site, s.map, x.pos, x.loc, x.lastmod FROM s JOIN (SELECT page_id, 0 AS pos, url AS loc, '2026-07-0' || (page_id % 9)::VARCHAR AS lastmod FROM pages UNION ALL SELECT page_id, 1, 'https://x.example.org/a/' || page_id::VARCHAR, NULL FROM pages) x USING (page_id)""")
def sitemap_scan(t):
    return html.site_urls(derived(t, _MAPS).select("site", "url", "body"))


_LD = """SELECT page_id, '<script type="application/ld+json">{"@type": "Event", "url": "https://e.org/' || CAST(page_id AS STRING) || '", "sameAs": ["https://s.org/1", "ftp://no"]}</script><script type="application/ld+json">{broken</script>'
|| '<script type=''application/ld+json''>{"@graph": [{"mainEntityOfPage": "https://m.org/' || CAST(page_id % 7 AS STRING) || '"}, {"url": "rel"}]}</script><link rel="alternate" type="application/rss+xml" href="/feed"><link rel="alternate" href="/no"><link type="application/atom+xml" href="https://f.org/atom">' AS html, url FROM {pages}"""


@query("""SELECT page_id, 'https://e.org/' || page_id::VARCHAR AS url FROM pages UNION ALL SELECT page_id, 'https://s.org/1' FROM pages UNION ALL SELECT page_id, 'https://m.org/' || (page_id % 7)::VARCHAR FROM pages""")
def json_ld_urls(t):
    return html.json_ld_urls(derived(t, _LD), "page_id").select("page_id", "url")


@query(r"SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/feed' AS feed FROM pages UNION ALL SELECT page_id, 'https://f.org/atom' FROM pages")
def feed_alternates(t):
    return html.feed_alternates(derived(t, _LD), "page_id")


_PQ = "CASE WHEN starts_with(regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://[^/?#]*', ''), '/') THEN regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://[^/?#]*', '') ELSE '/' || regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://[^/?#]*', '') END"
_URLS = [(-1, "https://a.org/"), (-2, "https://a.org/tag/x"), (-3, "https://a.org/x.PDF"), (-4, "https://a.org/x?page=3"), (-5, "https://a.org/news/show-time"), (-6, "https://a.org/about"), (-7, "https://a.org/jobs/curator"), (-8, "https://a.org/20260131/x"), (-9, "https://a.org/positions/a1")]


@query(rf"""WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT * FROM {values(_URLS)} v(page_id, url)), p AS (SELECT page_id, url, {_PQ} AS pq FROM u),
q AS (SELECT *, regexp_extract(pq, '^([^?]*)', 1) AS path, regexp_extract(pq, '(\?.*)$', 1) AS query FROM p)
SELECT page_id, path <> '/' AND NOT regexp_matches(path, '{html.NO_CONTENT_FILE}') AND NOT regexp_matches(path, '{html.NO_CONTENT_SECTION}') AND NOT regexp_matches(query, '(?i)[?&]page=[0-9]+') AS content,
regexp_matches(pq, '{html.NEWS_DETAIL}') AS news, regexp_matches(pq, '{html.JOB_DETAIL}') AS job FROM q""")
def page_kinds(t):
    u = t("pages").select("page_id", "url").unionByName(rows(t, _URLS, "page_id long, url string"))
    pq = html.path_query(F.col("url"))
    return u.select("page_id", html.is_content(F.col("url")).alias("content"), pq.rlike(html.NEWS_DETAIL).alias("news"), pq.rlike(html.JOB_DETAIL).alias("job"))


_HOSTS = [(-1, "https://www.zhihu.com/x"), (-2, "https://10.0.0.1:80/"), (-3, "https://printer.local/"), (-4, "https://[::1]/"), (-5, "https://localhost"), (-6, "https://fine.org")]


@query(rf"""WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT * FROM {values(_HOSTS)} v(page_id, url)), h AS (SELECT *, regexp_extract(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^\[|\]$', '', 'g'), '^([^:]*)', 1) AS h FROM u)
SELECT page_id, regexp_matches(url, '{urls.BLOCKED}') AS blocked, h = '' OR h = 'localhost' OR regexp_matches(h, '\.(?:local|internal|lan|home)$') OR regexp_matches(h, '^[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}$') AS unsafe FROM h""")
def blocked_hosts(t):
    u = t("pages").select("page_id", "url").unionByName(rows(t, _HOSTS, "page_id long, url string"))
    return u.select("page_id", urls.is_blocked(F.col("url")).alias("blocked"), urls.is_unsafe(F.regexp_extract("url", "^https?://([^/?#]*)", 1)).alias("unsafe"))


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 304 ELSE 200 END AS status, md5(html) AS hash FROM pages), s AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN md5(html) ELSE 'old' END AS hash FROM pages WHERE page_id % 5 <> 0)
SELECT page_id, status = 304 OR (s.hash IS NOT NULL AND p.hash = s.hash) AS unchanged FROM p LEFT JOIN s USING (page_id)""")
def unchanged_pages(t):
    p = t("pages").select("page_id", F.when(F.col("page_id") % 9 == 0, 304).otherwise(200).alias("status"), F.md5("html").alias("hash"))
    state = p.where("page_id % 5 <> 0").select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("hash")).otherwise("old").alias("hash"))
    return crawl.unchanged(p, state, "page_id").select("page_id", "unchanged")


@query("""SELECT s_suppkey FROM supplier WHERE coalesce(CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey % 5 <> 0 END, true) AND NOT (s_suppkey % 3 = 0 AND true)""")
def polled_sources(t):
    s = t("supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey") % 5 != 0).alias("reachable"), F.when(F.col("s_suppkey") % 3 == 0, "low").otherwise("normal").alias("tier"))
    return crawl.polled_today(s, "2026-08-11").select("s_suppkey")


@query(f"""WITH f AS (SELECT link, min(page_id * 10 + pos) AS ord FROM (SELECT page_id, pos, regexp_replace(link, '#.*$', '') AS link FROM ({_ITEMS})) GROUP BY link), s AS (SELECT url AS link, min(page_id) AS ord FROM pages GROUP BY url)
SELECT coalesce(f.link, s.link) AS link, CASE WHEN f.link IS NOT NULL THEN 0 ELSE 1 END AS stream FROM f FULL JOIN s ON f.link = s.link WHERE coalesce(f.link, s.link) NOT IN (SELECT url FROM pages WHERE page_id % 4 = 0 AND url IS NOT NULL)""")
def unseen_links(t):
    f = html.feed_items(derived(t, FEEDS), "page_id").select(F.regexp_replace("link", "#.*$", "").alias("link"), (F.col("page_id") * 10 + F.col("pos")).alias("ord"))
    s = t("pages").select(F.col("url").alias("link"), F.col("page_id").alias("ord"))
    seen = t("pages").where("page_id % 4 = 0").select(F.col("url").alias("link"))
    return merge.unseen([f, s], "link", "ord", seen).select("link", "stream")


@query("""SELECT * FROM (SELECT p_partkey AS page, 'v' || (p_size % 6)::VARCHAR AS host, row_number() OVER (PARTITION BY p_size % 6 ORDER BY contains(p_name, 'ring') DESC, p_partkey) AS rn FROM part) WHERE rn <= 3""")
def best_of_site(t):
    p = t("part").select(F.col("p_partkey").alias("page"), F.concat(F.lit("v"), (F.col("p_size") % 6).cast("string")).alias("host"), html.path_score(F.col("p_name"), {"ring": 1}).alias("score"))
    return ordering.ranked(p, ["host"], [F.desc("score"), "page"]).where("rn <= 3").select("page", "host", F.col("rn").cast("long").alias("rn"))
