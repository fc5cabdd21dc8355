"""Queries over texts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import catalog, crawl, evidence, geo, ordering, social
from ..sources import html
from .base import derived, plain, query, rows, values

_WS = r"'[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+'"


def _n(x: str) -> str:
    return f"trim(regexp_replace({x}, {_WS}, ' ', 'g'))"


_PAIRS = f"""SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d
ON length({_n("b.text")}) > 0 AND contains({_n("d.text")}, {_n("b.text")})"""


@query(_PAIRS)
def evidence_in_source(t):
    return evidence.evidence_pairs(t("benchmark"), t("documents"))


@query(f"""WITH d AS (SELECT *, md5({_n("text")}) AS fp FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY n_chars DESC, doc_id) AS r FROM d),
e AS (SELECT DISTINCT doc_id FROM ({_PAIRS})),
g AS (SELECT k.lang, CASE WHEN e.doc_id IS NOT NULL THEN 'evidence' WHEN l.quality = 1 AND l.toxic = 0 THEN 'trusted' WHEN l.quality IS NULL THEN 'unchecked' ELSE 'pending' END AS grade
FROM k LEFT JOIN labels l USING (doc_id) LEFT JOIN e USING (doc_id) WHERE r = 1)
SELECT lang, grade, count(*) AS n FROM g GROUP BY ALL""")
def evidence_grade_rollup(t):
    d = t("documents").withColumn("fp", F.md5(text.squeeze(F.col("text"))))
    best = ordering.keep_best(d.select("doc_id", "lang", "n_chars", "fp"), "fp", "n_chars", "doc_id")
    held = evidence.evidence_pairs(t("benchmark"), t("documents")).select("doc_id").distinct().withColumn("held", F.lit(True))
    g = best.join(t("labels"), "doc_id", "left").join(held, "doc_id", "left")
    grade = F.when(F.col("held"), "evidence").when((F.col("quality") == 1) & (F.col("toxic") == 0), "trusted").when(F.col("quality").isNull(), "unchecked").otherwise("pending")
    return g.withColumn("grade", grade).groupBy("lang", "grade").agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, fp, score, "at" FROM (SELECT doc_id, fp, n_chars AS score, min(doc_id) OVER (PARTITION BY fp) AS "at",
row_number() OVER (PARTITION BY fp ORDER BY n_chars DESC, doc_id) AS r FROM (SELECT *, md5({_n("text")}) AS fp FROM documents)) WHERE r = 1""")
def fingerprint_keep_best(t):
    d = t("documents").select("doc_id", F.md5(text.squeeze(F.col("text"))).alias("fp"), F.col("n_chars").alias("score"))
    return ordering.keep_best(d, "fp", "score", "doc_id").select("doc_id", "fp", "score", "at")


@query(f"""SELECT fp, doc_id, size, keep FROM (SELECT doc_id, md5({_n("text")}) AS fp, count(*) OVER (PARTITION BY md5({_n("text")})) AS size, min(doc_id) OVER (PARTITION BY md5({_n("text")})) AS keep FROM documents) WHERE size > 1""")
def duplicate_clusters(t):
    d = t("documents").select("doc_id", F.md5(text.squeeze(F.col("text"))).alias("fp"))
    return ordering.clusters(d, "fp", "doc_id").select("fp", "doc_id", "size", "keep")


@query("""SELECT doc_id, source, h, n AS rows, s AS sources FROM (SELECT doc_id, source, md5(text) AS h FROM documents) JOIN
(SELECT md5(text) AS h, count(*) AS n, count(DISTINCT source) AS s FROM documents GROUP BY 1 HAVING count(*) > 1) USING (h)""")
def shared_value_audit(t):
    return ordering.shared(t("documents").select("doc_id", "source", F.md5("text").alias("h")), "h", "source")


_RAW = [(-1, "<p>a &#128512;&#x1F600; &LDQUO;b&rdquo; &copy;</p>"), (-2, "one<BR/>two</li>\n \n\n<br>three&#0065;&#x26;#65;&#xD800;&#99999999;"), (-3, "<svg><p>no</p></SVG >x</svg><!-- c -->\u3000&amp;lt;&nbsp;y"), (-4, ""), (-5, None)]


def _numeric_sql(x: str, pattern: str, value: str) -> str:
    """The numeric references of a text decoded in DuckDB: pieces, each a reference or not."""
    digits = f"ltrim(regexp_replace(regexp_extract(p, '^&#({pattern});$', 1), '^[xX]', ''), '0')"
    code = value.format(d=digits)
    return f"""array_to_string(list_transform(regexp_extract_all({x}, '(?s)(?:&#{pattern};|&|[^&]+)'), lambda p: CASE WHEN NOT regexp_matches(p, '^&#{pattern};$') THEN p
WHEN length({digits}) BETWEEN 1 AND 7 AND ({code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111) THEN chr(({code})::INTEGER) ELSE '' END), '')"""


_HEX = "list_reduce(list_transform(string_split(lower({d}), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT), lambda a, b: a * 16 + b)"
_NAMED = "x"
for _name, _char in list(text.ENTITIES.items()):
    _NAMED = f"regexp_replace({_NAMED}, '(?i)&{_name};', '" + _char.replace("'", "''") + "', 'g')"
_SP = r"[\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


@query(rf"""WITH p AS (SELECT page_id, html FROM pages UNION ALL SELECT * FROM {values(_RAW)} v(page_id, html)),
a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g') AS x FROM p),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?is)<noscript.*?</noscript>', ' ', 'g'), '(?is)<svg.*?</svg>', ' ', 'g') AS x FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)</(?:p|div|li|tr|h[1-6]|br|section|article)>|<br\s*/?>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g') AS x FROM b),
h AS (SELECT page_id, CASE WHEN contains(x, '&#') THEN {_numeric_sql("x", "[xX][0-9a-fA-F]+", _HEX)} ELSE x END AS x FROM c),
n AS (SELECT page_id, CASE WHEN contains(x, '&#') THEN {_numeric_sql("x", "[0-9]+", "({d})::BIGINT")} ELSE x END AS x FROM h),
d AS (SELECT page_id, {_NAMED} AS x FROM n)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[ \t\x{{00A0}}]+', ' ', 'g'), '\n{_SP}*\n{_SP}*\n+', chr(10) || chr(10), 'g'), '[ \t]*\n[ \t]*', chr(10), 'g'), '^{_SP}+|{_SP}+$', '', 'g') AS t FROM d""")
def html_to_text(t):
    p = t("pages").select("page_id", "html").unionByName(rows(t, _RAW, "page_id long, html string"))
    return p.select("page_id", text.html_to_text(F.col("html")).alias("t"))


_A = r"""SELECT page_id, pos - 1 AS pos, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>"'']+)[^>]*>.*?</a>')[pos] AS a
FROM (SELECT page_id, html, unnest(range(1, len(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>"'']+)[^>]*>.*?</a>')) + 1)) AS pos FROM pages)"""
_H = r"""coalesce(nullif(trim(regexp_extract(a, '(?is)^<a\s[^>]*?href\s*=\s*"([^"]*)"', 1)), ''), nullif(trim(regexp_extract(a, '(?is)^<a\s[^>]*?href\s*=\s*''([^'']*)''', 1)), ''), nullif(regexp_extract(a, '(?is)^<a\s[^>]*?href\s*=\s*([^\s>"'']+)', 1), ''))"""


@query(rf"""SELECT page_id, pos::BIGINT AS pos, {_H} AS href, {_n("regexp_replace(regexp_extract(a, '(?is)^<a[^>]*>(.*)</a>$', 1), '(?s)<[^>]+>', ' ', 'g')")} AS label FROM ({_A}) WHERE {_H} IS NOT NULL""")
def anchors(t):
    return html.anchors(t("pages"), "page_id").select("page_id", F.col("pos").cast("long").alias("pos"), "href", F.col("text").alias("label"))


_HOST = r"nullif(regexp_replace(regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', ''), '')"
_PATH = "CASE WHEN starts_with(regexp_replace(regexp_replace({u}, '#.*$', ''), '^https?://[^/?#]*', ''), '/') THEN regexp_replace(regexp_replace({u}, '#.*$', ''), '^https?://[^/?#]*', '') ELSE '/' || regexp_replace(regexp_replace({u}, '#.*$', ''), '^https?://[^/?#]*', '') END"


_LINKED = [
    (-1, "https://www.a.example.org/list/index.html", '<a href="/2026/05/x.html">one</a> <a href="view.aspx?NewsID=12">two</a> <a href="https://sub.a.example.org/art/77#top">three</a> <a href="/art/77">four</a> <a href="https://b.org/art/1">five</a>'),
    (-2, "https://a.example.org/", '<a href="/more/open-calls/summer">more</a> <a href="/open-call/summer-show">Open call for artists</a> <a href="mailto:x@y.z">Open call for artists</a> <a href="/plain/page">征集作品公告第一号二</a> <a href="#a">x</a> <a href="/t20260324_1">更多列表</a>'),
]


@query(rf"""WITH p AS (SELECT page_id, url, html FROM pages UNION ALL SELECT * FROM {values(_LINKED)} v(page_id, url, html)),
l AS (SELECT page_id, pos, {_H} AS href, {_n("regexp_replace(regexp_extract(a, '(?is)^<a[^>]*>(.*)</a>$', 1), '(?s)<[^>]+>', ' ', 'g')")} AS label FROM ({_A.replace('FROM pages', 'FROM p')}) WHERE {_H} IS NOT NULL),
r AS (SELECT page_id, pos, label, url AS base, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^(https?:)', 1) || href
 WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href WHEN starts_with(href, '?') THEN regexp_replace(url, '[?#].*$', '') || href
 ELSE regexp_replace(regexp_replace(url, '[?#].*$', '', 'g'), '(^https?://[^/]+)$|/[^/]*$', '\1/', 'g') || href END AS u FROM l JOIN p USING (page_id)
 WHERE NOT regexp_matches(href, '(?i)^(?:javascript:|mailto:|tel:|#)') AND NOT (regexp_matches(label, '{html.NAV_NOISE}') AND length(label) < 8)),
s AS (SELECT *, {_HOST.replace("url", "u")} AS host, {_HOST.replace("url", "base")} AS bhost, {_PATH.format(u="u")} AS path FROM r),
k AS (SELECT page_id, regexp_replace(u, '#.*$', '') AS u, pos, label FROM s WHERE (host = bhost OR ends_with(host, '.' || bhost)) AND u <> base
 AND (regexp_matches(path, '{html.DETAIL}') OR (length(label) >= 8 AND regexp_matches(label, '{html.CALL_TITLE}') AND regexp_matches(regexp_extract(path, '^([^?]*)', 1), '/[^/]'))))
SELECT page_id, u, min(pos)::BIGINT AS pos, arg_min(label, pos) AS label FROM k GROUP BY page_id, u""")
def detail_links(t):
    p = t("pages").select("page_id", "url", "html").unionByName(rows(t, _LINKED, "page_id long, url string, html string"))
    return html.detail_links(p, "page_id").select("page_id", "u", "pos", F.col("text").alias("label"))


_CLASSES = [("example.com", "trusted"), ("example.net", "third_party"), ("blog.example.org", "third_party")]


@query(f"""SELECT p.page_id, p.host, c.domain, c.class FROM (SELECT page_id, {_HOST} AS host FROM pages) p
LEFT JOIN {values(_CLASSES)} c(domain, class) ON p.host = c.domain OR ends_with(p.host, '.' || c.domain)""")
def host_suffix_join(t):
    p = t("pages").select("page_id", urls.host_of(F.col("url")).alias("host"))
    c = rows(t, _CLASSES, "domain string, class string")
    hit = p.select("page_id", F.explode(urls.suffixes(F.col("host"))).alias("domain")).join(F.broadcast(c), "domain")  # a fixed list
    return p.join(hit, "page_id", "left").select("page_id", "host", "domain", "class")


_EXTRA = [(1, "HTTP://Example.COM/a/?utm_source=x&b=2&a=1#top"), (2, "https://example.org/?spm=1"), (3, "https://a.b/c/"), (4, "https://a.b/x?ref=1&z&y=3")]
_NORM = r"""WITH q AS (SELECT id, url, regexp_replace(url, '#.*$', '') AS bare FROM u),
s AS (SELECT id, regexp_extract(bare, '^([^?]*)', 1) AS head, regexp_extract(bare, '\?(.*)$', 1) AS query, regexp_extract(regexp_extract(bare, '^([^?]*)', 1), '^(https?://[^/]*)', 1) AS origin FROM q),
k AS (SELECT id, origin, regexp_replace(head[length(origin)+1:], '/+$', '') AS path, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[^=]*|fbclid|gclid|spm|ref)(?:=|$)'))) AS kept FROM s)
SELECT id, lower(origin) || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS normal FROM k"""


@query(f"WITH u AS (SELECT page_id AS id, url FROM pages UNION ALL SELECT -id, url FROM {values(_EXTRA)} v(id, url)) {_NORM.replace('WITH q', ', q', 1)}")
def url_normalize(t):
    u = t("pages").select(F.col("page_id").alias("id"), "url").unionByName(rows(t, _EXTRA, "id long, url string").withColumn("id", -F.col("id")))
    return u.select("id", urls.normal_url(F.col("url")).alias("normal"))


_DATED = """SELECT page_id AS id, coalesce(url, '') || CASE page_id % 6 WHEN 0 THEN '/20' || CAST(20 + page_id % 9 AS STRING) || lpad(CAST(page_id % 14 AS STRING), 2, '0') || lpad(CAST(page_id % 33 AS STRING), 2, '0') || '/x'
WHEN 1 THEN '/20' || CAST(20 + page_id % 9 AS STRING) || '/' || CAST(page_id % 14 AS STRING) || '/' || CAST(page_id % 33 AS STRING) WHEN 2 THEN '/20' || CAST(20 + page_id % 9 AS STRING) || '-' || lpad(CAST(page_id % 14 AS STRING), 2, '0') || '-' || CAST(page_id % 33 AS STRING) || 'y'
WHEN 3 THEN '/20' || CAST(20 + page_id % 9 AS STRING) || '-' || CAST(page_id % 14 AS STRING) || '/' || lpad(CAST(page_id % 33 AS STRING), 2, '0') || '?q' ELSE '/x' END AS url FROM {pages}"""


@query(f"""WITH v AS ({plain(_DATED)}),
p AS (SELECT id, regexp_extract(url, '/(20[0-9][0-9])([01][0-9])([0-3][0-9])(?:[^0-9]|$)', 0) AS a, regexp_extract(url, '/(20[0-9][0-9])[/-]([0-9]{{1,2}})[/-]([0-9]{{1,2}})(?:[^0-9]|$)', 1) AS y,
regexp_extract(url, '/(20[0-9][0-9])[/-]([0-9]{{1,2}})[/-]([0-9]{{1,2}})(?:[^0-9]|$)', 2) AS m, regexp_extract(url, '/(20[0-9][0-9])[/-]([0-9]{{1,2}})[/-]([0-9]{{1,2}})(?:[^0-9]|$)', 3) AS d FROM v),
x AS (SELECT id, TRY_CAST(CASE WHEN a <> '' THEN a[2:5] || '-' || a[6:7] || '-' || a[8:9] WHEN y <> '' THEN y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') END AS DATE) AS day FROM p)
SELECT id, strftime(CASE WHEN day <= DATE '2026-08-11' THEN day END, '%Y-%m-%d') AS day FROM x""")
def url_date(t):
    return derived(t, _DATED).select("id", F.date_format(urls.url_date(F.col("url"), "2026-08-11"), "yyyy-MM-dd").alias("day"))


_SCORES = {"/en/": 3, "example.com": 2, "7": 1}


@query(f"""SELECT page_id, host, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id) AS rn FROM
(SELECT page_id, {_HOST} AS host, ({" + ".join(f"CASE WHEN contains(lower(url), '{w}') THEN {n} ELSE 0 END" for w, n in _SCORES.items())})::INTEGER AS score FROM pages)) WHERE rn <= 3""")
def sitemap_score_topk(t):
    p = t("pages").select("page_id", urls.host_of(F.col("url")).alias("host"), html.path_score(F.col("url"), _SCORES).alias("score"))
    return ordering.ranked(p, ["host"], [F.desc("score"), "page_id"]).where("rn <= 3")


@query("""SELECT o_orderkey, o_custkey, trusted FROM (SELECT *, date_diff('day', max(o_orderdate::DATE) OVER (PARTITION BY o_custkey), DATE '2001-12-31') <= 90 AS trusted FROM orders)
WHERE NOT trusted OR o_orderdate::DATE >= DATE '2001-06-01'""")
def lastmod_trust(t):
    o = t("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return crawl.trusted_lastmod(o, "o_custkey", "day", "2001-12-31", "2001-06-01").select("o_orderkey", "o_custkey", "trusted")


#: A robots file for each supplier: rules before any agent, fields between agents, names that ours holds, comments.
_ROBOTS = """SELECT s_suppkey AS site, CASE WHEN s_suppkey % 4 = 0 THEN 'Disallow: /de' || chr(10) ELSE '' END || CASE WHEN s_suppkey % 3 = 0 THEN 'User-agent: otherbot' || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN 'Crawl-delay: 5' || chr(10) ELSE '' END ELSE '' END
|| 'User-Agent: ' || CASE s_suppkey % 5 WHEN 0 THEN 'Kit' WHEN 1 THEN '*' WHEN 2 THEN 'KITBOT # ours' WHEN 3 THEN 'kitbot2' ELSE 'bot' END || chr(13) || chr(10) || 'Disallow: /fr' || chr(10) || 'Allow: /*/' || CAST(s_suppkey % 10 AS STRING) || chr(10) || 'Disallow: /en/*9$' || chr(10)
|| 'Sitemap: https://x.org/s.xml' || chr(10) || 'no field' || chr(10) || 'user-agent: *' || chr(10) || 'Disallow:' || chr(10) || 'Disallow: /' || CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'es' END AS body FROM {supplier}"""
_SITE_OF = "page_id % 110"


@query(rf"""WITH l AS (SELECT site, i, trim(regexp_replace(x, '#.*$', ''), chr(13) || ' ') AS x FROM (SELECT site, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM (SELECT site, string_split(body, chr(10)) AS l FROM ({plain(_ROBOTS)})))),
f AS (SELECT site, i, lower(trim(substr(x, 1, strpos(x, ':') - 1))) AS field, trim(substr(x, strpos(x, ':') + 1)) AS value FROM l WHERE contains(x, ':')),
g AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY site ORDER BY i) AS grp FROM (SELECT *, field = 'user-agent' AND lag(field) OVER (PARTITION BY site ORDER BY i) IS DISTINCT FROM 'user-agent' AS starts FROM f)),
c AS (SELECT site, coalesce(min(grp) FILTER (field = 'user-agent' AND lower(value) <> '*' AND contains('kitbot', lower(value))), min(grp) FILTER (field = 'user-agent' AND value = '*' OR grp = 0 AND field IN ('allow', 'disallow'))) AS grp FROM g GROUP BY site),
r AS (SELECT site, field = 'allow' AS allow, '^' || replace(regexp_replace(value, '([.+?^(){{}}\[\]|\\])', '\\\1', 'g'), '*', '.*') AS pattern, length(replace(value, '*', '')) AS n FROM g JOIN c USING (site, grp) WHERE field IN ('allow', 'disallow') AND value <> ''),
p AS (SELECT page_id, {_SITE_OF} AS site, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT p.page_id, p.path, d IS NULL OR coalesce(a, -1) >= d AS allowed FROM (SELECT p.page_id, p.path, max(n) FILTER (allow AND regexp_matches(path, pattern)) AS a, max(n) FILTER (NOT allow AND regexp_matches(path, pattern)) AS d FROM p LEFT JOIN r USING (site) GROUP BY p.page_id, p.path) p""")
def robots_allow(t):
    rules = crawl.parse_robots(derived(t, _ROBOTS), "KitBot")
    p = t("pages").select("page_id", F.expr(_SITE_OF).alias("site"), F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1).alias("path"))
    return crawl.robots_allowed(p, rules).select("page_id", "path", "allowed")


_TAGS = [("stats", ["tion"], ["the"]), ("law", ["licen"], ["mit", "gnu"]), ("water", ["aqua"], ["eau", "eaux"]), ("self", ["ich"], ["ich", "yo"])]
_TAG_SQL = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'''contains(lower(text), '{a}')''' for a in x)} OR regexp_matches(lower(text), '(?:^|[^a-z0-9_])(?:{'|'.join(w)})(?:[^a-z0-9_]|$)') THEN '{n}' END" for n, x, w in _TAGS) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({_TAG_SQL}, ',') AS tags FROM documents")
def tags_multilabel(t):
    return t("documents").select("doc_id", F.array_join(catalog.tags(F.col("text"), _TAGS), ",").alias("tags"))


@query(f"SELECT tag, count(*) AS n FROM (SELECT unnest({_TAG_SQL}) AS tag FROM documents) GROUP BY tag")
def tag_counts(t):
    return catalog.tag_counts(t("documents").select(catalog.tags(F.col("text"), _TAGS).alias("tags")), "tags")


_TERMS = ["thing", "Heit", "ción", "auxê"]


@query(f"SELECT doc_id, lang FROM documents WHERE {' OR '.join(f'''contains(lower(text || source), lower('{w}'))''' for w in _TERMS)}")
def location_relevance(t):
    hay = F.lower(F.concat(F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))))
    return t("documents").where(F.exists(F.array(*map(F.lit, _TERMS)), lambda w: F.contains(hay, F.lower(w)))).select("doc_id", "lang")


_NAMES = ["the", "thea", "heit", "keit", "ción", "eau", "aux"]


@query(f"""SELECT doc_id, name FROM (SELECT doc_id, n.name, row_number() OVER (PARTITION BY doc_id ORDER BY length(n.name) DESC, n.ord) AS rn
FROM documents LEFT JOIN {values([(i, n) for i, n in enumerate(_NAMES)])} n(ord, name) ON contains(text, n.name)) WHERE rn = 1""")
def dictionary_longest_match(t):
    return t("documents").select("doc_id", geo.longest_match(F.col("text"), _NAMES).alias("name"))


@query("""SELECT doc_id, source, CASE WHEN regexp_matches(lower(source), '[13579]$') THEN 'odd' WHEN lang IN ('fr', 'es') THEN 'south' WHEN lang = 'de' THEN 'middle' ELSE 'north' END AS bucket FROM documents""")
def region_buckets(t):
    b = evidence.waterfall([("odd", F.lower("source").rlike("[13579]$")), ("south", F.col("lang").isin("fr", "es")), ("middle", F.col("lang") == "de"), ("north", F.lit(True))])
    return t("documents").select("doc_id", "source", b.alias("bucket"))


@query("""SELECT doc_id, CASE WHEN len(r) = 0 THEN 'auto' ELSE 'pending' END AS trust, array_to_string(r, ',') AS reasons FROM (
SELECT doc_id, list_filter([CASE WHEN NOT coalesce(source <> 'src0', false) THEN 'source' END, CASE WHEN NOT coalesce(n_chars >= 200, false) THEN 'text' END,
CASE WHEN NOT coalesce(quality = 1, false) THEN 'quality' END, CASE WHEN NOT coalesce(toxic = 0, false) THEN 'toxic' END], lambda x: x IS NOT NULL) AS r FROM documents LEFT JOIN labels USING (doc_id))""")
def trust_grade(t):
    d = t("documents").join(t("labels"), "doc_id", "left")
    r = evidence.reasons([("source", F.col("source") != "src0"), ("text", F.col("n_chars") >= 200), ("quality", F.col("quality") == 1), ("toxic", F.col("toxic") == 0)])
    return d.withColumn("r", r).select("doc_id", F.when(F.size("r") == 0, "auto").otherwise("pending").alias("trust"), F.array_join("r", ",").alias("reasons"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'scum') THEN 'reject' WHEN contains(lower(text), 'clown') OR contains(lower(text), 'trash') THEN 'review' ELSE 'pass' END AS verdict FROM documents""")
def moderation_verdict(t):
    return t("documents").select("doc_id", evidence.moderation(F.col("text"), ["idiot", "scum"], ["clown", "trash"]).alias("verdict"))


@query(f"""WITH e AS (SELECT DISTINCT doc_id FROM ({_PAIRS}))
SELECT doc_id, CASE WHEN toxic = 1 THEN 'not-applicable' WHEN n_chars < 200 THEN 'thin' WHEN NOT regexp_matches(lower(text), 'tion|heit|ment|ción') THEN 'no-signal' WHEN e.doc_id IS NOT NULL THEN 'leak' WHEN quality = 0 THEN 'quality' END AS drop_reason
FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN e USING (doc_id)""")
def verify_waterfall(t):
    held = evidence.evidence_pairs(t("benchmark"), t("documents")).select("doc_id").distinct().withColumn("held", F.lit(True))
    d = t("documents").join(t("labels"), "doc_id", "left").join(held, "doc_id", "left")
    steps = [("not-applicable", F.col("toxic") == 1), ("thin", F.col("n_chars") < 200), ("no-signal", ~F.lower("text").rlike("tion|heit|ment|ción")), ("leak", F.col("held")), ("quality", F.col("quality") == 0)]
    return d.select("doc_id", evidence.waterfall(steps).alias("drop_reason"))


@query("""SELECT c.conv_id, c.turn, coalesce(p.parent, c.parent) AS parent FROM (SELECT conv_id, turn, CASE WHEN turn > 0 THEN turn // 2 END AS parent FROM conversations) c
LEFT JOIN (SELECT conv_id, turn, CASE WHEN turn > 0 THEN turn // 2 END AS parent FROM conversations) p ON p.conv_id = c.conv_id AND p.turn = c.parent""")
def thread_flatten(t):
    name = lambda x: F.concat_ws(":", "conv_id", x)
    c = t("conversations").withColumn("up", F.when(F.col("turn") > 0, F.floor(F.col("turn") / 2)))
    c = c.select("conv_id", "turn", name(F.col("turn")).alias("id"), F.when(F.col("up").isNotNull(), name(F.col("up"))).alias("parent"))
    return social.flatten_threads(c).select("conv_id", "turn", F.substring_index("parent", ":", -1).cast("long").alias("parent"))


@query(f"""SELECT doc_id, source, md5(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug_md5, n_chars FROM documents WHERE lang = 'en' AND contains(lower(text || ' ' || source), 'that')""")
def keyword_search(t):
    d = catalog.CatalogQuery(any={"lang": ["en"]}, keyword="that", searched=["text", "source"], id="doc_id").apply(t("documents"))
    return d.select("doc_id", "source", F.md5(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", "-"), "^-+|-+$", "")).alias("slug_md5"), "n_chars")


_NEW = "SELECT c_custkey AS id, c_name || CASE WHEN c_custkey % 3 = 0 THEN ' new' ELSE '' END AS src, CASE c_custkey % 4 WHEN 0 THEN 'T ' || c_mktsegment WHEN 1 THEN '' ELSE NULL END AS tr FROM {customer}"
_OLD = "SELECT c_custkey AS id, c_name AS src, 'old ' || c_mktsegment AS tr FROM {customer} WHERE c_nationkey <> 7"


@query(f"""SELECT n.id, n.src, coalesce(nullif(n.tr, ''), CASE WHEN n.src = o.src THEN o.tr END) AS tr FROM ({plain(_NEW)}) n LEFT JOIN ({plain(_OLD)}) o USING (id)""")
def translation_carry(t):
    n, o = derived(t, _NEW), derived(t, _OLD).select("id", F.col("src").alias("osrc"), F.col("tr").alias("otr"))
    return n.join(o, "id", "left").select("id", "src", F.coalesce(text.present(F.col("tr")), F.when(F.col("src") == F.col("osrc"), F.col("otr"))).alias("tr"))
