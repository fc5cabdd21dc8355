"""Queries that meet texts with dictionaries, which are tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary, geo
from .base import derived, plain, query, rows, values
from .derived import RECORDS

#: Words of the benchmark's items as a dictionary: the place of a word's first use, the word, and one of 14 regions.
_WORDS_SQL = """words AS (SELECT item_id, i, w[i] AS word FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{4,}') AS w FROM benchmark), unnest(range(1, len(w) + 1)) t(i)),
terms AS (SELECT min(item_id * 1000 + i) AS ord, word AS term, 'r' || (min(item_id * 1000 + i) % 14)::VARCHAR AS value FROM words GROUP BY word)"""


def _words(t):
    w = t("benchmark").select("item_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1))).alias("i", "word"))
    ord_ = F.min(F.col("item_id") * 1000 + F.col("i") + 1)
    return w.groupBy(F.col("word").alias("term")).agg(ord_.alias("ord")).withColumn("value", F.concat(F.lit("r"), F.col("ord") % 14))


@query(f"""WITH {_WORDS_SQL} SELECT doc_id, term, value FROM (SELECT doc_id, term, value, row_number() OVER (PARTITION BY doc_id ORDER BY length(term) DESC, ord) AS rn FROM documents LEFT JOIN terms ON contains(lower(text), term)) WHERE rn = 1""")
def dictionary_terms(t):
    """The longest word of the dictionary that each document holds."""
    best = dictionary.longest_term(F.lower("text"), _words(t))
    return t("documents").select("doc_id", best.alias("b")).select("doc_id", "b.term", "b.value")


_SOURCES = """SELECT doc_id AS id, CASE doc_id % 11 WHEN 0 THEN 'r1' WHEN 1 THEN 'old' ELSE NULL END AS hint, coalesce(source, '') || ' ' || coalesce(text, '') AS hay,
CASE WHEN doc_id % 3 = 0 THEN 'WWW.' ELSE '' END || 's' || CAST(doc_id % 700 AS STRING) || CASE doc_id % 4 WHEN 0 THEN '.co.uk' WHEN 1 THEN '.cn' WHEN 2 THEN '.DE' ELSE '' END AS domain FROM {documents}"""
_HOSTS = "SELECT 's' || CAST(s_suppkey AS STRING) || '.co.uk' AS name, 'h' || CAST(s_nationkey AS STRING) AS region FROM {supplier}"
_TLDS = "SELECT CASE r_regionkey WHEN 0 THEN 'uk' WHEN 1 THEN 'de' WHEN 2 THEN 'cn' WHEN 3 THEN 'fr' ELSE 'org' END AS name, 't' || CAST(r_regionkey AS STRING) AS region FROM {region}"
_KNOWN = "SELECT 'r' || CAST(n_nationkey AS STRING) AS id FROM {nation}"


@query(f"""WITH {_WORDS_SQL}, s AS ({plain(_SOURCES)}), h AS ({plain(_HOSTS)}), t AS ({plain(_TLDS)}), k AS ({plain(_KNOWN)}),
n AS (SELECT id, arg_min(term, -length(term) * 1000000 + ord) AS term, arg_min(value, -length(term) * 1000000 + ord) AS value FROM s JOIN terms ON contains(lower(hay), term) GROUP BY id),
d AS (SELECT s.*, regexp_replace(lower(domain), '^www\\.', '') AS host, nullif(regexp_extract(lower(domain), '\\.([a-z0-9]+)$', 1), '') AS tld FROM s)
SELECT d.id, coalesce(k.id, h.region, n.value, t.region) AS region, CASE WHEN k.id IS NOT NULL THEN 'kept' WHEN h.region IS NOT NULL THEN d.host WHEN n.term IS NOT NULL THEN n.term WHEN t.region IS NOT NULL THEN '.' || d.tld END AS why
FROM d LEFT JOIN k ON k.id = d.hint LEFT JOIN h ON h.name = d.host LEFT JOIN n ON n.id = d.id LEFT JOIN t ON t.name = d.tld AND d.tld <> 'cn'""")
def region_hints(t):
    """The region of each source: its own hint, its domain's, that of the longest name in its text, its domain's ending."""
    found = geo.region_hints(derived(t, _SOURCES), derived(t, _KNOWN), derived(t, _HOSTS), _words(t), derived(t, _TLDS))
    return found.select("id", "region", "why")


_ALIASES = "SELECT n_nationkey AS ord, n_name AS term, 'R' || CAST(n_regionkey AS STRING) AS value FROM {nation}"
_COUNTRIES = """SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'NATION_' || CAST(c_nationkey AS STRING) WHEN 1 THEN ' nation_' || CAST(c_nationkey AS STRING) WHEN 2 THEN '  In Nation_' || CAST(c_nationkey AS STRING) || ' now '
WHEN 3 THEN 'ation_' || CAST(c_nationkey AS STRING) WHEN 4 THEN '  ' WHEN 5 THEN NULL ELSE 'Elsewhere ' || CAST(c_custkey AS STRING) END AS name FROM {customer}"""


@query(f"""WITH n AS (SELECT id, trim(coalesce(name, '')) AS name FROM ({plain(_COUNTRIES)})), a AS ({plain(_ALIASES)})
SELECT id, CASE WHEN name = '' THEN '未知' ELSE coalesce(exact, folded, held, name) END AS country FROM (SELECT id, name, arg_min(value, ord) FILTER (term = name) AS exact, arg_min(value, ord) FILTER (lower(term) = lower(name)) AS folded,
arg_min(value, ord) FILTER (contains(lower(name), lower(term)) OR contains(lower(term), lower(name))) AS held FROM n CROSS JOIN a GROUP BY id, name)""")
def country_normalize(t):
    """Names of countries brought to one spelling by a table of aliases."""
    return derived(t, _COUNTRIES).select("id", dictionary.normal_name(F.col("name"), derived(t, _ALIASES), geo.UNKNOWN).alias("country"))


@query("""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{4,}') AS w FROM benchmark),
d AS (SELECT item_id % 23 AS ord, 'L' || (item_id % 23)::VARCHAR AS label, w[1:3] AS anywhere, '(?:^|[^a-z0-9_])(?:' || w[4] || '[ -]' || w[5] || '|' || w[6] || ')(?:[^a-z0-9_]|$)' AS words FROM w WHERE len(w) >= 6),
h AS (SELECT DISTINCT doc_id, ord, label FROM documents JOIN d ON len(list_filter(anywhere, lambda x: contains(lower(text), x))) > 0 OR regexp_matches(lower(text), words))
SELECT doc_id, coalesce((SELECT string_agg(label, ',' ORDER BY ord) FROM h WHERE h.doc_id = x.doc_id), '') AS labels FROM documents x WHERE text IS NOT NULL""")
def topic_labels(t):
    """All topics of each document, by terms that count anywhere and phrases that count as whole words."""
    w = t("benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1)).alias("w")).where("size(w) >= 6")
    d = w.select((F.col("item_id") % 23).alias("ord"), F.concat(F.lit("L"), F.col("item_id") % 23).alias("label"), F.slice("w", 1, 3).alias("anywhere"), F.array(F.concat(F.get("w", F.lit(3)), F.lit(" "), F.get("w", F.lit(4))), F.get("w", F.lit(5))).alias("words"))
    found = dictionary.labels(F.lower("text"), dictionary.label_terms(d))
    return t("documents").where("text is not null").select("doc_id", F.array_join(found, ",").alias("labels"))


_BUCKETS = [(0, "日本", "asia-east"), (0, "韩国", "asia-east"), (1, "印度尼西亚", "asia-sea"), (2, "印度", "asia-south"), (3, "法国", "europe-west"), (4, "瑞典", "europe-north"), (5, "意大利", "europe-south"), (6, "波兰", "europe-east"), (7, "美国", "namerica"), (8, "巴西", "latam"), (9, "埃及", "africa"), (10, "土耳其", "middle-east"), (11, "澳大利亚", "oceania")]
_SENT = [(0, "Japan", "asia-east"), (0, "Korea", "asia-east"), (3, "France", "europe-west"), (2, "India", "asia-south"), (1, "Indonesia", "asia-sea"), (11, "Australia", "oceania")]
_PLACED = f"""SELECT id, CASE id % 13 WHEN 0 THEN '印度尼西亚' WHEN 1 THEN '印度' WHEN 2 THEN '台湾' WHEN 3 THEN '波兰共和国' ELSE country_zh END AS country_zh, city_zh, CASE WHEN id % 4 = 0 THEN 'news' ELSE category END AS category,
'Daily ' || CASE id % 3 WHEN 0 THEN 'Paris Post' WHEN 1 THEN 'Tokyo Times' ELSE 'None' END AS source, CASE id % 7 WHEN 0 THEN '中国' WHEN 1 THEN 'South Korea' WHEN 2 THEN 'france' WHEN 3 THEN 'Nowhere' WHEN 4 THEN 'Indonesia' WHEN 5 THEN '日本' ELSE NULL END AS ip_country,
CASE id % 2 WHEN 0 THEN '香港' ELSE '浙江' END AS ip_province, CASE id % 5 WHEN 0 THEN 'Paris' ELSE '宁波' END AS ip_city FROM ({RECORDS})"""


@query(f"""WITH p AS ({plain(_PLACED)}), n AS (SELECT * FROM {values(_BUCKETS)} v(ord, term, value)), s AS (SELECT * FROM {values(_SENT)} v(ord, term, value)),
a AS (SELECT id, arg_min(value, ord) AS own FROM p JOIN n ON contains(country_zh, term) GROUP BY id), b AS (SELECT id, arg_min(value, ord) AS sent FROM p JOIN s ON contains(lower(ip_country), lower(term)) GROUP BY id)
SELECT p.id, coalesce(CASE WHEN regexp_matches(coalesce(country_zh, ''), '香港|澳门|台湾|台北|高雄') OR regexp_matches(coalesce(city_zh, ''), '香港|澳门|台北|高雄|台中|台南') THEN 'hktw' WHEN country_zh = '中国' THEN 'cn' ELSE own END,
CASE WHEN coalesce(country_zh, '') = '' THEN CASE WHEN ip_country = '中国' THEN CASE WHEN regexp_matches(ip_province, '香港|澳门|台湾') THEN 'hktw' ELSE 'cn' END ELSE sent END END, 'other') AS bucket FROM p LEFT JOIN a USING (id) LEFT JOIN b USING (id)""")
def region_buckets_by_name(t):
    """The region of each record among 14, by its country, else by the address it was sent from."""
    p, kind = derived(t, _PLACED), "ord long, term string, value string"
    b = geo.region_bucket(F.col("country_zh"), F.col("city_zh"), F.col("ip_country"), F.col("ip_province"), rows(t, _BUCKETS, kind), rows(t, _SENT, kind))
    return p.select("id", b.alias("bucket"))


_CITIES = [("台北", 121.5, 25.0), ("Paris", 2.35, 48.85), ("香港", 114.1, 22.3), ("Tokyo", 139.7, 35.7), ("杭州", 120.1, 30.2)]
_LANDS = [("中国", 104.0, 35.0), ("法国", 2.0, 46.0), ("日本", 138.0, 36.0), ("美国", -98.0, 39.0)]
_SEATS = [(0, "Post", "台北"), (1, "Paris", "Paris"), (2, "Tokyo", "Tokyo")]
_CAPITALS = [("浙江", "杭州"), ("香港", "香港")]


@query(f"""WITH p AS ({plain(_PLACED)}), c AS (SELECT * FROM {values(_CITIES)} v(name, lng, lat)), l AS (SELECT * FROM {values(_LANDS)} v(name, lng, lat)), k AS (SELECT * FROM {values(_SEATS)} v(ord, term, value)), m AS (SELECT * FROM {values(_CAPITALS)} v(province, city)),
q AS (SELECT p.*, CASE WHEN category = 'news' THEN (SELECT arg_min(value, ord) FROM k WHERE contains(p.source, term)) END AS seat, m.city AS capital FROM p LEFT JOIN m ON m.province = ip_province)
SELECT q.id, CASE WHEN a.name IS NOT NULL THEN '城市' WHEN b.name IS NOT NULL THEN '国家' WHEN d.name IS NOT NULL THEN '信源地' WHEN coalesce(e.name, f.name, g.name) IS NOT NULL THEN 'IP属地' END AS "precision",
coalesce(a.lng, b.lng, d.lng, e.lng, f.lng, g.lng)::DOUBLE AS lng, coalesce(a.lat, b.lat, d.lat, e.lat, f.lat, g.lat)::DOUBLE AS lat
FROM q LEFT JOIN c a ON a.name = city_zh LEFT JOIN l b ON b.name = country_zh LEFT JOIN c d ON d.name = seat LEFT JOIN c e ON ip_country = '中国' AND e.name = ip_city LEFT JOIN c f ON ip_country = '中国' AND f.name = capital LEFT JOIN l g ON g.name = ip_country""")
def map_points(t):
    """Where each record stands on the map, and how precisely that is known."""
    spot = "name string, lng double, lat double"
    found = geo.located(derived(t, _PLACED), rows(t, _CITIES, spot), rows(t, _LANDS, spot), rows(t, _SEATS, "ord long, term string, value string"), rows(t, _CAPITALS, "province string, city string"))
    return found.select("id", "precision", "lng", "lat")
