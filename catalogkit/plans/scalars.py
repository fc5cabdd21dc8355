"""Queries over single values: names, hashes, places, markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text, urls
from ..operators import geo
from .base import derived, plain, query
from .derived import EXTRACTS, RECORDS

_REC = f"rec AS ({plain(RECORDS)})"


@query(f"""WITH {_REC}, s AS (SELECT id, regexp_replace(regexp_replace(lower(coalesce(title_zh, '')), '[^a-z0-9一-龥]+', '-', 'g'), '^-+|-+$', '', 'g') AS s, title_zh FROM rec)
SELECT id, coalesce(nullif(substr(s, 1, 40), ''), 'item') AS slug, sha1(title_zh) AS sha FROM s""")
def slugs(t):
    return derived(t, RECORDS).select("id", text.slug(F.col("title_zh")).alias("slug"), F.sha1("title_zh").alias("sha"))


_B36 = "0123456789abcdefghijklmnopqrstuvwxyz"


@query(f"""WITH RECURSIVE h AS (SELECT p_partkey AS id, p_name, list_reduce(list_transform(string_split(substr(sha1(p_name), 1, 10), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT), lambda a, b: a * 16 + b) AS n FROM part),
d(id, n, s) AS (SELECT id, n, '' FROM h UNION ALL SELECT id, n // 36, substr('{_B36}', (n % 36)::INTEGER + 1, 1) || s FROM d WHERE n > 0),
k AS (SELECT id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: unicode(c)::BIGINT)), lambda a, b: (a * 31 + b) % 4294967296) AS times31,
 list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(p_name, ''), lambda c: unicode(c)::BIGINT)), lambda a, b: xor((a * 33) % 4294967296, b)) AS djb2 FROM h)
SELECT d.id, substr(s, 1, 6) AS short, times31, djb2 FROM d JOIN k USING (id) WHERE n = 0""")
def short_hashes(t):
    x = F.col("p_name")
    return t("part").select(F.col("p_partkey").alias("id"), hashing.short_id(x).alias("short"), hashing.times31(x).alias("times31"), hashing.djb2(x).alias("djb2"))


@query("""SELECT c_custkey AS id, substr((13000000000 + c_custkey * 7919)::VARCHAR, 1, 3) || '****' || substr((13000000000 + c_custkey * 7919)::VARCHAR, 8) AS phone,
greatest(0, ceil(30 - (c_custkey % 400) / 10.0))::INTEGER AS days_left FROM customer""")
def masks_and_days(t):
    phone = (F.lit(13000000000) + F.col("c_custkey") * 7919).cast("string")
    return t("customer").select(F.col("c_custkey").alias("id"), text.mask_phone(phone).alias("phone"), F.greatest(F.lit(0), F.ceil(30 - (F.col("c_custkey") % 400) / 10.0)).cast("int").alias("days_left"))


_ORGS = [("museum|gallery|house", "museum"), ("university|academy", "school"), ("shed|house", "space")]


@query(f"""WITH e AS ({plain(EXTRACTS)}) SELECT id, CASE WHEN regexp_matches(lower(org), 'museum|gallery|house') THEN 'museum' WHEN regexp_matches(lower(org), 'university|academy') THEN 'school' WHEN regexp_matches(lower(org), 'shed|house') THEN 'space' ELSE 'none' END AS kind,
CASE WHEN ends_with(domain, '0.example.com') THEN 'DE' WHEN ends_with(domain, '.example.com') THEN 'US' END AS by_domain FROM e""")
def first_rules(t):
    e = derived(t, EXTRACTS)
    kind = geo.first_match(F.lower("org"), [(words.split("|"), name) for words, name in _ORGS], "none")
    by_domain = F.when(F.endswith("domain", F.lit("0.example.com")), "DE").when(F.endswith("domain", F.lit(".example.com")), "US")
    return e.select("id", kind.alias("kind"), by_domain.alias("by_domain"))


_CITIES = [("the", "A"), ("Paris", "F"), ("heit", "D")]


@query("""WITH p AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'Paris' WHEN doc_id % 4 = 1 THEN ' ' WHEN doc_id % 4 = 2 THEN '未知' END AS city, CASE WHEN doc_id % 3 = 0 THEN 'F' WHEN doc_id % 3 = 1 THEN '' END AS country, coalesce(text, '') AS text, source || CASE WHEN doc_id % 5 = 0 THEN '.fr' ELSE '.org' END AS domain FROM documents),
m AS (SELECT *, trim(coalesce(city, '')) IN ('', '未知') AS no_city, trim(coalesce(country, '')) IN ('', '未知') AS no_country, CASE WHEN contains(text, 'Paris') THEN 'Paris' WHEN contains(text, 'heit') THEN 'heit' WHEN contains(text, 'the') THEN 'the' END AS named, CASE WHEN ends_with(domain, '.fr') THEN 'F' END AS tld FROM p),
b AS (SELECT *, CASE WHEN NOT no_city AND NOT no_country THEN 'given' WHEN no_city AND named IS NOT NULL THEN 'text' WHEN no_country AND tld IS NOT NULL THEN 'domain' WHEN no_city AND NOT no_country AND country = 'F' THEN 'main_city' ELSE 'unknown' END AS by FROM m),
f AS (SELECT *, CASE WHEN by = 'text' THEN named WHEN by = 'domain' AND no_city THEN CASE tld WHEN 'F' THEN 'Paris' END WHEN by = 'main_city' THEN 'Paris' ELSE city END AS c1,
 CASE WHEN NOT no_country THEN country WHEN by = 'text' THEN CASE named WHEN 'the' THEN 'A' WHEN 'Paris' THEN 'F' ELSE 'D' END WHEN by = 'domain' THEN tld END AS c2 FROM b)
SELECT id, by AS how, CASE WHEN trim(coalesce(c1, '')) IN ('', '未知') THEN '未知' ELSE c1 END AS city, CASE WHEN trim(coalesce(c2, '')) IN ('', '未知') THEN '未知' ELSE c2 END AS country FROM f""".replace(" AS by FROM", " AS how0 FROM").replace("by = ", "how0 = ").replace("by AS how", "how0 AS how"))
def place_filled(t):
    k = F.col("doc_id") % 4
    p = t("documents").select(
        F.col("doc_id").alias("id"), F.when(k == 0, "Paris").when(k == 1, " ").when(k == 2, "未知").alias("city"), F.when(F.col("doc_id") % 3 == 0, "F").when(F.col("doc_id") % 3 == 1, "").alias("country"),
        F.coalesce("text", F.lit("")).alias("text"), F.concat("source", F.when(F.col("doc_id") % 5 == 0, ".fr").otherwise(".org")).alias("domain"),
    )
    return geo.fill_place(p, "text", "domain", _CITIES, [(".fr", "F")], {"F": "Paris"}).select("id", F.col("by").alias("how"), "city", "country")


@query("""WITH f AS (SELECT doc_id % 3 AS before, CASE WHEN doc_id % 3 = 0 OR lang = 'fr' THEN 1 ELSE 0 END AS filled, lang FROM documents)
SELECT lang AS method, count(*) AS n, count(*) FILTER (before <> 0) AS unknown_before, count(*) FILTER (filled = 0) AS unknown_after, round(100.0 * count(*) FILTER (filled = 0) / count(*), 1) AS pct FROM f GROUP BY lang""")
def geo_fill_stats(t):
    f = t("documents").select(F.col("lang").alias("method"), (F.col("doc_id") % 3 != 0).alias("missing"), ((F.col("doc_id") % 3 != 0) & (F.col("lang") != "fr")).alias("still"))
    return geo.fill_stats(f, "method", F.col("missing"), F.col("still"))


_IPS = """SELECT event_id AS id, CASE event_id % 12 WHEN 0 THEN '10.0.0.' || CAST(event_id % 256 AS STRING) WHEN 1 THEN '::ffff:1.2.3.' || CAST(event_id % 300 AS STRING) WHEN 2 THEN CAST(event_id % 300 AS STRING) || '.1.1.1' WHEN 3 THEN NULL WHEN 4 THEN 'fe80::1' WHEN 5 THEN ' 8.8.8.' || CAST(event_id % 99 AS STRING) || ' '
WHEN 6 THEN '172.' || CAST(event_id % 64 AS STRING) || '.3.4' WHEN 7 THEN '192.168.' || CAST(event_id % 256 AS STRING) || '.9' WHEN 8 THEN '100.' || CAST(event_id % 256 AS STRING) || '.0.1' WHEN 9 THEN '169.254.1.' || CAST(event_id % 256 AS STRING) WHEN 10 THEN CAST(200 + event_id % 60 AS STRING) || '.5.6.7' ELSE '1.2.3' END AS x FROM {events}"""


@query(rf"""WITH p AS (SELECT id, regexp_replace(trim(x), '^::ffff:', '') AS a FROM ({plain(_IPS)})),
n AS (SELECT id, CASE WHEN regexp_matches(a, '^[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}$') AND len(list_filter(string_split(a, '.'), lambda o: o::INTEGER > 255)) = 0 THEN list_reduce(list_transform(string_split(a, '.'), lambda o: o::BIGINT), lambda s, o: s * 256 + o) END AS ip FROM p)
SELECT id, ip, ip // 16777216 IN (0, 10, 127) OR ip // 16777216 >= 224 OR ip // 4194304 = 401 OR ip // 65536 IN (43518, 49320) OR ip // 1048576 = 2753 AS reserved FROM n""")
def ip_numbers(t):
    r = derived(t, _IPS).withColumn("ip", geo.ipv4(F.col("x")))
    return r.select("id", "ip", geo.is_reserved(F.col("ip")).alias("reserved"))


_JSON = """SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'noise ' || props || ' tail' WHEN 1 THEN 'no json' WHEN 2 THEN substr(props, 1, 5) || '}' WHEN 3 THEN NULL WHEN 4 THEN '```json' || chr(10) || '{"name": "yé' || CAST(user_id AS STRING) || '", "a": ' || props || '}' || chr(10) || '```' ELSE props || props END AS x FROM {events}"""


@query(f"""WITH j AS (SELECT id, nullif(regexp_extract(x, '(?s)(\{{.*\}})', 1), '') AS j FROM ({plain(_JSON)})), v AS (SELECT id, CASE WHEN json_valid(j) THEN j END AS j FROM j)
SELECT id, json_extract_string(j, '$.name') AS name, coalesce(json_extract_string(j, '$.k'), json_extract_string(j, '$.a.k'))::INTEGER AS k FROM v""")
def tolerant_json(t):
    v = text.tolerant_json(F.col("x"))
    return derived(t, _JSON).select("id", F.try_variant_get(v, "$.name", "string").alias("name"), F.coalesce(F.try_variant_get(v, "$.k", "int"), F.try_variant_get(v, "$.a.k", "int")).alias("k"))


@query("""SELECT doc_id, CASE WHEN len(regexp_extract_all(coalesce(text, ''), '[^ ]+')) % 3 = 0 THEN array_to_string(list_transform(regexp_extract_all(substr(coalesce(text, ''), 1, 60), '[a-z]+'), lambda w: upper(w)), ',') END AS names FROM documents""")
def aligned_lists(t):
    own = F.regexp_extract_all(F.substring(F.coalesce("text", F.lit("")), 1, 60), F.lit("([a-z]+)"), F.lit(1))
    three = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([^ ]+)"), F.lit(1))) % 3 == 0
    other = F.when(three, F.transform(own, F.upper)).otherwise(F.concat(F.transform(own, F.upper), F.array(F.lit("more"))))
    return t("documents").select("doc_id", F.array_join(text.aligned(other, own), ",").alias("names"))


_PATHS = """SELECT page_id AS id, url AS base, CASE page_id % 11 WHEN 0 THEN '../b/c' WHEN 1 THEN './d' WHEN 2 THEN '../../../e/..' WHEN 3 THEN '//b.org/a/./b' WHEN 4 THEN '?p=' || CAST(page_id AS STRING) WHEN 5 THEN '#top' WHEN 6 THEN 'f..g/h.' WHEN 7 THEN '/r/../s/' || CAST(page_id AS STRING) || '?q=../x' WHEN 8 THEN 'mailto:a@b.org' WHEN 9 THEN 'https://c.org/x/./y' ELSE 'rel/' || CAST(page_id AS STRING) END AS href FROM {pages}"""


@query(rf"""WITH p AS ({plain(_PATHS)}), b AS (SELECT *, regexp_replace(base, '[?#].*$', '') AS bare, regexp_extract(base, '^(https?://[^/?#]+)', 1) AS origin FROM p),
f AS (SELECT id, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(base, '^(https?:)', 1) || href WHEN starts_with(href, '/') THEN origin || href WHEN starts_with(href, '?') THEN bare || href
 WHEN starts_with(href, '#') THEN regexp_replace(base, '#.*$', '') || href ELSE CASE WHEN bare = origin THEN bare || '/' ELSE regexp_replace(bare, '/[^/]*$', '/') END || href END AS u FROM b),
s AS (SELECT id, u, regexp_extract(u, '^(https?://[^/?#]*)', 1) AS host, regexp_extract(u, '([?#].*)$', 1) AS tail FROM f), q AS (SELECT *, u[length(host) + 1 : length(u) - length(tail)] AS path FROM s),
k AS (SELECT *, string_split(path, '/') AS seg FROM q), r AS (SELECT *, list_reduce(list_prepend([]::VARCHAR[], list_transform(seg, lambda x: [x])), lambda acc, x: CASE WHEN x[1] = '..' THEN acc[1:greatest(len(acc) - 1, 1)] WHEN x[1] = '.' THEN acc ELSE list_concat(acc, x) END) AS kept FROM k)
SELECT id, CASE WHEN host = '' THEN u WHEN regexp_matches(path, '(?:^|/)\.\.?(?:/|$)') THEN host || array_to_string(kept, '/') || CASE WHEN seg[-1] IN ('.', '..') THEN '/' ELSE '' END || tail ELSE u END AS full_url FROM r""")
def resolved_urls(t):
    return derived(t, _PATHS).select("id", urls.resolve(F.col("href"), F.col("base")).alias("full_url"))
