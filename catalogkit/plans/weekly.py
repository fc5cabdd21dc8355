"""Queries over what goes into issues and lists: references, names, personal lists, triage, duty."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import assembly, references
from .base import derived, plain, query
from .derived import RECORDS

_TITLED = """SELECT doc_id AS id, substr(coalesce(text, ''), 1, 30 + doc_id % 90) || CASE doc_id % 9 WHEN 0 THEN ' - ' || source WHEN 1 THEN '_新闻' WHEN 2 THEN '__' || upper(source) || '_ART News' WHEN 3 THEN ' | Other' WHEN 4 THEN '_a_独家_官网_资讯_新闻' WHEN 5 THEN ' – b — ' || source WHEN 6 THEN ' - a tail of many letters here' WHEN 7 THEN '_' ELSE '' END AS title,
source, source || '.example.org' AS domain FROM {documents}"""


def _peel(x: str) -> str:
    p = r"'(?s)^((?:[^\n\r\x{0085}\x{2028}\x{2029}])*?)(?:__|_|\s+[-–—|]\s+)([^_]{1,20})$'"
    names = "list_concat([" + ", ".join(f"'{n}'" for n in text.SITE_NAMES) + "], [lower(trim(source)), lower(trim(domain))])"
    return f"CASE WHEN trim(regexp_extract({x}, {p}, 1)) <> '' AND list_contains({names}, lower(trim(regexp_extract({x}, {p}, 2)))) THEN trim(regexp_extract({x}, {p}, 1)) ELSE {x} END"


@query(f"""WITH t AS ({plain(_TITLED)}), a AS (SELECT id, source, domain, trim(title) AS t0 FROM t), b AS (SELECT *, {_peel('t0')} AS t1 FROM a), c AS (SELECT *, {_peel('t1')} AS t2 FROM b), d AS (SELECT *, {_peel('t2')} AS t3 FROM c)
SELECT id, {_peel('t3')} AS title FROM d""")
def site_suffixes(t):
    """Titles without the names of sites at their ends."""
    return derived(t, _TITLED).select("id", text.strip_site_suffix(F.col("title"), F.col("source"), F.col("domain")).alias("title"))


_NAMED = """SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN '艺术学院 (Art ' || c_name || ')' WHEN 1 THEN '卢浮宫 Louvre ' || c_mktsegment WHEN 2 THEN '故宫' WHEN 3 THEN '  ' || c_name || ' ' WHEN 4 THEN c_name || '（艺术新闻报）' WHEN 5 THEN '馆 X1 ab' WHEN 6 THEN 'A 馆 b' WHEN 7 THEN NULL ELSE '名' || c_name END AS name,
CASE WHEN c_custkey % 5 = 0 THEN 'Known ' || c_mktsegment ELSE NULL END AS known FROM {customer}"""


@query(f"""WITH n AS (SELECT id, trim(coalesce(name, '')) AS s, known FROM ({plain(_NAMED)})), b AS (SELECT *, trim(regexp_replace(s, '[(（][^)）]*[)）]', '', 'g')) AS bare,
array_to_string(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: regexp_matches(w, '^[\\x20-\\x7E’&.·-]+$') AND regexp_matches(w, '[A-Za-z]')), ' ') AS latin FROM n)
SELECT id, CASE WHEN s = '' OR NOT regexp_matches(s, '[一-鿿]') THEN s WHEN known IS NOT NULL THEN known WHEN bare <> '' AND NOT regexp_matches(bare, '[一-鿿]') THEN bare WHEN length(latin) >= 3 THEN latin ELSE s END AS name FROM b""")
def english_names(t):
    """Names in English, where they have one."""
    return derived(t, _NAMED).select("id", text.english_name(F.col("name"), F.col("known")).alias("name"))


#: Items of 50 issues, some with one title, and texts that name them in good and loose forms.
ISSUE_ITEMS = """SELECT CAST(c_custkey % 50 AS INT) AS issue, CAST(floor(c_custkey / 50) AS INT) AS n, CASE WHEN c_custkey % 3 = 0 THEN '《Title ' || CAST(floor(c_custkey / 50) % 25 AS INT) || '》' WHEN c_custkey % 3 = 1 THEN 'Title ' || CAST(floor(c_custkey / 50) % 25 AS INT) ELSE '' END AS title,
'o' || CAST(c_custkey AS STRING) AS oid, CASE WHEN c_custkey % 2 = 0 THEN 'opp' ELSE 'news' END AS kind, 'https://x.org/' || CAST(c_custkey AS STRING) AS url FROM {customer}"""
ISSUE_TEXTS = """SELECT CAST(doc_id % 50 AS INT) AS issue, doc_id AS ord, coalesce(text, '') || ' [[' || CAST(doc_id % 35 AS STRING) || ':a label]] [' || CAST(doc_id % 31 AS STRING) || '][[' || CAST(doc_id % 29 AS STRING) || ']] [' || CAST(doc_id % 40 AS STRING) || '：words]x[3:y][[4:z] 【Title ' || CAST(doc_id % 26 AS STRING) || '】【none here】 [[5: ]] [[x:1]] end' || substr(coalesce(text, ''), 1, 40) AS text FROM {documents}"""


@query()
def issue_segments(t):
    """Texts of issues in segments, references repaired and numbered by first use."""
    return references.segments(derived(t, ISSUE_TEXTS), derived(t, ISSUE_ITEMS))


_KEPT = f"""SELECT CASE WHEN id % 1000 = 7 THEN -id ELSE owner % 40 END AS person, id AS ord, CASE id % 4 WHEN 0 THEN 'opp' WHEN 1 THEN 'news' WHEN 2 THEN 'job' ELSE 'work' END AS kind, title_zh AS title, org_zh AS org, city_zh AS city, country_zh AS country, deadline,
CASE WHEN id % 3 = 0 THEN '国内' ELSE '国际' END AS region, via AS source, updated_at AS published_at, city_zh AS location, CASE WHEN id % 5 = 0 THEN '' ELSE 'summary ' || CAST(id AS STRING) END AS summary, CASE WHEN id % 6 = 0 THEN 'c' ELSE NULL END AS cover FROM ({RECORDS})"""


@query(f"""WITH k AS ({plain(_KEPT)}), r AS (SELECT *, CASE kind WHEN 'opp' THEN 0 WHEN 'news' THEN 1 ELSE 2 END AS place, row_number() OVER (PARTITION BY person, kind ORDER BY ord) AS rn FROM k WHERE kind <> 'work'),
b AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY place, rn) - 1 AS n FROM r WHERE rn <= CASE place WHEN 0 THEN 30 WHEN 1 THEN 25 ELSE 12 END),
l AS (SELECT person, n, place, '[' || n::VARCHAR || '] ' || concat_ws(' | ', title, CASE place WHEN 1 THEN concat_ws(' | ', '【' || region || '】', '来源:' || source, published_at)
 ELSE nullif(concat_ws(' | ', org, CASE place WHEN 0 THEN nullif(concat_ws(' ', city, country), '') ELSE location END, '截止' || deadline), '') END, nullif(summary, ''), CASE WHEN cover IS NOT NULL THEN '[有配图]' END) AS line FROM b),
p AS (SELECT person, place, string_agg(line, chr(10) ORDER BY n) AS lines, count(*) AS c FROM l GROUP BY ALL),
w AS (SELECT person, sum(c)::INTEGER AS items, '{assembly.KINDS[0][2]}' || coalesce(chr(10) || max(lines) FILTER (place = 0), '') || coalesce(chr(10) || chr(10) || '{assembly.KINDS[1][2]}' || chr(10) || max(lines) FILTER (place = 1), '') || coalesce(chr(10) || chr(10) || '{assembly.KINDS[2][2]}' || chr(10) || max(lines) FILTER (place = 2), '') AS text FROM p GROUP BY person)
SELECT e.person, coalesce(items, 0)::INTEGER AS items, CASE WHEN coalesce(items, 0) < 2 THEN 'too_few' END AS error, CASE WHEN items >= 2 THEN text END AS text FROM (SELECT DISTINCT person FROM k) e LEFT JOIN w USING (person)""")
def personal_lists(t):
    """What each person keeps, as the numbered list that a summary is written from."""
    return assembly.personal_lists(derived(t, _KEPT), "person", "ord")


_NOTES = "SELECT conv_id * 1000 + turn AS id, CASE WHEN length(text) % 7 = {} THEN NULL ELSE substr(text, 1, 12) END AS answer FROM {conversations}"
_COMMENTS = "SELECT c_custkey AS id, c_custkey * 7 % 90 AS reports, CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE c_mktsegment END AS answer FROM {customer}"
_WORKS = "SELECT s_suppkey AS id, s_suppkey * 3 % 50 AS reports, CASE WHEN s_suppkey = 33 THEN NULL ELSE s_name END AS answer FROM {supplier}"


def _triage_sql(bad: int) -> str:
    return f"""WITH f AS (SELECT * FROM ({plain(_NOTES.replace('{}', str(bad)))}) ORDER BY id LIMIT 30), g AS (SELECT coalesce(min(id) FILTER (answer IS NULL), 9e18::BIGINT) AS bad, count(*) FILTER (answer IS NULL) AS fails FROM f),
t AS (SELECT row_number() OVER (ORDER BY place, reports DESC, id DESC) AS k, * FROM (SELECT * FROM (SELECT 0 AS place, 'comment' AS kind, * FROM ({plain(_COMMENTS)}) WHERE reports > 0 ORDER BY reports DESC, id DESC LIMIT 6) UNION ALL SELECT * FROM (SELECT 1, 'work', * FROM ({plain(_WORKS)}) WHERE reports > 0 ORDER BY reports DESC, id DESC LIMIT 4)))
SELECT 'feedback' AS kind, id, answer FROM f, g WHERE id < bad UNION ALL SELECT kind, id, answer FROM t, g WHERE fails = 0 AND k < (SELECT coalesce(min(k) FILTER (answer IS NULL), 99) FROM t)"""


@query(_triage_sql(3))
def feedback_triage(t):
    """A round of triage that ends at the first note without an answer."""
    return assembly.triaged(derived(t, _NOTES.replace("{}", "3")), derived(t, _COMMENTS), derived(t, _WORKS))


@query(_triage_sql(8))
def reported_triage(t):
    """A round in which all notes are answered, and reported comments and works follow."""
    return assembly.triaged(derived(t, _NOTES.replace("{}", "8")), derived(t, _COMMENTS), derived(t, _WORKS))


_STAFF = """SELECT s_name AS id, CASE s_suppkey % 5 WHEN 0 THEN 'resident' WHEN 1 THEN 'cn' WHEN 2 THEN 'cn' ELSE 'intl' END AS kind, s_nationkey % 7 AS slot, CAST(s_suppkey % 24 AS DOUBLE) AS hour, s_nationkey % 25 - 12 + CASE WHEN s_suppkey % 4 = 0 THEN 0.5 ELSE 0.0 END AS tz, s_suppkey % 6 AS pool FROM {supplier}"""


@query(f"""WITH s AS ({plain(_STAFF)}), d AS (SELECT *, 20676 AS day, row_number() OVER (PARTITION BY kind ORDER BY slot, id) - 1 AS place, count(*) OVER (PARTITION BY kind) AS size FROM s),
e AS (SELECT *, CASE WHEN kind = 'resident' THEN 0 ELSE (place - day % size + size) % size END AS wait, ((floor(hour - tz + 0.5)::BIGINT % 24) + 24) % 24 AS utc,
 list_reduce(list_prepend(day::BIGINT, list_transform(string_split(id, ''), lambda c: unicode(c)::BIGINT)), lambda a, b: (a * 31 + b) % 4294967296) AS seed FROM d)
SELECT id, wait::INTEGER AS next_in_days, wait = 0 AS on_duty, utc::INTEGER AS utc_hour, wait = 0 AND utc = 15 AS due_now, coalesce(array_to_string(list_transform(range(least(3, pool)), lambda i: 'q' || ((seed % greatest(pool, 1) + i) % pool)::VARCHAR), ','), '') AS picks FROM e""")
def duty_rota(t):
    """Who is on duty on a day, who is next and when, and the queries of each shift."""
    pool = F.when(F.col("pool") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("pool") - 1, F.lit(0)).cast("int")), lambda i: F.concat(F.lit("q"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    r = assembly.duty_roster(derived(t, _STAFF).withColumn("queries", pool), "2026-08-11 15:30:00")
    return r.select("id", "next_in_days", "on_duty", "utc_hour", "due_now", F.array_join("picks", ",").alias("picks"))
