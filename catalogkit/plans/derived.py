"""Records, extractions and feeds made from the driver's tables, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

#: Records of a catalog, one for each order.
RECORDS = """SELECT o_orderkey AS id, o_orderkey AS ord,
CASE o_orderkey % 5 WHEN 0 THEN '第 ' || CAST(o_custkey % 40 AS STRING) || ' 届双年展（征集）' WHEN 1 THEN 'Open Call: Triennial ' || CAST(o_custkey % 60 AS STRING) WHEN 2 THEN 'RESIDENCY-' || CAST(o_custkey % 90 AS STRING) WHEN 3 THEN 'Residency ' || CAST(o_custkey % 90 AS STRING) ELSE 'Prize ' || CAST(o_orderkey AS STRING) END AS title_zh,
CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'title ' || CAST(o_orderkey % 97 AS STRING) END AS title_en,
'Org (' || CAST(o_custkey % 3 AS STRING) || ')' AS org_zh,
CASE o_custkey % 7 WHEN 0 THEN '台北' WHEN 1 THEN 'Paris' WHEN 2 THEN '香港' ELSE NULL END AS city_zh,
CASE o_custkey % 6 WHEN 0 THEN '中国' WHEN 1 THEN '法国' WHEN 2 THEN '日本' WHEN 3 THEN '美国' WHEN 4 THEN '巴西' ELSE NULL END AS country_zh,
CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN '2026-02-30' WHEN o_orderkey % 2 = 0 THEN '2001-06-15' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS deadline,
CASE WHEN o_orderkey % 17 = 0 THEN 'dead' WHEN o_orderstatus = 'F' THEN 'expired' ELSE 'open' END AS status,
CASE WHEN o_orderkey % 11 = 0 THEN 'verified' WHEN o_orderkey % 7 = 0 THEN 'user' WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'auto' END AS trust,
CASE o_orderkey % 8 WHEN 0 THEN 'search' WHEN 1 THEN 'submit' ELSE NULL END AS via,
CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 < 4 THEN 'https://news.example.net/' || CAST(o_orderkey AS STRING) ELSE 'https://org' || CAST(o_custkey % 50 AS STRING) || '.example.org/call' END AS url,
CASE WHEN o_orderkey % 4 = 0 THEN 'https://org' || CAST(o_custkey % 50 AS STRING) || '.example.org/official' WHEN o_orderkey % 4 = 1 THEN 'https://trusted.example.com/' || CAST(o_orderkey AS STRING) ELSE NULL END AS official_url,
CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS free, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 3 = 0 END AS required,
o_orderkey % 3 = 0 AS stipend, o_orderkey % 2 = 0 AS housing, CASE WHEN o_orderkey % 6 = 0 THEN true ELSE NULL END AS travel,
CASE o_orderkey % 3 WHEN 0 THEN 'residency' WHEN 1 THEN 'prize' ELSE 'exhibition' END AS category, o_custkey AS owner,
CAST(CAST(o_orderdate AS DATE) AS STRING) AS updated_at, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '2001-11-' || CAST(10 + o_orderkey % 20 AS STRING) END AS last_seen, o_orderkey % 4 AS n_disciplines
FROM {orders}"""

#: Texts with what was extracted from them, one for each document.
EXTRACTS = """SELECT doc_id AS id, doc_id % 23 <> 0 AS applicable,
coalesce(text, '') || CASE WHEN doc_id % 5 <> 0 THEN ' Please apply by  1' || CAST(doc_id % 10 AS STRING) || chr(10) || 'March' || CASE WHEN doc_id % 2 = 0 THEN ' 2027' ELSE '' END || '. Fee:  none, Org House, ' || coalesce(source, '') || ' paid' ELSE '' END AS text,
CASE WHEN doc_id % 14 = 0 THEN 'No such title' WHEN doc_id % 29 = 0 THEN '' ELSE substr(coalesce(text, ''), 1, 24) END AS title, CASE WHEN doc_id % 13 = 0 THEN '' ELSE substr(coalesce(text, ''), 1, 30) END AS ev_title,
CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '2026-02-30' WHEN 2 THEN '2020-03-1' || CAST(doc_id % 10 AS STRING) ELSE '2027-03-1' || CAST(doc_id % 10 AS STRING) END AS deadline,
CASE WHEN doc_id % 4 = 0 THEN 'Deadline: Aug 20' ELSE 'apply by 1' || CAST(doc_id % 10 AS STRING) || ' March' || CASE WHEN doc_id % 2 = 0 THEN ' 2027' ELSE '' END END AS ev_deadline,
CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'none' END AS fee, CASE WHEN doc_id % 9 = 1 THEN 'Fee 5 EUR' ELSE 'Fee:' || chr(10) || 'none' END AS ev_fee,
CASE WHEN doc_id % 10 = 3 THEN '常年' ELSE NULL END AS deadline_note,
CASE doc_id % 8 WHEN 0 THEN 'https://other.org/x' WHEN 1 THEN 'https://www.' || coalesce(source, 's') || '.example.com/a' WHEN 2 THEN NULL ELSE 'https://sub.' || coalesce(source, 's') || '.example.com/a?b' END AS url, 'www.' || coalesce(source, 's') || '.example.com' AS domain,
CASE WHEN doc_id % 2 = 0 THEN 'official' ELSE 'other' END AS org_type, CASE WHEN doc_id % 5 = 1 THEN true ELSE NULL END AS trust_auto,
CASE WHEN doc_id % 3 = 0 THEN 'Org House' WHEN doc_id % 3 = 1 THEN 'Org Shed' ELSE '' END AS org, CASE WHEN doc_id % 4 = 1 THEN 'Org' ELSE 'Org House' END AS ev_org,
CASE WHEN doc_id % 2 = 0 THEN 'paid' ELSE NULL END AS salary, CASE WHEN doc_id % 6 = 0 THEN 'unpaid' ELSE 'paid' END AS ev_salary, CASE WHEN doc_id % 5 = 2 THEN source ELSE 'Nowhere' END AS source,
CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS provider, doc_id % 1000 AS input_tokens, doc_id % 300 AS output_tokens
FROM {documents}"""

#: A feed for each page: two RSS items and an Atom entry.
FEEDS = """SELECT page_id, '<rss><channel><title>all</title><item><title><![CDATA[Call <b>no</b> ' || CAST(page_id AS STRING) || ']]></title><link>' || coalesce(url, '') || '#top</link><pubDate>2026-01-0' || CAST(page_id % 9 AS STRING) || '</pubDate><description>A &amp; b &#233;</description></item>'
|| '<item><title> two  &ldquo;x&rdquo; </title><link>' || coalesce(url, '') || '</link><summary>s</summary></item></channel></rss><entry><title>three</title><link rel="alternate" href="https://a.example.org/' || CAST(page_id % 5 AS STRING) || '"/><updated>2026-02-0' || CAST(page_id % 9 AS STRING) || '</updated></entry>' AS body FROM {pages}"""
