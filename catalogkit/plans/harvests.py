"""Queries over whole harvests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import host_of
from ..operators import harvest, verify
from .base import derived, plain, query
from .content import _HOST, _n
from .derived import EXTRACTS, RECORDS
from .verification import _TITLE, _TRUST, _VERIFIED, _day, _holds, _told

_BASE = "SELECT doc_id AS id, doc_id AS ord, doc_id % 8 = 0 AS verified, CASE WHEN doc_id % 16 = 4 THEN NULL ELSE '2026-12-31' END AS fee, '2026-12-31' AS deadline FROM {documents} WHERE doc_id % 4 = 0"


@query(f"""WITH {_VERIFIED}, {_TRUST}, nw AS (SELECT id, fee1 AS fee, d2 AS deadline FROM g WHERE drop_reason IS NULL AND len(reasons) = 0 AND id % 6 <> 1), b AS ({plain(_BASE)})
SELECT coalesce(b.id, nw.id) AS id, CASE WHEN b.id IS NOT NULL AND (nw.id IS NULL OR b.verified) THEN b.fee ELSE coalesce(nw.fee, b.fee) END AS fee, CASE WHEN b.id IS NOT NULL AND (nw.id IS NULL OR b.verified) THEN b.deadline ELSE nw.deadline END AS deadline,
CASE WHEN nw.id IS NULL THEN 'kept' WHEN b.id IS NULL THEN 'added' WHEN b.verified THEN 'skipped' ELSE 'updated' END AS action FROM b FULL JOIN nw ON b.id = nw.id""")
def daily_harvest(t):
    e = derived(t, EXTRACTS)
    pages = e.select("id", "text", F.lit(200).alias("status"), F.md5("text").alias("hash"))
    state = pages.select("id", F.when(F.col("id") % 6 == 1, F.col("hash")).otherwise("old").alias("hash"))
    found = harvest.verdicts(pages, state, e.drop("text"), [("deadline", "ev_deadline"), ("fee", "ev_fee")], "2026-06-01")
    catalog, _ = harvest.into_catalog(derived(t, _BASE), found, "id", ["fee"])
    return catalog.select("id", "fee", "deadline", "action")


@query(f"""WITH e AS ({plain(EXTRACTS)}), n AS (SELECT *, {_n("text")} AS nt FROM e),
k AS (SELECT *, deadline IS NOT NULL AND NOT (({_day("deadline")}) IS NOT NULL AND {_holds("ev_deadline")} AND {_told("deadline", "ev_deadline")}) AS bad_p FROM n),
v AS (SELECT id, url FROM k WHERE ({_TITLE} WHEN NOT bad_p AND date_diff('day', {_day("deadline")}, DATE '2027-06-20') > 95 THEN 'too-old' END) IS NULL), b AS (SELECT id, url FROM e WHERE id % 10 = 0)
SELECT id, url FROM b UNION ALL SELECT id, url FROM v WHERE id NOT IN (SELECT id FROM b) AND (url IS NULL OR url NOT IN (SELECT url FROM b WHERE url IS NOT NULL))""")
def channel_harvest(t):
    e = derived(t, EXTRACTS)
    found = verify.verify_news(e.withColumnsRenamed({"deadline": "published_at", "ev_deadline": "ev_published_at"}), "2027-06-20", 95)
    return harvest.into_channel(e.where("id % 10 = 0").select("id", "url"), found, "id", "url")


@query(f"""WITH rec AS ({plain(RECORDS)}), h AS (SELECT id, owner % 50 AS q, official_url AS url, ord, stipend AS ok FROM rec WHERE official_url IS NOT NULL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, url ORDER BY ord) AS k FROM h) WHERE k = 1 AND url NOT IN (SELECT url FROM rec WHERE url IS NOT NULL AND id % 7 = 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY ord) AS rn FROM f), b AS (SELECT *, coalesce(sum(ok::INTEGER) OVER (PARTITION BY q ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM r WHERE rn <= 16)
SELECT id, q, url FROM b WHERE done < 6 AND ok""")
def search_ingest(t):
    r = derived(t, RECORDS)
    hits = r.where("official_url is not null").select("id", (F.col("owner") % 50).alias("q"), F.col("official_url").alias("url"), "ord", F.col("stipend").alias("ok"))
    return harvest.search_and_ingest(hits, r.where("id % 7 = 0").select("url"), "q", "url", ["ord"], F.col("ok")).select("id", "q", "url")


@query(f"""WITH rec AS ({plain(RECORDS)}), f AS (SELECT id, 'en ' || id::VARCHAR AS title_en, 'City' AS city_zh FROM rec WHERE id % 2 = 0) SELECT rec.id, coalesce(nullif(rec.title_en, ''), f.title_en) AS title_en, coalesce(rec.city_zh, f.city_zh) AS city_zh FROM rec LEFT JOIN f ON f.id = rec.id""")
def missing_filled(t):
    r = derived(t, RECORDS).select("id", "title_en", "city_zh")
    found = r.where("id % 2 = 0").select("id", F.concat(F.lit("en "), F.col("id").cast("string")).alias("title_en"), F.lit("City").alias("city_zh"))
    return harvest.filled(r, found, "id", ["title_en", "city_zh"])


@query(f"""WITH c AS (SELECT page_id, {_HOST} AS domain FROM pages), f AS (SELECT domain, min(page_id) AS page_id FROM c WHERE domain IS NOT NULL GROUP BY domain) SELECT page_id, domain FROM f WHERE domain NOT IN (SELECT domain FROM c WHERE page_id % 3 = 0 AND domain IS NOT NULL)""")
def source_discovery(t):
    c = t("pages").select("page_id", host_of(F.col("url")).alias("domain"))
    return harvest.new_sources(c, c.where("page_id % 3 = 0"), "domain", ["page_id"])
