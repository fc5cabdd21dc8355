"""Queries over extractions: verification, trust, run statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import crawl, evidence, verify
from .base import derived, plain, query
from .content import _n
from .derived import EXTRACTS

_SIGNAL = "regexp_matches({x}, '(?i)" + "|".join(text.APPLY_SIGNALS) + "')"
_HOST = r"nullif(regexp_replace(regexp_extract(lower({u}), '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', ''), '')"
_MONTH = "substr('janfebmaraprmayjunjulaugsepoctnovdec', 3 * substr({d}, 6, 2)::INTEGER - 2, 3)"


def _holds(e: str, t: str = "nt") -> str:
    return f"coalesce(length({_n(e)}) > 0 AND contains({t}, {_n(e)}), false)"


def _day(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST({x} AS DATE) END"


def _told(d: str, e: str) -> str:
    """Whether a date is told by its evidence."""
    nums = f"list_transform(regexp_extract_all({e}, '[0-9]+'), lambda x: x::HUGEINT)"
    years = f"list_filter({nums}, lambda y: y BETWEEN 2000 AND 2099)"
    return f"""coalesce({e} <> '' AND (contains({e}, {d}) OR contains({e}, replace({d}, '-', '')) OR (list_contains({nums}, substr({d}, 9, 2)::HUGEINT)
AND (list_contains({nums}, substr({d}, 6, 2)::HUGEINT) OR regexp_matches(lower({e}), '(?:^|[^a-z0-9_])' || {_MONTH.format(d=d)})) AND (len({years}) = 0 OR list_contains({years}, substr({d}, 1, 4)::HUGEINT)))), false)"""


_VERIFIED = f"""e AS ({plain(EXTRACTS)}), n AS (SELECT *, {_n("text")} AS nt FROM e),
k AS (SELECT *, {_holds("ev_title")} AS title_ok, deadline IS NOT NULL AND NOT {_holds("ev_deadline")} AS bad_d, fee IS NOT NULL AND NOT {_holds("ev_fee")} AS bad_f FROM n),
d AS (SELECT *, CASE WHEN NOT bad_d THEN deadline END AS d1, CASE WHEN NOT bad_f THEN fee END AS fee1 FROM k),
w AS (SELECT *, d1 IS NOT NULL AND ({_day("d1")}) IS NULL AS wrong, {_HOST.format(u="url")} AS host, regexp_replace(lower(domain), '^www\\.', '') AS base FROM d),
v AS (SELECT *, CASE WHEN NOT wrong THEN d1 END AS d2, list_filter([CASE WHEN bad_d THEN 'deadline' END, CASE WHEN bad_f THEN 'fee' END, CASE WHEN wrong THEN 'deadline' END], lambda x: x IS NOT NULL) AS nulled FROM w),
r AS (SELECT *, CASE WHEN NOT coalesce(applicable, true) THEN 'not-applicable' WHEN text <> '' AND NOT {_SIGNAL.format(x="text")} THEN 'no-apply-signal' WHEN coalesce(d2 < '2026-06-01', false) THEN 'expired'
 WHEN NOT coalesce(host = base OR ends_with(host, '.' || base), false) THEN 'cross-domain-url' END AS drop_reason, d2 IS NOT NULL OR coalesce(regexp_matches(deadline_note, '(?i)常年|长期|滚动|rolling|ongoing'), false) AS has_deadline,
 len(nulled) > 0 OR NOT title_ok AS any_fail FROM v)"""


def _verified(t):
    return verify.verify_opportunity(derived(t, EXTRACTS), [("deadline", "ev_deadline"), ("fee", "ev_fee")], "2026-06-01")


@query(f"WITH {_VERIFIED} SELECT id, drop_reason, d2 AS deadline, fee1 AS fee, array_to_string(nulled, ',') AS nulled, has_deadline, any_fail FROM r")
def verified_opportunities(t):
    return _verified(t).select("id", "drop_reason", "deadline", "fee", F.array_join("nulled", ",").alias("nulled"), "has_deadline", "any_fail")


_TRUST = """g AS (SELECT *, list_filter([CASE WHEN NOT coalesce(org_type = 'official' OR coalesce(trust_auto, false), false) THEN 'source' END, CASE WHEN coalesce(url, '') = '' THEN 'url' END,
CASE WHEN NOT has_deadline THEN 'deadline' END, CASE WHEN any_fail THEN 'evidence' END], lambda x: x IS NOT NULL) AS reasons FROM r)"""


@query(f"WITH {_VERIFIED}, {_TRUST} SELECT id, array_to_string(reasons, ',') AS reasons FROM g WHERE drop_reason IS NULL AND len(reasons) > 0")
def review_queue(t):
    q = verify.trust(_verified(t)).where("drop_reason is null and trust = 'pending'")
    return q.select("id", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {_VERIFIED}, {_TRUST} SELECT count(*) FILTER (drop_reason IS NULL) AS kept, count(*) FILTER (drop_reason IS NULL AND len(reasons) > 0) AS pending, count(*) FILTER (drop_reason IS NOT NULL) AS dropped,
sum(len(nulled))::BIGINT AS nulled, sum(input_tokens + output_tokens)::BIGINT AS tokens, round(sum((input_tokens * CASE provider WHEN 'a' THEN 1.5 ELSE 0.25 END + output_tokens * CASE provider WHEN 'a' THEN 6.0 ELSE 1.0 END) / 1e6), 6) AS cost FROM g""")
def run_statistics(t):
    return verify.run_stats(verify.trust(_verified(t)), {"a": (1.5, 6.0), "b": (0.25, 1.0)})


_TITLE = f"CASE WHEN NOT coalesce(applicable, true) THEN 'not-applicable' WHEN coalesce(title, '') = '' THEN 'no-title' WHEN NOT {_holds('ev_title')} THEN 'title-evidence-fail' WHEN NOT {_holds('title')} THEN 'title-not-verbatim'"


@query(f"""WITH e AS ({plain(EXTRACTS)}), n AS (SELECT *, {_n("text")} AS nt FROM e),
k AS (SELECT *, coalesce(source, '') <> '' AND NOT {_holds("source")} AS bad_s, deadline IS NOT NULL AND NOT (({_day("deadline")}) IS NOT NULL AND {_holds("ev_deadline")} AND {_told("deadline", "ev_deadline")}) AS bad_p FROM n)
SELECT id, CASE WHEN NOT bad_s THEN source END AS source, CASE WHEN NOT bad_p THEN deadline END AS published_at, {_TITLE} WHEN NOT bad_p AND date_diff('day', {_day("deadline")}, DATE '2027-06-20') > 95 THEN 'too-old' END AS drop_reason FROM k""")
def news_verify(t):
    e = derived(t, EXTRACTS).withColumnsRenamed({"deadline": "published_at", "ev_deadline": "ev_published_at"})
    return verify.verify_news(e, "2027-06-20", 95).select("id", "source", "published_at", "drop_reason")


@query(f"""WITH e AS ({plain(EXTRACTS)}), n AS (SELECT *, {_n("text")} AS nt, nullif(org, '') AS org0, nullif(salary, '') AS sal0 FROM e),
k AS (SELECT *, CASE WHEN {_holds("ev_org")} AND {_holds("org0")} THEN org0 END AS org1, CASE WHEN {_holds("ev_salary")} AND {_holds("sal0")} THEN sal0 END AS sal1,
 deadline IS NOT NULL AND NOT (({_day("deadline")}) IS NOT NULL AND {_holds("ev_deadline")} AND {_told("deadline", "ev_deadline")}) AS bad_d FROM n)
SELECT id, org1 AS org, sal1 AS salary, CASE WHEN NOT bad_d THEN deadline END AS deadline, {_TITLE} WHEN NOT bad_d AND coalesce(deadline < '2027-03-15', false) THEN 'job-expired' END AS drop_reason FROM k""")
def job_verify(t):
    e = derived(t, EXTRACTS).withColumns({c: F.lit(None).cast("string") for c in ("employment_type", "ev_employment_type", "city", "country")})
    return verify.verify_jobs(e, "2027-03-15").select("id", "org", "salary", "deadline", "drop_reason")


@query(f"SELECT id, {_told('deadline', 'ev_deadline')} AS told FROM ({plain(EXTRACTS)})")
def date_evidence(t):
    from ..functions.dates import matches_evidence

    return derived(t, EXTRACTS).select("id", matches_evidence(F.col("deadline"), F.col("ev_deadline")).alias("told"))


@query(f"SELECT id, {_SIGNAL.format(x='text')} AS signal, length(text) < 200 AS thin FROM ({plain(EXTRACTS)})")
def apply_signal_scan(t):
    return derived(t, EXTRACTS).select("id", text.apply_signal(F.col("text")).alias("signal"), (F.length("text") < 200).alias("thin"))


@query(f"""SELECT d.doc_id, d.source, e.title FROM documents d JOIN ({plain(EXTRACTS)}) e ON e.id = d.doc_id""")
def extraction_source(t):
    e = derived(t, EXTRACTS).select(F.col("id").alias("doc_id"), "title")
    return crawl.extracted(t("documents").select("doc_id", "source"), e, "doc_id")


@query(f"""WITH e AS ({plain(EXTRACTS)}), j AS (SELECT id, text, CASE WHEN id % 3 = 0 THEN 'B' WHEN id % 3 = 1 THEN 'A' END AS kind, CASE WHEN id % 2 = 0 THEN ev_title ELSE 'nothing so' END AS proof FROM e)
SELECT id, coalesce(kind = 'B' AND {_holds("proof", _n("text"))}, false) AS blocked FROM j""")
def applicability_judgement(t):
    e = derived(t, EXTRACTS)
    j = e.select("id", "text", F.when(F.col("id") % 3 == 0, "B").when(F.col("id") % 3 == 1, "A").alias("kind"), F.when(F.col("id") % 2 == 0, F.col("ev_title")).otherwise("nothing so").alias("proof"))
    return j.select("id", F.coalesce((F.col("kind") == "B") & evidence.in_source(F.col("proof"), F.col("text")), F.lit(False)).alias("blocked"))


_SEARCHED = "lower(concat_ws(' ', nullif(title, ''), nullif(org, ''), nullif(source, '')))"


@query(f"""SELECT id, coalesce(length(text) > 200 AND NOT {_SIGNAL.format(x='text')} AND NOT {_SIGNAL.format(x="concat_ws(' ', title, org)")}, false) AS silent, sha256({_SEARCHED}) AS searched FROM ({plain(EXTRACTS)})""")
def silent_pages(t):
    """Pages of some length without a word of applying, in them or in what was taken from them; and the text to be searched."""
    from ..operators import catalog, quality

    return derived(t, EXTRACTS).select("id", quality.no_signal(F.col("text"), ["title", "org"]).alias("silent"), F.sha2(catalog.search_text(["title", "org", "source"]), 256).alias("searched"))
