"""Queries over logs of what people ask the catalog to do."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import commands, submission
from ..streaming import online
from .base import derived, plain, query

#: Events as commands on works, each user's and the users' next to it, with preconditions that some miss.
_COMMANDS = """SELECT event_id AS id, user_id % 60 AS item, ts, CASE WHEN event_id % 9 = 0 THEN 'publish' WHEN event_id % 4 = 0 THEN 'submit' WHEN event_type = 'error' THEN 'reject' WHEN event_type = 'signup' THEN 'withdraw' WHEN event_id % 3 = 0 THEN 'reject' ELSE 'approve' END AS command,
CASE WHEN event_id % 17 = 0 THEN 'not signed in' WHEN event_type = 'signup' AND event_id % 5 <> 0 THEN 'not yours' ELSE NULL END AS refusal FROM {events}"""


def _walk(restore: str | None, again: bool) -> str:
    """The fold, step by step over each item's commands in order."""
    restored = "CASE WHEN w.state = 'rejected' AND n.command = 'approve' AND n.us - w.since >= {} THEN 'too late' END".format(restore) if restore else "NULL"
    more = "WHEN w.state = 'approved' AND n.command = 'approve' THEN 'approved|decided:approved' WHEN w.state = 'rejected' AND n.command = 'reject' THEN 'rejected|decided:rejected'" if again else ""
    move = f"""CASE WHEN n.refusal IS NOT NULL OR {restored} IS NOT NULL THEN NULL WHEN w.state = 'none' AND n.command = 'submit' THEN 'pending|created' WHEN w.state = 'none' AND n.command = 'publish' THEN 'approved|auto-approved'
 WHEN w.state = 'pending' AND n.command = 'approve' THEN 'approved|decided:approved' WHEN w.state = 'pending' AND n.command = 'reject' THEN 'rejected|decided:rejected' WHEN w.state = 'approved' AND n.command = 'reject' THEN 'rejected|takedown'
 WHEN w.state = 'rejected' AND n.command = 'approve' THEN 'approved|{'decided:approved' if again else 'restored'}' {more} WHEN w.state IN ('pending', 'approved', 'rejected') AND n.command = 'withdraw' THEN 'gone|withdrawn' END"""
    why = f"coalesce(n.refusal, {restored}, CASE w.state WHEN 'none' THEN 'not found' WHEN 'gone' THEN 'not found' WHEN 'pending' THEN 'exists' ELSE 'decided' END)"
    return f"""WITH RECURSIVE c AS MATERIALIZED (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY item ORDER BY ts, id) AS rn FROM ({plain(_COMMANDS)})),
w(item, rn, id, before, state, since, taken, outcome) AS (SELECT item, 0::BIGINT, NULL::BIGINT, 'none', 'none', -4611686018427387904, false, '' FROM (SELECT DISTINCT item FROM c)
UNION ALL SELECT item, rn, id, before, coalesce(split_part(move, '|', 1), before), CASE WHEN move IS NULL THEN since ELSE us END, move IS NOT NULL, coalesce(split_part(move, '|', 2), why)
FROM (SELECT n.item, n.rn, n.id, n.us, w.state AS before, w.since, {move} AS move, {why} AS why FROM w JOIN c n ON n.item = w.item AND n.rn = w.rn + 1))
SELECT id, before, state, taken, outcome FROM w WHERE rn > 0"""


@query(_walk(str(2 * 86_400_000_000), False))
def work_commands(t):
    """Works taken through submission, decision, takedown, restoring within two days and withdrawal."""
    return commands.decided(derived(t, _COMMANDS), commands.works(restore_days=2), at="ts")


@query(_walk(None, True))
def submission_commands(t):
    """Submissions, which can be decided again."""
    return commands.decided(derived(t, _COMMANDS), commands.submissions(), at="ts")


#: Events as searches: some asked, some ending, by few queries of two channels.
_SEARCHES = """SELECT event_id AS id, ts, CASE WHEN user_id % 2 = 0 THEN 'news:' ELSE 'jobs:' END || CAST(user_id % 30 AS STRING) AS q, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'ask' END AS kind, CASE WHEN user_id % 3 = 0 THEN 'x' ELSE 'y' END AS source FROM {events}"""


@query(f"""WITH RECURSIVE s AS MATERIALIZED (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY q ORDER BY ts, id) AS rn FROM ({plain(_SEARCHES)})),
w(q, rn, id, kind, running, done, verdict) AS (SELECT DISTINCT q, 0::BIGINT, NULL::BIGINT, '', false, -4611686018427387904, '' FROM s
UNION ALL SELECT s.q, s.rn, s.id, s.kind, s.kind = 'ask' AND (w.running OR s.us - w.done >= 7200000000), CASE WHEN s.kind = 'done' THEN s.us ELSE w.done END, CASE WHEN s.us - w.done < 7200000000 THEN 'recent' WHEN w.running THEN 'running' ELSE 'run' END FROM w JOIN s ON s.q = w.q AND s.rn = w.rn + 1)
SELECT id, verdict FROM w WHERE kind = 'ask'""")
def search_gate(t):
    """Searches that run, and those held back since the same one runs or has just succeeded (here within two hours)."""
    return online.gated(derived(t, _SEARCHES), "q", "id", "ts", "kind", keep=120 * online.MINUTE)


@query()
def paid_searches(t):
    """Searches answered from a source's cache of 600 answers, paid for, or over the day's budget."""
    return online.paid(derived(t, _SEARCHES), "source", "id", "ts", "q", budget=12)


#: Documents as submissions of all kinds, with faults of all sorts.
_SUBMITTED = """SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'job' WHEN 1 THEN 'news' ELSE NULL END AS kind, CASE WHEN doc_id % 19 = 0 THEN ' x ' ELSE ' ' || substr(coalesce(text, ''), 1, 40 + doc_id % 110) END AS title, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'Org ' || source END AS org, CASE WHEN doc_id % 17 = 0 THEN 's' ELSE source END AS source,
CASE WHEN doc_id % 14 = 0 THEN ' ' ELSE 'seen at ' || source END AS source_note, CASE doc_id % 4 WHEN 0 THEN 'prize' WHEN 1 THEN 'residency' WHEN 2 THEN 'exhibition' ELSE 'else' END AS category, CASE WHEN doc_id % 2 = 0 THEN 'full-time' ELSE 'other' END AS employment_type, lang AS city, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Land' END AS country,
CASE WHEN doc_id % 6 = 0 THEN NULL ELSE '5000 a month' END AS salary, CASE doc_id % 8 WHEN 0 THEN '2026-02-30' WHEN 1 THEN '2026/01/02' WHEN 2 THEN '2027-05-06' WHEN 3 THEN ' 2025-05-06 ' ELSE '' END AS deadline, coalesce(text, '') AS summary,
CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'ftp://a.org/x' WHEN 2 THEN 'https://localhost/x' WHEN 3 THEN 'https://www.zhihu.com/q' ELSE ' HTTPS://' || source || '.example.org/' || CAST(doc_id AS STRING) END AS url FROM {documents}"""


def _checked_sql() -> str:
    f = submission.FAULTS
    host = r"regexp_extract(regexp_replace(lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#]*)', 1)), '^\[|\]$', '', 'g'), '^([^:]*)', 1)"
    unsafe = rf"({host} IN ('', 'localhost') OR regexp_matches({host}, '\.(?:local|internal|lan|home)$') OR regexp_matches({host}, '^[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}$') OR regexp_matches(url, '{urls.BLOCKED}'))"
    bad = lambda label: f"CASE WHEN NOT regexp_matches(url, '(?i)^https?://.{{4,300}}$') THEN '{label}{submission.NO_SCHEME}' WHEN {unsafe} THEN '{submission.UNUSABLE}' END"
    j, n, o = f["job"], f["news"], f["opp"]
    trimmed = ", ".join(f"trim(coalesce({c}, '')) AS {c}" for c in ("title", "org", "source", "source_note", "category", "employment_type", "city", "country", "salary", "deadline", "summary", "url"))
    return f"""WITH s AS (SELECT id, coalesce(kind, 'opp') AS kind, {trimmed} FROM ({plain(_SUBMITTED)})),
e AS (SELECT *, coalesce(CASE WHEN deadline = '' THEN NULL WHEN NOT regexp_matches(deadline, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN '{submission.DATE_FORM}' WHEN TRY_CAST(deadline AS DATE) IS NULL THEN '{submission.DATE_NONE}' END, CASE kind
WHEN 'job' THEN CASE WHEN length(title) NOT BETWEEN 2 AND 80 THEN '{j[0]}' WHEN length(org) NOT BETWEEN 2 AND 80 THEN '{j[1]}' WHEN url = '' THEN '{j[2]}' ELSE {bad(j[3])} END
WHEN 'news' THEN CASE WHEN length(title) NOT BETWEEN 4 AND 120 THEN '{n[0]}' WHEN length(source[1:40]) < 2 THEN '{n[1]}' WHEN url = '' THEN '{n[2]}' ELSE {bad(n[3])} END
ELSE CASE WHEN length(title) NOT BETWEEN 2 AND 120 THEN '{o[0]}' WHEN length(org) NOT BETWEEN 2 AND 80 THEN '{o[1]}' WHEN category NOT IN ('prize', 'residency', 'exhibition') THEN '{o[2]}' WHEN length(source_note[1:150]) < 2 THEN '{o[3]}' WHEN url <> '' THEN {bad(o[4])} END END) AS error FROM s)
SELECT id, error, CASE WHEN error IS NULL THEN title END AS kept_title, CASE WHEN error IS NULL AND kind <> 'news' THEN org END AS kept_org, CASE WHEN error IS NULL AND kind <> 'news' THEN nullif(concat_ws(' ', nullif(city, ''), nullif(country, '')), '') END AS kept_place,
CASE WHEN error IS NULL THEN CASE kind WHEN 'news' THEN source[1:40] WHEN 'opp' THEN source_note[1:150] END END AS kept_source, CASE WHEN error IS NULL THEN CASE kind WHEN 'opp' THEN category WHEN 'job' THEN CASE WHEN employment_type = 'full-time' THEN employment_type END END END AS kept_type,
CASE WHEN error IS NULL AND kind = 'job' THEN nullif(salary, '') END AS kept_salary, CASE WHEN error IS NULL THEN CASE WHEN kind = 'news' AND deadline > '2026-08-11' THEN '2026-08-11' ELSE nullif(deadline, '') END END AS kept_day,
CASE WHEN error IS NULL THEN sha256(coalesce(summary[1:500], '')) END AS summary, CASE WHEN error IS NULL THEN nullif(url, '') END AS kept_url FROM e"""


@query(_checked_sql())
def submission_checks(t):
    """Submissions checked by kind, with the first fault or what is kept."""
    c = submission.checked(derived(t, _SUBMITTED), "2026-08-11", ["prize", "residency", "exhibition"], ["full-time"])
    summary = F.when(F.col("error").isNull(), F.sha2(F.coalesce("kept_summary", F.lit("")), 256)).alias("summary")
    return c.select("id", "error", "kept_title", "kept_org", "kept_place", "kept_source", "kept_type", "kept_salary", "kept_day", summary, "kept_url")
