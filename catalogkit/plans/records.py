"""Queries over catalog records: browsing, duplicates, inspection, weekly issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, hashing, text
from ..operators import catalog, collect, evidence, ordering, quality
from .base import derived, plain, query
from .derived import RECORDS

_AS_OF = "2001-12-01"
_THIRD, _TRUSTED = ["example.net"], ["trusted.example.com"]
_REC = f"rec AS ({plain(RECORDS)})"
_KEY = r"regexp_replace(lower(coalesce({x}, '')), '[\s\x{{3000}}\x{{00A0}}·:：()（）《》\"''”“-]', '', 'g')"
_FP = f"md5({_KEY.format(x='title_zh')} || '|' || {_KEY.format(x='org_zh')} || '|' || coalesce(deadline, 'rolling'))"
_FIELDS = ["title_en", "city_zh", "country_zh", "deadline", "free", "required", "stipend", "housing", "travel"]
_COMPLETE = f"({' + '.join(f'''(coalesce({c}::VARCHAR, '') <> '')::INTEGER''' for c in _FIELDS)} + n_disciplines + CASE WHEN trust = 'verified' THEN 100 ELSE 0 END)"
_DAY = "CASE WHEN regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST({x} AS DATE) END"
_DUE = _DAY.format(x="deadline")
_LEFT = f"date_diff('day', DATE '{_AS_OF}', {_DUE})"


def _records(t):
    return derived(t, RECORDS)


def _scored(t):
    r = _records(t)
    fp = hashing.fingerprint(F.col("title_zh"), F.col("org_zh"), F.col("deadline"))
    score = hashing.completeness([F.col(c) for c in _FIELDS], F.col("trust") == "verified") + F.col("n_disciplines")
    return r.withColumn("fp", fp).withColumn("score", score.cast("long"))


@query(f"WITH {_REC} SELECT id, {_FP} AS fp, {_COMPLETE}::BIGINT AS score FROM rec")
def record_fingerprint(t):
    return _scored(t).select("id", "fp", "score")


@query(f"""WITH {_REC}, s AS (SELECT id, ord, {_FP} AS fp, {_COMPLETE}::BIGINT AS score FROM rec)
SELECT id, fp, score, "at" FROM (SELECT *, min(ord) OVER (PARTITION BY fp) AS "at", row_number() OVER (PARTITION BY fp ORDER BY score DESC, ord) AS k FROM s) WHERE k = 1""")
def record_keep_best(t):
    return ordering.keep_best(_scored(t).select("id", "ord", "fp", "score"), "fp", "score", "ord").select("id", "fp", "score", "at")


def _within(u: str, domains: list[str]) -> str:
    h = rf"regexp_replace(regexp_extract(lower({u}), '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '')"
    return "coalesce(" + " OR ".join(f"{h} = '{d}' OR ends_with({h}, '.{d}')" for d in domains) + ", false)"


_OFFICIAL = f"""coalesce(CASE WHEN NOT {_within("official_url", _THIRD + _TRUSTED)} THEN official_url END, CASE WHEN NOT {_within("url", _THIRD + _TRUSTED)} THEN url END,
CASE WHEN {_within("official_url", _TRUSTED)} THEN official_url END, CASE WHEN {_within("url", _TRUSTED)} THEN url END)"""


def _official():
    return catalog.official_url("url", "official_url", _THIRD, _TRUSTED)


@query(f"WITH {_REC} SELECT id, {_OFFICIAL} AS leads_to, CASE WHEN via = 'submit' OR trust = 'user' THEN 'user' WHEN via = 'search' THEN 'search' WHEN {_within('url', _THIRD)} THEN 'platform' ELSE 'official' END AS comes_from FROM rec")
def official_and_provenance(t):
    platform = F.when(F.regexp_like("url", F.lit("^https?://(?:[^/]*[.])?example[.]net(?:/|$)")), "example.net")
    return _records(t).select("id", _official().alias("leads_to"), catalog.provenance(F.col("via"), F.col("trust"), platform).alias("comes_from"))


_CAD = "CASE WHEN regexp_matches(coalesce(title_zh, '') || ' ' || coalesce(title_en, ''), '(?i)三年展|triennial') THEN 3 WHEN regexp_matches(coalesce(title_zh, '') || ' ' || coalesce(title_en, ''), '(?i)双年展|雙年展|biennial|biennale') THEN 2 END"
_STATE = f"CASE WHEN NOT (coalesce(status = 'expired', false) OR coalesce({_LEFT} < 0, false)) THEN 'open' WHEN {_CAD} IS NOT NULL THEN 'upcoming' ELSE 'past' END"


def _stated(df):
    title = F.concat(F.coalesce("title_zh", F.lit("")), F.lit(" "), F.coalesce("title_en", F.lit("")))
    left = F.datediff(dates.calendar_date(F.col("deadline")), F.to_date(F.lit(_AS_OF)))
    df = df.withColumn("cadence", dates.cadence(title)).withColumn("days", left)
    return df.withColumn("state", dates.item_state(F.col("status"), F.col("days"), F.col("cadence")))


@query(f"""WITH RECURSIVE {_REC}, s AS (SELECT id, {_STATE} AS state, {_LEFT} AS days, {_CAD} AS cadence, {_DUE} AS due FROM rec),
y(id, due, cadence, year) AS (SELECT id, due, cadence, year(due) FROM s WHERE due IS NOT NULL AND cadence IS NOT NULL
 UNION ALL SELECT id, due, cadence, year + cadence FROM y WHERE year::VARCHAR || strftime(due, '-%m-%d') < '{_AS_OF}'),
n AS (SELECT id, (max(year) + CASE WHEN any_value(due) >= DATE '{_AS_OF}' THEN any_value(cadence) ELSE 0 END)::INTEGER AS next_year FROM y GROUP BY id)
SELECT s.id, state, CASE WHEN days IS NULL THEN 'rolling' WHEN days < 0 THEN 'past' WHEN days = 0 THEN 'today' WHEN days <= 7 THEN 'week' WHEN days <= 30 THEN 'month' ELSE 'later' END AS band, next_year FROM s LEFT JOIN n ON n.id = s.id""")
def record_state(t):
    r = _stated(_records(t))
    coming = F.when(F.col("cadence").isNotNull() & F.col("days").isNotNull(), dates.next_edition(dates.calendar_date(F.col("deadline")), F.col("cadence"), _AS_OF))
    return r.select("id", "state", dates.deadline_band(F.col("days")).alias("band"), coming.cast("int").alias("next_year"))


_REGION = """CASE WHEN regexp_matches(coalesce(country_zh, ''), '香港|澳门|台湾|台北|高雄') OR regexp_matches(coalesce(city_zh, ''), '香港|澳门|台北|高雄|台中|台南') THEN 'hktw' WHEN country_zh = '中国' THEN 'cn'
WHEN regexp_matches(coalesce(country_zh, ''), '日本|韩国|新加坡|印度|泰国|越南|马来|菲律宾|印尼|蒙古|哈萨克') THEN 'asia'
WHEN regexp_matches(coalesce(country_zh, ''), '法国|德国|荷兰|英国|意大利|西班牙|瑞士|比利时|奥地利|斯洛文尼亚|瑞典|挪威|芬兰|丹麦|波兰|葡萄牙|捷克|匈牙利|希腊|爱尔兰|冰岛|克罗地亚') THEN 'europe'
WHEN regexp_matches(coalesce(country_zh, ''), '美国|加拿大|墨西哥') THEN 'namerica' ELSE 'other' END"""


def _region():
    from ..operators import geo

    return geo.region(F.col("country_zh"), F.col("city_zh"))


@query(f"WITH {_REC} SELECT {_REGION} AS region, count(*) AS n, count(*) FILTER (free AND NOT required) AS fully_free, count(*) FILTER (stipend AND housing) AS funded FROM rec GROUP BY 1")
def region_rollup(t):
    free = catalog.fully_free(F.col("free"), F.col("required"))
    return _records(t).groupBy(_region().alias("region")).agg(F.count("*").alias("n"), F.count_if(free).alias("fully_free"), F.count_if(F.col("stipend") & F.col("housing")).alias("funded"))


_SHOWN = f"coalesce(status <> 'dead', true) AND ({_OFFICIAL} IS NOT NULL OR coalesce(trust = 'user', false))"


@query(f"""WITH {_REC}, v AS (SELECT *, {_STATE} AS state, {_LEFT} AS days, id IN (5, 34, 68) AS pinned, {_REGION} AS region FROM rec WHERE {_SHOWN}),
f AS (SELECT * FROM v WHERE pinned OR (category = 'residency' AND state <> 'past' AND NOT coalesce(via = 'search', false) AND region IN ('cn', 'europe', 'asia', 'hktw') AND coalesce(stipend, false) AND coalesce(housing, false)
 AND contains(lower(concat_ws(' ', nullif(title_zh, ''), nullif(title_en, ''), nullif(org_zh, ''))), 'org (')))
SELECT id, pinned, state, CASE WHEN state = 'open' THEN coalesce(days, 500000000) WHEN state = 'upcoming' THEN 1000000000 + coalesce(days, 0) ELSE 2000000000 + coalesce(days, 0) END::BIGINT AS rank,
row_number() OVER (ORDER BY pinned DESC, CASE WHEN state = 'open' THEN coalesce(days, 500000000) WHEN state = 'upcoming' THEN 1000000000 + coalesce(days, 0) ELSE 2000000000 + coalesce(days, 0) END, ord) AS position FROM f""")
def catalog_browse(t):
    r = _stated(_records(t)).withColumn("region", _region()).withColumn("from_search", F.coalesce(F.col("via") == "search", F.lit(False)))
    shown = F.coalesce(F.col("status") != "dead", F.lit(True)) & (_official().isNotNull() | F.coalesce(F.col("trust") == "user", F.lit(False)))
    q = catalog.CatalogQuery(visible=shown, any={"category": ["residency"], "state": ["open", "upcoming"], "from_search": [False], "region": ["cn", "europe", "asia", "hktw"]}, every=["stipend", "housing"], keyword="ORG (", searched=["title_zh", "title_en", "org_zh"], pinned=[5, 34, 68])
    q = q.apply(r).withColumn("rank", catalog.deadline_rank(F.col("state"), F.col("days")))
    q = catalog.numbered(q.select("id", "ord", "pinned", "state", "rank"), [F.desc("pinned"), F.asc("rank"), F.asc("ord")], 30)
    return q.select("id", "pinned", "state", "rank", F.col("position").cast("long").alias("position"))


@query(f"""WITH {_REC}, v AS (SELECT *, {_STATE} AS state, id IN (15, 48, 63) AS pinned FROM rec WHERE {_SHOWN} AND owner IN (SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 0))
SELECT id, pinned FROM v WHERE pinned OR (state <> 'upcoming' AND NOT (coalesce(trust = 'user', false) OR coalesce(via = 'submit', false)) AND (id % 3 = 1 OR id % 5 = 1) AND owner % 4 IN (0, 2) AND coalesce(free AND NOT required, false) AND trust IN ('verified', 'auto'))""")
def catalog_facets(t):
    """Browsing what a person likes by tag, kind of organiser, provenance, trust, and whether it is free of charge."""
    r = _stated(_records(t)).withColumn("tags", F.array(F.concat(F.lit("a"), F.col("id") % 3), F.when(F.col("id") % 5 == 1, F.lit("a1")))).withColumn("org_type", F.col("owner") % 4)
    by_user = F.coalesce(F.col("trust") == "user", F.lit(False)) | F.coalesce(F.col("via") == "submit", F.lit(False))
    r = r.withColumn("by_user", by_user).withColumn("fully_free", catalog.fully_free(F.col("free"), F.col("required")))
    shown = F.coalesce(F.col("status") != "dead", F.lit(True)) & (_official().isNotNull() | F.coalesce(F.col("trust") == "user", F.lit(False)))
    liked = t("customer").where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("owner"))
    liked = r.join(liked, "owner", "left_semi").select("id")
    q = catalog.CatalogQuery(visible=shown, favourites=liked, any={"state": ["open", "past"], "by_user": [False], "org_type": [0, 2], "trust": ["verified", "auto"]}, holds={"tags": "a1"}, every=["fully_free"], pinned=[15, 48, 63])
    return q.apply(r).select("id", "pinned")


@query(f"WITH {_REC}, s AS (SELECT id, ord, coalesce(nullif(title_zh, ''), nullif(title_en, ''), '') AS shown FROM rec) SELECT id, shown FROM s WHERE contains(lower(shown), 'triennial 7') ORDER BY ord LIMIT 5")
def title_suggestion(t):
    return catalog.suggestions(_records(t), ["title_zh", "title_en"], "Triennial 7", ["ord"]).select("id", "shown")


@query(f"WITH {_REC} SELECT count(*) AS total, count(*) FILTER (coalesce(status <> 'dead', true)) AS alive, count(url) AS with_url, count({_OFFICIAL}) AS official, count(*) FILTER ({_SHOWN}) AS shown FROM rec")
def visibility_funnel(t):
    return quality.visibility_funnel(_records(t), "url", _official())


_INSPECT = f"""s AS (SELECT *, {_FP} AS fp, {_COMPLETE}::BIGINT AS score FROM rec),
w AS (SELECT *, count(*) OVER (PARTITION BY fp) AS size, first_value(ord) OVER (PARTITION BY fp ORDER BY score DESC, ord) AS best FROM s),
q AS (SELECT *, size > 1 AND best <> ord AS dup, date_diff('day', {_DUE}, DATE '{_AS_OF}') AS over FROM w),
i AS (SELECT *, CASE WHEN trust <> 'verified' THEN CASE WHEN dup THEN 'duplicate' WHEN over > 365 THEN 'long-expired' END END AS reason, coalesce({_DUE} < DATE '{_AS_OF}' AND status = 'open', false) AS expires FROM q)"""


def _inspected(t):
    d = quality.marked_duplicates(_scored(t), "fp", "score", "ord")
    return d.withColumn("reason", quality.archive_reason("opportunity", _AS_OF, F.col("duplicate"))).withColumn("expires", quality.newly_expired(d, _AS_OF))


@query(f"WITH {_REC}, {_INSPECT} SELECT id, CASE WHEN size > 1 THEN best END AS keeper, reason, expires FROM i")
def qc_inspect(t):
    return _inspected(t).select("id", "keeper", "reason", "expires")


@query(f"WITH {_REC}, {_INSPECT} SELECT reason, count(*) AS n, array_to_string((list(id ORDER BY id))[:CASE reason WHEN 'duplicate' THEN 100 ELSE 300 END], ',') AS ids FROM i WHERE reason IS NOT NULL GROUP BY reason")
def qc_report(t):
    r = quality.capped_lists(_inspected(t).where("reason is not null"), "reason", "id", {"duplicate": 100, "long-expired": 300})
    return r.select("reason", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"""WITH {_REC}, {_INSPECT} SELECT 'stays' AS side, count(*) AS n FROM i WHERE reason IS NULL UNION ALL SELECT 'recycle', count(*) FROM i WHERE reason IS NOT NULL
UNION ALL SELECT 'restored', count(*) FROM i WHERE reason IS NULL OR reason = 'duplicate' UNION ALL SELECT 'tombstones', count(*) FROM i WHERE reason IS NOT NULL UNION ALL SELECT 'after purge', 0""")
def archive_restore(t):
    from ..operators import merge
    from ..operators.scratch import fixed

    # inspected once, not for each side, and no more of a record than its id and reason
    live, bin_, tombs = merge.archive(fixed(_inspected(t).select("id", "reason")), "id", F.col("reason"))
    back, _, _ = merge.restore(live, bin_, tombs, "id", F.col("reason") == "duplicate")
    left, kept = merge.purge(bin_, tombs, F.lit(True))
    counts = [("stays", live), ("recycle", bin_), ("restored", back), ("tombstones", kept), ("after purge", left)]
    out = None
    for name, df in counts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_REC}, e AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'dead' WHEN 'signup' THEN 'unknown' ELSE 'alive' END AS verdict FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM e) WHERE k = 1),
j AS (SELECT rec.id, rec.status, rec.deadline, l.verdict, rec.id % 4 AS streak FROM rec LEFT JOIN l ON l.user_id = rec.id),
n AS (SELECT *, CASE verdict WHEN 'dead' THEN streak + 1 WHEN 'alive' THEN 0 ELSE streak END AS new_streak FROM j)
SELECT id, new_streak::INTEGER AS new_streak, CASE WHEN verdict = 'dead' AND new_streak >= 3 THEN 'dead' WHEN verdict = 'alive' AND status = 'dead' THEN CASE WHEN {_DUE} < DATE '{_AS_OF}' THEN 'expired' ELSE 'open' END ELSE status END AS new_status,
coalesce(verdict = 'alive' AND status = 'dead', false) AS revived FROM n""")
def probe_effects(t):
    e = t("events").withColumn("verdict", F.when(F.col("event_type") == "error", "dead").when(F.col("event_type") == "signup", "unknown").otherwise("alive"))
    last = ordering.top(e, ["user_id"], [F.desc("event_id")]).select(F.col("user_id").alias("id"), "verdict")
    r = _records(t).join(last, "id", "left").withColumn("fail_streak", F.col("id") % 4)
    return quality.after_probe(r, _AS_OF).select("id", F.col("new_streak").cast("int").alias("new_streak"), "new_status", "revived")


@query(f"WITH {_REC} SELECT id, last_seen FROM rec WHERE url IS NOT NULL AND status <> 'dead' ORDER BY coalesce(last_seen, ''), ord LIMIT 6")
def audit_rotation(t):
    return quality.audit_sample(_records(t).where("url is not null and status <> 'dead'"), "last_seen", ["ord"]).select("id", "last_seen")


@query(f"""WITH {_REC} SELECT id, deadline FROM rec WHERE {_OFFICIAL} IS NOT NULL AND NOT coalesce(deadline < '{_AS_OF}', false) AND (greatest(coalesce(updated_at, ''), coalesce(last_seen, '')) >= '2001-11-24' OR coalesce(deadline <= '2001-12-22', false))
ORDER BY deadline NULLS LAST, ord LIMIT 40""")
def weekly_opportunities(t):
    return collect.weekly_opportunities(_records(t), _AS_OF, _official()).select("id", "deadline")


@query(f"""WITH {_REC}, n AS (SELECT id, ord, title_zh AS title, CASE WHEN id % 3 = 0 THEN '' ELSE updated_at END AS published_at, last_seen AS added_at, org_zh FROM rec),
w AS (SELECT *, CASE WHEN org_zh = 'Org (1)' OR regexp_matches(title, '[㐀-鿿]') THEN 1 ELSE 0 END AS side FROM n WHERE coalesce(nullif(published_at, ''), nullif(added_at, ''), '') >= '2001-07-10'),
k AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY coalesce(published_at, '') DESC, ord) AS turn FROM w) SELECT id, side, turn FROM k WHERE turn <= 30 ORDER BY turn, side LIMIT 30""")
def weekly_news(t):
    n = _records(t).select("id", "ord", F.col("title_zh").alias("title"), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("updated_at")).alias("published_at"), F.col("last_seen").alias("added_at"), "org_zh")
    return collect.weekly_news(n, "2001-07-20", F.col("org_zh") == "Org (1)").select("id", "side", F.col("turn").cast("long").alias("turn"))


@query(f"""WITH {_REC} SELECT id, coalesce(nullif(updated_at, ''), last_seen, '') >= '2001-11-17' AS fresh FROM rec WHERE NOT coalesce(regexp_matches(deadline, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND deadline < '{_AS_OF}', false) ORDER BY fresh DESC, ord LIMIT 30""")
def weekly_jobs(t):
    j = _records(t).withColumnsRenamed({"updated_at": "posted_at", "last_seen": "added_at"})
    return collect.weekly_jobs(j, _AS_OF).select("id", "fresh")


@query(f"""WITH {_REC}, j AS (SELECT *, CASE WHEN {_DAY.format(x="last_seen")} IS NOT NULL THEN last_seen ELSE updated_at END AS added FROM rec)
SELECT id, CASE WHEN trust <> 'verified' THEN CASE WHEN {_DUE} IS NOT NULL THEN CASE WHEN date_diff('day', {_DUE}, DATE '{_AS_OF}') > 60 THEN 'job-expired' END WHEN date_diff('day', added::DATE, DATE '{_AS_OF}') > 120 THEN 'job-stale' END END AS job,
CASE WHEN trust <> 'verified' AND date_diff('day', updated_at::DATE, DATE '{_AS_OF}') > 730 THEN 'news-too-old' END AS news FROM j""")
def job_and_news_archive(t):
    r = _records(t).withColumn("added_at", F.col("last_seen")).withColumn("posted_at", F.lit(None).cast("string")).withColumn("published_at", F.col("updated_at"))
    job = quality.archive_reason("job", _AS_OF, F.lit(False))
    news = r.withColumn("added_at", F.lit(None).cast("string"))
    return r.select("id", job.alias("job")).join(news.select("id", quality.archive_reason("news", _AS_OF, F.lit(False)).alias("news")), "id")


@query(f"""WITH {_REC}, o AS (SELECT id, contains(official_url, 'trusted') AS platform, ord FROM rec WHERE official_url IS NOT NULL)
SELECT id, row_number() OVER (ORDER BY platform, ord) AS place FROM o ORDER BY platform, ord LIMIT 50""")
def official_first(t):
    o = _records(t).where("official_url is not null").withColumn("platform", F.contains("official_url", F.lit("trusted")))
    return catalog.numbered(o.select("id", "ord", "platform").orderBy("platform", "ord").limit(50), ["platform", "ord"], 30).select("id", F.col("position").cast("long").alias("place"))


@query(f"""WITH {_REC}, c AS (SELECT id, ord, owner, stipend AS added FROM rec), k AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ord) AS rn FROM c),
b AS (SELECT *, coalesce(sum(added::INTEGER) OVER (PARTITION BY owner ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k WHERE rn <= 16) SELECT id, owner FROM b WHERE before < 3""")
def early_stop(t):
    from ..operators import crawl

    return crawl.early_stop(_records(t).select("id", "ord", "owner", "stipend"), "owner", ["ord"], F.col("stipend"), 3).select("id", "owner")


@query(f"""WITH {_REC} SELECT id, array_to_string(list_filter([CASE WHEN length(coalesce(title_en, '')) < 4 THEN 'title' END, CASE WHEN country_zh IS NULL THEN 'country' END, CASE WHEN deadline IS NOT NULL AND {_DUE} IS NULL THEN 'deadline' END,
CASE WHEN category NOT IN ('prize', 'residency') THEN 'category' END, CASE WHEN url IS NOT NULL AND NOT regexp_matches(url, '^https?://[^/]+') THEN 'url' END], lambda x: x IS NOT NULL), ',') AS faults FROM rec""")
def submission_faults(t):
    ok = [
        ("title", F.length(F.coalesce("title_en", F.lit(""))) >= 4), ("country", F.col("country_zh").isNotNull()), ("deadline", F.col("deadline").isNull() | dates.calendar_date(F.col("deadline")).isNotNull()),
        ("category", F.col("category").isin("prize", "residency")), ("url", F.col("url").isNull() | F.col("url").rlike("^https?://[^/]+")),
    ]
    return _records(t).select("id", F.array_join(evidence.reasons(ok), ",").alias("faults"))


@query(f"WITH {_REC} SELECT id, array_to_string(list_filter([CASE WHEN free THEN 'free' END, CASE WHEN NOT free THEN 'fee' END, CASE WHEN free IS NULL THEN 'unknown' END, CASE WHEN required THEN 'part-fee' END, CASE WHEN stipend THEN 'stipend' END, CASE WHEN housing THEN 'housing' END, CASE WHEN travel THEN 'travel' END], lambda x: x IS NOT NULL), ',') AS badges FROM rec")
def record_badges(t):
    b = [("free", F.col("free")), ("fee", ~F.col("free")), ("unknown", F.col("free").isNull()), ("part-fee", F.col("required")), ("stipend", F.col("stipend")), ("housing", F.col("housing")), ("travel", F.col("travel"))]
    return _records(t).select("id", F.array_join(catalog.badges(b), ",").alias("badges"))


@query(f"WITH {_REC} SELECT id, regexp_matches(coalesce(title_zh, ''), '[㐀-鿿]') AND (coalesce(title_en, '') = '' OR id % 5 = 0) AS needed FROM rec")
def needs_translation(t):
    need = text.has_cjk(F.coalesce("title_zh", F.lit(""))) & ((F.coalesce("title_en", F.lit("")) == "") | (F.col("id") % 5 == 0))
    return _records(t).select("id", need.alias("needed"))
