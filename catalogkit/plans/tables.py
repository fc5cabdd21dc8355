"""Queries over records, events and social tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import analytics, catalog, crawl, geo, merge, ordering, social
from ..streaming import state
from .base import query, rows, values

_DAY = "(ts + INTERVAL 8 HOUR)::DATE"


def _events(t):
    return t("events").withColumn("day", dates.beijing_day(F.col("ts")))


@query("""WITH b AS (SELECT c_custkey AS id, c_custkey AS ord, c_custkey % 5 = 0 AS verified, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS cover FROM customer WHERE c_custkey % 4 <> 3),
n AS (SELECT c_custkey AS id, c_custkey + 1000000 AS ord, false AS verified, 'new ' || c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'c' END AS cover FROM customer WHERE c_custkey % 4 >= 2)
SELECT coalesce(b.id, n.id) AS id, coalesce(b.ord, n.ord) AS ord, CASE WHEN b.id IS NOT NULL AND (n.id IS NULL OR b.verified) THEN b.verified ELSE n.verified END AS verified,
CASE WHEN b.id IS NOT NULL AND (n.id IS NULL OR b.verified) THEN b.name ELSE n.name END AS name, CASE WHEN b.id IS NOT NULL AND (n.id IS NULL OR b.verified) THEN b.cover ELSE coalesce(n.cover, b.cover) END AS cover,
CASE WHEN n.id IS NULL THEN 'kept' WHEN b.id IS NULL THEN 'added' WHEN b.verified THEN 'skipped' ELSE 'updated' END AS action FROM b FULL JOIN n ON b.id = n.id""")
def upsert_keep_verified(t):
    c = t("customer")
    base = c.where("c_custkey % 4 <> 3").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"), (F.col("c_custkey") % 5 == 0).alias("verified"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("cover"))
    new = c.where("c_custkey % 4 >= 2").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") + 1000000).alias("ord"), F.lit(False).alias("verified"), F.concat(F.lit("new "), "c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "c").alias("cover"))
    return merge.upsert(base, new, "id", ["cover"])


def _side(o, cond, v, shift):
    return o.where(cond).select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % v == 0).alias("verified"), F.date_add(F.to_date("o_orderdate"), F.pmod(F.col("o_orderkey"), F.lit(3)).cast("int") - shift).cast("string").alias("stamp"), F.when(F.col("o_orderkey") % (v + 1) != 0, F.lit(f"c{v}")).alias("cover"), F.concat(F.lit("u"), F.floor(F.col("o_orderkey") / 2).cast("string")).alias("url"))


def _side_sql(cond, v, shift):
    return f"SELECT o_orderkey AS id, o_orderkey AS ord, o_orderkey % {v} = 0 AS verified, strftime(o_orderdate::DATE + ((o_orderkey % 3)::INTEGER - {shift}), '%Y-%m-%d') AS stamp, CASE WHEN o_orderkey % {v + 1} <> 0 THEN 'c{v}' END AS cover, 'u' || (o_orderkey // 2)::VARCHAR AS url FROM orders WHERE {cond}"


@query(f"""WITH l AS ({_side_sql("o_orderkey % 4 <> 0", 7, 1)}), r AS ({_side_sql("o_orderkey % 4 <> 1", 5, 0)}),
j AS (SELECT *, CASE WHEN l.id IS NULL OR (r.id IS NOT NULL AND CASE WHEN l.verified <> r.verified THEN r.verified ELSE r.stamp > l.stamp END) THEN 'remote' ELSE 'local' END AS side FROM l FULL JOIN r ON l.id = r.id),
m AS (SELECT coalesce(id, id_1) AS id, CASE side WHEN 'remote' THEN stamp_1 ELSE stamp END AS stamp, CASE side WHEN 'remote' THEN coalesce(cover_1, cover) ELSE coalesce(cover, cover_1) END AS cover,
 CASE side WHEN 'remote' THEN verified_1 ELSE verified END AS verified, CASE side WHEN 'remote' THEN url_1 ELSE url END AS url, CASE WHEN id_1 IS NOT NULL THEN 0 ELSE 1 END AS far, coalesce(ord_1, ord) AS ord, side FROM j)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY far, ord, id) AS k FROM m) WHERE k = 1""".replace("SELECT * FROM (SELECT *, row", "SELECT id, verified, stamp, cover, url, side FROM (SELECT *, row").replace("FROM l FULL JOIN r", "FROM l FULL JOIN (SELECT id AS id_1, ord AS ord_1, verified AS verified_1, stamp AS stamp_1, cover AS cover_1, url AS url_1 FROM r) r").replace("l.id = r.id)", "l.id = r.id_1)").replace("r.id IS NOT NULL", "r.id_1 IS NOT NULL").replace("l.verified <> r.verified THEN r.verified ELSE r.stamp >", "l.verified <> r.verified_1 THEN r.verified_1 ELSE r.stamp_1 >"))
def two_way_merge(t):
    o = t("orders")
    return merge.two_way(_side(o, "o_orderkey % 4 <> 0", 7, 1), _side(o, "o_orderkey % 4 <> 1", 5, 0), "id", "stamp", ["cover"], "url").select("id", "verified", "stamp", "cover", "url", "side")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity < 10)")
def tombstone_anti(t):
    gone = t("lineitem").where("l_quantity < 10").select(F.col("l_orderkey").alias("o_orderkey"))
    return merge.minus(t("orders").select("o_orderkey", "o_custkey"), gone, "o_orderkey")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0""")
def backfill_window(t):
    o = t("orders").select("o_orderkey", "o_custkey")
    return merge.backfill(o.where("o_orderkey % 3 = 0"), o, o.where("o_orderkey % 5 = 0"), "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'duplicate' WHEN o_orderdate::DATE < DATE '1996-01-01' THEN 'long-expired' WHEN o_orderstatus = 'F' AND o_orderdate::DATE < DATE '1998-01-01' THEN 'stale' END AS reason,
(o_orderkey % 10 = 0 OR o_orderdate::DATE < DATE '1996-01-01' OR (o_orderstatus = 'F' AND o_orderdate::DATE < DATE '1998-01-01')) AS archived FROM orders""")
def archive_split(t):
    day = F.to_date("o_orderdate")
    reason = F.when(F.col("o_orderkey") % 10 == 0, "duplicate").when(day < "1996-01-01", "long-expired").when((F.col("o_orderstatus") == "F") & (day < "1998-01-01"), "stale")
    return merge.split_archive(t("orders"), reason).select("o_orderkey", "reason", "archived")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(t):
    return ordering.top(t("events"), ["user_id"], [F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 12")
def retain_latest_n(t):
    return ordering.top(t("events"), ["user_id"], [F.desc("event_id")], 12).select("user_id", "event_id")


@query("""WITH e AS (SELECT event_id, user_id, event_type, CASE WHEN value > 50 THEN user_id % 7 END AS actor FROM events),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, actor ORDER BY event_id DESC) AS rn FROM e) WHERE rn = 1)
SELECT event_id, user_id, event_type, actor FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM a) WHERE k <= 6""")
def notification_upsert(t):
    e = t("events").select("event_id", "user_id", "event_type", F.when(F.col("value") > 50, F.col("user_id") % 7).alias("actor"))
    return merge.latest_by_identity(e, ["user_id", "event_type", "actor"], [F.desc("event_id")], "user_id", 6)


@query("SELECT user_id, event_id % 50 AS item, count(*) AS times FROM events WHERE event_type = 'click' GROUP BY ALL HAVING count(*) % 2 = 1")
def like_toggle(t):
    return merge.toggled(t("events").where("event_type = 'click'").select("user_id", (F.col("event_id") % 50).alias("item")), ["user_id", "item"])


@query("""SELECT event_id, event_type, turn FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS turn, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS side
FROM events WHERE event_type IN ('view', 'click')) ORDER BY turn, side LIMIT 30""")
def interleave_two_streams(t):
    e = t("events").where("event_type in ('view', 'click')")
    return ordering.interleave(e, F.when(F.col("event_type") == "view", 0).otherwise(1), [F.desc("ts"), "event_id"], 30).select("event_id", "event_type", F.col("turn").cast("long").alias("turn"))


_DAYS = "date_diff('day', DATE '1998-06-01', o_orderdate::DATE)"


@query(f"""SELECT o_orderkey, pinned, rank, row_number() OVER (ORDER BY pinned DESC, rank, o_orderkey) AS position FROM (
SELECT o_orderkey, o_orderkey IN (1, 2, 3, 7) AS pinned, CASE WHEN o_orderpriority = '1-URGENT' THEN 500000000 WHEN {_DAYS} >= 0 THEN {_DAYS} WHEN o_orderkey % 3 = 0 THEN 1000000000 + {_DAYS} ELSE 2000000000 + {_DAYS} END::BIGINT AS rank
FROM orders WHERE o_totalprice > 1000 AND (o_orderstatus IN ('O', 'P') OR o_orderkey IN (1, 2, 3, 7)))""")
def browse_filter_sort(t):
    o = t("orders").withColumn("days", F.when(F.col("o_orderpriority") != "1-URGENT", F.datediff(F.to_date("o_orderdate"), F.lit("1998-06-01").cast("date"))))
    o = o.withColumn("state", dates.item_state(F.lit("open"), F.col("days"), F.when(F.col("o_orderkey") % 3 == 0, 2)))
    q = catalog.CatalogQuery(visible=F.col("o_totalprice") > 1000, any={"o_orderstatus": ["O", "P"]}, pinned=[1, 2, 3, 7], id="o_orderkey").apply(o)
    q = q.select("o_orderkey", "pinned", catalog.deadline_rank(F.col("state"), F.col("days")).alias("rank"))
    return catalog.numbered(q, [F.desc("pinned"), F.asc("rank"), F.asc("o_orderkey")], 30).select("o_orderkey", "pinned", "rank", F.col("position").cast("long").alias("position"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30 OFFSET 60")
def browse_page(t):
    return catalog.page(t("part"), [F.desc("p_retailprice"), "p_partkey"], 3).select("p_partkey", "p_name")


@query("""SELECT o_orderkey, grp, row_number() OVER (ORDER BY grp, o_totalprice DESC, o_orderkey) AS position FROM (SELECT o_orderkey, o_totalprice, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS grp FROM orders)""")
def multi_key_priority_sort(t):
    o = t("orders").withColumn("grp", F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2))
    return catalog.numbered(o.select("o_orderkey", "o_totalprice", "grp"), [F.asc("grp"), F.desc("o_totalprice"), F.asc("o_orderkey")], 30).select("o_orderkey", "grp", F.col("position").cast("long").alias("position"))


@query("""SELECT o_orderkey, strftime(o_orderdate::DATE, '%Y-%m-%d') AS deadline FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate::DATE >= DATE '1998-06-01' AND o_orderdate::DATE <= DATE '1998-06-22' ORDER BY o_orderdate::DATE, o_orderkey LIMIT 40""")
def weekly_candidates(t):
    day = F.to_date("o_orderdate")
    return t("orders").where((F.col("o_orderstatus") != "F") & day.between("1998-06-01", "1998-06-22")).orderBy(day, "o_orderkey").limit(40).select("o_orderkey", day.cast("string").alias("deadline"))


_KINDS = ["view", "click", "purchase", "signup", "error"]


@query(f"""WITH e AS (SELECT *, {_DAY} AS day FROM events), s AS (SELECT unnest(generate_series(DATE '2024-01-25', DATE '2024-02-07', INTERVAL 1 DAY))::DATE AS day)
SELECT strftime(s.day, '%Y-%m-%d') AS day, {", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in _KINDS)}, count(DISTINCT user_id) AS visitors FROM s LEFT JOIN e ON e.day = s.day GROUP BY s.day""")
def daily_funnel_zero_fill(t):
    return analytics.daily_funnel(t("events"), _KINDS, "2024-02-07").withColumn("day", F.col("day").cast("string"))


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id ORDER BY n DESC, user_id LIMIT 12")
def top_items(t):
    return analytics.top_counts(t("events").where("event_type in ('view', 'click')"), "user_id", 12)


@query("SELECT json_extract_string(props, '$.k') AS term, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, term LIMIT 10")
def top_terms(t):
    return analytics.top_counts(t("events").select(F.get_json_object("props", "$.k").alias("term")), "term", 10)


@query("SELECT user_id, count(*) AS n, max(event_id) AS last FROM events WHERE event_type = 'error' GROUP BY user_id ORDER BY n DESC, last DESC LIMIT 20")
def zero_terms(t):
    return t("events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last")).orderBy(F.desc("n"), F.desc("last")).limit(20)


@query(f"SELECT strftime(day, '%Y-%m-%d') AS day, region, count(*) AS visitors, sum(n)::BIGINT AS events FROM (SELECT {_DAY} AS day, user_id % 5 AS region, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL")
def visitors_by_day_two_level(t):
    e = _events(t).withColumn("region", F.col("user_id") % 5)
    return analytics.visitors_two_level(e, "user_id", "region").withColumn("day", F.col("day").cast("string"))


@query(f"SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE {_DAY} = DATE '2024-01-15' GROUP BY event_type")
def today_counters(t):
    return _events(t).where("day = DATE '2024-01-15'").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent FROM events")
def rolling_rate(t):
    return analytics.rolling_count(t("events"), "user_id", "ts", 24).select("event_id", "user_id", "recent")


@query("""SELECT event_id, user_id, sum(dead) OVER (PARTITION BY user_id, island ORDER BY ts, event_id)::BIGINT AS streak FROM (SELECT *, sum(1 - dead) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island
FROM (SELECT *, (event_type = 'error')::INTEGER AS dead FROM events WHERE event_type <> 'signup'))""")
def fail_streak(t):
    return crawl.fail_streak(t("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "signup").select("event_id", "user_id", "streak")


@query("""WITH p AS (SELECT event_id, user_id, ts, (event_type = 'purchase' AND value > 60)::INTEGER AS found FROM events),
y AS (SELECT *, sum(found) OVER w AS got, sum(found) OVER w AS island FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, sum(1 - found) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM y)
SELECT event_id, user_id, CASE WHEN got >= 5 THEN 'high' WHEN streak >= 14 AND got = 0 THEN 'low' ELSE 'normal' END AS tier FROM s""")
def source_tier(t):
    return crawl.source_tier(t("events"), "user_id", ["ts", "event_id"], (F.col("event_type") == "purchase") & (F.col("value") > 60)).select("event_id", "user_id", "tier")


@query("""WITH e AS (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 7200000000)::INTEGER, 1) AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, session::BIGINT AS session, count(*) AS events, date_diff('second', min(ts), max(ts)) AS seconds FROM s GROUP BY user_id, session""")
def presence_sessions(t):
    s = analytics.sessions(t("events"), "user_id", "ts", 7200)
    return s.select("user_id", "session", "events", (F.unix_seconds(F.col("end").cast("timestamp")) - F.unix_seconds(F.col("begin").cast("timestamp"))).alias("seconds"))


@query(f"SELECT strftime({_DAY}, '%G-W%V') AS week, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def iso_week_rollup(t):
    return _events(t).groupBy(dates.iso_week(F.col("day")).alias("week"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_nationkey = 3) ON k = o_custkey LEFT JOIN customer ON c_custkey = o_custkey")
def follows_feed(t):
    follows = t("customer").select(F.col("c_nationkey").alias("follower"), F.col("c_custkey").alias("followee"))
    f = social.feed(t("orders").select("o_orderkey", "o_custkey"), follows, "o_custkey", 3)
    return f.join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left").select("o_orderkey", "o_custkey", "c_name")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AS liked FROM customer")
def liked_flag(t):
    marks = t("orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return social.flagged(t("customer").select("c_custkey"), marks, ["c_custkey"], "liked")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def isblocked_semi(t):
    return t("customer").select("c_custkey").join(t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


_FAVOURITES = [(1, "part:5"), (2, "customer:7"), (3, "part:999999"), (4, "order:1"), (5, "part:1"), (6, "nope:1")]


@query(f"""SELECT pos, key, channel, title FROM (SELECT pos, key, split_part(key, ':', 1) AS channel, split_part(key, ':', 2) AS id FROM {values(_FAVOURITES)} f(pos, key)) JOIN
(SELECT 'part' AS channel, p_partkey::VARCHAR AS id, p_name AS title FROM part UNION ALL SELECT 'customer', c_custkey::VARCHAR, c_name FROM customer UNION ALL SELECT 'order', o_orderkey::VARCHAR, o_orderstatus FROM orders) USING (channel, id)""")
def favourite_resolve(t):
    keys = rows(t, _FAVOURITES, "pos long, key string")
    return social.resolve(keys, {"part": (t("part"), "p_partkey", "p_name"), "customer": (t("customer"), "c_custkey", "c_name"), "order": (t("orders"), "o_orderkey", "o_orderstatus")})


@query("SELECT o_orderpriority, count(*) AS n, round(100.0 * count(*) FILTER (o_orderstatus = 'O') / count(*), 1) AS pct FROM orders GROUP BY 1")
def category_percent(t):
    return analytics.share(t("orders"), "o_orderpriority", F.col("o_orderstatus") == "O", "pct")


@query("""SELECT n_name, count(c_custkey) AS customers, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AS covered FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey""")
def coverage_semi_anti(t):
    n = t("nation").select("n_nationkey", "n_name")
    count = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    d = social.flagged(n, t("supplier").select(F.col("s_nationkey").alias("n_nationkey")), ["n_nationkey"], "covered")
    return d.join(count, "n_nationkey", "left").select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), "covered")


@query("SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name ORDER BY n, n_name LIMIT 6")
def scarcest_k(t):
    return t("nation").join(t("supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n")).orderBy("n", "n_name").limit(6)


@query(f"SELECT coalesce(event_type, 'all') AS event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type)")
def qc_totals_rollup(t):
    return t("events").rollup("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).withColumn("event_type", F.coalesce("event_type", F.lit("all")))


_RANGES = [(0, 999, "low"), (1000, 70000, "mid"), (70001, 200000, "high"), (900000, 16000000, "far")]


@query(f"SELECT e.event_id, e.event_id * 37 AS ip, r.name FROM events e LEFT JOIN {values(_RANGES)} r(a, b, name) ON e.event_id * 37 BETWEEN r.a AND r.b")
def ip_range_join(t):
    p = t("events").select("event_id", (F.col("event_id") * 37).alias("ip"))
    return geo.range_join(p, "ip", rows(t, _RANGES, "a long, b long, name string"), "a", "b").select("event_id", "ip", "name")


@query()
def limiter_admission(t):
    return state.admission(t("events"), "user_id", "event_id", "ts", 3, 86400)
