"""Queries over people, messages and counts for the back office."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, collect, merge, ordering, social
from .base import derived, plain, query
from .derived import RECORDS


@query("SELECT event_id % 500 AS work, count(*) AS likes FROM events WHERE event_type = 'click' GROUP BY 1")
def likes_per_work(t):
    return t("events").where("event_type = 'click'").groupBy((F.col("event_id") % 500).alias("work")).agg(F.count("*").alias("likes"))


_ACTION = "CASE event_type WHEN 'view' THEN 'auto-approved:a' WHEN 'click' THEN 'created:review' WHEN 'purchase' THEN 'created:reject' WHEN 'signup' THEN 'decided:no' ELSE 'reported' END"


@query(f"""WITH m AS (SELECT {_ACTION} AS action FROM events WHERE ts > TIMESTAMP '2024-01-09 00:00:00') SELECT count(*) FILTER (starts_with(action, 'auto-approved')) AS auto, count(*) FILTER (starts_with(action, 'created:review') OR starts_with(action, 'created:reject')) AS pending,
count(*) FILTER (starts_with(action, 'decided:')) AS decided, count(*) FILTER (starts_with(action, 'reported')) AS reported, count(*) AS total FROM m""")
def moderation_work(t):
    m = t("events").where("ts > timestamp_ntz'2024-01-09 00:00:00'").select(F.expr(_ACTION).alias("action"))
    return analytics.prefix_counts(m, "action", {"auto": ["auto-approved"], "pending": ["created:review", "created:reject"], "decided": ["decided:"], "reported": ["reported"]})


@query("SELECT count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 200000) AS unread, count(*) FILTER (o_orderstatus = 'F') AS approved FROM orders")
def inbox_counts(t):
    s = F.col("o_orderstatus")
    return t("orders").agg(F.count_if(s == "P").alias("pending"), F.count_if((s == "O") & (F.col("o_totalprice") > 200000)).alias("unread"), F.count_if(s == "F").alias("approved"))


_SENDS = "SELECT event_id AS id, event_id % 6 AS issue, user_id AS address, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS ok FROM {events}"


@query(f"SELECT issue, sum(ok)::BIGINT AS ok, count(*) AS total, count(DISTINCT CASE WHEN ok = 1 THEN address END) AS reached FROM ({plain(_SENDS)}) GROUP BY issue")
def newsletter_sent(t):
    return analytics.sent_stats(derived(t, _SENDS), "issue")


@query(f"""SELECT c_custkey AS address, c_custkey % 3 = 0 AS verified FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT address FROM ({plain(_SENDS)}) WHERE issue = 4 AND ok = 1) ORDER BY verified DESC, c_custkey""")
def newsletter_audience(t):
    p = t("customer").select(F.col("c_custkey").alias("address"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3 == 0).alias("verified"), (F.col("c_custkey") % 2 == 0).alias("subscribed"))
    return social.audience(p, derived(t, _SENDS), 4).select("address", "verified")


_FOLLOWS = "SELECT user_id AS follower, event_id % 200 AS followee, max(event_id) AS stamp FROM {events} WHERE event_type = 'view' GROUP BY user_id, event_id % 200"


@query(f"""WITH f AS ({plain(_FOLLOWS)}) SELECT c_custkey AS uid, (SELECT count(*) FROM f WHERE followee = c_custkey) AS followers, (SELECT count(*) FROM f WHERE follower = c_custkey) AS following, c_custkey IN (SELECT followee FROM f WHERE follower = 7) AS is_following FROM customer""")
def follow_info(t):
    return social.follow_info(t("customer").select(F.col("c_custkey").alias("uid")), derived(t, _FOLLOWS), "uid", 7)


_BLOCKS = "SELECT user_id AS blocker, event_id % 200 AS blocked, max(event_id) AS stamp FROM {events} WHERE event_type = 'error' GROUP BY user_id, event_id % 200"


@query(f"""WITH f AS ({plain(_FOLLOWS)}), b AS ({plain(_BLOCKS)}) SELECT follower, followee, stamp FROM f WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.stamp >= f.stamp AND ((b.blocker = f.follower AND b.blocked = f.followee) OR (b.blocker = f.followee AND b.blocked = f.follower)))""")
def follows_after_blocks(t):
    return merge.follows_after_blocks(derived(t, _FOLLOWS).withColumnRenamed("stamp", "at"), derived(t, _BLOCKS).withColumnRenamed("stamp", "at")).select("follower", "followee", F.col("at").alias("stamp"))


@query("SELECT user_id, item, event_type AS action FROM (SELECT user_id, event_id % 20 AS item, event_type, row_number() OVER (PARTITION BY user_id, event_id % 20 ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def last_action(t):
    return merge.last_action(t("events").withColumn("item", F.col("event_id") % 20), ["user_id", "item"], "event_id", "event_type").select("user_id", "item", F.col("event_type").alias("action"))


@query("""WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 2 = 0 THEN 'serper' ELSE 'brave' END AS source, CASE WHEN event_type = 'error' THEN 'other' ELSE event_type END AS who, event_id % 5 = 0 AS cached FROM events),
n AS (SELECT day, source, who, count(*) FILTER (NOT cached) AS n, count(*) FILTER (cached) AS h FROM c GROUP BY ALL)
SELECT day, source, sum(n)::BIGINT AS used, sum(h)::BIGINT AS hits, string_agg(who || '=' || n::VARCHAR, ',' ORDER BY who) FILTER (n > 0) AS callers FROM n GROUP BY ALL""")
def search_budget(t):
    c = t("events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(F.col("event_id") % 2 == 0, "serper").otherwise("brave").alias("source"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("who"), (F.col("event_id") % 5 == 0).alias("cached"))
    b = analytics.budget_use(c, "day", "source", "who", "cached")
    return b.select("day", "source", "used", "hits", F.array_join(F.transform(F.map_entries("by"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("callers"))


@query("""WITH s AS (SELECT user_id % 14 AS region, event_id AS id, event_id % 17 AS probed, event_id % 3 AS added, event_type <> 'error' AS ok FROM events)
SELECT region, count(*) AS shifts, sum(probed)::BIGINT AS probed, sum(added)::BIGINT AS added, count(*) FILTER (NOT ok) AS fails, array_to_string((list(id ORDER BY id DESC))[:12], ',') AS recent FROM s GROUP BY region""")
def region_score_cards(t):
    s = t("events").select((F.col("user_id") % 14).alias("region"), F.col("event_id").alias("id"), (F.col("event_id") % 17).alias("probed"), (F.col("event_id") % 3).alias("added"), (F.col("event_type") != "error").alias("ok"))
    return analytics.score_cards(s, "region", F.col("id")).withColumn("recent", F.array_join(F.col("recent").cast("array<string>"), ","))


@query("""SELECT n_nationkey AS region, coalesce(a.added, 0) AS added, coalesce(s.n, 0) AS sources FROM nation LEFT JOIN (SELECT user_id % 25 AS k, sum(event_id % 3)::BIGINT AS added FROM events GROUP BY 1) a ON a.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON s.k = n_nationkey""")
def region_roster(t):
    a = t("events").groupBy((F.col("user_id") % 25).alias("k")).agg(F.sum(F.col("event_id") % 3).alias("added"))
    s = t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    n = t("nation").select(F.col("n_nationkey").alias("k"))
    return n.join(a, "k", "left").join(s, "k", "left").select(F.col("k").alias("region"), F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("n", F.lit(0)).alias("sources"))



@query("SELECT sum(n)::BIGINT AS total, max(n) AS most FROM (SELECT user_id, least(count(DISTINCT event_id % 40), 5) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id)")
def favourites_total(t):
    f = t("events").where("event_type = 'purchase'").groupBy("user_id").agg(F.slice(F.collect_set(F.col("event_id") % 40), 1, 5).alias("favorites"))
    return f.agg(F.sum(F.size("favorites")).alias("total"), F.max(F.size("favorites").cast("long")).alias("most"))


@query("""SELECT o_orderstatus AS channel, n + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS declared, n AS actual, o_orderstatus <> 'P' AS agrees FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)""")
def channel_counts(t):
    o = t("orders").select(F.col("o_orderstatus").alias("channel"))
    declared = o.groupBy("channel").agg((F.count("*") + F.max((F.col("channel") == "P").cast("int"))).alias("declared"))
    return analytics.declared_and_actual(declared, o, "channel")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def last_events(t):
    return t("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(30).select("event_id", "event_type")


@query("""WITH e AS (SELECT event_id AS id, user_id % 300 AS q, ts FROM events WHERE ts > TIMESTAMP '2024-01-08 00:00:00' - INTERVAL 7 DAY), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY ts DESC, id DESC) AS k FROM e) SELECT id, q FROM k WHERE k = 1 ORDER BY ts DESC, id DESC LIMIT 60""")
def search_cache(t):
    c = t("events").select(F.col("event_id").alias("id"), (F.col("user_id") % 300).alias("q"), F.col("ts").cast("timestamp").alias("ts"))
    return analytics.recent_hits(c, "q", "ts", "2024-01-08 00:00:00", 7, 60).select("id", "q")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND contains(regexp_replace(lower(c_name), '\\s+', '', 'g'), 'mer#00000012') ORDER BY c_custkey LIMIT 12")
def people_search(t):
    return social.people_named(t("customer"), "c_name", "MER #00000012", F.col("c_acctbal") > 0, ["c_custkey"]).select("c_custkey", "c_name")


@query("""WITH c AS (SELECT o_orderkey AS id, o_custkey AS uid, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'pending' ELSE 'rejected' END AS status FROM orders)
SELECT id, uid, status FROM c WHERE (status = 'approved' OR (status = 'pending' AND uid = 7)) AND uid NOT IN (SELECT blocked FROM (SELECT 7 AS blocker, c_custkey AS blocked FROM customer WHERE c_custkey % 3 = 0))""")
def visible_comments(t):
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "pending").otherwise("rejected")
    c = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("uid"), status.alias("status"))
    blocks = t("customer").where("c_custkey % 3 = 0").select(F.lit(7).alias("blocker"), F.col("c_custkey").alias("blocked"))
    return social.without_blocked(social.visible_comments(c, 7), blocks, 7, "uid").select("id", "uid", "status")


@query("""SELECT o_orderkey AS id, o_orderstatus AS status FROM orders ORDER BY o_orderstatus = 'P' DESC, o_orderkey DESC LIMIT 200""")
def pending_first(t):
    return t("orders").orderBy((F.col("o_orderstatus") == "P").desc(), F.desc("o_orderkey")).limit(200).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


@query("""SELECT user_id, n AS reports, last AS id FROM (SELECT user_id, count(*) AS n, max(event_id) AS last FROM events WHERE event_type = 'error' GROUP BY user_id) ORDER BY n DESC, last DESC LIMIT 50""")
def most_reported(t):
    r = t("events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("reports"), F.max("event_id").alias("id"))
    return r.orderBy(F.desc("reports"), F.desc("id")).limit(50)


@query("""WITH i AS (SELECT DISTINCT (event_id % 3000)::VARCHAR AS id FROM events) SELECT id, coalesce(p_name, c_name, o_orderstatus) AS title FROM i LEFT JOIN part ON p_partkey::VARCHAR = id LEFT JOIN customer ON c_custkey::VARCHAR = id LEFT JOIN orders ON o_orderkey::VARCHAR = id""")
def item_titles(t):
    i = t("events").select((F.col("event_id") % 3000).cast("string").alias("id")).distinct()
    return social.titles_by_id(i, [(t("part"), "p_partkey", "p_name"), (t("customer"), "c_custkey", "c_name"), (t("orders"), "o_orderkey", "o_orderstatus")])


@query("""WITH r AS (SELECT o_custkey % 60 AS batch, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey % 60 ORDER BY o_orderkey) AS pos FROM orders),
b AS (SELECT batch, pos, CASE batch % 3 WHEN 0 THEN id WHEN 1 THEN id + 1000000 ELSE id - pos % 2 END AS id, 't' || pos::VARCHAR AS text FROM r),
k AS (SELECT b.batch, count(b.id) = count(DISTINCT b.id) AS sound, count(r.id) = 0 AS by_pos FROM b LEFT JOIN r ON r.batch = b.batch AND r.id = b.id GROUP BY b.batch)
SELECT r.batch, r.pos, r.id, b.text FROM r JOIN k ON k.batch = r.batch AND k.sound JOIN b ON b.batch = r.batch AND CASE WHEN k.by_pos THEN b.pos = r.pos ELSE b.id = r.id END""")
def translation_batches(t):
    r = ordering.ranked(t("orders").select((F.col("o_custkey") % 60).alias("batch"), F.col("o_orderkey").alias("id")), ["batch"], ["id"], "pos").withColumn("pos", F.col("pos").cast("long"))
    told = F.when(F.col("batch") % 3 == 0, F.col("id")).when(F.col("batch") % 3 == 1, F.col("id") + 1000000).otherwise(F.col("id") - F.col("pos") % 2)
    b = r.select("batch", "pos", told.alias("id"), F.concat(F.lit("t"), F.col("pos").cast("string")).alias("text"))
    return social.translations(b, r)


@query("""WITH b AS (SELECT o_orderkey AS id, 'u' || (o_custkey % 400)::VARCHAR AS url FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'u' || (o_custkey % 800)::VARCHAR END AS url FROM orders WHERE o_orderkey % 3 = 0)
SELECT id, url FROM n WHERE id NOT IN (SELECT id FROM b) AND (url IS NULL OR url NOT IN (SELECT url FROM b))""")
def channel_append(t):
    o = t("orders")
    b = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("u"), (F.col("o_custkey") % 400).cast("string")).alias("url"))
    n = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("u"), (F.col("o_custkey") % 800).cast("string"))).alias("url"))
    return merge.append_new(b, n, "id", "url")


@query("""WITH l AS (SELECT o_orderkey AS id, 'l' || o_custkey::VARCHAR AS at FROM orders WHERE o_orderkey % 2 = 0), r AS (SELECT o_orderkey AS id, 'r' || o_custkey::VARCHAR AS at FROM orders WHERE o_orderkey % 3 = 0) SELECT coalesce(l.id, r.id) AS id, coalesce(r.at, l.at) AS at FROM l FULL JOIN r ON l.id = r.id""")
def tombstone_union(t):
    side = lambda k, p: t("orders").where(F.col("o_orderkey") % k == 0).select(F.col("o_orderkey").alias("id"), F.concat(F.lit(p), F.col("o_custkey").cast("string")).alias("at"))
    return merge.tombstone_union([side(2, "l"), side(3, "r")], ["id"], "at")


@query("""SELECT week, ord AS id FROM (SELECT strftime(o_orderdate, '%G-W%V') AS week, o_orderkey AS ord, row_number() OVER (PARTITION BY strftime(o_orderdate, '%G-W%V') ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1 ORDER BY week DESC LIMIT 120""")
def issue_index(t):
    from ..functions.dates import iso_week

    i = t("orders").select(iso_week(F.to_date("o_orderdate")).alias("week"), F.col("o_orderkey").alias("ord"))
    return collect.kept_issues(i, "week").select("week", F.col("ord").alias("id"))


_CLUE = r"regexp_replace(lower({x}), '[\s《》「」【】''\"·・—()（）“”‘’-]', '', 'g')"


@query(f"""WITH rec AS ({plain(RECORDS)}), c AS (SELECT c_custkey AS id, c_custkey % 30 AS batch, CASE c_custkey % 5 WHEN 0 THEN 'Triennial ' || (c_custkey % 90)::VARCHAR WHEN 1 THEN 'abc' WHEN 2 THEN '《a》b c' WHEN 3 THEN 'Unheard Prize ' || c_custkey::VARCHAR ELSE 'Never told' END AS name FROM customer),
h AS (SELECT batch, string_agg(name || ' seen', chr(10)) AS hay FROM c WHERE name <> 'Never told' GROUP BY batch), f AS (SELECT c.*, {_CLUE.format(x="name")} AS fp, coalesce(contains(hay, name), false) AS told FROM c LEFT JOIN h USING (batch)),
lib AS (SELECT DISTINCT {_CLUE.format(x="title_zh")} AS t FROM rec)
SELECT id, CASE WHEN length(name) < 4 OR NOT told THEN 'invented' WHEN fp IN (SELECT {_CLUE.format(x="'Unheard Prize ' || c_custkey::VARCHAR")} FROM customer WHERE c_custkey % 10 = 3) THEN 'tried'
WHEN length(fp) < 4 OR EXISTS (SELECT 1 FROM lib WHERE contains(t, fp)) THEN 'known' ELSE 'fresh' END AS verdict FROM f""")
def clue_verdicts(t):
    k, c = F.col("c_custkey"), t("customer")
    name = F.when(k % 5 == 0, F.concat(F.lit("Triennial "), (k % 90).cast("string"))).when(k % 5 == 1, "abc").when(k % 5 == 2, "《a》b c").when(k % 5 == 3, F.concat(F.lit("Unheard Prize "), k.cast("string"))).otherwise("Never told")
    clues = c.select(k.alias("id"), (k % 30).alias("batch"), name.alias("name"))
    hits = clues.where("name <> 'Never told'").select("batch", "name", F.lit("seen").alias("snippet")).withColumnRenamed("name", "title")
    tried = clues.where("id % 10 = 3").select(collect.clue_text(F.col("name")).alias("fp"))
    return collect.clue_verdicts(clues, hits, tried, derived(t, RECORDS).select(F.col("title_zh").alias("title"))).select("id", "verdict")


@query("""SELECT p_partkey, array_to_string((list_filter(['oil', 'ink', 'clay', 'film'], lambda x: list_contains(['film', 'oil', p_brand, 'clay', 'oil', 'ink'], x)))[:3], ',') AS tags FROM part""")
def work_tags(t):
    allowed = F.array(*map(F.lit, ("oil", "ink", "clay", "film")))
    own = F.array(F.lit("film"), F.lit("oil"), F.col("p_brand"), F.lit("clay"), F.lit("oil"), F.lit("ink"))
    return t("part").select("p_partkey", F.array_join(F.slice(F.array_intersect(allowed, own), 1, 3), ",").alias("tags"))
