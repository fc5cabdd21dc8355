"""Running values at one huge key, and dictionaries in parts."""

from __future__ import annotations

import random

import pytest
from catalogkit.operators import analytics, crawl, dictionary, geo, scan
from pyspark.sql import Window
from pyspark.sql import functions as F


def result(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def events(spark):
    """One key has half of all rows, one is null, many have few; seconds repeat within a key."""
    rng = random.Random(7)
    rows = [(i, rng.choice([1, 1, 1, None, *range(2, 6), *range(100, 140)]) if i % 2 else 1, 1_700_000_000 + rng.randrange(400_000), rng.random() < 0.6) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, key long, s long, dead boolean")
    return df.withColumn("ts", F.timestamp_seconds("s")).cache()


def test_a_huge_key_is_cut_into_ranges(events):
    ranged = scan.in_ranges(events, "key", ["s", "id"], 12)
    most = ranged.groupBy("key", "_range").count().agg(F.max("count")).first()[0]
    assert most < 1200 and ranged.where("key = 1").select("_range").distinct().count() >= 6
    got = scan.running(ranged, "key", ["s", "id"], total=("sum", F.col("id")), low=("min", F.col("id")), before=("max", F.col("s"), "before"))
    w = Window.partitionBy("key").orderBy("s", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = events.select("id", F.sum("id").over(upto), F.min("id").over(upto), F.max("s").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    assert result(got.select("id", "total", "low", "before")) == result(want)


def test_streaks_of_a_huge_key(events):
    rows = [tuple(r) for r in events.select("key", "s", "id", "dead").collect()]
    want, streak, at = [], 0, object()
    for key, _, id_, dead in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        streak = (streak if key == at else 0) + 1 if dead else 0
        at = key
        want.append((id_, streak))
    got = crawl.fail_streak(events, "key", ["s", "id"], F.col("dead"), ranges=9)
    assert result(got.select("id", "streak")) == sorted(want, key=repr)


def test_tiers_of_a_huge_key(events):
    rows = [tuple(r) for r in events.select("key", "s", "id").collect()]
    want, found, empty, at = [], 0, 0, object()
    for key, s, id_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        if key != at:
            found = empty = 0
        at = key
        found, empty = (found + 1, 0) if s % 97 == 0 else (found, empty + 1)
        want.append((id_, "high" if found >= 5 else "low" if empty >= 14 and not found else "normal"))
    got = crawl.source_tier(events, "key", ["s", "id"], F.col("s") % 97 == 0, ranges=9)
    assert result(got.select("id", "tier")) == sorted(want, key=repr)


def test_rates_and_sessions_of_a_huge_key(events):
    w = Window.partitionBy("key").orderBy("s").rangeBetween(-2 * 3600, 0)
    got = analytics.rolling_count(events, "key", "ts", 2, id_="id", ranges=9)
    assert result(got.select("id", "recent")) == result(events.select("id", F.count("*").over(w)))
    of_key = {}
    for key, s in events.select("key", "s").collect():
        of_key.setdefault(key, []).append(s)
    want = []
    for key, seconds in of_key.items():
        seconds.sort()
        runs = [[seconds[0]]]
        for s in seconds[1:]:
            runs.append([s]) if s - runs[-1][-1] >= 60 else runs[-1].append(s)
        want += [(key, k + 1, run[0], run[-1], len(run)) for k, run in enumerate(runs)]
    got = analytics.sessions(events, "key", "ts", 60, id_="id", ranges=9)
    assert result(got.select("key", "session", F.unix_seconds("begin"), F.unix_seconds("end"), "events")) == sorted(want, key=repr)


def test_scans_of_nothing(events):
    none = events.limit(0)
    assert crawl.fail_streak(none, "key", ["s", "id"], F.col("dead")).count() == 0
    assert analytics.sessions(none, "key", "ts", 60, id_="id").count() == 0


TERMS = [(3, "ab", "x"), (1, "abc", "y"), (2, "bcd", "z"), (0, "d", "w"), (4, "abc", "later"), (5, "", "never"), (6, None, "never")]
TEXTS = ["abcd", "xab", "none", "", None, "abc abc", "d", "bcd ab"]


@pytest.mark.parametrize("part", [1, 1000])
def test_terms_that_win_do_not_depend_on_parts(spark, monkeypatch, part):
    monkeypatch.setattr(dictionary, "PART_TERMS", part)
    terms = spark.createDataFrame(TERMS, "ord long, term string, value string")
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "id long, x string")
    good = [r for r in TERMS if r[1]]
    held = lambda x: [r for r in good if x and r[1] in x]
    longest = lambda x: min(held(x), key=lambda r: (-len(r[1]), r[0]), default=(None,) * 3)[1:]
    first = lambda x: min(held(x), default=(None,) * 3)[1:]
    for f, want in ((dictionary.longest_term, longest), (dictionary.first_term, first)):
        got = texts.select("id", f(F.col("x"), terms).alias("b")).select("id", "b.term", "b.value")
        assert result(got) == result(spark.createDataFrame([(i, *want(x)) for i, x in enumerate(TEXTS)], "id long, term string, value string"))
    none = texts.select(dictionary.longest_term(F.col("x"), terms.limit(0)).alias("b")).where("b.term is not null")
    assert none.count() == 0


@pytest.mark.parametrize("part", [1, 1000])
def test_labels_count_whole_words_where_they_must(spark, monkeypatch, part):
    monkeypatch.setattr(dictionary, "PART_TERMS", part)
    words = spark.createDataFrame([(0, "glass", ["瓷"], ["glass", "stained glass"]), (1, "public", ["公共"], ["public art"]), (2, "clay", [], ["clay"])], "ord long, label string, anywhere array<string>, words array<string>")
    terms = dictionary.label_terms(words)
    texts = ["two glasses", "a glass.", "stained-glass", "青瓷 clay", "publicart public-art", "clay_x 9clay", "漢clay漢", None, ""]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, x string").select("i", dictionary.labels(F.col("x"), terms))
    want = [[], ["glass"], ["glass"], ["glass", "clay"], ["public"], [], ["clay"], None, []]
    assert [r[1] for r in sorted(map(tuple, got.collect()))] == want


@pytest.mark.parametrize("part", [1, 1000])
def test_names_find_their_alias(spark, monkeypatch, part):
    monkeypatch.setattr(dictionary, "PART_TERMS", part)
    aliases = spark.createDataFrame([(0, "China", "C"), (1, "US", "U"), (2, "Russia", "R"), (3, "us", "lower"), (4, "Hong Kong", "H")], "ord long, term string, value string")
    names = ["us", "US", "Us", "Belarus", "russia ", "ong", "Nowhere", " ", None, "s", "rich in China"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "i long, x string").select("i", dictionary.normal_name(F.col("x"), aliases, geo.UNKNOWN))
    assert [r[1] for r in sorted(map(tuple, got.collect()))] == ["lower", "U", "U", "U", "R", "H", "Nowhere", "未知", "未知", "U", "C"]


@pytest.mark.parametrize("most", [0, 100])
def test_large_tables_are_looked_up_alike(spark, monkeypatch, most):
    monkeypatch.setattr(dictionary, "BROADCAST_ROWS", most)
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "z"), (4, "a")], "id long, k string")
    table = spark.createDataFrame([("a", 7), ("b", 8), (None, 9)], "name string, n long")
    assert result(dictionary.looked_up(df, "k", table, "name", got="n")) == [(1, "a", 7), (2, None, None), (3, "z", None), (4, "a", 7)]


def test_robots_files(spark):
    bodies = [
        ("early", "Disallow: /private\nUser-agent: other\nDisallow: /"), ("split", "User-agent: KitBot\nCrawl-delay: 1\nUser-agent: evil\nDisallow: /"), ("shared", "User-agent: evil\nUser-agent: KitBot\nDisallow: /a$\nAllow: /a"),
        ("empty", "User-agent: *\nDisallow:"), ("none", None), ("held", "user-agent: kit\nDISALLOW : /x # no\n\nuser-agent: *\nDisallow: /"),
    ]
    rules = crawl.parse_robots(spark.createDataFrame(bodies, "site string, body string"), "KitBot")
    asked = [("early", "/private"), ("early", "/other"), ("split", "/x"), ("shared", "/a"), ("shared", "/a/b"), ("empty", "/"), ("none", "/"), ("held", "/x"), ("held", "/y"), ("held", "/y"), ("unknown", "/"), (None, "/")]
    got = crawl.robots_allowed(spark.createDataFrame(asked, "site string, path string"), rules)
    want = [False, True, True, False, True, True, True, False, True, True, True, True]
    assert result(got.select("site", "path", "allowed")) == sorted([(*a, w) for a, w in zip(asked, want)], key=repr)
