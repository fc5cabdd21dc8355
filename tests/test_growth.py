"""Steps whose work must grow no faster than their input, on small tables."""

from __future__ import annotations

import re

from catalogkit.operators import catalog, collect, official, references, verify
from catalogkit.plans import registry
from pyspark.sql import functions as F


def test_items_share_the_hits_of_a_search(spark):
    links = spark.createDataFrame([(1, 0, "https://own.org/"), (1, 3, "https://h2.org/"), (2, 0, "https://own.org/")], "item long, pos int, link string")
    searches = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, None), (5, 8)], "item long, search long")
    hits = [(7, 0, i, f"https://h{i}.org/#{i}") for i in range(9)] + [(7, 1, 0, "https://h8.org/"), (7, 0, 3, "https://x.third.org/"), (8, 0, 0, "https://twitter.com/a"), (9, 0, 0, "https://h1.org/")]
    pages = [("https://h5.org/", "t" * 120, "specific"), ("https://h2.org/", "t" * 200, "org"), ("https://h1.org/", "short", "specific"), ("https://h8.org/", "t" * 120, "specific")]
    found = official.located(links, searches, spark.createDataFrame(hits, "search long, query int, rank long, url string"), spark.createDataFrame(pages, "url string, text string, level string"), "item", ["third.org"])
    # item 1 probes own, h2, h0, h1, h3, h4; item 2 own, h0 to h4; item 3 h0 to h5
    assert sorted(tuple(r) for r in found.collect()) == [(1, "https://h2.org/", "org", 6), (2, "https://h2.org/", "org", 6), (3, "https://h5.org/", "specific", 6)]


def test_an_issue_may_have_any_number_of_items(spark):
    items = [(1, n, f"《Title {n}》", f"o{n}", "news", f"u{n}") for n in range(references.LOOSE + 200)]
    texts = [(1, 0, "[999] [[1000]] [[1100:far]] 【Title 1150】【Title 7】 [998：w]"), (1, None, "【Title 7】[3]"), (1, 1, "[[1199:]] [[1199: ]] [[1200:none]] 【Title 1150】"), (2, 0, "[0]【Title 7】"), (None, 0, "[0]")]
    t, i = spark.createDataFrame(texts, "issue int, ord long, text string"), spark.createDataFrame(items, "issue int, n int, title string, oid string, kind string, url string")
    found = references.segments(t, i).collect()
    held = {(r.issue, r.ord, r.seg): (r.t, r.ref, r.oid, r.label) for r in found}
    # the text without a place comes first in its issue
    assert held[1, None, 0] == (None, 1, "o7", "Title 7") and held[1, None, 1] == (None, 2, "o3", "Title 3")
    assert [held[1, 0, k][2] for k in (0, 2, 4, 5)] == ["o999", "o1100", "o1150", "o7"] and held[1, 0, 1][0] == " [[1000]] " and held[1, 0, 7][2:] == ("o998", "w")
    assert held[1, 1, 0][0].startswith("[[1199:]] ") is True and held[2, 0, 0][0] == "[0]【Title 7】" and held[None, 0, 0][0] == "[0]"
    # no text carries more names than a loose mark can have
    assert max(len(r) for r in references.loose_names(i).select("_names").collect()[0]) == references.LOOSE


def test_tags_are_searched_plainly_before_patterns_and_once(spark):
    d = [("law", ["licen"], ["mit", "open call"]), ("a+", [], ["a+", "yo"])]
    texts = ["permit", "MIT", "a mit.", "mit_", "emit mit", "open-call", "reopen call open call!", "open  call", "a+", "xa+ yo-yo", "yoyo", "LICENce", "ämit", "mit\n", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = {r.i: r.tags for r in df.select("i", catalog.tags(F.col("text"), d).alias("tags")).collect()}
    assert [i for i in found if "law" in found[i]] == [1, 2, 4, 5, 6, 11, 12, 13] and [i for i in found if "a+" in found[i]] == [8, 9]
    n = catalog.tag_counts(df.select(catalog.tags(F.col("text"), d).alias("tags")), "tags")
    assert sorted(tuple(r) for r in n.collect()) == [("a+", 2), ("law", 8)]
    assert n._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1  # two before: a filter had the tags computed again


def test_a_page_is_squeezed_once_for_all_its_checks(spark):
    row = [(1, True, "Apply  by May.", "Apply by", "2030-01-01", "by  May", None, None, None, "https://a.org/x", "a.org", "official", None)]
    names = "id long, applicable boolean, text string, ev_title string, deadline string, ev_deadline string, fee string, ev_fee string, deadline_note string, url string, domain string, org_type string, trust_auto boolean"
    q = verify.trust(verify.verify_opportunity(spark.createDataFrame(row, names), [("deadline", "ev_deadline"), ("fee", "ev_fee")], "2026-06-01")).where("drop_reason is null and trust = 'auto'")
    assert [tuple(r) for r in q.select("id", "deadline", "any_fail").collect()] == [(1, "2030-01-01", False)]
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_replace\((?:coalesce\()?text#", plan)) == 1  # several before


def test_clues_are_not_compared_with_all_hits(spark):
    names = [(1, "Alpha Prize"), (1, "pha Pri"), (1, "Prize seen"), (1, "abc"), (1, "Nowhere"), (2, "Alpha Prize"), (1, "Ze seen x"), (None, "Alpha Prize"), (1, "《abc》d"), (1, "Fresh One")]
    clues = spark.createDataFrame([(i, *r) for i, r in enumerate(names)], "ord int, batch int, name string")
    hits = spark.createDataFrame([(1, "Alpha Prize", "seen"), (1, "Alpha Prize", "seen"), (1, None, "《abc》d and Fresh One"), (2, "other", None), (1, "", "")], "batch int, title string, snippet string")
    history = spark.createDataFrame([("phapri",)], "fp string")
    library = spark.createDataFrame([("The Alpha Prizes",), ("xabcd",), ("abc",), (None,)], "title string")
    df = collect.clue_verdicts(clues, hits, history, library)
    assert [r.verdict for r in df.orderBy("ord").collect()] == ["known", "tried", "fresh", "invented", "invented", "invented", "invented", "invented", "known", "fresh"]
    assert "contains(" not in df._jdf.queryExecution().optimizedPlan().toString().lower()  # before: each clue against all hits of its batch in one text


def test_records_are_inspected_once_for_all_sides(spark):
    df = registry.queries()["archive_restore"](spark, "/root/testdata/sf0.001")
    assert "parquet" not in df._jdf.queryExecution().optimizedPlan().toString().lower()  # before: the orders were read and inspected for each side
    assert {r.side for r in df.collect()} == {"stays", "recycle", "restored", "tombstones", "after purge"}
