"""What the queries don't reach: files, versioned tables, streams, other plans of one operator."""

from __future__ import annotations

import random
from collections import defaultdict

import pandas as pd
import pytest
from catalogkit.operators import catalog, evidence, ordering
from catalogkit.sources import tables
from catalogkit.streaming import state
from pyspark.sql import functions as F
from pyspark.sql import types as T


@pytest.mark.parametrize("advisory", ["64m", "32k"])
def test_positions_are_each_given_once(spark, advisory):
    """With a column that is no order column, whatever size of partitions adaptive execution aims at."""
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
    try:
        n = 40_000
        df = spark.range(n).select(F.xxhash64("id").alias("k"), F.repeat(F.lit("x"), 50).alias("payload"), "id")
        got = catalog.numbered(df, [F.desc("k"), "id"], 30).select("position", "page", "k").toPandas().sort_values("position")
        assert got.position.tolist() == list(range(1, n + 1))
        assert got.k.is_monotonic_decreasing and (got.page == (got.position + 29) // 30).all()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)


def test_evidence_in_rows_and_in_joins_is_the_same(spark, monkeypatch):
    rng = random.Random(4)
    words = [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(60)]
    docs = [(i, "  ".join(rng.choice(words) for _ in range(rng.randrange(0, 80)))) for i in range(60)] + [(100, None), (101, "")]
    items = []
    for i in range(60):
        w = (docs[rng.randrange(60)][1]).split()
        a = rng.randrange(max(1, len(w)))
        text = " ".join(w[a : a + rng.randrange(0, 9)])
        items.append((i, text[rng.randrange(2) :] if text else text))
    items += [(200, None), (201, "x"), (202, "zz none here at all so")]
    flat = lambda x: " ".join((x or "").split())
    want = sorted((i, d) for i, e in items for d, t in docs if flat(e) and flat(e) in flat(t))
    e, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, evidence.evidence_pairs(e, d).collect())) == want
    monkeypatch.setattr(evidence, "FEW_STATEMENTS", 0)
    assert sorted(map(tuple, evidence.evidence_pairs(e, d).collect())) == want
    assert evidence.evidence_pairs(e.limit(0), d).count() == 0


def test_catalogs_events_and_words_are_read(spark, tmp_path):
    item = T.StructType().add("id", "long").add("title", "string")
    (tmp_path / "c.json").write_text('{"count": 2, "items": [{"id": 2, "title": "b"}, {"id": 1, "title": "a"}]}')
    assert [tuple(r) for r in tables.read_catalog(spark, str(tmp_path / "c.json"), item, "items").collect()] == [(0, 2, "b"), (1, 1, "a")]
    (tmp_path / "bad.json").write_text('{"items": [{"id": 2, "title": ')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        tables.read_catalog(spark, str(tmp_path / "bad.json"), item, "items").collect()
    (tmp_path / "e.jsonl").write_text('{"t": "2026-01-01", "type": "view"}\nnot json\n{"t": "2026-01-02", "type": "out"}\n')
    (tmp_path / "e.jsonl.1").write_text('{"t": "2025-12-31", "type": "view"}\n{"type": "no time"}\n')
    assert sorted(r.t for r in tables.read_events(spark, [str(tmp_path / "e.jsonl"), str(tmp_path / "e.jsonl.1")]).collect()) == ["2025-12-31", "2026-01-01", "2026-01-02"]
    (tmp_path / "w.txt").write_text("# words\nsoft # comment\n!hard\n\n")
    assert sorted(tuple(r) for r in tables.read_words(spark, str(tmp_path / "w.txt")).collect()) == [("hard", "hard"), ("soft", "soft")]


def test_versioned_table(spark, tmp_path):
    root = str(tmp_path / "t")
    assert tables.read_table(spark, root) is None
    df = spark.range(5).select("id", (F.col("id") * 2).alias("x"))
    tables.replace_table(df, root)
    tables.replace_table(tables.read_table(spark, root).where("id > 2"), root)  # from the version that is replaced
    assert sorted(r.id for r in tables.read_table(spark, root).collect()) == [3, 4]
    kept = tables.snapshot(tables.read_table(spark, root), root, "before")
    assert spark.read.parquet(kept).count() == 2
    e = spark.createDataFrame([("2026-01-01", "a")], "day string, type string")
    tables.append_events(e, str(tmp_path / "log"))
    tables.append_events(e, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def admitted(rows: list[tuple], most: int, seconds: float) -> list[tuple]:
    held, out = defaultdict(list), []
    for u, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        mine = [h for h in held[u] if h > t - seconds]
        out.append((u, i, len(mine) < most))
        held[u] = mine + [t] * (len(mine) < most)
    return sorted(out)


def test_limiter_is_a_fold_over_accepted_events(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(5), i, rng.randrange(400)) for i in range(600)]
    df = spark.createDataFrame(rows, "u long, i long, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(map(tuple, state.admission(df, "u", "i", "ts", 3, 60).collect())) == admitted(rows, 3, 60)


def test_repeated_searches_are_suppressed_after_success_only(spark):
    rows = [("q", 1, False, 0), ("q", 2, True, 60), ("q", 3, True, 300), ("q", 4, True, 541), ("q", 5, False, 545), ("r", 6, True, 10)]
    df = spark.createDataFrame(rows, "q string, id long, ok boolean, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.id: r.suppressed for r in state.suppressed(df, "q", "ts", "ok").collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: True, 6: False}


def streamed(spark, tmp_path, rows: list[list[tuple]], schema: str, make, name: str, mode: str = "append"):
    """Rows of a file stream, a file after the other."""
    folder = tmp_path / name
    folder.mkdir()
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / f"f{k}"))
    stream = spark.readStream.schema(spark.createDataFrame(rows[0], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.table(name).toPandas()


def test_streams_count_and_find_sessions(spark, tmp_path):
    day = pd.Timestamp("2026-01-01")
    at = lambda *minutes: [(1, "view", (day + pd.Timedelta(minutes=m)).to_pydatetime()) for m in minutes]
    parts = [at(0, 2, 70), at(300)]
    hours = streamed(spark, tmp_path, parts, "user_id long, event_type string, ts timestamp", lambda s: state.counters(s, "ts"), "hours")
    assert sorted(hours.n.tolist()) == [1, 2]  # the last hour is not over
    visits = streamed(spark, tmp_path, parts, "user_id long, event_type string, ts timestamp", lambda s: state.presence(s, "user_id", "ts"), "visits")
    assert sorted(visits.events.tolist()) == [1, 2]
    batch = state.presence(spark.createDataFrame(parts[0] + parts[1], "user_id long, event_type string, ts timestamp"), "user_id", "ts")
    assert sorted(r.events for r in batch.collect()) == [1, 1, 2]


def test_streamed_limiter_keeps_its_state(spark, tmp_path):
    at = lambda i, s: (1, i, (pd.Timestamp("2026-01-01") + pd.Timedelta(seconds=s)).to_pydatetime())
    got = streamed(spark, tmp_path, [[at(1, 0), at(2, 1)], [at(3, 2), at(4, 61)]], "u long, i long, ts timestamp", lambda s: state.admission_stream(s, "u", "i", "ts", 2, 60), "limited")
    assert dict(zip(got.i, got.accepted)) == {1: True, 2: True, 3: False, 4: True}


def test_latest_state_of_batches(spark, tmp_path):
    merge = state.latest_state(str(tmp_path / "state"))
    batch = lambda *rows: spark.createDataFrame(rows, "key string, at long, hash string")
    merge(batch(("a", 1, "x"), ("b", 1, "y")), 0)
    merge(batch(("a", 2, "z"), ("b", 0, "old")), 1)
    merge(batch(("a", 2, "z"), ("b", 0, "old")), 1)  # the same batch again
    assert sorted(map(tuple, tables.read_table(spark, str(tmp_path / "state")).collect())) == [("a", 2, "z"), ("b", 1, "y")]


def test_best_rows_of_a_large_key(spark):
    df = spark.range(20_000).select((F.col("id") % 3 == 0).cast("string").alias("k"), (F.col("id") % 100).alias("s"), "id")
    assert sorted(map(tuple, ordering.keep_best(df, "k", "s", "id").select("k", "s", "id", "at").collect())) == [("false", 99, 199, 1), ("true", 99, 99, 0)]
