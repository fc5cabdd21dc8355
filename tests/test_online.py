"""Search gates and paid searches: batch against a plain fold, streams against the batch, over restarts."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from catalogkit.streaming import online
from pyspark.sql import functions as F

MINUTE = 60_000_000


@pytest.fixture(scope="module")
def now() -> int:
    return int(pd.Timestamp.now("UTC").value // 1000)  # a time to live counts from the present


def gate_rows(now: int) -> list[tuple]:
    rng = random.Random(2)
    return [(i, rng.choice("ab") + str(rng.randrange(3)), now + i * MINUTE // 2, rng.choices(["ask", "done", "failed"], [6, 2, 1])[0]) for i in range(300)]


def test_gates_hold_back_repeats_and_failures_do_not_count(spark, now):
    rows = gate_rows(now)
    running, done, want = set(), {}, {}
    for i, k, at, kind in rows:
        if kind == "ask":
            want[i] = "recent" if k in done and at - done[k] < 8 * MINUTE else "running" if k in running else "run"
            if want[i] == "run":
                running.add(k)
        else:
            running.discard(k)
            if kind == "done":
                done[k] = at
    df = spark.createDataFrame(rows, "id long, k string, us long, kind string").withColumn("ts", F.timestamp_micros("us"))
    assert {r.id: r.verdict for r in online.gated(df, "k", "id", "ts", "kind").collect()} == want
    assert set(want.values()) == {"run", "running", "recent"}


def paid_rows(now: int) -> list[tuple]:
    rng = random.Random(3)
    return [(i, rng.choice(["x", "y"]), now + i * 40 * MINUTE, f"q{rng.randrange(25)}") for i in range(400)]


def plain_paid(rows: list[tuple], budget: int, keep: int, most: int) -> dict:
    out, cache, used = {}, {}, {}
    for i, source, at, q in rows:
        own, day = cache.setdefault(source, {}), (source, (at + 8 * 60 * MINUTE) // (1440 * MINUTE))
        if q in own and at - own[q] <= keep:
            out[i] = "cached"
        elif used.get(day, 0) >= budget:
            out[i] = "over budget"
        else:
            out[i], used[day] = "paid", used.get(day, 0) + 1
            own[q] = at
            for old in sorted(own, key=own.get)[: max(0, len(own) - most)]:
                del own[old]
    return out


def test_paid_searches_are_cached_and_budgeted(spark, now):
    rows = paid_rows(now)
    df = spark.createDataFrame(rows, "id long, source string, us long, q string").withColumn("ts", F.timestamp_micros("us"))
    want = plain_paid(rows, 7, 1000 * MINUTE, 9)
    assert {r.id: r.verdict for r in online.paid(df, "source", "id", "ts", "q", 7, 1000 * MINUTE, 9).collect()} == want
    assert set(want.values()) == {"paid", "cached", "over budget"}


def streamed_with_restarts(spark, tmp_path, rows: list, schema: str, make, name: str) -> dict:
    """A file after the other, the query stopped and started again from its checkpoint for each."""
    out = {}
    for part in (rows[:120], rows[120:130], rows[130:]):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(f"{schema}, ts timestamp").parquet(str(tmp_path / name))
        query = make(stream).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
    for r in spark.read.parquet(str(tmp_path / f"{name}-out")).collect():
        assert r.id not in out
        out[r.id] = r.verdict
    return out


@pytest.fixture
def rocksdb(spark):
    """The store that keeps such state; and no batches without data, of which a time to live would make ever more."""
    own = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    old = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_streamed_gates_keep_their_state_over_restarts(spark, tmp_path, now, rocksdb):
    rows, schema = gate_rows(now), "id long, k string, us long, kind string"
    got = streamed_with_restarts(spark, tmp_path, rows, schema, lambda s: online.gate_stream(s, "k", "id", "ts", "kind"), "gates")
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("us"))
    assert got == {r.id: r.verdict for r in online.gated(df, "k", "id", "ts", "kind").collect()}


def test_streamed_budgets_keep_their_state_over_restarts(spark, tmp_path, now, rocksdb):
    rows, schema = paid_rows(now), "id long, source string, us long, q string"
    got = streamed_with_restarts(spark, tmp_path, rows, schema, lambda s: online.paid_stream(s, "source", "id", "ts", "q", 7, 1000 * MINUTE, 9), "budgets")
    assert got == plain_paid(rows, 7, 1000 * MINUTE, 9)
