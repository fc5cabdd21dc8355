"""Stateful operators: an admission limiter, presence and running counters, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit(times: list[float], held: list[float], most: int, window: float) -> tuple[list[bool], list[float]]:
    """Accept an event if fewer than ``most`` were accepted within ``window`` before it; rejected ones don't count."""
    out = []
    for t in times:
        held = [h for h in held if h > t - window]
        ok = len(held) < most
        if ok:
            held.append(t)
        out.append(ok)
    return out, held


def admission(events: DataFrame, key: str, id_: str, ts: str, most: int, seconds: float) -> DataFrame:
    """Each event with whether it is accepted. Whether one is depends on those accepted before, so a key's events are
    walked in order: sorted by Spark, read batch by batch, with no more than ``most`` times held."""
    schema = f"{key} long, {id_} long, accepted boolean"
    rows = events.select(key, id_, F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).repartition(key).sortWithinPartitions(key, "t", id_)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for b in batches:
            ok = []
            for k, t in zip(b[key].tolist(), b["t"].tolist()):
                if k != at:
                    at, held = k, []
                got, held = admit([t], held, most, seconds * 1e6)
                ok += got
            yield pd.DataFrame({key: b[key], id_: b[id_], "accepted": ok})

    return rows.mapInPandas(run, schema)


def admission_stream(events: DataFrame, key: str, id_: str, ts: str, most: int, seconds: float) -> DataFrame:
    """The same over a stream: the accepted times of each key are its state, dropped when the key rests."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values([ts, id_])
        t = [x.timestamp() for x in rows[ts]]
        ok, held = admit(t, held, most, seconds)
        state.update((held,))
        state.setTimeoutDuration(int(seconds * 1000))
        yield pd.DataFrame({key: k[0], id_: rows[id_], "accepted": ok})

    return events.groupBy(key).applyInPandasWithState(run, f"{key} long, {id_} long, accepted boolean", "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def presence(events: DataFrame, key: str, ts: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key, over a stream or a table."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    s = F.session_window(ts, gap)
    return e.groupBy(key, s).agg(F.count("*").alias("events")).select(key, F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "events")


def counters(events: DataFrame, ts: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by kind and window."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, every), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("begin"), "event_type", "n")


def latest_state(path: str):
    """A foreachBatch function that keeps the latest row of each (key) in a versioned table. A batch that comes twice
    changes nothing, since the latest of equal rows is the same row."""
    from ..operators.ordering import top
    from ..sources.tables import read_table, replace_table

    def merge(batch: DataFrame, epoch: int) -> None:
        old = read_table(batch.sparkSession, path)
        both = batch if old is None else old.unionByName(batch)
        replace_table(top(both, ["key"], [F.desc("at"), *(c for c in batch.columns if c not in ("key", "at"))]), path)

    return merge


def suppressed(searches: DataFrame, key: str, ts: str, ok: str, minutes: int = 8) -> DataFrame:
    """Whether each search repeats one that succeeded within ``minutes`` before it. Suppressed searches don't run, so they
    don't count as successes: like the limiter, a key's searches are walked in order, with one time held."""
    schema = f"{key} string, id long, suppressed boolean"
    rows = searches.select(key, "id", ok, F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).repartition(key).sortWithinPartitions(key, "t", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, None
        for b in batches:
            out = []
            for k, good, t in zip(b[key].tolist(), b[ok].tolist(), b["t"].tolist()):
                if k != at:
                    at, last = k, None
                again = last is not None and t - last < minutes * 60_000_000
                out.append(again)
                if good and not again:
                    last = t
            yield pd.DataFrame({key: b[key], "id": b["id"], "suppressed": out})

    return rows.mapInPandas(run, schema)
