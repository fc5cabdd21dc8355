"""Searches as they are asked: repeats held back, paid answers cached and budgeted. Over a stream the state is Spark's,
with a time to live; in batch the same folds run over each key's rows in order, of which one is held at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

MINUTE, DAY = 60_000_000, 86_400_000_000
#: A day is a Beijing calendar day.
_OFFSET = 8 * 3600 * 1_000_000


@dataclass
class Gate:
    """A query's state: whether a search for it runs, and when one last succeeded."""

    keep: int = 8 * MINUTE
    running: bool = False
    done: int | None = None

    def step(self, kind: str, at: int) -> str | None:
        """``ask``: whether to run. ``done`` and ``failed`` end what runs, and only success counts as an answer."""
        if kind == "ask":
            if self.done is not None and at - self.done < self.keep:
                return "recent"
            if self.running:
                return "running"
            self.running = True
            return "run"
        self.running = False
        if kind == "done":
            self.done = at
        return None


@dataclass
class Paid:
    """A source's state: answers by query, the latest ``most`` for ``keep`` microseconds, and what its day has used."""

    budget: int
    keep: int = 7 * DAY
    most: int = 600
    answers: dict[str, int] = field(default_factory=dict)
    day: int = -1
    used: int = 0

    def step(self, query: str, at: int) -> str:
        day = (at + _OFFSET) // DAY
        if day != self.day:
            self.day, self.used = day, 0
        met = self.answers.get(query)
        if met is not None and at - met <= self.keep:
            return "cached"
        if self.used >= self.budget:
            return "over budget"
        self.used += 1
        self.answers.pop(query, None)  # the latest come last
        self.answers[query] = at
        while len(self.answers) > self.most or at - next(iter(self.answers.values())) > self.keep:
            del self.answers[next(iter(self.answers))]
        return "paid"


def _folded(events: DataFrame, key: str, id_: str, ts: str, what: str, new: Callable) -> DataFrame:
    """(id, verdict) of a fold over each key's rows in the order of time and id, read batch by batch."""
    rows = events.select(F.col(key).alias("k"), F.col(id_).alias("i"), F.col(what).alias("w"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).where("k is not null and t is not null")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None
        for f in frames:
            out = []
            for k, w, t in zip(f["k"].tolist(), f["w"].tolist(), f["t"].tolist()):
                if held is None or k != at:
                    at, held = k, new()
                out.append(held.step(w, t))
            yield pd.DataFrame({id_: f["i"], "verdict": out}).dropna(subset=["verdict"])

    return rows.repartition("k").sortWithinPartitions("k", "t", "i").mapInPandas(run, f"{id_} long, verdict string")


def gated(events: DataFrame, key: str, id_: str, ts: str, kind: str, keep: int = 8 * MINUTE) -> DataFrame:
    """(id, verdict) of each ``ask`` among events (key, id, ts, kind): run, running (one for the same key is under way) or
    recent (one has succeeded not long ago). Rows without key or time get none."""
    return _folded(events, key, id_, ts, kind, lambda: Gate(keep))


def paid(searches: DataFrame, source: str, id_: str, ts: str, query: str, budget: int, keep: int = 7 * DAY, most: int = 600) -> DataFrame:
    """(id, verdict) of searches of paid sources: cached, paid, or over budget."""
    return _folded(searches, source, id_, ts, query, lambda: Paid(budget, keep, most))


class _GateProcessor(StatefulProcessor):
    def __init__(self, id_: str, ts: str, kind: str, keep: int):
        self.id_, self.ts, self.kind, self.keep = id_, ts, kind, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        # what runs is forgotten too if nothing ends it
        self.running = handle.getValueState("running", StructType().add("running", BooleanType()), ttlDurationMs=10 * self.keep // 1000)
        self.done = handle.getValueState("done", StructType().add("at", LongType()), ttlDurationMs=self.keep // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        gate = Gate(self.keep, self.running.exists(), self.done.get()[0] if self.done.exists() else None)
        before = gate.done
        f = pd.concat(list(rows)).sort_values([self.ts, self.id_])
        verdicts = [gate.step(kind, int(at.value // 1000)) for kind, at in zip(f[self.kind], pd.to_datetime(f[self.ts]))]
        self.running.update((True,)) if gate.running else self.running.clear()
        if gate.done != before:
            self.done.update((gate.done,))
        yield pd.DataFrame({self.id_: f[self.id_], "verdict": verdicts}).dropna(subset=["verdict"])

    def close(self) -> None:
        pass


class _PaidProcessor(StatefulProcessor):
    def __init__(self, id_: str, ts: str, query: str, budget: int, keep: int, most: int):
        self.id_, self.ts, self.query, self.budget, self.keep, self.most = id_, ts, query, budget, keep, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answers = handle.getListState("answers", StructType().add("query", StringType()).add("at", LongType()), ttlDurationMs=self.keep // 1000)
        self.used = handle.getValueState("used", StructType().add("day", LongType()).add("used", LongType()), ttlDurationMs=2 * DAY // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        day, used = self.used.get() if self.used.exists() else (-1, 0)
        held = Paid(self.budget, self.keep, self.most, {q: at for q, at in self.answers.get()}, day, used)
        f = pd.concat(list(rows)).sort_values([self.ts, self.id_])
        verdicts = [held.step(q, int(at.value // 1000)) for q, at in zip(f[self.query], pd.to_datetime(f[self.ts]))]
        self.used.update((held.day, held.used))
        self.answers.put(list(held.answers.items())) if held.answers else self.answers.clear()
        yield pd.DataFrame({self.id_: f[self.id_], "verdict": verdicts})

    def close(self) -> None:
        pass


def gate_stream(events: DataFrame, key: str, id_: str, ts: str, kind: str, keep: int = 8 * MINUTE) -> DataFrame:
    """``gated`` over a stream: the state of a query lives as long as it can matter. Needs the RocksDB state store; with the
    availableNow trigger also spark.sql.streaming.noDataMicroBatches.enabled=false, since a time to live asks for ever more
    batches."""
    return events.groupBy(key).transformWithStateInPandas(_GateProcessor(id_, ts, kind, keep), f"{id_} long, verdict string", "Append", "ProcessingTime")


def paid_stream(searches: DataFrame, source: str, id_: str, ts: str, query: str, budget: int, keep: int = 7 * DAY, most: int = 600) -> DataFrame:
    """``paid`` over a stream: a source's state is its answers, ``most`` of them, and its day's use."""
    return searches.groupBy(source).transformWithStateInPandas(_PaidProcessor(id_, ts, query, budget, keep, most), f"{id_} long, verdict string", "Append", "ProcessingTime")
