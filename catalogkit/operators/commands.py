"""Command logs folded through a state machine, whatever an item's number of commands.

Each command of an item is taken or refused by the state that the commands before it left, so an item's log is a fold. A
range of a log is a function from the state that it begins with to the one that it ends with; states are few, so the
function is a small table, and those of ranges compose. Commands are sorted by item and time over all tasks and fixed in
the checkpoint folder; a first pass gives the tables of the items at the ranges' edges, the driver composes them, two for
each range, and a second pass folds each range from the right state. No task holds an item's whole log.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan


@dataclass
class Machine:
    """moves: (state, command) -> (next state, what it is called). refusals: state -> the reason of a command that has no
    move from it. windows: (state, command) -> (microseconds, reason): a move that is refused unless the state is younger;
    a state has one such command at most."""

    start: str
    moves: dict[tuple[str, str], tuple[str, str]]
    refusals: dict[str, str]
    windows: dict[tuple[str, str], tuple[int, str]] = field(default_factory=dict)

    def states(self) -> list[str]:
        return sorted({self.start, *(s for s, _ in self.moves), *(s for s, _ in self.moves.values())})

    def step(self, state: str, since: int, command: str, at: int) -> tuple[str, int, bool, str]:
        """The next state, since when it holds, whether the command is taken, and its name or the reason against it."""
        if (state, command) not in self.moves:
            return state, since, False, self.refusals.get(state, state)
        window = self.windows.get((state, command))
        if window and at - since >= window[0]:
            return state, since, False, window[1]
        following, name = self.moves[state, command]
        return following, at, True, name


#: Long before any command: a state so old that no window holds.
_OLD = -(2**62)


class Summary:
    """What a run of commands makes of each state it may begin with. Where that state has a window, its age decides: the
    first command that the window may let through splits the outcome in two, by whether the state is younger then."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.plain = {s: (s, _OLD) for s in machine.states()}  # the outcome if no window of the first state holds
        self.split: dict[str, tuple[int, str, int]] = {}  # state: (latest time at which it is too old, then state, since)

    def add(self, command: str, at: int) -> None:
        m = self.machine
        for s, (_, now, since) in [(s, x) for s, x in self.split.items()]:
            self.split[s] = (self.split[s][0], *m.step(now, since, command, at)[:2])
        for s, (now, since) in self.plain.items():
            window = m.windows.get((now, command))
            if window and now == s and since == _OLD and s not in self.split:
                self.split[s] = (at - window[0], m.moves[now, command][0], at)
            self.plain[s] = m.step(now, since, command, at)[:2]

    def apply(self, state: str, since: int) -> tuple[str, int]:
        if state in self.split and since > self.split[state][0]:
            return self.split[state][1:]
        now, then = self.plain[state]
        return now, since if then == _OLD else then

    def row(self) -> dict:
        return {"plain": [(s, *x) for s, x in self.plain.items()], "split": [(s, *x) for s, x in self.split.items()]}

    def restored(self, plain: list, split: list) -> Summary:
        self.plain, self.split = {s: (a, b) for s, a, b in plain}, {s: (t, a, b) for s, t, a, b in split}
        return self


def decided(log: DataFrame, machine: Machine, item: str = "item", at: str = "at", id_: str = "id", ranges: int | None = None) -> DataFrame:
    """``log`` (item, at as a timestamp, id, command, refusal) with ``before`` and ``state``, whether each command is ``taken``,
    and the ``outcome``: what it is called, or why it is refused. A command with a ``refusal``, a precondition that it misses
    whatever the state, changes nothing. Commands of an item count in the order of time and id; those without an item or
    time are refused as unknown."""
    rows = log.withColumn("_at", F.unix_micros(F.col(at).cast("timestamp")))
    good = rows.where(F.col(item).isNotNull() & F.col("_at").isNotNull())
    order = ["_at", id_]
    ranged = scan.in_ranges(good, item, order, ranges).sortWithinPartitions(item, *order)

    def edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = current = None
        where, key = 0, None
        for f in frames:
            where = int(f["_range"].iloc[0]) if len(f) else where
            for k, command, refused, t in zip(f[item].tolist(), f["command"].tolist(), f["refusal"].tolist(), f["_at"].tolist()):
                if current is None or k != key:
                    if current is not None and first is None:
                        first = (key, current)
                    key, current = k, Summary(machine)
                if refused is None:
                    current.add(command, t)
        if current is not None:
            out = [(where, 1, str(key), current.row())] if first is None else [(where, 0, str(first[0]), first[1].row()), (where, 1, str(key), current.row())]
            yield pd.DataFrame([(w, last, k, r["plain"], r["split"]) for w, last, k, r in out], columns=["range", "last", "key", "plain", "split"])

    narrow = ranged.select("_range", F.col(item).cast("string").alias(item), "command", "refusal", "_at")
    kinds = "range int, last int, key string, plain array<struct<s: string, a: string, b: long>>, split array<struct<s: string, t: long, a: string, b: long>>"
    found: dict[int, list] = {}
    for r in narrow.mapInPandas(edges, kinds).collect():  # two rows for each range at most
        found.setdefault(r["range"], []).append((r["last"], r["key"], Summary(machine).restored(r["plain"], r["split"])))
    begins: dict[int, tuple[str, int]] = {}
    held_key, held = None, (machine.start, _OLD)
    for where in sorted(found):
        both = sorted(found[where], key=lambda x: x[0])
        begins[where] = held if both[0][1] == held_key else (machine.start, _OLD)
        held = both[-1][2].apply(*(begins[where] if len(both) == 1 else (machine.start, _OLD)))
        held_key = both[-1][1]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for f in frames:
            out = []
            for k, where, command, refused, t in zip(f[item].tolist(), f["_range"].tolist(), f["command"].tolist(), f["refusal"].tolist(), f["_at"].tolist()):
                if state is None:
                    state = begins[where]
                elif k != key:
                    state = (machine.start, _OLD)
                key, before = k, state[0]
                if refused is None:
                    *state, taken, name = machine.step(*state, command, t)
                else:
                    taken, name = False, refused
                out.append((before, state[0], taken, name))
            f[["before", "state", "taken", "outcome"]] = pd.DataFrame(out, columns=["before", "state", "taken", "outcome"], index=f.index)
            yield f[[id_, "before", "state", "taken", "outcome"]]

    narrow = ranged.select("_range", F.col(item).cast("string").alias(item), "command", "refusal", "_at", id_)
    kind = log.schema[id_].dataType.simpleString()
    out = narrow.mapInPandas(fold, f"{id_} {kind}, before string, state string, taken boolean, outcome string")
    none = rows.where(F.col(item).isNull() | F.col("_at").isNull()).select(id_, F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("state"), F.lit(False).alias("taken"), F.lit("unknown").alias("outcome"))
    return out.unionByName(none)


def _machine(decide_again: bool, restore_days: int | None) -> Machine:
    moves = {("none", "submit"): ("pending", "created"), ("none", "publish"): ("approved", "auto-approved")}
    moves |= {("pending", "approve"): ("approved", "decided:approved"), ("pending", "reject"): ("rejected", "decided:rejected"), ("approved", "reject"): ("rejected", "takedown")}
    moves |= {(s, "withdraw"): ("gone", "withdrawn") for s in ("pending", "approved", "rejected")}
    moves["rejected", "approve"] = ("approved", "decided:approved" if decide_again else "restored")
    if decide_again:
        moves |= {("approved", "approve"): ("approved", "decided:approved"), ("rejected", "reject"): ("rejected", "decided:rejected")}
    windows = {} if restore_days is None else {("rejected", "approve"): (restore_days * 86_400_000_000, "too late")}
    return Machine("none", moves, {"none": "not found", "gone": "not found", "pending": "exists", "approved": "decided", "rejected": "decided"}, windows)


def works(restore_days: int = 30) -> Machine:
    """Works: published at once or pending; decided once; a published one can be taken down, and one that was rejected put
    back for some days. Its owner can withdraw it."""
    return _machine(False, restore_days)


def submissions() -> Machine:
    """Submissions: published at once or pending; they can be decided again at any time."""
    return _machine(True, None)
