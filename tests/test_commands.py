"""Command logs against a plain fold, cut into ranges wherever it may be."""

from __future__ import annotations

import random

import pytest
from catalogkit.operators import commands
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def plain_fold(rows: list[tuple], machine: commands.Machine) -> dict:
    out, held = {}, {}
    for id_, item, at, command, refusal in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        state, since = held.get(item, (machine.start, 0))
        window = machine.windows.get((state, command))
        if refusal:
            out[id_] = (state, state, False, refusal)
        elif (state, command) not in machine.moves:
            out[id_] = (state, state, False, machine.refusals[state])
        elif window and at - since >= window[0]:
            out[id_] = (state, state, False, window[1])
        else:
            to, name = machine.moves[state, command]
            out[id_], held[item] = (state, to, True, name), (to, at)
    return out


def log_rows(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    commands_ = ["submit", "publish", "approve", "reject", "approve", "reject", "reject", "withdraw", "else"]
    return [(i, rng.choice([1, 1, 1, 2, 3, 4, 5]), rng.randrange(200) * 10 * HOUR, rng.choices(commands_, [4, 1, 6, 6, 1, 1, 1, 0.3, 1])[0], rng.choice([None] * 9 + ["rate"])) for i in range(n)]


@pytest.mark.parametrize("ranges", [1, 7, 40])
@pytest.mark.parametrize("machine", [commands.works(10), commands.submissions()])
def test_logs_are_folded_alike_however_they_are_cut(spark, ranges, machine):
    rows = log_rows(ranges, 500)
    df = spark.createDataFrame(rows, "id long, item long, us long, command string, refusal string").withColumn("at", F.timestamp_micros("us"))
    got = {r.id: (r.before, r.state, r.taken, r.outcome) for r in commands.decided(df, machine, ranges=ranges).collect()}
    assert got == plain_fold(rows, machine)


def test_a_summary_is_the_fold_from_every_state():
    machine = commands.works(10)
    for seed in range(200):
        rng = random.Random(seed)
        log = sorted((rng.randrange(60) * 12 * HOUR, rng.choice(["approve", "reject", "withdraw", "submit", "approve", "reject"])) for _ in range(rng.randrange(6)))
        summary = commands.Summary(machine)
        for at, command in log:
            summary.add(command, at)
        for state in machine.states():
            for since in range(-30 * 24 * HOUR, 0, 40 * HOUR):
                now, then = state, since
                for at, command in log:
                    now, then = machine.step(now, then, command, at)[:2]
                assert summary.apply(state, since) == (now, then)


def test_commands_without_an_item_or_time_are_refused(spark):
    df = spark.createDataFrame([(1, None, "submit", None), (2, 5, "submit", None)], "id long, item long, command string, refusal string").withColumn("at", F.when(F.col("id") == 1, F.timestamp_micros(F.lit(0))))
    assert sorted(tuple(r) for r in commands.decided(df, commands.works()).collect()) == [(1, None, None, False, "unknown"), (2, None, None, False, "unknown")]
