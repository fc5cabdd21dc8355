"""Vectors as short codes: a codebook for each part of a vector, learned by exact integer k-means with Exponion search.

A vector's components become integers, so that distances, sums and ties are exact. A part whose entry was a starts at a,
at distance d. An entry c that is as near or nearer has |a - c| <= |a - x| + |x - c| <= 2 d, so of a's other entries,
sorted by their distance to a, only those within 2 d are scanned: in squares, up to 4 times the squared distance. All
ties are within it too, and the lower index wins. Each round is one pass of tasks: they write their rows with the new
codes, and one row with the sums of their parts; only sums by part and entry come to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import join_one

SCALE = 4096
_ROW = "vec_id long, label_key string, vector array<int>, code binary, error long, sums array<long>"


def most_component(width: int, parts: int) -> int:
    """The bound on integer components: with it, squared distances of whole vectors fit 63 bits, and components 31."""
    return min(2**31 - 1, math.isqrt((2**63 - 1) // (parts * width)) // 2)


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, row by row."""
    apart = points - entries
    return np.einsum("ij,ij->i", apart, apart)


def nearest(points: np.ndarray, entries: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point (ties: the lower index) and its squared distance, searched from the previous one."""
    apart = np.array([distances(entries, np.broadcast_to(e, entries.shape)) for e in entries])
    order = np.argsort(apart, axis=1, kind="stable")  # begins with an entry at distance 0, mostly the entry itself
    beside = np.take_along_axis(apart, order, axis=1)
    best, least = previous.astype(np.int64), distances(points, entries[previous])
    radius = 4 * least.astype(np.float64) * (1 + 1e-12)  # an upper bound, where 4 * least would leave 64 bits
    reach = np.array([np.searchsorted(beside[a], r, "right") for a, r in zip(previous.tolist(), radius.tolist())]) if len(points) < 64 else _reach(beside, previous, radius)
    by = np.argsort(-reach, kind="stable")  # those that scan farther come first
    upto = np.searchsorted(-reach[by], -np.arange(entries.shape[0]), "left")  # how many points scan their k-th neighbour
    for k in range(entries.shape[0]):
        at = by[: upto[k]]
        if not len(at):
            break
        c = order[previous[at], k]
        d = distances(points[at], entries[c])
        better = (d < least[at]) | ((d == least[at]) & (c < best[at]))
        best[at[better]], least[at[better]] = c[better], d[better]
    return best, least


def _reach(beside: np.ndarray, previous: np.ndarray, radius: np.ndarray) -> np.ndarray:
    out = np.empty(len(previous), np.int64)
    for a in range(len(beside)):
        mine = np.flatnonzero(previous == a)
        out[mine] = np.searchsorted(beside[a], radius[mine], "right")
    return out


def _assign(codebooks: np.ndarray):
    """A pass: each row with its nearest entries, then one row with counts and sums by part, entry and place.
    ``codebooks`` is (parts, entries, width)."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            n = batch.num_rows
            vectors = batch["vector"].flatten().to_numpy().astype(np.int64).reshape(n, parts, width)
            before = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(n, parts)
            code, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
            for p in range(parts):
                best, least = nearest(vectors[:, p], codebooks[p], before[:, p])
                code[:, p] = best
                error += least
                np.add.at(sums[p, :, 0], best, 1)
                np.add.at(sums[p, :, 1:], best, vectors[:, p])
            out = [batch["vec_id"], batch["label_key"], batch["vector"], pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error), pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=["vec_id", "label_key", "vector", "code", "error", "sums"])
        row = [[None], [None], [None], [None], [None], [sums.ravel()]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.binary(), pa.int64(), pa.list_(pa.int64())))], names=["vec_id", "label_key", "vector", "code", "error", "sums"])

    return run


def moved(codebooks: np.ndarray, assigned: DataFrame) -> np.ndarray:
    """Each entry at the floor of its parts' mean; an unused one stays. A number for each part, entry and place comes to
    the driver, whatever the input."""
    total = assigned.where("sums is not null").select(F.posexplode("sums").alias("place", "value"))
    found = dict(total.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total")).collect())
    parts, entries, width = codebooks.shape
    out = codebooks.copy()
    for p in range(parts):
        for e in range(entries):
            at = (p * entries + e) * (width + 1)
            n = int(found.get(at, 0))
            if n:
                out[p, e] = [int(found[at + 1 + i]) // n for i in range(width)]
    return out


@common.in_small_batches
def encode_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each kept row of ``vectors`` (vec_id, embedding, label;
    other columns, whatever their names, are ignored).

    Rows whose vector is null, empty or holds a null or non-finite component are dropped, and so are those whose length
    is no multiple of ``parts`` or not that of the first kept row (the order is that of vec_id, null last, then of the
    vector). A component x becomes floor(4096 * x), within bounds that keep distances in 63 bits (at 64 components, x
    within 46,340 of zero; farther ones count as the bound). The codebooks start as the parts of the first ``entries``
    kept rows, fewer if there are fewer; repeated rows take part as often as they stand. code has two hexadecimal digits
    for each part; error is the sum of squared distances, label_error that over all rows of a label, nulls together.
    An empty table gives an empty result.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index takes one byte")
    spark = vectors.sparkSession
    real = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("label_key")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), key, real.alias("embedding")).where((F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & sound)
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding").asc()]
    first = kept.orderBy(*order).limit(1).select(F.size("embedding")).collect()
    empty = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if not first:
        return spark.createDataFrame([], empty)
    size = first[0][0]
    bound = most_component(size // parts, parts)
    whole = F.transform("embedding", lambda x: F.greatest(F.lit(float(-bound)), F.least(F.lit(float(bound)), F.floor(x * SCALE).cast("double"))).cast("int"))
    kept = kept.where(F.size("embedding") == size).select("vec_id", "label_key", "embedding", whole.alias("vector"))
    start = np.array([r.vector for r in kept.orderBy(*order).limit(entries).select("vector").collect()], np.int64)
    codebooks = start.reshape(len(start), parts, size // parts).transpose(1, 0, 2).copy()

    rows = common.written(kept.select("vec_id", "label_key", "vector", F.lit(bytes(parts)).alias("code")), "vectors")
    for step in range(rounds + 1):
        assigned = common.written(rows.select("vec_id", "label_key", "vector", "code").mapInArrow(_assign(codebooks), _ROW), "vector-codes")
        if step < rounds:
            codebooks = moved(codebooks, assigned)
        common.dropped(rows)
        rows = assigned.where("sums is null")
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    coded = rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_key")
    by_label = coded.groupBy("label_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"))
    by_label = common.written(by_label.select("label_key", F.expr("try_cast(total AS long)").alias("label_error"), "n"), "label-errors")
    total = by_label.agg(F.sum("n")).first()[0] or 0
    return join_one(coded, by_label, "label_key", total).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
