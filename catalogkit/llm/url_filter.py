"""URL filters on a sorted digest array.

Every rule is a string ``host/path``. The 64-bit xxhash of each rule goes into sorted arrays in the shared
folder; workers memory-map them, probe them with one vectorised binary search per batch, and confirm each hit
against the stored rule string, so that a digest collision never decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_PARTS = re.compile(r"([^/?#]*)([^?#]*)", re.S)
_AZ = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or where ``://`` is missing."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    host, path = _PARTS.match(url, at + 3).groups()
    return host.translate(_AZ), path


def build_index(rules: DataFrame) -> list[dict]:
    """Write sorted shards of (digest, rule, verdict) to the shared folder; one small record per shard comes back.

    rules: columns rule, verdict. Null rules are dropped; of a rule given with both verdicts ``block`` stays (the larger
    string), so any order of rows gives the same index. An empty table gives no shards.
    """
    spark = rules.sparkSession
    uri = common.scratch(spark, "url-index")
    one = rules.where("rule is not null").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    one = one.withColumn("digest", F.xxhash64("rule")).repartitionByRange("digest").sortWithinPartitions("digest")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.select(["rule", "verdict"]).to_pylist()]
        if not rows:
            return
        rows = sorted((xxhash.xxh64_intdigest(r["rule"]), r["rule"], r["verdict"]) for r in rows)
        text = [r[1].encode() for r in rows]
        ends = np.cumsum([len(t) for t in text], dtype=np.int64)
        yield pa.RecordBatch.from_pylist([{
            "digests": common.put_array(uri, "digests", np.array([r[0] for r in rows], np.uint64)),
            "ends": common.put_array(uri, "ends", ends),
            "strings": common.put_array(uri, "strings", np.frombuffer(b"".join(text), np.uint8)),
            "blocked": common.put_array(uri, "blocked", np.array([r[2] == "block" for r in rows], np.uint8)),
            "uri": uri,
            "lengths": sorted({len(r[1].partition("/")[2]) for r in rows}),
        }])

    schema = "digests string, ends string, strings string, blocked string, uri string, lengths array<long>"
    return [r.asDict() for r in one.mapInArrow(store, schema).collect()]


class _Shard:
    def __init__(self, at: dict):
        self.digests = common.map_array(at["uri"], at["digests"], np.uint64)
        self.ends = common.map_array(at["uri"], at["ends"], np.int64)
        self.strings = common.map_array(at["uri"], at["strings"], np.uint8)
        self.blocked = common.map_array(at["uri"], at["blocked"], np.uint8)

    def probe(self, keys: list[bytes], digests: np.ndarray) -> Iterator[tuple[int, bool]]:
        """(index of a key, blocked) for each key that is stored."""
        at = np.searchsorted(self.digests, digests)
        for k in np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == digests)).tolist():
            i = int(at[k])
            while i < len(self.digests) and self.digests[i] == digests[k]:  # equal digests stand side by side
                if self.strings[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])].tobytes() == keys[k]:
                    yield k, bool(self.blocked[i])
                i += 1


def apply(pages: DataFrame, index: list[dict], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url; other columns are ignored).

    A rule fits its host and all its subdomains where the url's path starts with the rule's path; the longest
    fitting rule wins. Without one, rule is null and the verdict is ``default``. A null url, or one without
    ``://``, has an empty host and path; urls of any length are read whole. Repeated rows are judged each; an empty table gives an empty result.
    """
    lengths = sorted({n for s in index for n in s["lengths"]})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [_Shard(s) for s in index]
        for batch in batches:
            parts = [split_url(u) for u in batch["url"].to_pylist()]
            keys: list[str] = []
            owner: list[int] = []
            for row, (host, path) in enumerate(parts):
                if host and path[:1] == "/":
                    labels = host.split(".")
                    ends = [path[: n + 1] for n in lengths if n < len(path)]
                    for i in range(len(labels)):
                        keys += [".".join(labels[i:]) + end for end in ends]
                        owner += [row] * len(ends)
            raw = [k.encode("utf-8", "surrogatepass") for k in keys]
            digests = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
            best: dict[int, tuple[int, str, bool]] = {}
            for shard in shards:
                for k, blocked in shard.probe(raw, digests):
                    best[owner[k]] = max(best.get(owner[k], (-1, "", False)), (len(keys[k]), keys[k], blocked))
            found = [best.get(row) for row in range(len(parts))]
            yield pa.RecordBatch.from_arrays([
                batch["page_id"].cast(pa.int64()), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()),
                pa.array([f and f[1] for f in found], pa.string()), pa.array([default if f is None else "block" if f[2] else "allow" for f in found], pa.string()),
            ], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", "url").mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")
