"""Evidence checks, grades and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze


def in_source(evidence: Column, text: Column) -> Column:
    """Whether the evidence, white space aside, stands in the text; empty or null evidence never does."""
    e = squeeze(evidence)
    return F.coalesce((F.length(e) > 0) & F.contains(squeeze(text), e), F.lit(False))


#: Statements that are matched within the row; more of them go through joins.
FEW_STATEMENTS = 10_000


def evidence_pairs(evidence: DataFrame, docs: DataFrame, words: int = 3) -> DataFrame:
    """(item_id, doc_id) of all evidence that stands in a document.

    Evidence is cut at spaces. Its first and last word may go on in the document, so runs of ``words`` inner words are
    its keys, and the key with the smallest hash stands for it; a document is a candidate if it has that run. Of short
    evidence the first letters stand for it. Up to FEW_STATEMENTS statements, counted first, a document's runs are
    intersected with all keys in one expression, so that only hits become rows; beyond that, hashes meet in a join. Texts
    come to the candidates in the end and confirm them.
    """
    e = evidence.select("item_id", squeeze(F.col("text")).alias("e")).where(F.length("e") > 0).withColumn("w", F.split("e", " "))
    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(words))))
    # a variable of its own holds the words, so that they are split once and not for each run
    runs = lambda x: F.transform(F.array(x), lambda w: F.when(F.size(w) >= words, hashed(w)).otherwise(F.array().cast("array<long>")))[0]
    inner = F.slice("w", 2, F.size("w") - 2)
    long = e.where(F.size("w") >= words + 2).select("item_id", "e", F.array_min(runs(inner)).alias("key"))
    short = e.where(F.size("w") < words + 2).select("item_id", "e")
    d = docs.select("doc_id", squeeze(F.col("text")).alias("t"))
    n_long, n_short = e.agg(F.count_if(F.size("w") >= words + 2), F.count_if(F.size("w") < words + 2)).first()
    found = []
    if n_long:
        held = runs(F.split("t", " "))
        if n_long <= FEW_STATEMENTS:
            keys = long.agg(F.collect_set("key")).scalar()
            hits = d.select("doc_id", "t", F.explode(F.array_intersect(held, keys)).alias("key"))
            found.append(hits.join(F.broadcast(long), "key").where(F.contains("t", F.col("e"))))
        else:
            hits = d.select("doc_id", F.explode(F.array_distinct(held)).alias("key")).join(long, "key").select("doc_id", "item_id", "e")
            found.append(hits.join(d, "doc_id").where(F.contains("t", F.col("e"))))
    if n_short and n_short <= FEW_STATEMENTS:
        all_short = short.agg(F.collect_list(F.struct("item_id", "e"))).scalar()
        here = d.withColumn("short", all_short)
        found.append(here.select("doc_id", F.explode(F.filter("short", lambda s: F.contains(F.col("t"), s["e"]))).alias("s")).select("doc_id", "s.item_id"))
    elif n_short:
        for size in range(1, 5):  # letters that stand for it: four, or all of shorter evidence
            part = short.withColumn("key", F.substring("e", 1, size)).where(F.length("e") == size if size < 4 else F.length("e") >= size)
            grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - size + 1, F.lit(1))), lambda i: F.substr(F.col("t"), i, F.lit(size))))
            hits = d.select("doc_id", F.explode(grams).alias("key")).join(part, "key").select("doc_id", "item_id", "e")
            found.append(hits.join(d, "doc_id").where(F.contains("t", F.col("e"))))
    if not found:
        return evidence.select("item_id").join(docs.select("doc_id"), F.lit(False))
    out = found[0].select("item_id", "doc_id")
    for f in found[1:]:
        out = out.unionByName(f.select("item_id", "doc_id"))
    return out.distinct()


def waterfall(steps: list[tuple[str, Column]]) -> Column:
    """The name of the first step whose condition holds; null if none does."""
    out = F.lit(None).cast("string")
    for name, cond in reversed(steps):
        out = F.when(F.coalesce(cond, F.lit(False)), name).otherwise(out)
    return out


def reasons(checks: list[tuple[str, Column]]) -> Column:
    """Names of all checks that fail, in order."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks)))


def moderation(text: Column, hard: list[str], soft: list[str]) -> Column:
    """reject for a hard word, else review for a soft one, else pass."""
    t = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))
    return F.when(hit(hard), "reject").when(hit(soft), "review").otherwise("pass")
