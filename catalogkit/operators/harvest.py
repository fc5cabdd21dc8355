"""From landed pages to a catalog: what is new is verified, graded and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crawl, merge, verify
from .ordering import top


def changed(pages: DataFrame, state: DataFrame, key: str) -> DataFrame:
    return crawl.unchanged(pages, state, key).where("not unchanged").drop("unchanged")


def verdicts(pages: DataFrame, state: DataFrame, extractions: DataFrame, fields: list[tuple[str, str]], as_of: str, key: str = "id") -> DataFrame:
    """Changed pages with what was extracted from them, verified and graded."""
    return verify.trust(verify.verify_opportunity(crawl.extracted(changed(pages, state, key), extractions, key), fields, as_of))


def into_catalog(base: DataFrame, found: DataFrame, key: str, inherit: list[str]) -> tuple[DataFrame, DataFrame]:
    """The catalog after an upsert of the records that are graded auto, and the queue of those to be reviewed. ``found``
    are verdicts; verified rows of the base stay as they are."""
    kept = found.where("drop_reason is null")
    new = kept.where("trust = 'auto'").withColumns({"verified": F.lit(False), "ord": F.col(key) + F.lit(1 << 40)})
    return merge.upsert(base, new.select(base.columns), key, inherit), kept.where("trust = 'pending'")


def into_channel(base: DataFrame, found: DataFrame, key: str, url: str) -> DataFrame:
    """A channel with the verified records that it does not have by key or url."""
    new = found.where("drop_reason is null").select(base.columns)
    return base.unionByName(merge.append_new(base, new, key, url))


def search_and_ingest(hits: DataFrame, base: DataFrame, query: str, url: str, order: list, ok: Column, target: int = 6, most: int = 16) -> DataFrame:
    """The hits of a search that become records: each address once, none that the base has, in order, until enough of
    those probed have been taken."""
    fresh = top(hits, [query, url], order).join(base.select(url).where(F.col(url).isNotNull()).distinct(), url, "left_anti")
    return crawl.early_stop(fresh, query, order, ok, target, most).where(ok)


def filled(base: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The base with values found for fields that it still lacks (null or empty)."""
    f = found.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    j = base.join(f, key, "left")
    return j.withColumns({c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.col(f"_{c}")) for c in fields}).select(base.columns)


def new_sources(candidates: DataFrame, known: DataFrame, domain: str, order: list) -> DataFrame:
    """Candidates of domains that are not known yet, the first of each domain."""
    return merge.minus(top(candidates.where(F.col(domain).isNotNull()), [domain], order), known, domain)
