"""Keys and scores of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import key_text


def fingerprint(title: Column, org: Column, deadline: Column) -> Column:
    return F.md5(F.concat_ws("|", key_text(title), key_text(org), F.coalesce(deadline, F.lit("rolling"))))


def completeness(fields: list[Column], verified: Column, items: Column | None = None) -> Column:
    """A point for each field that is neither null nor empty, one for each list item, 100 for a verified record."""
    score = F.lit(0)
    for f in fields:
        score = score + (F.coalesce(f.cast("string"), F.lit("")) != "").cast("int")
    if items is not None:
        score = score + F.greatest(F.size(items), F.lit(0))
    return score + F.when(F.coalesce(verified, F.lit(False)), 100).otherwise(0)


def djb2(x: Column) -> Column:
    """The 32-bit hash h * 33 ^ c over a text's letters, from 5381."""
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: F.pmod(h * 33, F.lit(4294967296)).bitwiseXOR(c))


def short_id(x: Column) -> Column:
    """Six base-36 digits of the first ten hex digits of the sha1."""
    return F.substring(F.lower(F.conv(F.substring(F.sha1(x), 1, 10), 16, 36)), 1, 6)


def times31(x: Column) -> Column:
    """The 32-bit hash h * 31 + c over a text's letters (basic plane)."""
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(4294967296)))
