"""Verification of extracted records against the page that they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import calendar_date, expired, matches_evidence
from ..functions.text import apply_signal, present, squeeze
from ..functions.urls import host_of, same_site
from .evidence import waterfall
from .scratch import settled


def _texts(df: DataFrame, text: str) -> DataFrame:
    """The page's text with its white space squeezed once, as ``_text``, whatever asks for it later."""
    return df if "_text" in df.columns else settled(df.withColumn("_text", squeeze(F.coalesce(text, F.lit("")))))


def _holds(value: Column) -> Column:
    e = squeeze(value)
    return F.coalesce((F.length(e) > 0) & F.contains(F.col("_text"), e), F.lit(False))


def without_evidence(df: DataFrame, fields: list[tuple[str, str]], text: str) -> DataFrame:
    """Fields (name, evidence column) lose values that the text does not prove; ``nulled`` lists their names in order."""
    given, df = df.columns, _texts(df, text)
    fails = {f: F.col(f).isNotNull() & ~_holds(F.col(e)) for f, e in fields}
    out = df.withColumn("nulled", F.array_compact(F.array(*(F.when(c, F.lit(f)) for f, c in fails.items()))))
    return out.withColumns({f: F.when(~F.array_contains("nulled", f), F.col(f)) for f in fails}).drop(*{"_text"}.difference(given))


def not_verbatim(df: DataFrame, fields: list[str], text: str) -> DataFrame:
    """Fields lose non-empty values that do not themselves stand in the text; ``nulled`` gains their names."""
    given, df = df.columns, _texts(df, text)
    fails = {f: present(F.col(f)).isNotNull() & ~_holds(F.col(f)) for f in fields}
    old = F.col("nulled") if "nulled" in df.columns else F.array().cast("array<string>")
    out = df.withColumn("_more", F.array_compact(F.array(*(F.when(c, F.lit(f)) for f, c in fails.items()))))
    out = out.withColumns({f: F.when(~F.array_contains("_more", f), F.col(f)) for f in fails})
    return out.withColumn("nulled", F.concat(old, "_more")).drop("_more", *{"_text"}.difference(given))


def verify_opportunity(df: DataFrame, fields: list[tuple[str, str]], as_of: str, grace_days: int = 0, text: str = "text") -> DataFrame:
    """Opportunities with ``drop_reason`` (null: kept), ``nulled`` and flags. The order of the checks decides the reason:
    not applicable, no word of applying in the text, then, after values without evidence and impossible dates are
    taken away, an expired deadline, an url of another site."""
    applicable, signal = F.coalesce("applicable", F.lit(True)), apply_signal(F.col(text)) | (F.coalesce(text, F.lit("")) == "")
    df = _texts(df, text)
    df = df.withColumn("_title_ok", _holds(F.col("ev_title")))
    df = without_evidence(df, fields, text)
    wrong = F.col("deadline").isNotNull() & calendar_date(F.col("deadline")).isNull()
    df = df.withColumn("nulled", F.when(wrong, F.concat("nulled", F.array(F.lit("deadline")))).otherwise(F.col("nulled"))).withColumn("deadline", F.when(~wrong, F.col("deadline")))
    own = same_site(host_of(F.col("url")), F.regexp_replace(F.lower("domain"), r"^www\.", ""))
    reason = waterfall([("not-applicable", ~applicable), ("no-apply-signal", ~signal), ("expired", expired(F.col("deadline"), as_of, grace_days)), ("cross-domain-url", ~F.coalesce(own, F.lit(False)))])
    rolling = F.coalesce(F.col("deadline_note").rlike("(?i)常年|长期|滚动|rolling|ongoing"), F.lit(False))
    df = df.withColumns({"drop_reason": reason, "has_deadline": F.col("deadline").isNotNull() | rolling, "any_fail": (F.size("nulled") > 0) | ~F.col("_title_ok")})
    return settled(df.drop("_title_ok", "_text"))


def trust(df: DataFrame) -> DataFrame:
    """auto for records of trusted sources with a deadline, an url and all evidence; else pending, with the reasons."""
    source = (F.col("org_type") == "official") | F.coalesce("trust_auto", F.lit(False))
    checks = [("source", F.coalesce(source, F.lit(False))), ("url", present(F.col("url")).isNotNull()), ("deadline", F.col("has_deadline")), ("evidence", ~F.col("any_fail"))]
    reasons = F.array_compact(F.array(*(F.when(~ok, F.lit(n)) for n, ok in checks)))
    return df.withColumn("reasons", reasons).withColumn("trust", F.when(F.size("reasons") == 0, "auto").otherwise("pending"))


def _dated(df: DataFrame, field: str) -> DataFrame:
    """A date loses its value unless it is a date, proven by the text and told by its evidence."""
    ok = calendar_date(F.col(field)).isNotNull() & _holds(F.col(f"ev_{field}")) & matches_evidence(F.col(field), F.col(f"ev_{field}"))
    bad = F.col(field).isNotNull() & ~ok
    return df.withColumn("nulled", F.when(bad, F.concat("nulled", F.array(F.lit(field)))).otherwise(F.col("nulled"))).withColumn(field, F.when(~bad, F.col(field)))


def _titled() -> list[tuple[str, Column]]:
    title = F.col("title")
    return [("not-applicable", ~F.coalesce("applicable", F.lit(True))), ("no-title", present(title).isNull()), ("title-evidence-fail", ~_holds(F.col("ev_title"))), ("title-not-verbatim", ~_holds(title))]


def verify_news(df: DataFrame, as_of: str, most_days: int, text: str = "text") -> DataFrame:
    """News with ``drop_reason`` and ``nulled``: the title must be proven and verbatim, the source verbatim, the day of
    publication proven; news known to be older than ``most_days`` goes."""
    df = _dated(not_verbatim(_texts(df, text), ["source"], text), "published_at")
    old = F.datediff(F.to_date(F.lit(as_of)), calendar_date(F.col("published_at"))) > most_days
    return df.withColumn("drop_reason", waterfall([*_titled(), ("too-old", old)])).drop("_text")


def verify_jobs(df: DataFrame, as_of: str, text: str = "text") -> DataFrame:
    """Jobs: as news; organisation, salary and type need evidence, and what is to be copied must be verbatim; a job whose
    proven deadline is over goes."""
    df = without_evidence(_texts(df, text).withColumns({f: present(F.col(f)) for f in ("org", "salary", "employment_type")}), [(f, f"ev_{f}") for f in ("org", "salary", "employment_type")], text)
    df = _dated(not_verbatim(df, ["org", "salary", "city", "country"], text), "deadline")
    return df.withColumn("drop_reason", waterfall([*_titled(), ("job-expired", expired(F.col("deadline"), as_of))])).drop("_text")


def run_stats(verdicts: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """One row: kept, pending and dropped records, values taken away, tokens and cost. ``prices`` has the price of a million
    input and output tokens by provider."""
    price = F.create_map(*(F.lit(x) for k, (i, o) in prices.items() for x in (k, [float(i), float(o)])))[F.col("provider")]
    cost = (F.col("input_tokens") * price[0] + F.col("output_tokens") * price[1]) / 1e6
    return verdicts.agg(
        F.count_if(F.col("drop_reason").isNull()).alias("kept"), F.count_if(F.col("drop_reason").isNull() & (F.col("trust") == "pending")).alias("pending"), F.count_if(F.col("drop_reason").isNotNull()).alias("dropped"),
        F.coalesce(F.sum(F.size("nulled")), F.lit(0)).alias("nulled"), F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.sum(cost), F.lit(0.0)), 6).alias("cost"),
    )
