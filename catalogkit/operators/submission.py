"""What people submit, checked by kind: the first fault, or the record as it is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import calendar_date
from ..functions.text import present
from ..functions.urls import is_blocked, is_unsafe

#: What is said of each fault.
DATE_FORM, DATE_NONE = "日期格式应为 YYYY-MM-DD", "日期无效,请检查年月日"
NO_SCHEME, UNUSABLE = "需以 http(s):// 开头", "该链接不可用(请填原始/官方网址)"
FAULTS = {
    "job": ["职位名称需 2–80 字", "机构名称需 2–80 字", "请填写申请链接(官网招聘页/招聘启事原文)", "申请链接"],
    "news": ["资讯标题需 4–120 字", "请填写来源名称(媒体/机构)", "请填写原文链接", "原文链接"],
    "opp": ["标题需 2–120 字", "主办方需 2–80 字", "请选择类别", "请注明信息来源(如:机构公众号/官网/海报等)", "官网链接"],
}
MOST_SUMMARY, MOST_PLACE, MOST_NOTE = 500, 40, 150


def url_fault(url: Column, label: str) -> Column:
    """Why a link cannot be taken; null if it can."""
    host = F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#]*)", 1)
    return F.when(~url.rlike(r"(?i)^https?://.{4,300}$"), F.lit(label + NO_SCHEME)).when(is_unsafe(host) | is_blocked(url), F.lit(UNUSABLE))


def checked(rows: DataFrame, as_of: str, categories: list[str], employment: list[str]) -> DataFrame:
    """rows (kind, title, org, source, source_note, category, employment_type, city, country, salary, deadline, summary, url;
    all text) with ``error``, the first fault in the order in which a kind is checked, and, without one, the columns as they
    are kept: trimmed, cut to their lengths, empty ones null, and for news the day of publication, at most ``as_of``. A kind
    other than job and news is an opportunity. With an error the kept columns are null."""
    s = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "org", "source", "source_note", "category", "employment_type", "city", "country", "salary", "deadline", "summary", "url")}
    cut = lambda c, n: F.substring(s[c], 1, n)
    kind = F.when(F.col("kind").isin("job", "news"), F.col("kind")).otherwise("opp")
    length = lambda x, low, high: F.length(x).between(low, high)
    due = s["deadline"]
    date = F.when(due == "", None).when(~due.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), DATE_FORM).when(calendar_date(due).isNull(), DATE_NONE)
    f = FAULTS["job"]
    job = F.when(~length(s["title"], 2, 80), f[0]).when(~length(s["org"], 2, 80), f[1]).when(s["url"] == "", f[2]).otherwise(url_fault(s["url"], f[3]))
    f = FAULTS["news"]
    news = F.when(~length(s["title"], 4, 120), f[0]).when(F.length(cut("source", MOST_PLACE)) < 2, f[1]).when(s["url"] == "", f[2]).otherwise(url_fault(s["url"], f[3]))
    f = FAULTS["opp"]
    opp = F.when(~length(s["title"], 2, 120), f[0]).when(~length(s["org"], 2, 80), f[1]).when(~s["category"].isin(categories), f[2])
    opp = opp.when(F.length(cut("source_note", MOST_NOTE)) < 2, f[3]).otherwise(F.when(s["url"] != "", url_fault(s["url"], f[4])))
    out = rows.withColumn("_kind", kind).withColumn("error", F.coalesce(date, F.when(F.col("_kind") == "job", job).when(F.col("_kind") == "news", news).otherwise(opp)))
    ok, of = F.col("error").isNull(), lambda *kinds: F.col("_kind").isin(*kinds)
    kept = {
        "kept_title": s["title"], "kept_org": F.when(of("job", "opp"), s["org"]), "kept_place": F.when(of("job", "opp"), present(F.concat_ws(" ", present(cut("city", MOST_PLACE)), present(cut("country", MOST_PLACE))))),
        "kept_source": F.when(of("news"), cut("source", MOST_PLACE)).when(of("opp"), cut("source_note", MOST_NOTE)), "kept_type": F.when(of("opp"), s["category"]).when(of("job"), F.when(s["employment_type"].isin(employment), s["employment_type"])),
        "kept_salary": F.when(of("job"), present(cut("salary", MOST_PLACE))), "kept_day": F.when(of("news"), F.when(due != "", F.least(due, F.lit(as_of)))).otherwise(present(due)), "kept_summary": present(cut("summary", MOST_SUMMARY)), "kept_url": present(s["url"]),
    }
    return out.withColumns({n: F.when(ok, x) for n, x in kept.items()}).drop("_kind")
