"""URL expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = r"^(?:utm_[^=]*|fbclid|gclid|spm|ref)(?:=|$)"


def host_of(url: Column) -> Column:
    """Host in lower case without user, port and ``www.``; null if the text is no http url."""
    host = F.regexp_extract(F.lower(url), r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and all its parent domains, so that a suffix match becomes an equality."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def same_site(host: Column, base: Column) -> Column:
    return (host == base) | F.endswith(host, F.concat(F.lit("."), base))


def normal_url(url: Column) -> Column:
    """Without fragment and tracking parameters, parameters sorted, scheme and host in lower case, no slash at the end."""
    bare = F.regexp_replace(url, "#.*$", "")
    head, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    origin = F.regexp_extract(head, r"^(https?://[^/]*)", 1)
    path = F.regexp_replace(F.substr(head, F.length(origin) + 1), "/+$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(F.lower(origin), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def url_date(url: Column, as_of: str) -> Column:
    """A date in the path, ``/20260131`` or ``/2026/1/31``, unless it is no date or after ``as_of``."""
    a = F.regexp_extract(url, r"/(20[0-9]{2})([01][0-9])([0-3][0-9])(?:[^0-9]|$)", 0)
    b = [F.regexp_extract(url, r"/(20[0-9]{2})[/-]([0-9]{1,2})[/-]([0-9]{1,2})(?:[^0-9]|$)", i) for i in (1, 2, 3)]
    text = F.when(a != "", F.concat_ws("-", F.substring(a, 2, 4), F.substring(a, 6, 2), F.substring(a, 8, 2))).when(b[0] != "", F.concat_ws("-", b[0], F.lpad(b[1], 2, "0"), F.lpad(b[2], 2, "0")))
    day = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(day <= F.to_date(F.lit(as_of)), day)


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that it names several times and that is computed once."""
    return F.transform(F.array(x), f)[0]


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` parts taken away; what would lead above the root stays at the root."""

    def of(p: Column) -> Column:
        parts = F.split(p, "/")
        kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
        return F.when(p.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.concat(F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit("")))).otherwise(p)

    return bound(path, of)


def resolve(href: Column, base: Column) -> Column:
    """An absolute url for a link; one with a scheme of its own stays as it is. Each part is computed once."""

    def joined(h: Column, b: Column) -> Column:
        bare = F.regexp_replace(b, r"[?#].*$", "")
        full = F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract(b, r"^(https?:)", 1), h)).when(F.startswith(h, F.lit("/")), F.concat(F.regexp_extract(b, r"^(https?://[^/?#]+)", 1), h))
        full = full.when(F.startswith(h, F.lit("?")), F.concat(bare, h)).when(F.startswith(h, F.lit("#")), F.concat(F.regexp_replace(b, "#.*$", ""), h))
        return full.otherwise(F.concat(F.regexp_replace(bare, r"(^https?://[^/]+)$|/[^/]*$", "$1/"), h))

    def plain(full: Column) -> Column:
        host, tail = F.regexp_extract(full, r"^(https?://[^/?#]*)", 1), F.regexp_extract(full, r"([?#].*)$", 1)
        path = F.substr(full, F.length(host) + 1, F.length(full) - F.length(host) - F.length(tail))
        return F.when(host == "", full).otherwise(F.concat(host, without_dots(path), tail))

    return bound(F.struct(href.alias("h"), base.alias("b")), lambda x: bound(joined(x["h"], x["b"]), plain))


#: Hosts that are no sources, by any part of the address.
BLOCKED = (
    r"(?i)weixin\.qq|mp\.weixin|zhihu\.com|xiaohongshu|xhslink|weibo\.|douban\.com|bilibili|baike\.baidu|baidu\.com|bing\.com|duckduckgo|zhipin|liepin|58\.com|facebook\.|instagram\.|youtube\.|twitter\.|t\.me"
    r"|tiktok|douyin|1688\.|taobao|jd\.com|csdn|jianshu|sohu\.com|163\.com/|qq\.com/a/|sina\.com|1zj\.com|wjx\.cn|zhengjifuwu|opencallradar|saikr\.com|gfbzb|征兵|cpta\.com\.cn|activity\.tencent|meishujia\.cn"
    r"|zcool\.com\.cn/work|nipic|huitu\.com|quanjing"
)


def is_blocked(url: Column) -> Column:
    return url.rlike(BLOCKED)


def is_unsafe(authority: Column) -> Column:
    """Whether a host is empty, local, or a bare address."""
    h = F.lower(F.coalesce(authority, F.lit("")))
    h = F.regexp_extract(F.regexp_replace(h, r"^\[|\]$", ""), r"^([^:]*)", 1)
    return (h == "") | (h == "localhost") | h.rlike(r"\.(?:local|internal|lan|home)$") | h.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
