"""Places: dictionaries, address ranges, regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dictionary

UNKNOWN = "未知"


def longest_match(text: Column, names: list[str]) -> Column:
    """The longest dictionary name that the text holds, the first of equals. The names are a short literal list."""
    order = sorted(range(len(names)), key=lambda i: (-len(names[i]), i))
    return F.get(F.filter(F.array(*(F.lit(names[i]) for i in order)), lambda n: F.contains(text, n)), F.lit(0))


def first_match(text: Column, rules: list[tuple[list[str], str]], default: str | None = None) -> Column:
    """The value of the first rule of which a keyword stands in the text."""
    out = F.lit(default)
    for words, value in reversed(rules):
        cond = F.lit(False)
        for w in words:
            cond = cond | F.contains(text, F.lit(w))
        out = F.when(cond, F.lit(value)).otherwise(out)
    return out


def ipv4(x: Column) -> Column:
    """The address as a number; an IPv4 address in IPv6 form too; null for another text."""
    p = F.split(F.regexp_replace(F.trim(x), "^::ffff:", ""), r"\.")
    ok = F.regexp_replace(F.trim(x), "^::ffff:", "").rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")
    return F.when(ok, p[0].cast("long") * 16777216 + p[1].cast("long") * 65536 + p[2].cast("long") * 256 + p[3].cast("long"))


def is_reserved(ip: Column) -> Column:
    """Whether an address is of a private, local or reserved range."""
    blocks = [(0, 8), (10, 8), (100 * 256 + 64, 10), (127, 8), (169 * 256 + 254, 16), (172 * 256 + 16, 12), (192 * 256 + 168, 16)]
    starts = [(a << 24 if a < 256 else a << 16, n) for a, n in blocks]
    out = ip >= (224 << 24)
    for a, n in starts:
        out = out | ip.between(a, a + (1 << (32 - n)) - 1)
    return out


def fill_stats(df: DataFrame, method: str, missing: Column, still: Column) -> DataFrame:
    """For each method the rows, those unknown before and after it, and the share of the latter."""
    return df.groupBy(method).agg(F.count("*").alias("n"), F.count_if(missing).alias("unknown_before"), F.count_if(still).alias("unknown_after"), F.round(100.0 * F.count_if(still) / F.count("*"), 1).alias("pct"))


#: Places by which a record's region is told, the first that fits.
REGIONS = [
    ("asia", "日本|韩国|新加坡|印度|泰国|越南|马来|菲律宾|印尼|蒙古|哈萨克"),
    ("europe", "法国|德国|荷兰|英国|意大利|西班牙|瑞士|比利时|奥地利|斯洛文尼亚|瑞典|挪威|芬兰|丹麦|波兰|葡萄牙|捷克|匈牙利|希腊|爱尔兰|冰岛|克罗地亚"),
    ("namerica", "美国|加拿大|墨西哥"),
]


def region(country: Column, city: Column) -> Column:
    """One of six regions."""
    c, t = F.coalesce(country, F.lit("")), F.coalesce(city, F.lit(""))
    out = F.when(c.rlike("香港|澳门|台湾|台北|高雄") | t.rlike("香港|澳门|台北|高雄|台中|台南"), "hktw").when(c == "中国", "cn")
    for name, places in REGIONS:
        out = out.when(c.rlike(places), name)
    return out.otherwise("other")


def range_join(points: DataFrame, value: str, ranges: DataFrame, low: str, high: str, bits: int = 16, how: str = "left") -> DataFrame:
    """Join values with the ranges that hold them by an equality on their high bits; a range goes to each bucket it
    touches. Ranges must not overlap."""
    r = ranges.withColumn("_b", F.explode(F.sequence(F.shiftright(low, bits), F.shiftright(high, bits))))
    p = points.withColumn("_b", F.shiftright(value, bits))
    return p.join(r, (p["_b"] == r["_b"]) & F.col(value).between(F.col(low), F.col(high)), how).drop("_b")


def fill_place(df: DataFrame, text: str, domain: str, cities: list[tuple[str, str]], tlds: list[tuple[str, str]], capitals: dict[str, str]) -> DataFrame:
    """Fill city and country: both given; city named in the text; country of the domain's ending; the country's main
    city; else unknown. ``by`` tells which step did it. Blank and unknown count as missing."""
    miss = lambda c: F.coalesce(F.trim(c), F.lit("")).isin("", UNKNOWN)
    named = longest_match(F.coalesce(F.col(text), F.lit("")), [c for c, _ in cities])
    of_city = F.lit(None).cast("string")
    for c, n in reversed(cities):
        of_city = F.when(named == c, F.lit(n)).otherwise(of_city)
    of_tld = F.lit(None).cast("string")
    for t, n in reversed(tlds):
        of_tld = F.when(F.endswith(F.coalesce(F.col(domain), F.lit("")), F.lit(t)), F.lit(n)).otherwise(of_tld)
    main = lambda c: F.create_map(*(F.lit(x) for kv in capitals.items() for x in kv)).getItem(c)
    city, country = F.col("city"), F.col("country")
    both, by_text, by_tld, by_main = ~miss(city) & ~miss(country), miss(city) & named.isNotNull(), miss(country) & of_tld.isNotNull(), miss(city) & ~miss(country) & main(country).isNotNull()
    by = F.when(both, "given").when(by_text, "text").when(by_tld, "domain").when(by_main, "main_city").otherwise("unknown")
    df = df.withColumn("by", by).withColumn("_city", F.when(by == "text", named).when((by == "domain") & miss(city), main(of_tld)).when(by == "main_city", main(country)).otherwise(city))
    df = df.withColumn("_country", F.when(~miss(country), country).when(by == "text", of_city).when(by == "domain", of_tld))
    fix = lambda c: F.when(miss(F.col(c)), F.lit(UNKNOWN)).otherwise(F.col(c))
    return df.withColumn("city", fix("_city")).withColumn("country", fix("_country")).drop("_city", "_country")


#: The country whose regions are told by its provinces, and places that make a bucket of their own.
HOME = "中国"
_APART_COUNTRY, _APART_CITY, _APART_PROVINCE = "香港|澳门|台湾|台北|高雄", "香港|澳门|台北|高雄|台中|台南", "香港|澳门|台湾"


def region_bucket(country: Column, city: Column, ip_country: Column, ip_province: Column, names: DataFrame, ip_names: DataFrame) -> Column:
    """The bucket of a record: of its country by the first rule in order of which a name stands in it; where the country
    is missing, of the address it was sent from. ``names`` and ``ip_names`` are dictionaries (ord, term, value), the
    rule's number, a name and the bucket; those of addresses are met in any case."""
    c, t = F.coalesce(country, F.lit("")), F.coalesce(city, F.lit(""))
    own = F.when(c.rlike(_APART_COUNTRY) | t.rlike(_APART_CITY), "hktw").when(c == HOME, "cn").otherwise(dictionary.first_term(c, names)["value"])
    sent = F.when(ip_country == HOME, F.when(F.coalesce(ip_province, F.lit("")).rlike(_APART_PROVINCE), "hktw").otherwise("cn"))
    sent = sent.otherwise(dictionary.first_term(F.lower(F.coalesce(ip_country, F.lit(""))), ip_names.withColumn("term", F.lower("term")))["value"])
    return F.coalesce(own, F.when(c == "", sent), F.lit("other"))


def located(df: DataFrame, cities: DataFrame, countries: DataFrame, sources: DataFrame, capitals: DataFrame) -> DataFrame:
    """``df`` (city_zh, country_zh, category, source, ip_country, ip_province, ip_city) with lng, lat and ``precision``: of
    its city, else of its country, else, for news, of the first known source whose name stands in its own, else of the
    address it was sent from; null if nothing is known. Dictionaries: cities and countries (name, lng, lat), sources
    (ord, term, value: a city), capitals (province, city)."""
    spot = lambda t: t.select("name", F.struct("lng", "lat").alias("spot"))
    cities, countries = spot(cities), spot(countries)
    df = dictionary.looked_up(df, "city_zh", cities, "name", _city="spot")
    df = dictionary.looked_up(df, "country_zh", countries, "name", _country="spot")
    df = df.withColumn("_seat", F.when(F.col("category") == "news", dictionary.first_term(F.col("source"), sources)["value"]))
    df = dictionary.looked_up(df, "_seat", cities, "name", _source="spot")
    df = dictionary.looked_up(df, "ip_province", capitals, "province", _capital="city")
    home = F.col("ip_country") == HOME
    df = df.withColumn("_ip_city", F.when(home, F.col("ip_city"))).withColumn("_ip_capital", F.when(home, F.col("_capital")))
    for key, name in (("_ip_city", "_ip1"), ("_ip_capital", "_ip2")):
        df = dictionary.looked_up(df, key, cities, "name", **{name: "spot"})
    df = dictionary.looked_up(df, "ip_country", countries, "name", _ip3="spot")
    sent = F.coalesce("_ip1", "_ip2", "_ip3")
    best = F.coalesce("_city", "_country", "_source", sent)
    how = F.when(F.col("_city").isNotNull(), "城市").when(F.col("_country").isNotNull(), "国家").when(F.col("_source").isNotNull(), "信源地").when(sent.isNotNull(), "IP属地")
    out = df.withColumn("_spot", best).withColumn("precision", how).withColumn("lng", F.col("_spot.lng")).withColumn("lat", F.col("_spot.lat"))
    return out.drop("_city", "_country", "_seat", "_source", "_capital", "_ip_city", "_ip_capital", "_ip1", "_ip2", "_ip3", "_spot")


def region_hints(sources: DataFrame, known: DataFrame, hosts: DataFrame, terms: DataFrame, tlds: DataFrame) -> DataFrame:
    """Sources (id, hint, hay, domain) with the region each is told to be of, and ``why``: the hint it has, if that is
    known; the fact about its domain; the longest place name in its text, in any case; the ending of its domain, but not
    that of the home country. ``known`` (id), ``hosts`` and ``tlds`` (name, region), ``terms`` (ord, term, value)."""
    s = dictionary.looked_up(sources, "hint", known.withColumn("kept", F.col("id")), "id", _kept="kept")
    bare = F.regexp_replace(F.lower(F.coalesce("domain", F.lit(""))), r"^www\.", "")
    labels = F.filter(F.split(F.lower(F.coalesce("domain", F.lit(""))), r"\."), lambda x: x != "")
    s = s.withColumn("_host", bare).withColumn("_tld", F.when(F.size(labels) >= 2, F.nullif(F.element_at(labels, -1), F.lit("cn"))))
    s = dictionary.looked_up(s, "_host", hosts, "name", _of_host="region")
    s = dictionary.looked_up(s, "_tld", tlds, "name", _of_tld="region")
    named = dictionary.longest_term(F.lower("hay"), terms.withColumn("term", F.lower("term")).where(F.length("term") >= 2))
    s = s.withColumn("_named", named)
    region = F.coalesce("_kept", "_of_host", "_named.value", "_of_tld")
    why = F.when(F.col("_kept").isNotNull(), "kept").when(F.col("_of_host").isNotNull(), F.col("_host")).when(F.col("_named").isNotNull(), F.col("_named.term")).when(F.col("_of_tld").isNotNull(), F.concat(F.lit("."), "_tld"))
    return s.withColumn("region", region).withColumn("why", why).drop("_kept", "_host", "_tld", "_of_host", "_of_tld", "_named")
