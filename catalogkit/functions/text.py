"""Text expressions. White space is the Unicode set plus the byte order mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
#: Named character references and what they stand for; the ampersand comes last.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ldquo": "“", "rdquo": "”", "mdash": "—", "ndash": "–", "hellip": "…", "amp": "&"}
#: Words of a text by which one can tell that something can be applied for.
APPLY_SIGNALS = [
    "征集", "征稿", "投稿", "申请", "报名", "递交", "提交", "招募", "参赛", "应征", "甄选", "遴选", "申报", "招生",
    "徵集", "徵稿", "徵件", "徵選", "申請", "報名", "遞交", "應徵", "甄選", "遴選", "申報", "參賽",
    "open call", "call for", "apply", "application", "submission", "submit", "entries", "entry form",
    "register", "registration", "enroll", "enrol", "nomination", "nominate", "proposal",
    "応募", "募集", "公募", "공모", "지원",
    "candidature", "postuler", "appel à", "bewerbung", "ausschreibung", "einreich",
    "convocatoria", "postulación", "bando", "candidatura", "inscri", "aanmeld", "inzending",
]


def squeeze(x: Column) -> Column:
    """Each run of white space becomes a space; none at the ends."""
    return F.trim(F.regexp_replace(x, SPACE, " "))


def present(x: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(x, F.lit(""))


def key_text(x: Column) -> Column:
    """Lower case without white space and punctuation that titles differ in; null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[\s\x{3000}\x{00A0}·:：()（）《》\"'“”\-]", "")


def _numeric(x: Column, pattern: str, base: int) -> Column:
    """Numeric references as their letters; a number that is no letter gives nothing."""
    pieces = F.regexp_extract_all(x, F.lit(rf"(?s)(&#{pattern};|&|[^&]+)"), F.lit(1))

    def one(p: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(p, rf"^&#{pattern};$", 1), "^[xX]?0*", "")
        code = F.when(F.length(digits).between(1, 7), F.conv(digits, base, 10).try_cast("long"))
        safe = F.when((code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)), code)
        letter = F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")
        return F.when(p.rlike(rf"^&#{pattern};$"), F.coalesce(letter, F.lit(""))).otherwise(p)

    return F.when(F.contains(x, F.lit("&#")), F.array_join(F.transform(pieces, one), "")).otherwise(x)


def decode_entities(x: Column) -> Column:
    """Hexadecimal references, then decimal ones, then named ones in any case; unknown ones stay."""
    x = _numeric(_numeric(x, "([xX][0-9a-fA-F]+)", 16), "([0-9]+)", 10)
    for name, char in ENTITIES.items():
        x = F.regexp_replace(x, f"(?i)&{name};", char)
    return x


def html_to_text(html: Column) -> Column:
    """Visible text: comments and code go, block ends break lines, tags become spaces, entities are decoded, and of
    several blank lines one stays before lines are trimmed. Null is empty."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "noscript", "svg"):
        x = F.regexp_replace(x, rf"(?is)<{tag}.*?</{tag}>", " ")
    x = F.regexp_replace(x, r"(?i)</(?:p|div|li|tr|h[1-6]|br|section|article)>|<br\s*/?>", "\n")
    x = decode_entities(F.regexp_replace(x, r"(?s)<[^>]+>", " "))
    x = F.regexp_replace(x, r"[ \t\x{00A0}]+", " ")
    x = F.regexp_replace(x, rf"\n{SPACE[:-1]}*\n{SPACE[:-1]}*\n+", "\n\n")
    x = F.regexp_replace(x, r"[ \t]*\n[ \t]*", "\n")
    return F.regexp_replace(x, rf"^{SPACE}|{SPACE}$", "")


def apply_signal(x: Column) -> Column:
    """Whether a text has a word by which one can apply for something, in any case. The text is lower-cased once."""
    terms = [F.lit(w.lower()) for w in APPLY_SIGNALS]

    def held(t: Column) -> Column:
        found = F.lit(False)
        for w in terms:
            found = found | F.contains(t, w)
        return found

    return F.transform(F.array(F.lower(F.coalesce(x, F.lit("")))), held)[0]


def slug(x: Column, default: str = "item") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9一-龥]+", "-"), r"^-+|-+$", "")
    return F.coalesce(present(F.substring(s, 1, 40)), F.lit(default))


#: Names of sites and sections that end a page's title.
SITE_NAMES = ["新闻", "独家", "雅昌", "雅昌新闻", "雅昌艺术网", "艺术中国", "99艺术网", "资讯", "官网", "艺术资讯", "art news"]


def strip_site_suffix(title: Column, *sites: Column, rounds: int = 4) -> Column:
    """A title without the names of sites at its end: what follows the first separator from which at most 20 letters
    without ``_`` are left (``__``, ``_``, or a bar or dash between blanks) goes while it is one of ``sites`` or SITE_NAMES, in any
    case, at most ``rounds`` times."""
    pattern = r"^(.*?)(?:__|_|\s+[-–—|]\s+)([^_]{1,20})$"
    names = F.array_compact(F.array(*(F.lit(n) for n in SITE_NAMES), *(F.lower(F.trim(s)) for s in sites)))

    def peel(state: Column, _: Column) -> Column:
        head, tail = F.trim(F.regexp_extract(state, pattern, 1)), F.lower(F.trim(F.regexp_extract(state, pattern, 2)))
        return F.when((head != "") & (tail != "") & F.array_contains(names, tail), head).otherwise(state)

    whole = F.trim(title)
    # once nothing is peeled, later rounds change nothing
    return F.aggregate(F.array(*(F.lit(i) for i in range(rounds))), whole, peel)


def has_cjk(x: Column) -> Column:
    return x.rlike("[㐀-鿿]")


def mask_phone(x: Column) -> Column:
    return F.concat(F.substring(x, 1, 3), F.lit("****"), F.substr(x, F.lit(8)))


def tolerant_json(x: Column) -> Column:
    """The JSON from the first to the last brace of a text, as a variant; null where that is not one whole value (the parser
    alone would take the first of several)."""
    inner = F.nullif(F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.lit(""))
    one = F.try_parse_json(F.concat(F.lit("["), inner, F.lit("]")))
    return F.when(F.try_variant_get(one, "$[1]", "variant").isNull(), F.try_variant_get(one, "$[0]", "variant"))


def english_name(name: Column, known: Column) -> Column:
    """A name without Chinese letters as it is; the known English name; the name without what stands in brackets, if no
    Chinese letter is left; its parts, between blanks, that are Latin, if they have three letters or more; else the name."""
    s, chinese = F.trim(F.coalesce(name, F.lit(""))), "[一-鿿]"
    bare = F.trim(F.regexp_replace(s, "[(（][^)）]*[)）]", ""))
    latin = F.array_join(F.filter(F.split(s, SPACE), lambda w: w.rlike(r"^[\x20-\x7E’&.·-]+$") & w.rlike("[A-Za-z]")), " ")
    out = F.when((s == "") | ~s.rlike(chinese), s).when(known.isNotNull(), known)
    return out.when((bare != "") & ~bare.rlike(chinese), bare).when(F.length(latin) >= 3, latin).otherwise(s)


def aligned(other: Column, own: Column) -> Column:
    """A list that goes beside another, only if it is as long and has no empty item; else null."""
    return F.when((F.size(other) == F.size(own)) & F.forall(other, lambda x: F.coalesce(x, F.lit("")) != ""), other)
