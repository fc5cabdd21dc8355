"""References against a plain restatement, step by step over each text."""

from __future__ import annotations

import re

from catalogkit.operators import references
from catalogkit.plans import weekly
from catalogkit.plans.base import derived
from catalogkit.sources.tables import load

SF = "/root/testdata/sf0.001"
MARK = re.compile(r"\[\[(\d+)[:：]([^\]]{1,60})\]\]", re.A)


def plain_segments(texts: list[tuple], items: list[tuple]) -> list[tuple]:
    of_issue, out = {}, []
    for issue, n, title, oid, kind, url in sorted(items, key=lambda r: (r[0], r[1])):
        of_issue.setdefault(issue, []).append((title or "", oid, kind, url))
    numbers: dict = {}
    for issue, ord_, text in sorted(texts):
        held = of_issue.get(issue, [])
        index: dict = {}
        for i, (title, *_) in enumerate(held):
            for k in {title.strip(), re.sub("[《》]", "", title).strip()}:
                if len(k) >= 4:
                    index[k] = -1 if k in index and index[k] != i else i
        name = lambda i: re.sub("[《》]", "", held[i][0])[:40] or f"条目{i}"
        s = re.sub(r"\[\[?(\d{1,3})\]\]?", lambda m: f"[[{int(m[1])}:{name(int(m[1]))}]]" if int(m[1]) < len(held) else m[0], text, flags=re.A)
        s = re.sub(r"(^|[^\[])\[(\d{1,3})[:：]([^\]]{1,60})\](?!\])", lambda m: f"{m[1]}[[{m[2]}:{m[3]}]]" if int(m[2]) < len(held) else m[0], s, flags=re.A)
        s = re.sub("【([^】]{4,60})】", lambda m: f"[[{index[m[1].strip()]}:{m[1].strip()}]]" if index.get(m[1].strip(), -1) >= 0 else m[0], s)
        segs, last = [], 0
        for m in MARK.finditer(s):
            if m.start() > last:
                segs.append((s[last : m.start()], None, None, None, None, None))
            n, label = int(m[1]), m[2].strip()
            if n < len(held):
                own = numbers.setdefault(issue, {})
                own.setdefault(n, len(own) + 1)
                title, oid, kind, url = held[n]
                segs.append((None, own[n], oid, kind, None if kind == "opp" else url or None, label or title))
            else:
                segs.append((label, None, None, None, None, None))
            last = m.end()
        if last < len(s):
            segs.append((s[last:], None, None, None, None, None))
        out += [(issue, ord_, k, *x) for k, x in enumerate(segs)]
    return sorted(out, key=repr)


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("issue", "ord", "seg", "t", "ref", "oid", "kind", "url", "label").collect()), key=repr)


def test_references_of_awkward_texts(spark):
    items = [(1, 0, "《Long title》", "a", "opp", "u"), (1, 1, "Long title", "b", "news", ""), (1, 2, "《Only》ones", "c", "job", "v"), (1, 3, "", "d", "news", "w"), (2, 0, "Only ones", "e", "news", None)]
    texts = [
        (1, 0, "[[2:x]] [0][3] [[1]] [9] [[12]] [[9:gone]] end"), (1, 1, "[1:a][2:b] [[2:c] [3:d]] x[5:e] ([0：f])"), (1, 2, "【Long title】【Onlyones】【 Onlyones 】【Only】【《Only》ones】"), (1, 3, ""), (1, 4, "[[[3]]] [ [] ]] [[1: ]] [[" + "2" * 30 + ":z]]"),
        (1, 5, "line\n[[1:two\nlines]]\n[2]"), (2, 0, "【Only ones】 [[0:y]] [[0:" + "l" * 61 + "]]"), (3, 0, "[0] [[0:no items]] 【nothing here】"),
    ]
    t = spark.createDataFrame(texts, "issue int, ord long, text string")
    i = spark.createDataFrame(items, "issue int, n int, title string, oid string, kind string, url string")
    assert got(references.segments(t, i)) == plain_segments(texts, items)


def test_references_of_whole_tables(spark):
    t = lambda name: load(spark, SF, name)
    texts, items = derived(t, weekly.ISSUE_TEXTS), derived(t, weekly.ISSUE_ITEMS)
    want = plain_segments([tuple(r) for r in texts.collect()], [tuple(r) for r in items.collect()])
    assert got(references.segments(texts, items)) == want
    assert len({r[4] for r in want}) > 3
