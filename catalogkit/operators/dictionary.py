"""Dictionaries as tables: texts met with very many terms by an automaton.

The terms are a table (ord, term, value): ``ord`` is a term's place, no two alike. They are sent to the workers once, in
parts of bounded size, and each worker builds an Aho-Corasick automaton of a part when it first needs it; a text is then
read once for each part, however many terms there are. What wins among the terms of a text is decided by an order that
holds over parts, so the number of parts changes no result.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms that are collected and sent at once, and their letters.
PART_TERMS, PART_CHARS = 200_000, 8_000_000
#: Rows up to which a table that is looked up by key is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
_HIT = "struct<least: long, ord: long, term: string, value: string>"


def _parts(terms: DataFrame) -> list[tuple]:
    """(key, rows sent to the workers) of each part; equal terms share a part."""
    whole = F.col("whole") if "whole" in terms.columns else F.lit(False)
    terms = terms.where("term is not null and term <> ''").select(F.col("ord").cast("long").alias("ord"), "term", F.col("value").cast("string").alias("value"), whole.alias("whole"))
    n, chars = terms.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    n_parts = max(1, -(-n // PART_TERMS), -(-chars // PART_CHARS))
    at, context = F.pmod(F.xxhash64("term"), F.lit(n_parts)), terms.sparkSession.sparkContext
    return [(uuid.uuid4().hex, context.broadcast(sorted(tuple(r) for r in terms.where(at == p).collect()))) for p in range(n_parts)]


_built: OrderedDict[str, ahocorasick.Automaton] = OrderedDict()


def _automaton(key: str, shipped) -> ahocorasick.Automaton | None:
    """The worker's automaton of a part, whose values are a term and its rows (ord, value, whole) in order; the last few
    stay. None without terms."""
    if key not in _built:
        rows: dict[str, list] = {}
        for ord_, term, value, whole in shipped.value:
            rows.setdefault(term, []).append((ord_, value, whole))
        made = ahocorasick.Automaton()
        for term, own in rows.items():
            made.add_word(term, (term, own))
        if rows:
            made.make_automaton()
        _built[key] = made if rows else None
        while len(_built) > 4:
            _built.popitem(last=False)
    return _built[key]


def _of_parts(terms: DataFrame, kind: str, of_text) -> list[Column]:
    """For each part a function of a column that gives ``of_text(automaton, text)``, null for a null text."""

    def function(key: str, shipped):
        @F.pandas_udf(kind)
        def run(texts: pd.Series) -> pd.Series:
            made = _automaton(key, shipped)
            return pd.Series([None if t is None or made is None else of_text(made, t) for t in texts], dtype=object)

        @F.pandas_udf(kind)
        def run_struct(texts: pd.Series) -> pd.DataFrame:
            made = _automaton(key, shipped)
            found = [None if t is None or made is None else of_text(made, t) for t in texts]
            out = pd.DataFrame([f or (None,) * 4 for f in found], columns=["least", "ord", "term", "value"])
            return out.astype({"least": "Int64", "ord": "Int64"})

        return run_struct if kind == _HIT else run

    return [function(*p) for p in _parts(terms)]


def _least(found: list[Column]) -> Column:
    some = [F.when(f["ord"].isNotNull(), f) for f in found]
    return F.least(*some) if len(some) > 1 else some[0]


def longest_term(text: Column, terms: DataFrame) -> Column:
    """The longest term that a text holds, of equally long ones the first, as a struct with ``term`` and ``value``; null
    where there is none. The text is met as it is: fold both sides for other than exact letters."""

    def best(made, t):
        return min(((-len(term), rows[0][0], term, rows[0][1]) for _, (term, rows) in made.iter(t)), default=None)

    return _least([f(text) for f in _of_parts(terms, _HIT, best)])


def first_term(text: Column, terms: DataFrame) -> Column:
    """The term with the smallest ``ord`` that a text holds, as ``longest_term`` gives it."""

    def best(made, t):
        return min(((0, rows[0][0], term, rows[0][1]) for _, (term, rows) in made.iter(t)), default=None)

    return _least([f(text) for f in _of_parts(terms, _HIT, best)])


def _in_word(t: str, i: int) -> bool:
    return 0 <= i < len(t) and (t[i] == "_" or t[i].isascii() and t[i].isalnum())


def labels(text: Column, terms: DataFrame) -> Column:
    """The values of all terms that a text holds, each once, in the order of their first ``ord`` in the dictionary. Where
    ``whole`` is true a term counts only as whole words: no ASCII letter, digit or underscore right before or after it."""

    def held(made, t):
        out = set()
        for end, (term, rows) in made.iter(t):
            whole = not _in_word(t, end - len(term)) and not _in_word(t, end + 1)
            out.update(value for _, value, must in rows if whole or not must)
        return sorted(out)

    found = [F.coalesce(f(text), F.array().cast("array<string>")) for f in _of_parts(terms, "array<string>", held)]
    order = terms.groupBy(F.col("value").cast("string").alias("value")).agg(F.min("ord").alias("ord"))
    names = [r.value for r in order.orderBy("ord").limit(10_001).collect()]  # labels are few, terms may be many
    if len(names) > 10_000:
        raise ValueError("more than 10,000 different labels")
    have = F.array_distinct(F.flatten(F.array(*found)))
    return F.when(text.isNotNull(), F.array_intersect(F.array(*map(F.lit, names)).cast("array<string>"), have))


def label_terms(dictionary: DataFrame) -> DataFrame:
    """The terms of a dictionary (ord, label, anywhere, words): terms that count anywhere in a text, and phrases that count
    as whole words, whose blanks may be hyphens. Texts have to be in lower case for the latter."""
    one = dictionary.select("ord", "label", F.lit(False).alias("whole"), F.explode("anywhere").alias("term"))
    phrase = dictionary.select("ord", "label", F.lit(True).alias("whole"), F.explode("words").alias("term"))
    joined = F.aggregate(F.split(F.lower("term"), " "), F.array().cast("array<string>"), lambda got, w: F.when(F.size(got) == 0, F.array(w)).otherwise(F.flatten(F.transform(got, lambda g: F.array(F.concat(g, F.lit(" "), w), F.concat(g, F.lit("-"), w))))))
    phrase = phrase.withColumn("term", F.explode(joined))
    both = one.unionByName(phrase).groupBy("label", "term").agg(F.min("ord").alias("at"), F.min("whole").alias("whole"))
    # no two terms of a label are alike, so that label and term make an order of their own within a place
    return both.select(F.col("at").alias("ord"), "term", F.col("label").alias("value"), "whole")


def normal_name(name: Column, aliases: DataFrame, unknown: str) -> Column:
    """The value of the alias that a name is, else of one that it is in other case, else of the first that holds it or
    that it holds, in any case; else the name itself, trimmed. A null or blank name is ``unknown``."""

    def found(key: str, shipped) -> Column:
        @F.pandas_udf(_HIT)
        def run(names: pd.Series) -> pd.DataFrame:
            if key not in _names:
                _names.clear()
                _names[key] = _Names(shipped.value)
            out = pd.DataFrame([_names[key][n] if n else (None,) * 4 for n in names], columns=["least", "ord", "term", "value"])
            return out.astype({"least": "Int64", "ord": "Int64"})

        return run(F.trim(name))

    best = _least([found(*p) for p in _parts(aliases)])
    bare = F.trim(F.coalesce(name, F.lit("")))
    return F.when(bare == "", F.lit(unknown)).otherwise(F.coalesce(best["value"], bare))


class _Names(dict):
    """The alias of each name met so far, in a worker."""

    def __init__(self, rows: list[tuple]):
        super().__init__()
        self.exact, self.folded, self.made = {}, {}, ahocorasick.Automaton()
        for ord_, term, value, _ in rows:
            low = term.lower()
            self.exact.setdefault(term, (0, ord_, term, value))
            self.folded.setdefault(low, (1, ord_, term, value))
            if low not in self.made:
                self.made.add_word(low, (2, ord_, term, value))
        if rows:
            self.made.make_automaton()
        self.all = "\0".join(r[1].lower() for r in rows)
        self.starts, at = [], 0
        for r in rows:
            self.starts.append((at, (2, r[0], r[1], r[2])))
            at += len(r[1].lower()) + 1

    def __missing__(self, name: str) -> tuple:
        low, best = name.lower(), None
        if name in self.exact:
            best = self.exact[name]
        elif low in self.folded:
            best = self.folded[low]
        elif self.starts:
            held = [hit for _, hit in self.made.iter(low)]
            at = self.all.find(low) if "\0" not in low else -1
            if at >= 0:  # the first alias in order that holds the name
                lo, hi = 0, len(self.starts)
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if self.starts[mid][0] <= at else (lo, mid)
                held.append(self.starts[lo][1])
            best = min(held, default=None)
        if len(self) > 100_000:
            self.clear()
        self[name] = best or (None,) * 4
        return self[name]


_names: dict[str, _Names] = {}


def looked_up(df: DataFrame, key: str, table: DataFrame, table_key: str, **values: str) -> DataFrame:
    """``df`` with columns of the row of ``table`` that has its key, null without one; values: new name = column. Keys of
    the table are unique. A small table, counted first, is broadcast; a larger one meets the rows by a shuffle, in which
    rows without a key take no part."""
    own = table.where(F.col(table_key).isNotNull()).select(F.col(table_key).alias("_key"), *(F.col(c).alias(n) for n, c in values.items()))
    if own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(own), df[key] == F.col("_key"), "left").drop("_key")
    met = df.where(F.col(key).isNotNull()).join(own, F.col(key) == F.col("_key"), "left").drop("_key")
    none = [F.lit(None).cast(own.schema[n].dataType).alias(n) for n in values]
    return met.unionByName(df.where(F.col(key).isNull()).select("*", *none))
