"""Toxicity from a learned lexicon.

Training finds word stems that stand in toxic documents oftener than in others, each with its log odds. They form a
trie; a Levenshtein automaton intersected with it accepts a word that is a term, starts with a stem, or is a term
misspelled by a few edits. The product automaton is made deterministic as words are read, so a word costs one step per
letter. Each hit counts by the log odds of its term and is weighed by its context window: inside quotation marks or
beside words of reporting it counts less. A logistic model of the weighted hits, their density and the strongest of
them gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W_]+")
#: Letters of a stem: fewest and most.
STEM = (4, 10)
#: Toxic texts of the sample that a stem must be in (a number, and a share of them), and the share of its texts that
#: must be toxic.
SUPPORT, SUPPORT_SHARE, PURITY = 8, 0.01, 0.3
#: A longer stem is a term of its own if its log odds exceed those of a shorter one by so much.
FINER = 0.5
#: A closed term may be misspelled in one letter from 5 letters on, in two from 9 on.
EDITS = ((9, 2), (5, 1))
#: Letters read around a hit, and what a quoted or reported hit counts.
WINDOW, QUOTED_WEIGHT = 60, 0.35
_QUOTES = "\"“”«»„‘’'"
#: Words beside which a term is reported rather than used, in English, German, French and Spanish.
REPORTING = """said says wrote quote quoted quotes quoting called word term insult slur reported
sagte sagt schrieb zitat zitiert nannte wort begriff beleidigung berichtet
dit disait écrit citation cité appelé mot terme insulte rapporté
dijo dice escribió cita citado llamó palabra término insulto informó""".split()
_REPORTING = re.compile(rf"\b(?:{'|'.join(REPORTING)})\b")


def allowed(term: str, is_open: bool) -> int:
    return 0 if is_open else next((k for n, k in EDITS if len(term) >= n), 0)


class Matcher:
    """The trie of a lexicon {term: open} intersected with Levenshtein automata, determinised step by step.

    A state is the set of (trie node, edits so far) that the letters read can have reached. Edits begin after the
    first letter. An open term (a stem) accepts whatever follows it.
    """

    MOST_STATES = 50_000

    def __init__(self, lexicon: dict[str, bool], exceptions: set[str] = frozenset()):
        self.child: list[dict[str, int]] = [{}]
        self.end: list[tuple[str, bool, int] | None] = [None]
        self.most = [0]  # edits that some term below the node allows
        self.exceptions = exceptions
        for term, is_open in sorted(lexicon.items()):
            k, node, path = allowed(term, is_open), 0, [0]
            for c in term:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.end.append(None)
                    self.most.append(0)
                node = self.child[node][c]
                path.append(node)
            self.end[node] = (term, is_open, k)
            for n in path:
                self.most[n] = max(self.most[n], k)
        self.start = frozenset({(0, 0)})
        self.steps: dict[tuple[frozenset, str], frozenset] = {}
        self.states: dict[frozenset, frozenset] = {}  # equal states are one object

    def _closed(self, state: set[tuple[int, int]]) -> frozenset:
        """With the letters of terms that the word may leave out, and without what a smaller count covers."""
        best: dict[int, int] = {}
        todo = sorted(state, key=lambda x: x[1])
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            if node:
                todo += [(n, e + 1) for n in self.child[node].values()]
        return frozenset(best.items())

    def step(self, state: frozenset, c: str) -> frozenset:
        out: set[tuple[int, int]] = set()
        for node, e in state:
            if (to := self.child[node].get(c)) is not None:
                out.add((to, e))
            if node:
                out.add((node, e + 1))
                out.update((n, e + 1) for n in self.child[node].values())
        return self._closed(out)

    def match(self, word: str) -> tuple[str, int] | None:
        """The term met and the edits, the fewest edits first; None for no term or an exception."""
        state, stem, steps = self.start, None, self.steps
        for c in word:
            key = (state, c)
            nxt = steps.get(key)
            if nxt is None:
                if len(steps) >= self.MOST_STATES:
                    steps.clear()
                    self.states.clear()
                nxt = self.step(state, c)
                nxt = steps[key] = self.states.setdefault(nxt, nxt)
            state = nxt
            if not state:
                break
            if stem is None:
                stem = next(((t[0], e) for n, e in state if e == 0 and (t := self.end[n]) and t[1]), None)
        found = min(((e, t[0]) for n, e in state if (t := self.end[n]) and e <= t[2]), default=None)
        if stem and not (found and found[0] == 0):
            found = (stem[1], stem[0])
        if found is None or found[0] and word in self.exceptions:
            return None
        return found[1], found[0]


class Scorer:
    """Features of a text: the weighted sum of its hits, its share of the words, and the largest weight. ``odds`` has
    the log odds of terms; without it each counts 1."""

    MOST_WORDS = 200_000

    def __init__(self, lexicon: dict[str, bool], exceptions: set[str] = frozenset(), odds: dict[str, float] | None = None):
        self.matcher = Matcher(lexicon, exceptions)
        self.odds = odds or {}
        self.hits: dict[str, tuple[str, int]] = {}
        self.seen: set[str] = set()

    def hit_words(self, words: set[str]) -> set[str]:
        new = words - self.seen
        if new:
            if len(self.seen) > self.MOST_WORDS:
                self.seen.clear()
            match = self.matcher.match
            self.hits.update((w, m) for w in new if (m := match(w)))
            self.seen |= new
        return words & self.hits.keys()

    @staticmethod
    def quoted(text: str, start: int, end: int) -> bool:
        before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
        opened = sum(before.count(q) for q in _QUOTES if q != "'")
        closed = any(q in after for q in _QUOTES if q != "'")
        return opened % 2 == 1 and closed or bool(_REPORTING.search(before[-WINDOW // 2 :]))

    def features(self, text: str | None) -> tuple[float, float, float, int]:
        """(sum of hit weights, share of the words, largest weight, hits); a misspelled hit weighs less with each edit."""
        text = (text or "").lower()
        words = WORD.findall(text)
        found = self.hit_words(set(words))
        if not found:
            return 0.0, 0.0, 0.0, 0
        weight, most, n = 0.0, 0.0, 0
        for m in WORD.finditer(text):
            if m.group() in found:
                n += 1
                term, edits = self.hits[m.group()]
                one = self.odds.get(term, 1.0) * (QUOTED_WEIGHT if self.quoted(text, m.start(), m.end()) else 1.0) * 0.8**edits
                weight, most = weight + one, max(most, one)
        return weight, weight / len(words), most, n


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, closed word or null, toxic, clean): documents of this partition with a word that begins so / is so."""
    counts = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
            words = {w for w in WORD.findall((text or "").lower()) if len(w) >= STEM[0]}
            keys = {w[:n] for w in words for n in range(STEM[0], min(len(w), STEM[1]) + 1)}
            counts[toxic].update(keys)
            counts[toxic].update(w + "$" for w in words)
    keys = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(keys), 50_000):
        part = keys[at : at + 50_000]
        yield pa.RecordBatch.from_pydict({"stem": part, "toxic": [counts[1][k] for k in part], "clean": [counts[0][k] for k in part]})


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> list[float]:
    """Newton's method; the intercept is not shrunk."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-9] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def _inputs(weight: np.ndarray, density: np.ndarray, most: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(weight), np.sqrt(density), most])


def fit(docs: DataFrame, labels: DataFrame, held_out_fold: int | None = None, folds: int = 4, sample: int = 6000) -> dict:
    """Learn a lexicon and a logistic model from labelled rows outside the held-out fold, from all of them without one.

    At most about ``sample`` toxic and ``sample`` clean labelled documents are used, chosen by a hash of doc_id (the
    bound is on the expected size). A term must be in a hundredth of the toxic ones, so the lexicon has at most a hundred
    times as many terms as a text of the sample has words and stems, whatever the corpus. Rows without a label or text are
    not used; a document labelled twice counts as toxic if one label says so. With no toxic or no clean row the model is
    empty and scores every text with the share of toxic rows (0 without any).
    """
    taken = F.lit(True) if held_out_fold is None else common.fold_mod("doc_id", folds) != held_out_fold
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & taken).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return {"lexicon": {}, "exceptions": set(), "odds": {}, "weights": None, "prior": float(bool(sizes.get(1)))}
    rank = F.crc32(F.concat_ws("-", F.lit("sample"), F.col("doc_id").cast("string"))) / F.lit(2.0**32)
    share = {c: min(1.0, sample / n) for c, n in sizes.items()}
    chosen = marked.where(rank < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    rows = common.written(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-sample")  # chosen: bounded by sample
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    support = max(SUPPORT, SUPPORT_SHARE * n.get(1, 0))

    counts = rows.select("text", "toxic").mapInArrow(_stem_counts, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    often = counts.where((F.col("toxic") >= support) & (F.col("toxic") >= PURITY * (F.col("toxic") + F.col("clean") * share[1] / share[0])))
    found = {r["stem"]: (r["toxic"], r["clean"]) for r in often.collect()}  # bounded by sample and SUPPORT_SHARE
    log_odds = {k: math.log((c + 0.5) / (n.get(1, 0) + 1)) - math.log((d + 0.5) / (n.get(0, 0) + 1)) for k, (c, d) in found.items()}
    whole = {k[:-1] for k in found if k.endswith("$")}
    lexicon: dict[str, bool] = {}
    odds: dict[str, float] = {}
    for stem in sorted((k for k in found if not k.endswith("$")), key=lambda k: (len(k), k)):
        shorter = [odds[stem[:i]] for i in range(STEM[0], len(stem)) if stem[:i] in lexicon]
        if shorter and log_odds[stem] <= max(shorter) + FINER:
            continue  # a shorter stem has it
        top = max((w for w in whole if w.startswith(stem)), key=lambda w: (found[w + "$"][0], w), default=None)
        if top and found[top + "$"][0] >= 0.9 * found[stem][0]:  # nearly always the same word: a closed term
            lexicon[top], odds[top] = False, max(log_odds[top + "$"], 0.0)
        else:
            lexicon[stem], odds[stem] = True, max(log_odds[stem], 0.0)

    def near_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, out = Scorer(lexicon), set()
        for batch in batches:
            for text in batch["text"].to_pylist():
                out |= {w for w in scorer.hit_words(set(WORD.findall(text.lower()))) if scorer.hits[w][1]}
        yield pa.RecordBatch.from_pydict({"word": pa.array(sorted(out), pa.string())})

    exceptions = {r["word"] for r in rows.where("toxic = 0").select("text").mapInArrow(near_clean, "word string").distinct().collect()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon, exceptions, odds)
        for batch in batches:
            f = [scorer.features(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({c: pa.array([x[i] for x in f], pa.float64()) for i, c in enumerate(("weight", "density", "most"))} | {"toxic": batch["toxic"].cast(pa.int32())})

    seen = rows.select("text", "toxic").mapInArrow(measure, "weight double, density double, most double, toxic int").toPandas()  # bounded by sample
    x, y = _inputs(*(seen[c].to_numpy() for c in ("weight", "density", "most"))), seen["toxic"].to_numpy(dtype=float)
    if len(set(y.tolist())) < 2:
        return {"lexicon": {}, "exceptions": set(), "odds": {}, "weights": None, "prior": float(y.mean()) if len(y) else 0.0}
    weights = _logistic(x, y)
    # the sample holds toxic rows in another share than the labelled rows: correct the intercept
    weights[0] += math.log(share[0] / share[1])
    return {"lexicon": lexicon, "exceptions": exceptions, "odds": odds, "weights": weights, "prior": None}


def _scores(texts: list[str | None], scorer: Scorer, model: dict) -> tuple[np.ndarray, list[int]]:
    weights = model["weights"]
    if not weights:
        return np.full(len(texts), model["prior"]), [0] * len(texts)
    f = [scorer.features(t) for t in texts]
    if not f:
        return np.empty(0), []
    z = weights[0] + _inputs(*(np.array([a[i] for a in f]) for i in range(3))) @ np.array(weights[1:])
    return 1 / (1 + np.exp(-np.clip(z, -50, 50))), [a[3] for a in f]


def below(docs: DataFrame, model: dict, limit: float) -> DataFrame:
    """The rows of ``docs`` with a score under ``limit``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model["lexicon"], model["exceptions"], model["odds"])
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch["text"].to_pylist(), scorer, model)[0] < limit))

    return docs.mapInArrow(run, docs.schema)


_SCHEMA = "doc_id long, score double, n_hits long"


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1) and n_hits for each row of ``docs`` (doc_id, text; others, whatever their names, are ignored).
    A null text is empty; an empty text has no hit. Texts of any length are read whole, in time linear in it. Repeated
    rows get equal scores; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model["lexicon"], model["exceptions"], model["odds"])
        for batch in batches:
            score, hits = _scores(batch["text"].to_pylist(), scorer, model)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(score, pa.float64()), pa.array(hits, pa.int64())], names=["doc_id", "score", "n_hits"])

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)
