"""Plain restatements of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

_AZ = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_WORD = re.compile("[^\x20\x09-\x0d]+")
_PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text: str | None) -> str:
    return (text or "").translate(_AZ)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text or "")


# ---------------------------------------------------------------- near-duplicates


def shingles(text: str | None, width: int) -> set:
    w = words(lower(text))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def near_duplicates(rows: list[tuple], width: int, percent: int = 80) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text) rows, sorted."""
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is not None and b is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (a, _) in enumerate(rows):
        if a is not None:
            least[find(i)] = min(a, least.get(find(i), a))
    out = []
    for i, (a, _) in enumerate(rows):
        c = None if a is None else least[find(i)]
        out.append((a, len(sets[i]), c, a is None or a == c))
    return sorted(out, key=repr)


# ---------------------------------------------------------------- repeated passages


def remove_repeats(rows: list[tuple], window: int) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_text), sorted."""
    split = [words(t) for _, t in rows]
    met = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if met[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


# ---------------------------------------------------------------- licenses


def license_words(text: str | None) -> list[bytes]:
    return [w.encode() for w in _PLAIN.findall(lower(text))]


def licenses(text: str | None, phrases: dict[str, str]) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels)."""
    w = _PLAIN.findall(lower(text))
    places, labels = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


# ---------------------------------------------------------------- language model


def tokens(text: str | None) -> list[str]:
    return [*words(lower(text)), "</s>"]


def kneser_ney(train: list[str | None], order: int = 2):
    """log10 probability of a text under an interpolated modified Kneser-Ney model of ``train``, word by word."""
    unigrams, bigrams, trigrams = Counter(), Counter(), Counter()
    for t in train:
        toks = tokens(t)
        unigrams.update(toks)
        bigrams.update(zip(["<s>", *toks], toks))
        trigrams.update(zip(["<s>", *toks], toks, toks[1:]))
    before = Counter(b for _, b in bigrams)
    if order == 3:
        behind = Counter((b, c) for _, b, c in trigrams)
        middle = Counter({(a, b): n if a == "<s>" else behind[a, b] for (a, b), n in bigrams.items()})
    else:
        middle = bigrams

    def cuts(counts):
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return [0.5] * 3
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        return [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]

    low = cuts(before)
    less = lambda c, d: max(0.0, c - d[min(c, 3) - 1]) if c else 0.0
    types = max(1, len(bigrams))
    left = sum(low[min(c, 3) - 1] for c in before.values()) if bigrams else 1.0

    def level(counts):
        d, total, spared = cuts(counts), Counter(), Counter()
        for (*context, _), c in counts.items():
            total[tuple(context)] += c
            spared[tuple(context)] += less(c, d)
        return lambda context, word, p: p if not total[context] else less(counts[(*context, word)], d) / total[context] + (1 - spared[context] / total[context]) * p

    two, three = level(middle), level(trigrams)

    def p(context, word):
        base = less(before[word], low) / types + left / types / (len(unigrams) + 1)
        base = two(context[-1:], word, base)
        return three(context, word, base) if order == 3 and len(context) == 2 else base

    def score(text):
        toks = ["<s>", *tokens(text)]
        return sum(math.log10(p(tuple(toks[max(0, i - 2) : i]), toks[i])) for i in range(1, len(toks)))

    return score, p, unigrams


# ---------------------------------------------------------------- urls


def judge(url: str | None, rules: list[tuple[str, str]]) -> tuple:
    """(host, path, rule, verdict)."""
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, tail = rest.partition("/")
    host, path = lower(host), slash + tail
    fits = [r for r in rules if (host == r[0].split("/", 1)[0] or host.endswith("." + r[0].split("/", 1)[0])) and path.startswith("/" + r[0].split("/", 1)[1])]
    best = max(fits, key=lambda r: len(r[0]), default=(None, "allow"))
    return host, path, *best


# ---------------------------------------------------------------- digests


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def fold(value, modulus: int) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode()) % modulus


def ids_crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


# ---------------------------------------------------------------- bit fingerprints


def simhash(text: str | None, width: int) -> int:
    w = words(lower(text))
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def simhash_groups(rows: list[tuple], width: int, radius: int) -> list[tuple]:
    """(doc_id, fingerprint, component_id), sorted."""
    marks = [simhash(t, width) for _, t in rows]
    group = list(range(len(rows)))
    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if a is not None and b is not None and group[i] != group[j] and (marks[i] ^ marks[j]).bit_count() <= radius:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least: dict[int, int] = {}
    for (a, _), g in zip(rows, group):
        if a is not None:
            least[g] = min(a, least.get(g, a))
    return sorted(((a, f"{m:016x}", None if a is None else least[g]) for (a, _), m, g in zip(rows, marks, group)), key=repr)


# ---------------------------------------------------------------- vector codes


def vector_codes(rows: list[tuple], parts: int, entries: int, rounds: int) -> list[tuple]:
    """(vec_id, code, error, label_error, codebooks_sha256) of (vec_id, embedding, label) rows, sorted; every distance is
    computed."""
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    whole = [[math.floor(4096 * x) for x in v] for _, v, _ in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    error = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(kept, error):
        by_label[label] += e
    digest = sha(",".join(str(x) for p in books for e in p for x in e))
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], digest) for (i, _, label), f, e in zip(kept, found, error)), key=repr)


# ---------------------------------------------------------------- alignment


def alignment(rows: list[tuple], encode_a, encode_b) -> list[tuple]:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of (doc_id, text) rows, sorted. The encoders
    give (id, bytes) of each token of a whole text; every two tokens are compared."""
    found, count = [], Counter()
    for doc_id, text in rows:
        a, b = (encode_a(text), encode_b(text)) if text else ([], [])
        want = (" " + (text or "")).encode()
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            a = b = []
        span = lambda tokens: [(sum(len(x) for _, x in tokens[:i]), sum(len(x) for _, x in tokens[: i + 1])) for i in range(len(tokens))]
        sa, sb = span(a), span(b)
        links = [(a[i][0], b[j][0]) for i in range(len(a)) for j in range(len(b)) if sa[i][0] < sb[j][1] and sb[j][0] < sa[i][1]]
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [",".join(str(t[0]) for t, s in zip(a, sa) if lo < s[1] <= hi) + "|" + ",".join(str(t[0]) for t, s in zip(b, sb) if lo < s[1] <= hi) for lo, hi in zip([0, *ends], ends)]
        found.append((doc_id, len(a), len(b), links, groups))
        count.update(set(links))
    highest = Counter()
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    out = [(d, na, nb, len(groups), len(links), sum(count[k] == highest[k[0]] for k in links), sum(count[k] for k in links), sha(";".join(groups)) if groups else "") for d, na, nb, links, groups in found]
    return sorted(out, key=repr)
