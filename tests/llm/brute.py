"""Plain versions of the operators' results, for small tables. Documents are (doc_id, text) pairs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def alnum(text) -> list[str]:
    return ALNUM.findall((text or "").translate(UPPER))


def words(text) -> list[str]:
    return SPACE.findall(text or "")


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def _cover(starts, n: int, length: int) -> list[bool]:
    gone = [False] * n
    for p in starts:
        gone[p : p + length] = [True] * length
    return gone


def suffix_dedup(docs, length: int = 50):
    rank = lambda i: math.inf if i is None else i
    first: dict[bytes, float] = {}
    raw = [(i, (t or "").encode()) for i, t in docs]
    for i, t in raw:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            first[s] = min(first.get(s, math.inf), rank(i))
    out = []
    for i, t in raw:
        gone = _cover([p for p in range(len(t) - length + 1) if first[t[p : p + length]] < rank(i)], len(t), length)
        left = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, sha(left)))
    return out


def substring_index(docs, length: int = 35):
    split = [(i, words(t)) for i, t in docs]
    seen = Counter(tuple(w[p : p + length]) for _, w in split for p in range(len(w) - length + 1))
    out = []
    for i, w in split:
        gone = _cover([p for p in range(len(w) - length + 1) if seen[tuple(w[p : p + length])] > 1], len(w), length)
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return out


def decontaminate(docs, items, n: int = 10):
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = alnum(text)
        size = min(n, len(w))
        for p in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[p : p + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w, hit, found = alnum(text), set(), set()
        for size in sizes:
            for p in range(len(w) - size + 1):
                if got := windows.get(tuple(w[p : p + size])):
                    hit |= set(range(p, p + size))
                    found |= {str(x) for x in got if x is not None}
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    return out


def licence_base(docs):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    out = []
    for i, text in docs:
        w, at, labels = alnum(text), [], set()
        for phrase, label in phrases.items():
            want = phrase.split()
            found = [p for p in range(len(w)) if w[p : p + len(want)] == want]
            at += found
            if found:
                labels.add(label)
        out.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    return out


def licence_labels(text) -> tuple[str, float]:
    """Labels and score of a text, place by place."""
    from strataframe.llm import licences as m

    w = alnum(text)
    texts = [t.split() for _, t, _ in m.TEMPLATES]
    in_templates = Counter(x for t in texts for x in set(t))
    idf = {x: math.log(1 + len(texts) / n) for x, n in in_templates.items()}
    at = lambda phrase: [p for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
    found: dict[str, float] = {}
    for (label, _, keys), t in zip(m.TEMPLATES, texts):
        votes = [(i - p, x) for i, x in enumerate(w) for p, y in enumerate(t) if x == y]
        confirmed = [p for k in keys for p in at(k)]
        for begin in {v for v, x in votes if in_templates[x] <= m.MAX_TEMPLATES}:
            agreed = {x for v, x in votes if begin <= v <= begin + m.TOLERANCE}
            share = sum(idf[x] for x in agreed) / sum(idf[x] for x in set(t))
            if share >= m.LEAST_SHARE - 1e-12 and any(begin - m.TOLERANCE <= p <= begin + len(t) + m.TOLERANCE for p in confirmed):
                found[label] = max(found.get(label, 0.0), min(1.0, share))
    base = {label for phrase, label in m.BASE_PHRASES.items() if at(phrase)}
    return ",".join(sorted(base | set(found))), 1.0 if base else max(found.values(), default=0.0)


def script(text) -> str:
    """Coarse script of most letters of a fixture text."""
    n = Counter("cjk" if "\u3040" <= c < "\u3100" or "\u3400" <= c < "\ua000" else "latin" for c in text or "" if c.isalpha())
    n += Counter({"emoji": sum(c >= "\U0001f600" for c in text or "")})
    return max(sorted(n), key=lambda k: (n[k], k == "latin"), default="latin")


def kneser_ney(texts) -> dict:
    """Log-perplexity by text: interpolated modified Kneser-Ney from plain counts of symbols, by script."""
    by_script: dict = {}
    for t in texts:
        by_script.setdefault(script(t), []).append(t)
    return {t: x for own in by_script.values() for t, x in kneser_ney_of(own).items()}


def kneser_ney_of(texts) -> dict:
    from functools import lru_cache

    from strataframe.llm import ngram_rules as m

    fold = {**UPPER, **{ord(c): "0" for c in "123456789"}, **{ord(c): "*" for c in "#$%&|<>"}}
    letters = Counter(c for t in texts for w in words(t) for c in w.translate(fold))
    first = sorted(sorted(letters, key=lambda c: (-letters[c], ord(c)))[:55])
    number = {c: 1 + i for i, c in enumerate(first)}

    def symbols(text):
        return [x for w in words(text) for x in (*(number.get(c, 56 + ord(c) % 8) for c in w.translate(fold)), 0)]

    n = m.ORDER
    grams = [Counter() for _ in range(n + 1)]
    for t in texts:
        line = [0] * (n - 1) + symbols(t)
        for i in range(n, len(line) + 1):
            grams[n][tuple(line[i - n : i])] += 1
    for k in range(n - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])

    def discounts(counts):
        c = [sum(v == i for v in counts.values()) for i in range(5)]
        if not c[1] or not c[2]:
            return [0, 0.5, 0.5, 0.5]
        y = c[1] / (c[1] + 2 * c[2])
        d = [0, 1 - 2 * y * c[2] / c[1], 2 - 3 * y * c[3] / c[2], 3 - 4 * y * c[4] / max(c[3], 1)]
        return [0, *(min(max(x, 0.05), top) for x, top in zip(d[1:], (0.95, 1.95, 2.95)))]

    d = [None, *(discounts(grams[k]) for k in range(1, n + 1))]
    total, left = [Counter() for _ in range(n + 1)], [Counter() for _ in range(n + 1)]
    for k in range(1, n + 1):
        for g, c in grams[k].items():
            total[k][g[:-1]] += c
            left[k][g[:-1]] += d[k][min(c, 3)]

    @lru_cache(None)
    def p(g):
        k = len(g)
        if not k:
            return 1 / 64
        if not total[k][g[:-1]]:
            return p(g[1:])
        c = grams[k][g]
        return (max(c - d[k][min(c, 3)], 0) + left[k][g[:-1]] * p(g[1:])) / total[k][g[:-1]]

    out = {}
    for t in texts:
        line = [0] * (n - 1) + symbols(t)
        s = [math.log(p(tuple(line[i - n : i]))) for i in range(n, len(line) + 1)]
        out[t] = -sum(s) / len(s) if s else None
    return out


def language(text, model) -> tuple[str, float]:
    """The nearest codeword, from the weights of the classifiers."""
    from strataframe.llm import langid as m

    raw = (text or "").encode()
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    folded = []
    for b in raw:
        x = int(m._FOLD[b])
        if not (x == 32 and folded and folded[-1] == 32):
            folded.append(x)
    x = [0.0] * (2 * m.CELLS)
    for at, size in ((0, 2), (m.CELLS, 3)):
        codes = [sum(c << 8 * (size - 1 - j) for j, c in enumerate(folded[i : i + size])) & 0xFFFFFFFF for i in range(len(folded) - size + 1)]
        cells = Counter(c * 2654435761 % 2**32 >> 21 for c in codes)
        for c, n in cells.items():
            x[at + c] = math.sqrt(n / len(codes))
    bits = [sum(v * float(model.w[i][k]) for i, v in enumerate(x) if v) + float(model.b[k]) for k in range(model.w.shape[1])]
    loss = [
        sum(float(w) * math.log1p(math.exp(-b * int(c))) for w, b, c in zip(model.weight, bits, code)) / max(sum(map(float, model.weight)), 1e-9)
        for code in model.code
    ]
    best = min(range(len(loss)), key=loss.__getitem__)
    return model.langs[best], 1 / sum(math.exp(-8 * (v - loss[best])) for v in loss)


def quality(text, model) -> float:
    """The calibrated score, from plain compressed sizes."""
    import zstandard

    from strataframe.llm import zstd_quality as m

    raw = (text or "").encode()
    if model.coef is None or not raw:
        return model.prior
    blocks = [raw[i : i + m.BLOCK] for i in range(0, len(raw), m.BLOCK)]
    sizes = []
    for d in (model.good, model.bad):
        c = zstandard.ZstdCompressor(level=m.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(c.compress(b)) for b in blocks))
    good, bad = sizes
    d, share, shown = 20 * (bad - good) / (good + bad), 4 * ((good + bad) / (2 * len(raw)) - 0.4), len(raw) / (len(raw) + m.SHORT)
    z = sum(float(w) * x for w, x in zip(model.coef, (1, shown * d, shown * share, shown * d * share, shown * share * share)))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def rule_counts(docs):
    out = []
    for i, text in docs:
        text = text or ""
        w = words(text)
        lines = [x for x in text.split("\n") if SPACE.search(x)]
        dup = sum(x in lines[:k] for k, x in enumerate(lines))
        seen = Counter(zip(w, w[1:], w[2:]))
        hit = {q for p, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for q in (p, p + 1, p + 2)}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed))
    return out


def lm_base(docs):
    tokens = [(i, [*words((t or "").translate(UPPER)), None]) for i, t in docs]
    counts = Counter(x for i, w in tokens if i is None or crc(i) % 7 != 2 for x in w)
    n, v = sum(counts.values()), len(counts)
    return {i: (i is not None and crc(i) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens}


def symbol_log_p(net, h, symbol: int) -> float:
    """Natural log of a symbol's probability behind a state: its class, and for a frequent word its place in it."""
    from strataframe.llm import gru_lm as lm

    def log_softmax(x, i):
        return float(x[i]) - math.log(sum(math.exp(float(v)) for v in x))

    frequent = 1 <= symbol <= lm.WORDS
    kind = (symbol - 1) // lm.EACH if frequent else None
    out = log_softmax(h @ net.p["wo"] + net.p["bo"], 0 if symbol == 0 else 1 + kind if frequent else 1 + lm.FREQUENT + symbol - lm.WORDS - 1)
    if frequent:
        out += log_softmax(h @ net.p["wi"][kind] + net.p["bi"][kind], (symbol - 1) % lm.EACH)
    return out


def lm_score(docs, model) -> dict[int | None, list[float]]:
    """log10 scores by id: rare words by the add-one estimate inside their class."""
    import numpy as np
    import pyarrow as pa

    from strataframe.llm import gru_lm as lm

    tokens = [(i, [*words((t or "").translate(UPPER)), ""]) for i, t in docs]
    counts = Counter(x for i, w in tokens if i is None or crc(i) % 7 != 2 for x in w)
    every = sorted({x for _, w in tokens for x in w})
    symbol = dict(zip(every, model.classes(pa.array(every, pa.large_string())).tolist()))
    total, different = Counter(), Counter()
    for x, n in counts.items():
        total[symbol[x]] += n
        different[symbol[x]] += 1
    out: dict[int | None, list[float]] = {}
    for i, w in tokens:
        h, before, score = np.zeros((1, lm.HIDDEN), np.float32), lm.START, 0.0
        for x in w:
            h, s = model.network.step(np.array([before]), h), symbol[x]
            score += symbol_log_p(model.network, h[0], s) / math.log(10)
            if s > lm.WORDS:
                score += math.log10((counts[x] + 1) / (total[s] + different[s] + 1))
            before = s
        out.setdefault(i, []).append(score)
    return out


def near_classes(docs, size: int = 5):
    """Class by id. Rows with equal ids share a class."""
    rows = [(i, words(t)) for i, t in docs]
    bags = [Counter(tuple(w[p : p + size]) for p in range(len(w) - size + 1)) for _, w in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, v) in enumerate(rows):
        for j, (b, w) in enumerate(rows[:k]):
            common = sum((bags[k] & bags[j]).values())
            union = sum(bags[k].values()) + sum(bags[j].values()) - common
            if (v and v == w) or (union and 5 * common >= 4 * union):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}
