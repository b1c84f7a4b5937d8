"""Each code point of a script counts as itself, also in large alphabets and where the model isn't broadcast."""

from __future__ import annotations

import math
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from strataframe.llm import ngram_rules as m

SCHEMA = "doc_id long, text string, lang string"


def brute(texts, learned=None):
    """Log-perplexity of each text under interpolated modified Kneser-Ney, from tuples of characters of the learned ones."""
    learned = learned or texts
    fold = {**{c: c + 32 for c in range(65, 91)}, **{ord(c): "0" for c in "123456789"}, **{ord(c): "*" for c in "#$%&|<>"}}
    line = lambda t: "   " + "".join(w.translate(fold) + " " for w in t.split())
    n, lines = m.ORDER, [line(t) for t in learned]
    size = 1 << max(6, (len({c for x in lines for c in x} - {" "}) + 1).bit_length())
    grams = {n: Counter(x[i - n : i] for x in lines for i in range(n, len(x) + 1))}
    for k in range(n - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    d, total, left = {}, {}, {}
    for k in grams:
        d[k] = m.KneserNey.discounts(*(float(sum(v == i for v in grams[k].values())) for i in range(1, 5)))
        total[k], left[k] = Counter(), Counter()
        for g, c in grams[k].items():
            total[k][g[:-1]] += c
            left[k][g[:-1]] += d[k][min(c, 3)]

    @lru_cache(None)
    def p(g):
        k = len(g)
        if not k:
            return 1 / size
        if not total[k][g[:-1]]:
            return p(g[1:])
        c = grams[k][g]
        return (max(c - d[k][min(c, 3)], 0) + left[k][g[:-1]] * p(g[1:])) / total[k][g[:-1]]

    out = []
    for t in texts:
        x = line(t)
        logs = [math.log(p(x[i - n : i])) for i in range(n, len(x) + 1)]
        out.append(-sum(logs) / len(logs))
    return out


def made(letters, rows, words, seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(letters) for _ in range(r.randrange(1, 5))) for _ in range(200)]
    return [" ".join(r.choice(vocabulary) for _ in range(words)) for _ in range(rows)]


LATIN = [chr(c) for c in range(0xC0, 0x180)] + list("abcdefghij")
CJK = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]


@pytest.fixture(scope="module")
def groups():
    return [made(LATIN, 12, 60, 1), made(CJK, 12, 80, 2)]


def scores(spark, texts, models=None):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = m.score(docs, models or m.train(docs)).collect()
    assert len(got) == len(texts)
    return [r.log_perplexity for r in sorted(got, key=lambda r: r.doc_id)]


def test_every_code_point_counts(spark, groups):
    got = scores(spark, groups[0] + groups[1])
    assert np.allclose(got, brute(groups[0]) + brute(groups[1]), rtol=1e-5)


def test_code_points_share_no_symbol(spark):
    """A rare code point in the place of another one is unlikely, whatever its remainder by 8."""
    text = made(CJK, 1, 400, 3)[0]
    n = Counter(text.replace(" ", ""))
    points = sorted(n, key=lambda c: (-n[c], c))[55:]
    swap = {ord(c): chr(ord(c) + 8 * 200) for c in points}
    docs = spark.createDataFrame([(i, text, "zh") for i in range(20)] + [(99, text.translate(swap), "zh")], SCHEMA)
    got = {r.doc_id: r.log_perplexity for r in m.score(docs, m.train(docs)).collect()}
    assert got[99] > got[0] + 0.1


@pytest.mark.parametrize("hot", [0, 300, 1 << 20])
def test_joined_model_equals_broadcast_one(spark, groups, monkeypatch, hot):
    """Also with copies, texts without words, n-grams that weren't counted, and one script broadcast."""
    texts = [*groups[0], *groups[1], *groups[1][:3], groups[1][0], "", "   "]
    other = [*made(LATIN + list("xyzāΩ"), 3, 30, 4), *made(CJK + list("龍龘ab"), 3, 30, 5), "кирилл", groups[0][0], groups[1][0], groups[1][0]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    models = m.train(docs)
    assert not models.joined
    score = lambda own, by: [r.log_perplexity for r in sorted(m.score(own, by).collect(), key=lambda r: r.doc_id)]
    want, far = score(docs, models), scores(spark, other, models)
    assert want[-1] is None and far[6] is None
    monkeypatch.setattr(m, "HOT_CODES", hot)
    for limit in (0, min(r["count"] for r in models.counts.groupBy("script").count().collect())):
        monkeypatch.setattr(m, "MODEL_CODES", limit)
        models = m.train(docs)
        assert len(models.joined) == (1 if limit else 2)
        for got, right in ((score(docs, models), want), (scores(spark, other, models), far)):
            assert [x is None for x in got] == [x is None for x in right]
            assert np.allclose([x for x in got if x is not None], [x for x in right if x is not None], rtol=1e-6)
    assert m.judge(docs).count() == len(texts)


def test_more_code_points_than_symbols(spark, monkeypatch):
    """Beyond ``SINGLES`` a code point is spelled by two symbols, and still none is taken for another."""
    points = [c for a, b in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0x20000, 0x2A6E0)) for c in range(a, b)]
    assert len(points) > m.SINGLES
    common = made([chr(c) for c in points[-50:]], 1, 500, 6)[0]
    texts = ["".join(map(chr, points)), common]
    docs = spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts)], SCHEMA)
    models = m.train(docs)
    ((key, alphabet),) = models.letters.items()
    assert sorted(alphabet.tolist()) == sorted(points) and set(points[-50:]) <= set(alphabet[: m.SINGLES].tolist())
    symbols = m.symbol_table(alphabet)
    assert symbols.bits == m.MOST_BITS
    both = symbols.first[points].astype(np.int64) << 16 | symbols.second[points]
    assert len(np.unique(both)) == len(points) and symbols.first[points].min() > 0
    unknown = symbols.first[ord("q")]
    assert unknown == (1 << 16) - 1 and unknown not in symbols.first[points] and unknown not in symbols.second[points]
    codes, _ = (np.concatenate(x) for x in zip(*m.text_codes([[texts[0].encode()]], symbols)))
    spelled = int((symbols.second[points] > 0).sum())
    assert spelled == len(points) - m.SINGLES and len(codes) == len(points) + spelled + 1
    assert len(np.unique(codes)) == len(codes)
    want = [r.log_perplexity for r in sorted(m.score(docs, models).collect(), key=lambda r: r.doc_id)]
    monkeypatch.setattr(m, "MODEL_CODES", 0)
    models = m.train(docs)
    assert models.joined == [key]
    got = [r.log_perplexity for r in sorted(m.score(docs, models).collect(), key=lambda r: r.doc_id)]
    assert np.allclose(got, want, rtol=1e-6)
