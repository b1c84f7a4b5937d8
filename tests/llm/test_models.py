"""Operators with trained models: exact parts against plain versions, the rest on held-out rows."""

from __future__ import annotations

import math
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from strataframe.llm import gru_lm, langid, ngram_rules, zstd_quality

from . import brute
from .conftest import table


def test_lm_base(docs, pairs):
    want = brute.lm_base(pairs)
    got = gru_lm.score(docs.select("doc_id", "text")).collect()
    assert len(got) == len(pairs)
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held, n, total)
        assert r.n_known == known and math.isclose(r.base_score, base, abs_tol=1e-6 * n)
        assert r.score < 0


def test_lm_many_chunks(docs, pairs, monkeypatch):
    model = gru_lm.train(docs)
    one = table(gru_lm.score(docs, model), "doc_id", "n_tokens", "n_known", "train_tokens")
    monkeypatch.setattr(gru_lm, "chunk_count", lambda n: 6)
    assert table(gru_lm.score(docs, model), "doc_id", "n_tokens", "n_known", "train_tokens") == one


def test_lm_gradients():
    net = gru_lm.Network(3)
    r = np.random.default_rng(0)
    x, y = r.integers(0, gru_lm.START, (6, 4)), r.integers(0, gru_lm.START, (6, 4))
    y[5, 0], y[:5, 1], x[3, 2] = -1, 1 + r.integers(0, gru_lm.WORDS, 5), gru_lm.START
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    h = r.standard_normal((4, gru_lm.HIDDEN)) * 0.1

    def loss():
        state, total = h, 0.0
        for a, b in zip(x, y):
            state = net.step(a, np.where((a == gru_lm.START)[:, None], 0, state))
            for j, t in enumerate(b):
                if t >= 0:
                    total -= brute.symbol_log_p(net, state[j], int(t))
        return total / (y >= 0).sum()

    g, _ = net.gradients(x, y, h)
    word = int(y[0, 1] - 1) // gru_lm.EACH
    for k, w in net.p.items():
        for _ in range(5):
            at = [int(r.integers(0, n)) for n in w.shape]
            if k in ("wi", "bi"):
                at[0] = word
            elif k == "wx":
                at[0] = int(x.ravel()[r.integers(0, x.size)])
            at = tuple(at)
            old, eps = w[at], 1e-5
            w[at] = old + eps
            up = loss()
            w[at] = old - eps
            down = loss()
            w[at] = old
            assert math.isclose((up - down) / (2 * eps), g[k][at], rel_tol=1e-3, abs_tol=1e-7)


def test_lm_softmaxes_sum_to_one():
    """Over classes, and over the words inside each class of frequent words; the two give one distribution."""
    net = gru_lm.Network(5)
    h = np.random.default_rng(2).standard_normal((9, gru_lm.HIDDEN)).astype(np.float32)
    assert np.allclose(net.class_probs(h).sum(1), 1, atol=1e-5)
    for k in range(gru_lm.FREQUENT):
        assert np.allclose(net.word_probs(h, k).sum(1), 1, atol=1e-5)
    whole = sum(math.exp(brute.symbol_log_p(net, h[0], s)) for s in range(gru_lm.START))
    assert math.isclose(whole, 1, rel_tol=1e-4)


def test_lm_carries_state():
    """Windows and lanes don't change a text's score."""
    net = gru_lm.Network(1)
    r = np.random.default_rng(1)
    texts = [r.integers(0, gru_lm.START, n) for n in (1, 700, 30, 513, 256)]
    whole = net.score(texts)
    for t, s in zip(texts, whole):
        assert math.isclose(net.score([t])[0], s, rel_tol=1e-5)
        h, before, total = np.zeros((1, gru_lm.HIDDEN), np.float32), np.array([gru_lm.START]), 0.0
        for c in t.tolist():
            h = net.step(before, h)
            total += brute.symbol_log_p(net, h[0], c)
            before = np.array([c])
        assert math.isclose(total, s, rel_tol=1e-4)


def test_lm_score(docs, pairs):
    """The whole score token by token, from the network's weights and plain counts."""
    model = gru_lm.train(docs)
    want = brute.lm_score(pairs, model)
    for r in gru_lm.score(docs, model).collect():
        assert any(math.isclose(r.score, x, rel_tol=1e-3, abs_tol=1e-3) for x in want[r.doc_id])


def test_lm_beats_base(spark, real):
    got = gru_lm.score(real).where("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum()


def test_lm_learns_from_whole_texts(spark):
    """Classes come from the counts of all documents; what stands far behind in a text shapes the network."""
    def docs(tail, n):
        return spark.createDataFrame([(i, "x y " * 400 + tail * 1500) for i in range(n)], "doc_id long, text string")
    one, two = (gru_lm.train(docs(tail, 30)) for tail in ("p q ", "p p q q "))
    assert set(one.classes.frequent) == {"x", "y", "p", "q"}
    assert any((one.network.p[k] != two.network.p[k]).any() for k in one.network.p)
    p, q = one.classes(pa.array(["p", "q"], pa.large_string()))
    assert max(p, q) <= gru_lm.WORDS  # words of their own in the softmax
    turns, runs = np.tile([p, q], 500), np.repeat([p, q], 500)
    assert one.network.score([turns])[0] > one.network.score([runs])[0]


def test_lm_fits_every_document(docs, pairs, monkeypatch):
    """Each round's chunks see all tokens of their training documents, once."""
    monkeypatch.setattr(gru_lm, "chunk_count", lambda n: 6)
    corpus = gru_lm.Corpus(docs)
    seen = []
    monkeypatch.setattr(gru_lm, "added", lambda rows, size, real=gru_lm.added: seen.append(out := real(rows, size)) or out)
    gru_lm.fit(corpus)
    assert sum(int(x[-1]) for x in seen) == corpus.n_tokens


def test_kneser_ney_sums_to_one(docs):
    models = ngram_rules.train(docs)
    (block,) = models.blocks
    loaded = models.load(block)
    assert len(loaded) == 2 and ngram_rules.LATIN in loaded  # and a line of Japanese
    for _, model in loaded.values():
        codes = model.tables[ngram_rules.ORDER][0]
        for context in (0, 1, (5 << 12) | (1 << 6) | 20, 0x3FFFF):
            p = np.exp(model.log_p(np.array([(context << 6) | s for s in range(64)], np.int64)))
            assert math.isclose(p.sum(), 1.0, rel_tol=1e-5)
        assert (np.diff(codes.astype(np.int64)) > 0).all()


def perplexities(docs, models=None):
    rows = ngram_rules.score(docs, models or ngram_rules.train(docs)).collect()
    return sorted(((r.doc_id, r.lang, r.n_words, r.log_perplexity) for r in rows), key=repr)


def test_perplexity_by_brute_force(docs, pairs):
    want = brute.kneser_ney([t for _, t in pairs])
    by_id: dict = {}
    for i, t in pairs:
        by_id.setdefault(i, []).append(want[t])
    got = perplexities(docs)
    assert len(got) == len(pairs)
    for i, _, _, mean in got:
        assert any(x is None and mean is None or x is not None and mean is not None and math.isclose(x, mean, rel_tol=1e-4) for x in by_id[i])


def test_perplexity_in_blocks_and_steps(docs, monkeypatch):
    """Blocks of scripts, steps inside texts and counts handed on early change nothing."""
    want = perplexities(docs)
    monkeypatch.setattr(ngram_rules, "BLOCK_CODES", 100)
    models = ngram_rules.train(docs)
    assert len(models.blocks) == 2
    assert perplexities(docs, models) == want
    points, table = np.array(sorted({ord(c) for c in "abcdefgh"})), [b"abc de f".split(), [], b"gh".split() * 20]
    whole = [np.concatenate(x) for x in zip(*ngram_rules.text_codes(table, ngram_rules.symbol_table(points)))]
    monkeypatch.setattr(ngram_rules, "STEP", 5)
    parts = [np.concatenate(x) for x in zip(*ngram_rules.text_codes(table, ngram_rules.symbol_table(points)))]
    assert all((a == b).all() for a, b in zip(whole, parts)) and len(whole[0]) == 9 + 60
    tally = ngram_rules.Tally()
    monkeypatch.setattr(ngram_rules, "TABLE_CODES", 3)
    rows = []
    for i in range(10):
        tally.add(1, np.array([i % 7, i % 2], np.uint32))
        rows += [r for b in tally.rows() for r in b.to_pylist()]
    rows += [r for b in tally.rows(last=True) for r in b.to_pylist()]
    assert sum(r["n"] for r in rows) == 20 and {r["code"] for r in rows} == set(range(7))


def test_model_crosses_words_and_bands_hold_copies(spark):
    """Text of unlikely words is rejected, a large group of copies and the others stay, and the order of words changes a score."""
    import random

    r = random.Random(5)
    en, ru = (
        ["".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(3000)]
        for parts in (["the", "an", "in", "ou", "er", "st", "ti"], ["ни", "ко", "при", "ств", "ал"])
    )
    odd = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(3000)]
    rows = [(i, " ".join(r.choice(w) for _ in range(300)), lang) for i, (w, lang) in enumerate([(en, "en"), (ru, "ru")] * 60)]
    rows += [(1000, " ".join(r.choice(odd) for _ in range(300)), "en")]
    rows += [(2000 + i, rows[0][1], "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {x.doc_id: x.kept for x in ngram_rules.judge(docs).collect()}
    assert not kept[1000] and sum(kept.values()) >= len(rows) - 4
    assert len(ngram_rules.train(docs).letters) == 2
    line = "ab cd ef gh".split()
    models = ngram_rules.train(spark.createDataFrame([(1, " ".join(line * 30), "x"), (2, " ".join(sorted(line * 30)), "x")], "doc_id long, text string, lang string"))
    ((_, model),) = models.load([ngram_rules.LATIN]).values()
    a, b = model.score_texts([[w.encode() for w in line * 5], [w.encode() for w in line[::-1] * 5]], ngram_rules.symbol_table(models.letters[ngram_rules.LATIN]))
    assert a < b


def test_verdicts_by_brute_force(spark, real):
    """``kept`` from the scores, with quartiles taken from sorted lists."""
    scored = ngram_rules.score(real, ngram_rules.train(real)).toPandas()
    failed = (scored.n_words < 50) | (100 * scored.n_repeat_words > 50 * scored.n_words)
    limits = {}
    for lang, rows in scored[~failed].groupby("lang", dropna=False):
        every, once = (sorted(x.log_perplexity) for x in (rows, rows.drop_duplicates(["n_words", "log_perplexity"])))
        a, b = ([x[math.ceil(p * len(x)) - 1] for p in (0.25, 0.5, 0.75)] for x in (every, once))
        limits[lang] = b[1], max(b[1] - b[0], b[1] - a[0], 0.01), max(b[2] - b[1], a[2] - b[1], 0.01)
    want = {}
    for r, bad in zip(scored.itertuples(), failed):
        ok = not bad
        if ok:
            mid, below, above = limits[r.lang]
            wide = 4 + 30 / math.sqrt(r.n_words)
            ok = -wide * below <= r.log_perplexity - mid <= wide * above
        want[r.doc_id] = ok
    assert {r.doc_id: r.kept for r in ngram_rules.judge(real).collect()} == want and not all(want.values())


def test_rules_keep_good_text(spark, sf_dir, real):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = ngram_rules.judge(real).join(labels, "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.97


def test_rules_reject_bad_text(spark, sf_dir):
    """Most labelled-bad text that passes the base rules is rejected; good text stays. On a table with enough of both."""
    path = Path(sf_dir).parent / "sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{name}.parquet") for name in ("documents", "labels"))
    got = ngram_rules.judge(docs).join(labels, "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 0].kept.mean() < 0.3
    assert got[got.quality == 1].kept.mean() > 0.98


def test_language_id(real):
    got = langid.identify(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95


def test_language_id_by_brute_force(docs, pairs):
    model = langid.train(docs.select("doc_id", "text", "lang"))
    assert len(model.langs) == 2
    want = {}
    for i, t in pairs:
        want.setdefault(i, []).append(brute.language(t, model))
    for r in langid.predict(docs, model).collect():
        assert any(r.lang_pred == lang and math.isclose(r.score, s, rel_tol=1e-3, abs_tol=1e-6) for lang, s in want[r.doc_id])


def test_language_features_in_pieces(monkeypatch):
    texts = [b"a  b c" * 50 + b" \n \n " * 30 + b"xyz" * 9, b"ab", b"a", b"", b"    "]
    whole = langid.features(texts)
    for piece in (1, 2, 3, 7, 64):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert np.allclose(langid.features(texts), whole, atol=1e-6)


def test_language_id_edges(docs, empty, pairs):
    got = langid.identify(docs).collect()
    assert len(got) == len(pairs)
    text = dict(pairs)
    for r in got:
        if r.doc_id is not None and not any(c.isalpha() for c in text[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert 0 <= r.score <= 1
    model = langid.train(empty)
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} == {"und"}


def test_language_id_learns_every_language(spark):
    """However many there are, and the rarest too."""
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(210)]
    rows = [(1000 * k + i, " ".join([w * 3] * 20), f"l{i}") for i, w in enumerate(words) for k in range(1 + (i < 200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert set(model.langs) == {f"l{i}" for i in range(210)}
    got = langid.predict(docs, model).join(docs, "doc_id").where("int(substring(lang, 2, 9)) >= 200").toPandas()
    assert len(got) == 10 and (got.lang_pred == got.lang).mean() >= 0.8


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 12, 40])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len(code) == n
    for i in range(n):
        for j in range(i):
            assert (code[i] != code[j]).sum() >= (1 if n < 3 else 2)


def test_quality(spark, sf_dir, real):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = zstd_quality.classify(real, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert got.held_out.any() and (got.predicted == (got.score >= 0.3)).all()
    assert good.predicted.mean() > 0.9
    if len(bad):
        assert (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None]).mean() > 0.8


def test_quality_by_brute_force(spark, sf_dir, real):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = zstd_quality.fit(real, labels)
    text = {r.doc_id: r.text for r in real.select("doc_id", "text").collect()}
    for r in zstd_quality.score(real, model).collect():
        assert math.isclose(r.score, brute.quality(text[r.doc_id], model), rel_tol=1e-6)


def test_samples_dont_depend_on_partitions(spark, sf_dir, real):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    one, two = (zstd_quality.fit(d, labels) for d in (real.repartition(7), real.coalesce(1)))
    assert (one.good, one.bad) == (two.good, two.bad) and np.array_equal(one.coef, two.coef)
    some = real.select("doc_id", "text", "lang")
    one, two = (langid.train(d) for d in (some.repartition(7), some.coalesce(1)))
    assert np.array_equal(one.w, two.w) and one.langs == two.langs


def test_quality_edges(spark, docs, pairs, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 7)], "doc_id long, quality int")
    assert {r.score for r in zstd_quality.classify(docs, labels).collect()} == {1.0}
    ids = [i for i, _ in pairs if i is not None and brute.crc(i) % 5]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    got = zstd_quality.classify(docs, labels).collect()
    assert len(got) == len(pairs) and all(0 <= r.score <= 1 for r in got)
    kept = zstd_quality.keep_good(docs, zstd_quality.fit(docs, labels))
    assert kept.schema.simpleString() == docs.schema.simpleString()
    assert kept.count() == sum(r.predicted for r in got)
