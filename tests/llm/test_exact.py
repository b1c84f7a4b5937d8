"""Operators with one right result, against plain versions, over edge cases and the smallest tables."""

from __future__ import annotations

import random

import numpy as np
import pytest

from strataframe.llm import anchors, bpe, decontaminate, licences, near_dup, ngram_rules, oracles, queries, substring_index, suffix_dedup

from ..oracle import check, connect
from . import brute
from .conftest import table


def by_repr(rows):
    return sorted(rows, key=repr)


def test_suffix_array():
    r = random.Random(1)
    for n in [*range(1, 30), 200]:
        for letters in (1, 2, 4, 90):
            s = np.array([r.randrange(1, letters + 1) for _ in range(n)])
            assert suffix_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_suffix_dedup(docs, pairs):
    got = table(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == by_repr(brute.suffix_dedup(pairs))


def test_suffix_dedup_many_chunks(docs, pairs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "chunk_count", lambda n: 7)
    got = table(suffix_dedup.remove_repeats(docs, keep_text=False), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == by_repr(brute.suffix_dedup(pairs))


def test_cut_documents_keeps_columns(docs, pairs):
    out = suffix_dedup.cut_documents(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    rows = out.collect()
    assert len(rows) == len(pairs) and all(len(r.text) == r.n_chars for r in rows)
    assert sorted(r.extra for r in rows) == sorted(r.extra for r in docs.collect())


def test_substring_index(docs, pairs, monkeypatch):
    want = by_repr(brute.substring_index(pairs))
    for n in (1, 5):
        monkeypatch.setattr(substring_index, "chunk_count", lambda _, n=n: n)
        got = table(substring_index.remove_repeats(docs, keep_text=False), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == want


def test_index_is_incremental(spark, docs, pairs):
    """Batches in any number, with merges between them, give one index."""
    whole = substring_index.FingerprintIndex(spark, 3)
    whole.append(docs)
    parts = substring_index.FingerprintIndex(spark, 3)
    for k in range(5):
        parts.append(docs.where(f"pmod(extra, 5) = {k}"))
    assert len(parts.runs) < 5
    parts.compact()
    assert len(parts.runs) == 1
    rows = lambda i: by_repr((r.bucket, bytes(r.sent), bytes(r.times)) for r in i.read().collect())
    assert rows(whole) == rows(parts)


def test_later_batch_is_judged_against_history(spark, docs, pairs, monkeypatch):
    """Windows of a new batch that stand only in an earlier one go; those of earlier batches don't come back."""
    monkeypatch.setattr(substring_index, "chunk_count", lambda _: 3)
    cols = ("doc_id", "n_words", "n_removed", "kept_sha256")
    passage = " ".join(f"only{i}" for i in range(50))
    late = [(5001, f"fresh start {passage} fresh end"), (5002, pairs[10][1]), (5003, "nothing " * 10)]
    batches = [docs.select("doc_id", "text"), spark.createDataFrame([(5000, f"old words {passage}")], "doc_id long, text string")]
    index = substring_index.FingerprintIndex(spark, 3)
    for batch in [*batches, spark.createDataFrame([(5004, None)], "doc_id long, text string")]:
        index.append(batch)
    new = index.append(spark.createDataFrame(late, "doc_id long, text string"))  # the fourth: runs are merged
    want = [r for r in brute.substring_index([*pairs, (5000, f"old words {passage}"), (5004, None), *late]) if r[0] is not None and 5001 <= r[0] <= 5003]
    assert next(r for r in want if r[0] == 5001)[2] == 50
    assert table(substring_index.remove_known(index, new), *cols) == by_repr(want)
    # Runs that aren't merged say so too.
    index = substring_index.FingerprintIndex(spark, 3)
    index.append(batches[1])
    new = index.append(spark.createDataFrame(late, "doc_id long, text string"))
    assert len(index.runs) == 2
    got = {r.doc_id: r.n_removed for r in substring_index.remove_known(index, new).collect()}
    assert got[5001] == 50 and got.keys() == {5001, 5002, 5003}


def test_runs_find_every_repeat():
    """Equal windows lie in runs with equal anchors and equal offsets to them."""
    r = random.Random(3)
    for scheme, sep in ((anchors.Bytes(), ""), (anchors.Words(), " ")):
        texts = [sep.join(r.choice("abc") for _ in range(r.randrange(0, 400))).encode() for _ in range(30)] + [b"a" * 300, b"a " * 300]
        text, first, count, value = anchors.runs(scheme, texts)
        seen = {}
        for d, f, c, v in zip(text.tolist(), first.tolist(), count.tolist(), value.tolist()):
            take = scheme.taker(texts[d])
            for i in range(f, f + c):
                assert seen.setdefault(take(i, i + scheme.length), v) == v
        n = sum(max(0, (len(t) if sep == "" else len(t.split())) - scheme.length + 1) for t in texts)
        assert int(count.sum()) == n


@pytest.fixture(scope="module")
def items(pairs, texts):
    w = brute.alnum(texts[10])
    return [(3, " ".join(w[50:75])), (12, " ".join(w[60:64])), (7, None), (8, ""), (9, "mit LICENSE"), (None, " ".join(w[300:312])), (3, " ".join(w[50:75])), (4, "not there at all in any text that is scanned here")]


def test_decontaminate(spark, docs, pairs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = by_repr(brute.decontaminate(pairs, items))
    assert table(decontaminate.digests(docs, bench), *cols) == want
    clean = decontaminate.clean(docs, bench)
    assert clean.schema.simpleString() == docs.schema.simpleString()
    assert table(clean, "doc_id") == by_repr((w[0],) for w in want if not w[-1])


def test_decontaminate_in_blocks(spark, docs, pairs, items):
    """A benchmark over the broadcast bound is scanned in blocks with the same result."""
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = table(decontaminate.scan(docs, bench, max_words=40), "doc_id", "n_words", "n_hit")
    assert got == by_repr(r[:3] for r in brute.decontaminate(pairs, items))
    assert table(decontaminate.clean(docs, bench, max_words=40), "doc_id", "extra") == table(decontaminate.clean(docs, bench), "doc_id", "extra")


def test_decontaminate_removes_spans(spark, docs, pairs, items):
    """Hit words go, all others stay, in one pass and in blocks."""
    bench = spark.createDataFrame(items, "item_id long, text string")
    n_hit = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.scan(docs, bench).collect()}
    text = dict(pairs)
    one = decontaminate.remove_spans(docs, bench)
    assert one.schema.simpleString() == docs.schema.simpleString()
    got = one.collect()
    assert len(got) == len(pairs) and any(n for _, n in n_hit.values())
    for r in got:
        words, hit = n_hit[r.doc_id]
        assert len(brute.alnum(r.text)) == words - hit and r.n_chars == len(r.text or "")
        if not hit:
            assert r.text == text[r.doc_id]
    in_blocks = decontaminate.remove_spans(docs, bench, max_words=40)
    assert table(in_blocks, *docs.columns) == table(one, *docs.columns)
    assert decontaminate.without_words(b"a, (b c) d. e", np.array([[1, 2]])) == b"a, () d. e"


def test_licences(docs, pairs):
    got = licences.scan(docs)
    assert table(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == by_repr(brute.licence_base(pairs))
    for r in got.collect():
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


@pytest.mark.parametrize("label, text, keys", licences.TEMPLATES)
def test_licence_templates(label, text, keys):
    """Each notice is found inside other words, and with two of its words changed; a few of its words alone aren't."""
    words = ("some words before it " + text + " and behind").encode().split()
    joined = " ".join(text.split())
    assert any(k in joined for k in keys) or label == "cc-by"
    if any(k in joined for k in keys):
        assert label in licences.method_labels(words, b" " + b" ".join(words) + b" ")
    for phrase in keys:  # a key phrase alone isn't a notice, but for those of nothing else
        w = f"we speak of {phrase} here".encode().split()
        got = licences.method_labels(w, b" " + b" ".join(w) + b" ")
        assert label not in got


@pytest.mark.parametrize("text", [
    "these works are in the public domain by now", "see the file named cc0 for more", "they chose the mit license after a vote", "my cc0 variable",
    "no mit license applies here", "the public domain of ideas", "unauthorized copying", "creative commons attribution noncommercial",
    "the Creative Commons Attribution-NonCommercial License", "a BSD license, a Mozilla Public License or a lesser general public license",
])
def test_mentions_of_licences_are_no_notices(text):
    words = brute.alnum(text)
    assert licences.method_labels([w.encode() for w in words], f" {' '.join(words)} ".encode()) == {}


def test_licences_of_one_family_are_told_apart():
    for text, want in (
        ("Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", {"cc-by-nc"}),
        ("This is licensed under a Creative Commons Attribution 4.0 International License", {"cc-by"}),
        ("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", {"cc-by-sa"}),
    ):
        words = brute.alnum(text)
        assert set(licences.method_labels([w.encode() for w in words], f" {' '.join(words)} ".encode())) == want


def test_licence_labels_by_brute_force(spark, pairs):
    """All labels and scores, also of notices with words left out, doubled or out of place, against a plain version."""
    r = random.Random(8)
    rows = [*pairs]
    for k in range(300):
        words = " ".join(t for _, t, _ in r.sample(licences.TEMPLATES, 2)).split()
        for _ in range(r.randrange(0, 6)):
            i = r.randrange(len(words))
            words[i : i + 1] = r.choice([[], [words[i]] * 2, ["other"], [r.choice(words)]])
        rows.append((20_000 + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = table(licences.scan(docs), "doc_id", "labels", "score")
    want = by_repr((i, *brute.licence_labels(t)) for i, t in rows)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))
    assert sum(0.75 <= x[2] < 1 for x in want) > 5 and len({x[1] for x in want}) > 15


def test_rules(docs, pairs):
    got = ngram_rules.judge(docs)
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert table(got, *cols) == by_repr(brute.rule_counts(pairs))
    assert not any(r.kept and r.base_failed for r in got.collect())


def test_bpe(docs, pairs):
    import tiktoken

    path = queries.bpe_path()
    vocab = bpe.vocabulary(path)
    import public_tokenizers

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    want = []
    for i, t in pairs:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha((t or "").encode())))
    assert table(bpe.digests(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == by_repr(want)


def test_bpe_random_texts():
    import public_tokenizers
    import tiktoken

    vocab = bpe.vocabulary(queries.bpe_path())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    r = random.Random(5)
    near = "aabsstmdrevl''' \n\t   12.,!é中😀ⅷ²"
    texts = ["".join(r.choice(near) for _ in range(r.randrange(50))) for _ in range(3000)]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(500)]
    for t, x in zip(texts, bpe.encode_texts(texts, vocab)):
        assert np.frombuffer(x, "<u4").tolist() == own.encode_ordinary(t)
    x = bpe.encode_texts([texts[0]], vocab)[0]
    ends = bpe.token_ends(x, vocab)
    assert bpe.decode_span(x, 0, len(ends), vocab) == texts[0].encode()
    if len(ends) > 2:
        assert bpe.decode_span(x, 1, 2, vocab) == texts[0].encode()[ends[0] : ends[1]]


def test_near_dup(docs, pairs):
    want = brute.near_classes([(i, t) for i, t in pairs if i is not None])
    got = near_dup.classes(docs).collect()
    assert len(got) == len(pairs)
    assert all(r.class_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.class_id for r in got if r.doc_id is None] == [None]


def test_near_dup_pivots(spark):
    """Texts that aren't like their key's pivot are still compared with each other."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        w = [*base]
        for j in r.sample(range(300), 3 + i % 9):
            w[j] = f"v{i}_{j}"
        rows.append((i, " ".join(w)))
    want = brute.near_classes(rows)
    got = {x.doc_id: x.class_id for x in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_dup_equal_ids(spark):
    """Rows with equal ids share a class, and links of each of their texts count."""
    r = random.Random(4)
    a, b, c, d = (" ".join(f"w{r.randrange(9**9)}" for _ in range(80)) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (8, b + " more"), (9, c), (9, d), (2, d + " end"), (11, c), (11, c), (12, None), (13, ""), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_classes([x for x in rows if x[0] is not None])
    assert want == {3: 3, 5: 3, 8: 3, 9: 2, 2: 2, 11: 2, 12: 12, 13: 13}
    got = near_dup.classes(docs).collect()
    assert len(got) == len(rows) and all(x.class_id == want.get(x.doc_id) for x in got)
    assert sorted(x.doc_id or -1 for x in near_dup.keep_one(docs).collect()) == [-1, 2, 3, 12, 13]


def test_keep_one_keeps_any_columns(spark):
    rows = [(1, "a b c", 1, 2, 3), (1, "a b c", 1, 2, 3), (2, "a  b c", 4, 5, 6), (None, "x", 7, 8, 9), (None, "x", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _row int, `my col` int, `a.b-c``d` int")
    got = near_dup.keep_one(docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    assert sorted(map(tuple, got.collect()), key=repr) == [rows[0], rows[3]]


@pytest.mark.parametrize("n", [150, 600])
def test_near_dup_recall(spark, n):
    """Pairs at a similarity just over 0.8 share a class, at more than one size: what the formula says."""
    r = random.Random(n)
    rows = []
    for i in range(n):
        w = [f"w{r.randrange(40)}" for _ in range(r.randrange(120, 300))]
        rows.append((2 * i, " ".join(w)))
        for p in r.sample(range(len(w)), max(1, len(w) // 48)):  # five shingles a word changed
            w[p] = f"v{i}"
        rows.append((2 * i + 1, " ".join(w)))
    bag = near_dup.multiset
    near = [i for i in range(n) if near_dup.linked(*near_dup.overlap(bag(rows[2 * i][1].encode()), bag(rows[2 * i + 1][1].encode())))]
    got = {x.doc_id: x.class_id for x in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > n // 3
    assert sum(got[2 * i] == got[2 * i + 1] for i in near) >= 0.99 * len(near)


def test_near_dup_real_pairs(spark, real):
    """Recall on the given table, against all pairs found by an inverted index."""
    rows = [(x.doc_id, x.text) for x in real.select("doc_id", "text").collect()]
    sets = [near_dup.elements((t or "").encode()) for _, t in rows]
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))
    got = {x.doc_id: x.class_id for x in near_dup.classes(real).collect()}
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    found = 0
    for i, mine in enumerate(sets):
        lo, hi = np.searchsorted(flat, mine), np.searchsorted(flat, mine, "right")
        common = np.bincount(np.concatenate([owner[a:b] for a, b in zip(lo, hi)] or [owner[:0]]), minlength=len(sets))
        for j in np.flatnonzero(5 * common >= 4 * (len(mine) + np.array(list(map(len, sets))) - common)).tolist():
            if j < i and common[j]:
                found += 1
                assert got[rows[i][0]] == got[rows[j][0]]
    assert found


def test_bagminhash_is_unbiased():
    """Registers agree as often as the weighted Jaccard similarity says, for weights below and above powers of two."""
    r = np.random.default_rng(2)
    h = r.integers(0, 2**63, 60).astype(np.uint64)
    a, b = r.integers(1, 9, 60), r.integers(1, 9, 60)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    hits = []
    for k in range(40):
        g = np.sort(h + np.uint64(k * 7919))
        s = near_dup.signatures(2, np.repeat([0, 1], 60), np.r_[g, g], np.r_[a, b], 64)
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - want) < 0.03


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf_dir, name):
    check(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name])


def _frequent_phrase(n: int, words: bool):
    """Texts that share a phrase shorter than a window, with different text around it, and a few that share more."""
    r = random.Random(11)
    draw = (lambda k: " ".join("".join(r.choice("abcdef") for _ in range(4)) for _ in range(k))) if words else (lambda k: "".join(r.choice("abcdefghij ") for _ in range(k)))
    phrase, size = (" " + draw(30) + " ", 25) if words else (draw(45), 40)
    rows = [(i, draw(size) + phrase + draw(size)) for i in range(n)]
    return rows + [(n + i, "x y z " + rows[7 * i][1] + " w") for i in range(20)]


@pytest.mark.parametrize("op", [suffix_dedup, substring_index])
def test_frequent_phrases_are_parted(spark, monkeypatch, op):
    """The texts around a phrase that thousands share don't meet in one bucket, and results stay."""
    from strataframe.llm import exchange

    words = op is substring_index
    rows = _frequent_phrase(3000, words)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = by_repr((brute.substring_index if words else brute.suffix_dedup)(rows))
    cols = ("doc_id", "n_words", "n_removed", "kept_sha256") if words else ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    monkeypatch.setattr(op, "chunk_count", lambda n: 16)
    assert table(op.remove_repeats(docs, keep_text=False), *cols) == want
    # One chunk's share of the run texts: under one hash without parting, spread over buckets with it.
    group = pa_group(rows)
    chunk = exchange.Chunk(group.column("blob").to_pylist())
    sent = exchange.sent_rows(op.SCHEME, chunk, group, 16).to_pandas()
    import pyarrow as pa

    largest = {}
    for hot in (10**9, 100):
        monkeypatch.setattr(exchange, "HOT", hot)
        parts = [exchange.answered(pa.Table.from_pandas(g, schema=exchange_schema()), lambda v, r, t: np.ones(len(v), bool), 1) for _, g in sent.groupby("bucket")]
        made = exchange.RunTexts(op.SCHEME, chunk, pa.concat_tables(parts), 16)
        largest[hot] = np.unique(made.sent, return_counts=True)[1].max()
    assert largest[10**9] > 500 and largest[100] < 100


def exchange_schema():
    import pyarrow as pa

    return pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("sent", pa.binary()), ("times", pa.binary())])


def pa_group(rows):
    import pyarrow as pa

    from strataframe.llm.common import pack

    blob = pack(pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t.encode() for _, t in rows], pa.binary())}))
    return pa.table({"chunk": pa.array([0], pa.int32()), "blob": pa.array([blob], pa.binary())})


def test_cells_are_small():
    """What a chunk sends a bucket costs a few bytes beside the data, however little they share."""
    from strataframe.llm.common import cell, uncell

    for parts in ([], [b""], [b"a", b"", b"bcd"], [b"x" * 5000, b"y"]):
        assert uncell(cell(*parts)) == parts
    assert len(cell(b"\x01", b"12345", b"12345678", b"1234", b"x" * 50)) < 100
    assert len(cell(b"x" * 5000)) < 100


def test_bpe_keeps_columns(spark):
    """Columns with the names of new ones are kept under another name."""
    df = spark.createDataFrame([(1, "a b", 7, "x", 9, 4)], "doc_id long, text string, ids int, `my col` string, token_ends int, decoded int")
    path = queries.bpe_path()
    coded = bpe.encode(df, path)
    assert coded.columns == ["doc_id", "original_ids", "my col", "original_token_ends", "decoded", "ids", "token_ends"]
    row = bpe.decode(coded, path).first()
    assert (row.original_ids, row["my col"], row.original_token_ends, row.original_decoded, bytes(row.decoded)) == (7, "x", 9, 4, b"a b")


def test_any_column_names(spark, items):
    """Nothing depends on the names of other columns."""
    rows = [(i, f"text number {i} " + "same words here " * 20, "en", 1, 2, 3, 4) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `my col` int, `a-b` int, extra struct<`x y`:int>, n_chars int".replace("extra struct<`x y`:int>", "extra int"))
    nested = docs.selectExpr("doc_id", "text", "lang", "`my col`", "`a-b`", "named_struct('x y', extra) AS extra", "n_chars")
    out = suffix_dedup.cut_documents(nested)
    assert out.schema.simpleString() == nested.schema.simpleString() and out.columns == nested.columns
    assert sorted((r["my col"], r["a-b"], r.extra["x y"]) for r in out.collect()) == [(1, 2, 3)] * 5
    bench = spark.createDataFrame(items, "item_id long, text string")
    for made in (decontaminate.clean(nested, bench), decontaminate.clean(nested, bench, max_words=40), decontaminate.remove_spans(nested, bench, max_words=40)):
        assert made.columns == nested.columns and made.count() == 5
    assert near_dup.keep_one(nested).columns == nested.columns


def test_null_language_is_one_of_its_own(spark):
    text = " ".join(f"word{i % 60} other" for i in range(60))
    docs = spark.createDataFrame([(1, text, None), (2, text, ""), (3, text, "en")], "doc_id long, text string, lang string")
    bands = ngram_rules.bands(ngram_rules.score(docs, ngram_rules.train(docs)))
    assert {r.band_lang for r in bands.collect()} <= {None, "", "en"}
    assert bands.count() == 3
    assert {r.doc_id for r in ngram_rules.judge(docs).collect()} == {1, 2, 3}
