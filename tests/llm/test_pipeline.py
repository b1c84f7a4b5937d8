"""The pipeline against plain versions of its stages, and empty tables."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from strataframe.llm import bpe, decontaminate, gru_lm, langid, licences, near_dup, ngram_rules, queries, substring_index, suffix_dedup, zstd_quality

from . import brute


@pytest.fixture(scope="module")
def folder(spark, docs, pairs, texts, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs.where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{d}/documents.parquet")
    w = brute.alnum(texts[19])
    spark.createDataFrame([(0, " ".join(w[10:30]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    now = {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        got = {r.doc_id: r.text for r in docs.collect()}
        if k == 1:
            classes = brute.near_classes(list(now.items()))
            assert set(got) == set(classes.values())
        if k == 2:
            want = {r[0]: r[-1] for r in brute.suffix_dedup(list(now.items()))}
            whole = {i for i, t in now.items() if brute.sha((t or "").encode()) == want[i]}
            assert all((got[i] or "") == (now[i] or "") for i in whole)
            assert all(len(got[i]) < len(now[i]) for i in set(now) - whole)
        if k == 3:
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert set(got) == {r[0] for r in brute.decontaminate(list(now.items()), bench) if not r[-1]}
            assert set(got) != set(now)
        now = got
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(last) == set(now)
    vocab = bpe.vocabulary(queries.bpe_path())
    for i, t in now.items():
        assert last[i].decoded_sha256 == brute.sha((t or "").encode())
        assert last[i].n_tokens == len(np.frombuffer(bpe.encode_texts([t or ""], vocab)[0], "<u4"))


def test_empty_tables(spark, empty, tmp_path):
    for name, schema in (("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    bench, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("benchmark", "labels"))
    for made in (
        suffix_dedup.remove_repeats(empty), substring_index.remove_repeats(empty), decontaminate.digests(empty, bench), licences.scan(empty),
        ngram_rules.judge(empty), bpe.digests(empty, queries.bpe_path()), near_dup.classes(empty), zstd_quality.classify(empty, labels),
        langid.identify(empty), gru_lm.score(empty), corpus_pipeline.run(spark, str(tmp_path)),
    ):
        assert made.collect() == []


def test_unlabelled_and_unbenchmarked(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, bench).count() == docs.count()


def test_labels_null_ids_and_repeated_rows(spark, pairs, texts, tmp_path):
    """The whole pipeline with labels, rows without an id, rows with equal ids and repeated rows."""
    from .conftest import SCHEMA, _prose

    good = [(3000 + i, _prose(100 + i, 150)) for i in range(60)]
    bad = [(4000 + i, " | ".join([f"x{i}", "#", "$$$"] * 40)) for i in range(60)]
    rows = [*pairs, *good, *bad, good[0], (good[1][0], "another text " * 9), (None, _prose(990, 90)), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "c", "w", k) for k, (i, t) in enumerate(rows)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (good[0][0], 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, texts[19][:300]), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = zstd_quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    now = [(r.doc_id, r.text) for r in docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = [(r.doc_id, r.text) for r in docs.collect()]
        if k == 0:
            assert sorted(got, key=repr) == sorted(((i, t) for i, t in now if brute.quality(t, model) >= zstd_quality.THRESHOLD), key=repr)
            assert not {i for i, _ in bad} & {i for i, _ in got} and sum(3000 <= (i or 0) < 3060 for i, _ in got) >= 55
        if k == 1:
            classes = brute.near_classes([x for x in now if x[0] is not None])
            assert sorted(i for i, _ in got if i is not None) == sorted(set(classes.values()))
            assert sorted((t or "" for i, t in got if i is None)) == sorted({t or "" for i, t in now if i is None})
        now = got
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(now)


def test_texts_of_megabytes(spark):
    """Long texts, longer than a slice, a chunk and a batch, through every operator that reads them."""
    from .conftest import _prose

    words = _prose(5, 400).split()
    r = np.random.default_rng(0)
    long = " ".join(words[i] for i in r.integers(0, 400, 450_000))
    assert len(long) > 2 << 20
    tail = long[1_000_000:]
    rows = [(1, long, "en"), (2, long, "en"), (3, "before " + tail, "de"), (4, _prose(77, 60), "de"), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    size = {i: len((t or "").encode()) for i, t, _ in rows}
    got = {x.doc_id: x for x in suffix_dedup.remove_repeats(docs, keep_text=False).collect()}
    assert [got[i].n_bytes for i in range(1, 6)] == [size[i] for i in range(1, 6)]
    assert (got[1].n_removed, got[2].n_removed, got[4].n_removed) == (0, size[2], 0) and got[3].n_removed >= len(tail.encode())
    got = {x.doc_id: x for x in substring_index.remove_repeats(docs, keep_text=False).collect()}
    assert got[1].n_removed == got[1].n_words == 450_000 and got[4].n_removed == 0
    assert {x.doc_id: x.class_id for x in near_dup.classes(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    lm = {x.doc_id: x for x in gru_lm.score(docs.select("doc_id", "text")).collect()}
    assert lm[1].n_tokens == 450_001 and lm[1].score == lm[2].score and lm[5].n_tokens == 1
    vocab_path = queries.bpe_path()
    assert {x.doc_id: x.decoded_sha256 for x in bpe.digests(docs, vocab_path).collect()} == {i: brute.sha((t or "").encode()) for i, t, _ in rows}
    bench = spark.createDataFrame([(9, " ".join(long.split()[-30:]))], "item_id long, text string")
    hits = {x.doc_id: x.n_items for x in decontaminate.digests(docs, bench).collect()}
    assert hits == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0}
    assert {x.doc_id for x in ngram_rules.judge(docs).collect()} == {x.doc_id for x in licences.scan(docs).collect()} == {1, 2, 3, 4, 5}
    assert {x.doc_id: x.lang_pred for x in langid.identify(docs).collect()}[5] == "und"
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    assert zstd_quality.classify(docs, labels).count() == 5
