from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, n_words string, extra int"


def _prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    parts = ["an", "the", "er", "on", "in", "es", "ou", "ti", "st", "re", "é", "ß", "nd", "or"]
    out = []
    for i in range(n):
        w = "".join(r.choice(parts) for _ in range(r.randrange(1, 5)))
        out.append(w.capitalize() if i % 9 == 0 else w)
    return " ".join(out) + "."


@pytest.fixture(scope="session")
def texts():
    """Edge cases: null, empty, white space only, one word, long, copies, near copies, shared and inner passages, runs."""
    passage, long = _prose(1, 60), _prose(2, 4000)
    near = _prose(3, 200).split(" ")
    changed = [*near]
    changed[100] = "CHANGED"
    far = [*near]
    for i in range(0, 200, 12):
        far[i] = f"x{i}"
    return [
        None, "", " \n\t ", "one", "a b c d", "a b c d", passage, passage, f"{_prose(4, 30)}\n{passage}\n{_prose(5, 30)}",
        f"{_prose(6, 80)} {passage}", long, long, " ".join(near), " ".join(changed), " ".join(far), "x" * 3000, "ab" * 900, "ha " * 400,
        f"{passage}\n{passage}", _prose(7, 120), "  " + _prose(7, 120).replace(" ", "  "), "Licensed under CC BY-NC 4.0. All rights reserved.",
        "Released under the MIT License.", "GNU General Public License, version 3; general public license", "日本語 テキスト 😀 'S 's ''s", "\x00\x01 null bytes \x00",
        "#### | $$$ %%% <a> &amp; **", "line\nline\n\nline\nother\n", "éa" * 40 + _prose(8, 20), "aé" * 41 + _prose(8, 20),
    ]


@pytest.fixture(scope="session")
def pairs(texts):
    """(doc_id, text); the order of ids isn't that of rows, ids repeat once, and one is null."""
    ids = [(i * 37) % 1009 for i in range(len(texts))]
    out = list(zip(ids, texts))
    return [*out, (out[6][0], texts[6]), (None, texts[10]), (-5, "negative " + texts[7])]


@pytest.fixture(scope="session")
def docs(spark, pairs):
    langs = ["en", None, "de"]
    rows = [(i, t, langs[k % 3], f"src{k % 2}", len(t or ""), "c", "w", k) for k, (i, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="session")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
