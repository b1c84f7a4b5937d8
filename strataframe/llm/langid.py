"""Language identification by error-correcting output codes.

Each language gets a codeword; one binary classifier a bit, over hashed byte bigrams and trigrams, predicts it. All
code columns that split few languages are used (an exhaustive code); many languages get random columns. Decoding sums
each bit's loss, weighted by how well the bit was learned, and takes the nearest codeword; a small lead over the
second is flagged as ambiguous.

The classifiers are fitted on a bounded sample (``SAMPLE`` documents, in equal parts by language, but about
``LEAST_EACH`` a language at least, the first by a hash of the id), each text in whole; every whole text is then predicted.
Texts of any length are read in pieces. ``und``, with score 0, is given to null and empty texts and to texts without a
letter. Without any labelled row every text is ``und``; a null language teaches nothing. Equal rows give equal results, and
each row gives one. Other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import byte_texts, id_hash, slices, small_batches

#: Documents in the sample that the classifiers are fitted on; least documents a language, so that no language that has
#: rows is left out: with many languages the sample grows.
SAMPLE = 2_400
LEAST_EACH = 12
#: Bytes of a text that are read at a time.
PIECE = 1 << 20
#: Hash cells for bigrams, and again for trigrams.
CELLS = 1 << 11
EXHAUSTIVE = 6
AMBIGUOUS = 0.1

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "ignore")))


def features(texts: list[bytes]) -> np.ndarray:
    """Square roots of the shares of hashed bigrams and trigrams of letters and spaces; one row a text."""
    out = np.zeros((len(texts), 2 * CELLS), np.float32)
    for i, text in enumerate(texts):
        counts = np.zeros((2, CELLS), np.int64)
        tail = np.zeros(0, np.uint32)  # the last two symbols of the piece before
        for a in range(0, len(text), PIECE):
            x = np.r_[tail, _FOLD[np.frombuffer(text, np.uint8, min(PIECE, len(text) - a), a)].astype(np.uint32)]
            keep = np.ones(len(x), bool)
            keep[1:] = (x[1:] != 32) | (x[:-1] != 32)  # runs of spaces count once
            x = x[keep]
            two = (x[:-1] << 8) | x[1:]
            three = (two[:-1] << 8) | x[2:]
            for row, codes, new in ((counts[0], two, max(len(tail) - 1, 0)), (counts[1], three, 0)):
                cell = (codes[new:] * np.uint32(2654435761)) >> np.uint32(21)
                row += np.bincount(cell, minlength=CELLS)
            tail = x[-2:]
        for at, row in ((0, counts[0]), (CELLS, counts[1])):
            if total := row.sum():
                out[i, at : at + CELLS] = np.sqrt(row / total)
    return out


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1 as rows. No column is constant or another's complement."""
    if n <= EXHAUSTIVE:
        columns = [[1 if k == 0 or bits >> (k - 1) & 1 else -1 for k in range(n)] for bits in range(2 ** max(n - 1, 0) - 1)]
        return np.array(columns, np.int8).T.reshape(n, len(columns))
    rng = np.random.default_rng(n)
    length = 10 * int(np.ceil(np.log2(n)))
    best, far = None, -1
    for _ in range(max(1, 200 * 200**2 // max(n, 200) ** 2)):  # a try takes time with the square of n
        code = rng.choice(np.array([-1, 1], np.int8), (n, length))
        apart = (length - code.astype(int) @ code.T.astype(int)) // 2 + length * np.eye(n, dtype=int)
        if (abs(code.sum(0)) < n).all() and apart.min() > far:
            best, far = code, apart.min()
    return best


class Model:
    def __init__(self, x: np.ndarray, langs: list[str], rounds: int = 150, decay: float = 1e-4):
        self.langs = sorted(set(langs))
        self.code = codewords(len(self.langs))
        target = self.code[[self.langs.index(v) for v in langs]].astype(np.float32) if langs else np.zeros((0, 0), np.float32)
        w = np.zeros((x.shape[1], self.code.shape[1] if langs else 0), np.float32)
        b = np.zeros(w.shape[1], np.float32)
        ahead, step = w.copy(), 8.0
        for t in range(rounds if w.shape[1] else 0):  # accelerated gradient steps on the logistic loss
            g = -target / (1 + np.exp(target * (x @ ahead + b)))
            new = ahead - step * (x.T @ g / len(x) + decay * ahead)
            ahead = new + t / (t + 3) * (new - w)
            w = new
            b -= g.mean(0)
        self.w, self.b = w, b
        # A bit that separates its training rows better weighs more in decoding.
        right = (np.sign(x @ w + b) == target).mean(0) if len(langs) else np.zeros(0)
        self.weight = np.maximum(2 * right - 1, 0.01).astype(np.float32)

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float], list[bool]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        bits = features(texts) @ self.w + self.b
        one, other = (np.logaddexp(0, x) * self.weight for x in (-bits, bits))
        loss = (one @ (self.code > 0).T.astype(np.float32) + other @ (self.code < 0).T.astype(np.float32)) / max(self.weight.sum(), 1e-9)
        near = np.sort(loss, 1)
        lead = near[:, 1] - near[:, 0] if loss.shape[1] > 1 else np.full(len(loss), 9.0)
        p = np.exp(-8 * (loss - near[:, :1]))
        share = 1 / p.sum(1)
        out, scores, unsure = [], [], []
        for text, k, s, a in zip(texts, loss.argmin(1).tolist(), share.tolist(), (lead < AMBIGUOUS).tolist()):
            known = has_letter(text)
            out.append(self.langs[k] if known else "und")
            scores.append(s if known else 0.0)
            unsure.append(a or not known)
        return out, scores, unsure


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows (doc_id, text, lang); null languages teach nothing."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    if not counts:
        return Model(np.zeros((0, 2 * CELLS), np.float32), [])
    each = max(LEAST_EACH, sample // len(counts))
    # Ids alone decide who is in: those of the least hashes, `each` a language, of about twice as many to choose from.
    h = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40))
    share = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, (2 * each + 30) / n))))
    chosen = h / float(1 << 40) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(byte_texts(part.column("text"))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "h", "x"])

    # A row is 8 KB whatever its text. Each task gives at most `each` rows a language, so repeated ids don't fill one.
    made = small_batches(rows.where(chosen).select("lang", h.alias("h"), "text")).mapInArrow(run, "lang string, h long, x binary")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "x"))
    got = made.withColumn("place", place).where(F.col("place") <= each).collect()
    got.sort(key=lambda r: (r.lang, r.place))
    taken: dict[str, list[bytes]] = {}
    for r in got:
        taken.setdefault(r.lang, []).append(r.x)
    pairs = [(lang, x) for lang, xs in taken.items() for x in xs]
    x = np.frombuffer(b"".join(x for _, x in pairs), np.float16).reshape(len(pairs), 2 * CELLS).astype(np.float32)
    return Model(x, [lang for lang, _ in pairs])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for each row; only the text is used. No shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                for a in range(0, rows.num_rows, 256):
                    part = rows.slice(a, 256)
                    lang, score, unsure = held.value.predict(byte_texts(part.column("text")))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                        names=["doc_id", "lang_pred", "score", "ambiguous"],
                    )

    kind = StructType([docs.schema["doc_id"], *StructType.fromDDL("lang_pred string, score double, ambiguous boolean")])
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, kind)


def held_out():
    return F.coalesce(id_hash() % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    model = train(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
