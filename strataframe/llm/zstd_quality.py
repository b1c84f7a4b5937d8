"""Quality classifier by compression.

Two zstandard dictionaries are built, from labelled good and from labelled bad text. A text is cut into blocks and each
block is compressed with both; the difference of the summed sizes over their sum, with the share that compression
leaves, is mapped to a probability by a logistic fit on labelled rows that built no dictionary.

Dictionaries and fit use a bounded sample of labelled rows (``SAMPLE`` of each class, the first by a hash of the id), each
text in whole; every whole text is scored, block by block, so texts may be of any length. Labels that are null, not 0 or 1,
or contradict each other for one id teach nothing; of rows with equal ids one teaches, that with the least hash of its
text. Without rows of both classes every score is the share of good rows, or 1 without any. Null and empty texts score
what the labelled rows' share of good ones is. Each row gives a score, equal texts equal ones, a null id too; other
columns, whatever their names, are ignored (``classify``) or kept (``keep_good``). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, id_hash, map_texts, slices, small_batches

#: Labelled rows of each class in the sample.
SAMPLE = 1_500
DICT_BYTES = 64 << 10
BLOCK = 4 << 10
LEVEL = 3
THRESHOLD = 0.3
#: Bytes at which a text counts half.
SHORT = 300


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train, the text itself."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICT_BYTES:]


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for d in (good, bad):
            held = zstandard.ZstdCompressionDict(d) if d else None
            if held:
                held.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False))

    def measures(self, text: bytes) -> tuple[float, float, float]:
        """Difference of the compressed sizes over their sum (positive: the good one fits better), and the mean share."""
        good, bad = (sum(len(c.compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK)) for c in self.pair)
        return (bad - good) / max(good + bad, 1), (good + bad) / max(2 * len(text), 1), len(text) / (len(text) + SHORT)


def design(m: np.ndarray) -> np.ndarray:
    """Columns of the fit. The last measure draws short texts, which show little, to the intercept."""
    d, share, shown = 20 * m[:, 0], 4 * (m[:, 1] - 0.4), m[:, 2]
    return np.stack([np.ones(len(m)), shown * d, shown * share, shown * d * share, shown * np.square(share)], 1)


class Model:
    def __init__(self, good: list[bytes], bad: list[bytes]):
        n = len(good) + len(bad)
        self.prior = len(good) / n if n else 1.0
        self.good = self.bad = b""
        self.coef = None
        if not good or not bad:
            return
        split = lambda xs: (xs[::2], xs[1::2] or xs)
        (g1, g2), (b1, b2) = split(good), split(bad)
        self.good, self.bad = dictionary(g1), dictionary(b1)
        c = Compressors(self.good, self.bad)
        x = design(np.array([c.measures(t) for t in [*g2, *b2]]))
        y = np.r_[np.ones(len(g2)), np.zeros(len(b2))]
        w = np.zeros(x.shape[1])
        for _ in range(40):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
            w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        self.coef = w
        self._made = None

    def calibrate(self, prior: float) -> None:
        """Shift from the sample's share of good rows to the labels' own."""
        if self.coef is not None and 0 < prior < 1:
            self.coef[0] += np.log(prior / (1 - prior)) - np.log(self.prior / (1 - self.prior))
        self.prior = prior

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"} | {"_made": None}

    def __call__(self, texts: list[bytes]) -> dict[str, object]:
        if self.coef is None:
            return {"score": pa.array([self.prior] * len(texts), pa.float64())}
        self._made = self._made or Compressors(self.good, self.bad)
        m = np.array([self._made.measures(t) for t in texts]).reshape(-1, 3)
        p = 1 / (1 + np.exp(-np.clip(design(m) @ self.coef, -30, 30)))
        p[np.array([not t for t in texts], bool)] = self.prior
        return {"score": pa.array(p, pa.float64())}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``labels`` (doc_id, quality) and their documents. Only sampled ids are broadcast: 2 * sample rows; as many
    texts, in whole, reach the driver."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    one = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    counts = {r.quality: r["count"] for r in one.groupBy("quality").count().collect()}
    total = sum(counts.values())
    if not total:
        return Model([], [])
    pick = lambda q: one.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = pick(0).union(pick(1))
    same = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    rows = same.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id * 0x9E3779B1 % (1 << 32), r.doc_id))
    model = Model([r.text.encode() for r in rows if r.quality == 1], [r.text.encode() for r in rows if r.quality == 0])
    model.calibrate(counts.get(1, 0) / total)
    return model


def held_out():
    return F.coalesce(id_hash() % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The production model: learned from labels of ids that aren't held out."""
    return train(docs, labels.select("doc_id", "quality").where(~held_out()))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Per row: doc_id and score, the probability of label 1. No shuffle."""
    return map_texts(docs.select("doc_id", text), model, "score double", text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text is predicted as good; all columns stay. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = model(byte_texts(part.column("text")))["score"].to_numpy()
                yield part.filter(pa.array(got >= THRESHOLD))

    return small_batches(docs).mapInArrow(run, docs.schema)
