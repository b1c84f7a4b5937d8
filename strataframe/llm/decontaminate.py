"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams, scanned over all document words.

Words are runs of ASCII letters and digits and of non-ASCII code points, A-Z lower-cased. A window is ``n`` consecutive
words of a benchmark item; an item of fewer words, but not none, is one window. Each document window's 64-bit hash is
looked up in the sorted window hashes, and hits are verified word by word. The set is measured before it is broadcast:
beyond ``max_words`` the benchmark is split by a hash of its items into blocks that each fit, every block is scanned
against all documents, and the hit words of the blocks are united per document.

Null and empty texts have no words; items with a null id hit like others but have no id to list. Repeated items and
repeated documents are kept apart or together by their ids alone: each row of documents gives one row. Texts of any length
are scanned whole. Other columns, whatever their names, are ignored by ``scan`` and kept by ``clean`` and ``remove_spans``.
An empty benchmark hits nothing; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ALNUM, alnum_words, byte_texts, cut, quoted, slices, small_batches

WINDOW = 10
#: Benchmark words in one broadcast set, counted as half its bytes: so 2 MB of text, its vocabulary within that, and 24 MB
#: of arrays at most. A longer single item makes its set longer.
MAX_WORDS = 1_000_000

_MIX = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class Windows:
    """The windows of some benchmark items, as arrays: the items' words as numbers one behind another, and by window
    length the sorted hashes with the places that they come from. About 24 bytes a window, besides the vocabulary."""

    def __init__(self, items: list[tuple[object, list[bytes]]], n: int = WINDOW):
        self.n = n
        self.vocab: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        put = self.vocab.setdefault
        numbers = [[put(w, len(self.vocab) + 1) for w in words] for _, words in items]
        sizes = np.array([len(x) for x in numbers], np.int64)
        self.flat = np.array([x for ids in numbers for x in ids], np.uint32)
        self.owner = np.repeat(np.arange(len(items), dtype=np.int32), sizes)
        end = np.cumsum(sizes)[self.owner] if len(items) else np.zeros(0, np.int64)
        place = np.arange(len(self.flat))
        length = np.minimum(sizes, n)[self.owner] if len(items) else end
        starts = place[place + length <= end]
        self.by_length = {}
        for size in np.unique(length[starts]).tolist():
            at = starts[length[starts] == size]
            h = self.hashes([self.flat[at + j].astype(np.uint64) for j in range(size)])
            order = np.argsort(h, kind="stable")
            self.by_length[size] = h[order], at[order]

    @staticmethod
    def hashes(columns) -> np.ndarray:
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = (out ^ c) * np.uint64(_MIX)
            out ^= out >> np.uint64(29)
        return out

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Starts and lengths of verified windows in a document, and the items they come from."""
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        spans, items = [], set()
        zero = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, (known, place) in self.by_length.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(zero[size:] == zero[:-size])
            if not len(at):
                continue
            h = self.hashes([ids[at + j] for j in range(size)])
            low = np.searchsorted(known, h)
            some = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == h)
            for i, a, b in zip(at[some].tolist(), low[some].tolist(), np.searchsorted(known, h[some], "right").tolist()):
                # A hash hit is verified word by word.
                same = (self.flat[place[a:b, None] + np.arange(size)] == ids[i : i + size]).all(1)
                if same.any():
                    spans.append((i, size))
                    items.update(self.items[k] for k in np.unique(self.owner[place[a:b][same]]).tolist())
        return np.array(spans, np.int64).reshape(-1, 2), items


def covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of n places some span (start, length) covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 0] + spans[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def blocks(benchmark: DataFrame, n: int = WINDOW, max_words: int = MAX_WORDS) -> Iterator[Windows]:
    """The benchmark's windows in sets of bounded size, made one after the other."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 2  # a word takes two bytes at least
    count = max(1, math.ceil(words / max_words))
    for k in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield Windows([(r.item_id, alnum_words(r.text.encode())) for r in part.toLocalIterator()], n)


def scan_block(docs: DataFrame, windows: Windows, keep_spans: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, items array<string>, and with ``keep_spans`` spans array<long> (start, length, start,
    length ...). No shuffle."""
    held = small_batches(docs).sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                n_words, n_hit, items, spans = [], [], [], []
                for text in byte_texts(part.column("text")):
                    words = alnum_words(text)
                    found, got = w.hits(words)
                    n_words.append(len(words))
                    n_hit.append(int(covered(found, len(words)).sum()) if len(found) else 0)
                    items.append(sorted(x for x in got if x is not None))
                    spans.append(found.ravel().tolist() if keep_spans else None)
                made = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    kind = StructType([docs.schema["doc_id"], *StructType.fromDDL("n_words long, n_hit long, items array<string>, spans array<long>")])
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def _key() -> Column:
    """What stands for a document where blocks are united: its id and a hash of its text. Rows with equal ids and equal
    texts have equal hits in every block."""
    return F.struct("doc_id", F.xxhash64("text").alias("h"))


def _in_blocks(docs: DataFrame, sets: list[Windows] | Iterator[Windows], only_hits: bool = False) -> DataFrame:
    """The scans of all sets, each written before the next set is made and sent."""
    keyed = docs.select(_key().alias("doc_id"), "text")
    parts = None
    for w in sets:
        made = scan_block(keyed, w, keep_spans=True)
        made = cut(made.where("n_hit > 0") if only_hits else made)
        parts = made if parts is None else parts.union(made)
    return parts


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (sorted ids of items with occurring windows)."""
    sets = blocks(benchmark, n, max_words)
    first, second = next(sets), next(sets, None)
    if second is None:
        return scan_block(docs, first).drop("spans")
    parts = _in_blocks(docs, itertools.chain([first, second], sets))

    def size(spans: pd.Series, n_words: pd.Series) -> pd.Series:
        return pd.Series([int(covered(np.array(x, np.int64).reshape(-1, 2), n).sum()) for x, n in zip(spans, n_words)], dtype="int64")

    # A repeated row is in each block's scan as often: its copies are counted in the first block.
    copies = docs.groupBy(_key().alias("d")).agg(F.count("*").alias("copies"))
    merged = parts.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        F.flatten(F.collect_set("spans")).alias("spans"),
    )
    union_size = F.pandas_udf(size, "long")
    joined = merged.join(copies, F.col("doc_id").eqNullSafe(F.col("d")))
    return joined.select(
        F.explode(F.array_repeat("d", F.col("copies").cast("int"))).alias("d"), "n_words", union_size("spans", "n_words").alias("n_hit"), F.array_sort("items").alias("items"),
    ).select("d.doc_id", "n_words", "n_hit", "items")


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = scan(docs, benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _edit(docs: DataFrame, windows: Windows, whole: bool) -> DataFrame:
    held = small_batches(docs).sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                found = [w.hits(alnum_words(t))[0] for t in byte_texts(part.column("text"))]
                if whole:
                    yield part.filter(pa.array([not len(x) for x in found], pa.bool_()))
                else:
                    yield _with_texts(part, found)

    return docs.mapInArrow(run, docs.schema)


def without_words(text: bytes, spans: np.ndarray) -> bytes:
    """The text without the bytes from the first to the last word of each run of hit words."""
    inside = np.frombuffer(text.translate(ALNUM), np.uint8) != 32
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    gone = covered(spans, len(edge) // 2)
    run = np.flatnonzero(np.diff(gone.view(np.int8), prepend=0, append=0))
    out, at = [], 0
    for a, b in zip(run[::2].tolist(), run[1::2].tolist()):
        out.append(text[at : edge[2 * a]])
        at = int(edge[2 * b - 1])
    return b"".join(out) + text[at:]


def _with_texts(part: pa.RecordBatch, found: list[np.ndarray]) -> pa.RecordBatch:
    at = part.schema.names.index("text")
    texts = part.column(at).to_pylist()
    new = [t if not len(x) else without_words(t.encode(), x).decode() for t, x in zip(texts, found)]
    return part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """The documents without any benchmark window; all columns stay. One pass without a shuffle; with a benchmark over the
    bound, each block's contaminated ids are written, one block after the other, and then joined away."""
    sets = blocks(benchmark, n, max_words)
    first, second = next(sets), next(sets, None)
    if second is None:
        return _edit(docs, first, True)
    hit = _in_blocks(docs, itertools.chain([first, second], sets), only_hits=True).select("doc_id.*").distinct().toDF("i", "h")
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("h")), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """All documents, with the words of benchmark windows and what stands between them cut from the texts; n_chars, if there
    is one, follows the text, all other columns stay. Windows are judged on the input."""
    sets = blocks(benchmark, n, max_words)
    first, second = next(sets), next(sets, None)
    if second is None:
        made = _edit(docs, first, False)
    else:
        parts = _in_blocks(docs, itertools.chain([first, second], sets), only_hits=True)
        found = parts.groupBy("doc_id").agg(F.flatten(F.collect_set("spans")).alias("s")).select(F.col("doc_id.doc_id").alias("i"), F.col("doc_id.h").alias("h"), "s")
        whole = F.struct(*(F.col(quoted(c)).alias("text" if c == "text" else f"c{k}") for k, c in enumerate(docs.columns)))
        rows = docs.join(found, F.col("doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("h")), "left").select(whole.alias("w"), "s").select("w.*", "s")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = [np.array(x or [], np.int64).reshape(-1, 2) for x in batch.column("s").to_pylist()]
                yield _with_texts(batch, spans).select(batch.schema.names[:-1])

        made = rows.mapInArrow(run, StructType(rows.schema.fields[:-1])).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return made
