"""Substring removal with a log-structured fingerprint index.

A window is ``Words.length`` consecutive words of one document. A word goes if a window covers it whose word sequence
also starts anywhere else, in the same document or another; windows are judged on the input.

The index holds fingerprints of windows: the hashes of their anchors (see ``anchors``), which equal windows share. A
batch of documents becomes a run: for each hash bucket one row with the bucket's sorted hashes, and whether each came
once or more by then. For that a batch is merge-joined with all earlier runs, bucket by bucket. Runs are written once
and never changed; when there are ``FAN_IN`` runs they are merged into one. Beside the runs the index keeps the packed
texts of its batches, so that a hit can be verified against earlier documents.

A lookup judges the documents of some batch and all later ones against everything the index holds: each of their chunks
merge-joins its hashes with the index; for the hashes that came more than once these chunks, and those of earlier
batches that have them too, send the words of the runs of windows, and the buckets verify which windows really are
equal, word by word.

Hash arrays are a fixed few bytes an anchor, and a group of copies sends one text a chunk, so no key's rows meet in
one task; windows around a frequent phrase are dealt by their own hashes (see ``exchange``). Null and empty texts have no
words; rows with equal ids, repeated rows too, are documents like others and each give a row. Texts may be of any
length; other columns, whatever their names, are ignored. An empty table gives no rows, an empty batch an empty run.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors
from .common import Chunk, byte_texts, checkpoint_dir, chunk_count, chunked, slices, small_batches, text_bytes, trimmed
from .exchange import ANSWERS, SENT_ROWS, RunTexts, answered, covered, read_runs, sent_rows, spread

SCHEME = anchors.Words()
LENGTH = SCHEME.length
#: Batches that the query feeds to the index; runs that are merged into one.
BATCHES = 2
FAN_IN = 4
#: Hashes that a task holds before it sends them on.
HELD = 2_000_000

_RUN = "bucket int, sent binary, times binary"


def _merge(arrays: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of several sorted arrays, and how often each came, up to twice."""
    value, where = np.unique(np.concatenate(arrays), return_inverse=True)
    return value, np.minimum(np.bincount(where, np.concatenate(times), len(value)), 2).astype(np.uint8)


def _merge_rows(group: pa.Table) -> pa.Table:
    value, times = _merge(
        [anchors.from_bytes(x) for x in group.column("sent").to_pylist()],
        [np.frombuffer(x, np.uint8) for x in group.column("times").to_pylist()],
    )
    return pa.table({
        "bucket": group.column("bucket").slice(0, 1), "sent": pa.array([anchors.to_bytes(value)], pa.binary()),
        "times": pa.array([times.tobytes()], pa.binary()),
    })


def _join_rows(group: pa.Table, earlier: pa.Table) -> pa.Table:
    """A batch's hashes of a bucket; those that an earlier run has came more than once."""
    if not group.num_rows:
        return pa.table({"bucket": pa.array([], pa.int32()), "sent": pa.array([], pa.binary()), "times": pa.array([], pa.binary())})
    row = _merge_rows(group)
    value, times = anchors.from_bytes(row.column("sent")[0].as_py()), np.frombuffer(row.column("times")[0].as_py(), np.uint8).copy()
    for raw in earlier.column("sent").to_pylist():
        known = anchors.from_bytes(raw)
        if len(known):
            times[known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value] = 2
    return row.set_column(2, "times", pa.array([times.tobytes()], pa.binary()))


def _mark_rows(group: pa.Table, index: pa.Table, since: int, n_chunks: int) -> pa.Table:
    """The hashes of each row that the index has more than once and a chunk from ``since`` on has."""
    known = [anchors.from_bytes(x)[np.frombuffer(t, np.uint8) > 1] for x, t in zip(index.column("sent").to_pylist(), index.column("times").to_pylist())]
    wanted = np.unique(np.concatenate(known or [np.zeros(0, np.uint64)]))
    judged = group.column("chunk").to_numpy() >= since

    def again(value: np.ndarray, row: np.ndarray, times: np.ndarray) -> np.ndarray:
        out = np.isin(value, wanted)
        return out & np.isin(value, value[judged[row]]) if since else out

    return answered(group, again, n_chunks)


class FingerprintIndex:
    """Immutable sorted runs, and the packed texts they come from, below a folder that all executors share."""

    def __init__(self, spark: SparkSession, n_buckets: int, folder: str | None = None):
        self.spark, self.n_buckets = spark, n_buckets
        self.folder = folder or f"{checkpoint_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.runs: list[str] = []
        #: Folders of the batches' packed documents, and the number of each batch's first chunk; last, that of the next.
        self.texts: list[str] = []
        self.first = [0]

    def fingerprints(self, docs: DataFrame) -> DataFrame:
        """(bucket, sent, times) of the documents, sorted within each row; several rows a bucket. No shuffle."""
        n_buckets = self.n_buckets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []

            def flush() -> pa.RecordBatch:
                value, times = np.unique(np.concatenate(held), return_counts=True)
                bucket, low = anchors.route(value, n_buckets)
                rows = []
                for k, at in anchors.by_bucket(bucket, n_buckets):
                    at = at[np.argsort(low[at])]
                    rows.append((k, anchors.to_bytes(low[at]), np.minimum(times[at], 2).astype(np.uint8).tobytes()))
                return pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))],
                    names=["bucket", "sent", "times"],
                )

            for batch in batches:
                for part in slices(batch, "text"):
                    held.append(anchors.runs(SCHEME, byte_texts(part.column("text")))[3])
                    if sum(map(len, held)) > HELD:
                        yield flush()
                        held = []
            if sum(map(len, held)):
                yield flush()

        return small_batches(docs).select("text").mapInArrow(run, _RUN)

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.folder}/run-{uuid.uuid4().hex}"
        rows.sortWithinPartitions("bucket").write.parquet(path)
        return path

    def read(self) -> DataFrame:
        """All runs together: a bucket has one row in each."""
        if not self.runs:
            return self.spark.createDataFrame([], _RUN)
        return self.spark.read.schema(_RUN).parquet(*self.runs)

    def documents(self) -> DataFrame:
        """Packed rows (chunk, blob) of the documents of all batches."""
        return self.spark.read.schema("chunk int, blob binary").parquet(*self.texts)

    def append(self, docs: DataFrame) -> int:
        """Add a batch as a run of its own, merge-joined with the earlier ones; merge the runs when there are many.
        Gives the batch's number."""
        first, n_chunks = self.first[-1], chunk_count(text_bytes(docs))
        path = f"{self.folder}/texts-{uuid.uuid4().hex}"
        chunked(docs, n_chunks).select((F.col("chunk") + first).cast("int").alias("chunk"), "blob").write.parquet(path)
        rows = self.fingerprints(docs).groupBy("bucket")
        if self.runs:
            self.runs.append(self._write(rows.cogroup(self.read().groupBy("bucket")).applyInArrow(trimmed(_join_rows), _RUN)))
        else:
            self.runs.append(self._write(rows.applyInArrow(trimmed(_merge_rows), _RUN)))
        self.texts.append(path)
        self.first.append(first + n_chunks)
        if len(self.runs) >= FAN_IN:
            self.compact()
        return len(self.texts) - 1

    def compact(self) -> None:
        """Merge all runs into one. The old runs stay until the folder goes, so a reader that has them can go on."""
        if len(self.runs) > 1:
            self.runs = [self._write(self.read().groupBy("bucket").applyInArrow(trimmed(_merge_rows), _RUN))]

    def repeated(self, sent: DataFrame, since: int = 0) -> DataFrame:
        """Rows (bucket, chunk, sent, times) merge-joined with the runs: the hashes that came more than once, if a chunk from
        ``since`` on has them."""
        n_chunks = self.first[-1]
        return sent.groupBy("bucket").cogroup(self.read().groupBy("bucket")).applyInArrow(trimmed(lambda g, i: _mark_rows(g, i, since, n_chunks)), ANSWERS)


def run_rows(group: pa.Table, answers: pa.Table, n_buckets: int) -> pa.Table:
    """Chunk -> (bucket, chunk, blob): its different run texts with windows, sent hash and how often they stand there."""
    made = RunTexts(SCHEME, Chunk(group.column("blob").to_pylist()), answers, n_buckets)
    return made.rows(group, np.minimum(np.bincount(made.uses[2], minlength=len(made.raws)), 2).astype(np.int64))


def verify_rows(group: pa.Table) -> pa.Table:
    """Bucket -> (chunk, bucket, bits): for each run text that a chunk sent, which windows stand more than once."""
    number: dict[bytes, int] = {}
    windows, sent, times, parts = [], [], [], []
    for blob in group.column("blob").to_pylist():
        texts, *numbers = read_runs(blob)
        mine = []
        for raw, w, v, n in zip(texts, *(x.tolist() for x in numbers)):
            k = number.setdefault(raw, len(windows))
            if k == len(windows):
                windows.append(w)
                sent.append(v)
                times.append(0)
            times[k] += n
            mine.append(k)
        parts.append(mine)
    raws = list(number)
    flags: list[np.ndarray] = [np.full(w, n > 1) for w, n in zip(windows, times)]
    order = np.argsort(sent, kind="stable")
    edge = np.flatnonzero(np.diff(np.array(sent, np.int64)[order], prepend=-1, append=-1))
    for a, b in zip(edge[:-1], edge[1:]):
        if b - a < 2:
            continue  # a run has each of its windows once
        texts: Counter[bytes] = Counter()
        keys = []
        for i in order[a:b].tolist():
            words = raws[i].split(b" ")
            mine = [b" ".join(words[j : j + LENGTH]) for j in range(windows[i])]
            for x in mine:
                texts[x] += times[i]
            keys.append((i, mine))
        for i, mine in keys:
            flags[i] = np.array([texts[x] > 1 for x in mine])
    bits = [np.packbits(np.concatenate([flags[i] for i in mine])).tobytes() for mine in parts]
    return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "sent": pa.array(bits, pa.binary())})


def cut_rows(group: pa.Table, answers: pa.Table, n_buckets: int, whole: bool) -> pa.Table:
    chunk = Chunk(group.column("blob").to_pylist())
    kind = answers.column("kind").to_numpy()
    made = RunTexts(SCHEME, chunk, answers.filter(pa.array(kind == 0)), n_buckets)
    flags, offset = made.flags(answers.filter(pa.array(kind == 1)))
    doc, first, row = made.uses
    cols: dict[str, list] = {c: [] for c in ("doc_id", "n_words", "n_removed", "kept_sha256", "text")}
    for a, b in chunk.parts():
        texts = [t.split() for t in chunk.texts[a:b]]
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        lo, hi = np.searchsorted(doc, [a, b])
        w = made.windows[row[lo:hi]]
        places = spread(begin[doc[lo:hi] - a] + first[lo:hi], w)
        gone = covered(places[flags[spread(offset[row[lo:hi]], w)]], int(sizes.sum()), LENGTH)
        removed = np.add.reduceat(np.r_[gone, False], begin, dtype=np.int64) * (sizes > 0)
        for d, words, at, size, n in zip(range(a, b), texts, begin.tolist(), sizes.tolist(), removed.tolist()):
            if n:
                words = [words[i] for i in np.flatnonzero(~gone[at : at + size]).tolist()]
            left = b" ".join(words)
            for c, v in zip(cols.values(), (chunk.ids[d], size, n, hashlib.sha256(left).hexdigest(), left.decode() if whole else None)):
                c.append(v)
    kinds = (pa.int64(),) * 3 + (pa.string(),) * 2
    return pa.table({c: pa.array(v, kind) for (c, v), kind in zip(cols.items(), kinds)})


def remove_known(index: FingerprintIndex, batch: int = 0, keep_text: bool = True) -> DataFrame:
    """Per document of a batch of ``index`` and of all later ones: doc_id, n_words, n_removed, kept_sha256 and, with
    ``keep_text``, the kept words as ``text``. Windows are judged against all documents of the index."""
    n_buckets, since = index.n_buckets, index.first[batch]
    packed = index.documents()
    sent = packed.groupBy("chunk").applyInArrow(trimmed(lambda g: sent_rows(SCHEME, Chunk(g.column("blob").to_pylist()), g, n_buckets)), SENT_ROWS)
    repeated = index.repeated(sent, since)
    flags = (
        packed.groupBy("chunk").cogroup(repeated.groupBy("chunk"))
        .applyInArrow(trimmed(lambda g, a: run_rows(g, a, n_buckets)), "bucket int, chunk int, blob binary")
        .groupBy("bucket").applyInArrow(trimmed(verify_rows), "chunk int, bucket int, sent binary")
    )
    answers = repeated.withColumn("kind", F.lit(0)).union(flags.select("*", F.lit(None).cast("binary").alias("hot"), F.lit(1).alias("kind")))
    if since:
        packed, answers = (x.where(F.col("chunk") >= since) for x in (packed, answers))
    out = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        trimmed(lambda g, a: cut_rows(g, a, n_buckets, keep_text)), "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"
    )
    return out if keep_text else out.drop("text")


def remove_repeats(docs: DataFrame, keep_text: bool = True, batches: int = BATCHES) -> DataFrame:
    """All documents, fed to an index in batches (by a hash of the id), then looked up in it."""
    index = FingerprintIndex(docs.sparkSession, chunk_count(text_bytes(docs)))
    for k in range(batches):
        index.append(docs.where(F.pmod(F.xxhash64("doc_id", F.lit("batch")), F.lit(batches)) == k))
    return remove_known(index, 0, keep_text)
