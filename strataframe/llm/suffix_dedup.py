"""Suffix-array removal of repeated byte strings.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller id.
Matches never cross documents, overlaps count, and strings are judged on the input.

1. Documents are grouped into chunks. Each chunk sends the hashes of its windows' anchors (see ``anchors``) to hash
   buckets, with the number of different texts around each; buckets answer which hashes two documents have, and which
   of them are *hot*: those of phrases, shorter than a window, with many different texts around them.
2. Around each repeated anchor, a chunk sends the text of the run of windows that the anchor stands for, once for each
   different text, with the smallest id that has it. Equal windows have equal anchors, so they meet in one bucket. A hot
   anchor's runs are parted into windows, each dealt by the hash of its own text, so no phrase fills a bucket.
3. A bucket builds the suffix array of its different run texts by the difference-cover algorithm: suffixes at places
   1 and 2 modulo 3 are sorted by triples of names, recursing on the names until they differ, the remaining suffixes
   are sorted by first byte and the rank behind it, and both are merged. Adjacent suffixes with a common prefix of
   ``LENGTH`` bytes form a class; each window learns whether its class has a smaller id.
4. Chunks read the answers and cut their texts.

The sort is local to groups of about ``SORT_BYTES`` of runs: sorting triples across tasks would send each candidate byte's
suffix with its names, over 16 bytes for each byte and level of recursion, while the anchors, whose hashes equal windows
share, part the suffixes just as completely. Results are the same.

A group of copies of any size sends one run text a chunk, so no key's rows meet in one task. A null text is empty; a
null id is larger than any other; rows with equal ids, repeated rows too, don't remove each other's text and each give
a row. Texts may be of any length: they are read in slices, and a text longer than a chunk makes one of its own. Other
columns, whatever their names, are ignored (``remove_repeats``) or passed through (``cut_documents``). An empty table gives
none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import anchors
from .common import Chunk, chunk_count, chunked, others, others_struct, text_bytes, trimmed
from .exchange import ANSWERS, SENT_ROWS, TWO, RunTexts, answered, covered, read_runs, sent_rows, spread

LENGTH = anchors.Bytes.length
SCHEME = anchors.Bytes()
NULL_ID = np.iinfo(np.int64).max
#: Bytes whose suffixes are sorted together; runs with equal anchors are never parted.
SORT_BYTES = 1 << 20


# --- the difference-cover suffix array ---


def ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks, from 1, of tuples of small non-negative integers."""
    packed = keys[0].astype(np.uint64)
    for k in keys[1:]:
        width = np.uint64(int(k.max(initial=0)).bit_length())
        if int(packed.max(initial=0)).bit_length() + int(width) > 64:
            packed = np.unique(packed, return_inverse=True)[1].astype(np.uint64)
        packed = (packed << width) | k.astype(np.uint64)
    order = np.argsort(packed)
    fresh = np.ones(len(packed), np.int64)
    fresh[1:] = packed[order[1:]] != packed[order[:-1]]
    out = np.empty(len(packed), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Places of all suffixes of ``s`` (integers from 1) in order."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    one = np.arange(1, n + (n % 3 == 1), 3)  # with a dummy place at n where place n - 1 would lack its partner
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    names = ranks(t[sample], t[sample + 1], t[sample + 2])
    order = suffix_array(names) if names.max() < len(names) else np.argsort(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    sorted12 = sample[order]
    sorted12 = sorted12[sorted12 < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(_pair(t[zero], rank[zero + 1]))]
    # Merge: count for each place 0 modulo 3 the sampled suffixes before it, by the two rules of comparison.
    ones, twos = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    before = np.searchsorted(_pair(t[ones], rank[ones + 1]), _pair(t[zero], rank[zero + 1]))
    if len(twos):
        heads = ranks(np.concatenate([t[twos], t[zero]]), np.concatenate([t[twos + 1], t[zero + 1]]))
        before = before + np.searchsorted(_pair(heads[: len(twos)], rank[twos + 2]), _pair(heads[len(twos) :], rank[zero + 2]))
    out = np.empty(n, np.int64)
    at = before + np.arange(len(zero))
    out[at] = zero
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = sorted12
    return out


def window_classes(runs: list[bytes], windows: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A class number for each window of each run text, in order: equal for equal strings of ``length`` bytes."""
    sizes = np.array([len(r) + 1 for r in runs], np.int64)
    begin = np.cumsum(sizes) - sizes
    joined = np.frombuffer(b"\0".join(runs) + bytes(1 + length + 8), np.uint8)
    n = int(sizes.sum())
    s = joined[:n].astype(np.int64) + 2
    s[begin[1:] - 1] = 1  # ends of runs
    s[n - 1] = 1
    which = np.full(n, -1, np.int64)
    places = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    which[places] = np.arange(len(places))
    order = suffix_array(s)
    order = order[which[order] >= 0]
    eight = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))
    same = np.ones(len(order) - 1, bool)
    for j in [*range(0, length - 7, 8), length - 8]:
        x = eight[order + j]
        same &= x[1:] == x[:-1]
    out = np.empty(len(order), np.int64)
    out[which[order]] = np.cumsum(np.r_[True, ~same])
    return out


# --- chunks and buckets ---


def _ids(chunk: Chunk) -> np.ndarray:
    return np.array([NULL_ID if i is None else i for i in chunk.ids], np.int64)


def repeated_rows(group: pa.Table, n_chunks: int) -> pa.Table:
    """Bucket -> (chunk, bucket, sent, hot): hashes that two documents have."""

    def again(value: np.ndarray, row: np.ndarray, times: np.ndarray) -> np.ndarray:
        different, where, rows = np.unique(value, return_inverse=True, return_counts=True)
        two = rows > 1
        two[where[times >= TWO]] = True
        return two[where]

    return answered(group, again, n_chunks)


def run_rows(group: pa.Table, answers: pa.Table, n_buckets: int) -> pa.Table:
    """Chunk -> (bucket, chunk, blob): its different run texts with windows, sent hash and smallest id."""
    chunk = Chunk(group.column("blob").to_pylist())
    made = RunTexts(SCHEME, chunk, answers, n_buckets)
    return made.rows(group, _ids(chunk)[made.holder])


def smaller_ids(raws: list[bytes], windows: np.ndarray, sent: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each different run text the windows, in order, whose string has a smaller id than the text's own."""
    offset = np.cumsum(windows) - windows
    out = np.zeros(int(windows.sum()), bool)
    order = np.argsort(sent, kind="stable")
    edge = np.flatnonzero(np.diff(sent[order], prepend=-1, append=-1))
    length = np.array([len(r) for r in raws], np.int64)
    group: list[int] = []
    size = 0

    def settle() -> None:
        w = windows[group]
        cls = window_classes([raws[i] for i in group], w)
        own = np.repeat(ids[group], w)
        least = np.full(int(cls.max()) + 1, NULL_ID)
        np.minimum.at(least, cls, own)
        out[spread(offset[group], w)] = least[cls] < own

    for a, b in zip(edge[:-1], edge[1:]):
        if b - a < 2:
            continue  # one text only: all its windows have its own smallest id
        group += order[a:b].tolist()
        size += int(length[order[a:b]].sum())
        if size >= SORT_BYTES:
            settle()
            group, size = [], 0
    if group:
        settle()
    return out


def flag_rows(group: pa.Table) -> pa.Table:
    """Bucket -> (chunk, bucket, bits): for each run text that a chunk sent, which windows have a smaller id."""
    number: dict[bytes, int] = {}
    windows, sent, ids, parts = [], [], [], []
    for blob in group.column("blob").to_pylist():
        texts, w, v, own = read_runs(blob)
        mine = []
        for raw, w_, v_, i in zip(texts, w.tolist(), v.tolist(), own.tolist()):
            k = number.setdefault(raw, len(ids))
            if k == len(ids):
                windows.append(w_)
                sent.append(v_)
                ids.append(i)
            elif i < ids[k]:
                ids[k] = i
            mine.append(k)
        parts.append((np.array(mine, np.int64), own))
    raws = list(number)
    w, least = np.array(windows, np.int64), np.array(ids, np.int64)
    flags = smaller_ids(raws, w, np.array(sent, np.int64), least)
    offset = np.cumsum(w) - w
    bits = []
    for mine, own in parts:
        bits.append(np.packbits(flags[spread(offset[mine], w[mine])] | np.repeat(least[mine] < own, w[mine])).tobytes())
    return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "sent": pa.array(bits, pa.binary())})


def cut_rows(group: pa.Table, answers: pa.Table, n_buckets: int, text: str | None) -> pa.Table:
    """Chunk -> its documents with what is left of them, as bytes or code points if ``text`` names one of the types
    binary and string. ``answers`` has repeated hashes (kind 0) and bits (kind 1)."""
    chunk = Chunk(group.column("blob").to_pylist())
    kind = answers.column("kind").to_numpy()
    made, ids = RunTexts(SCHEME, chunk, answers.filter(pa.array(kind == 0)), n_buckets), _ids(chunk)
    flags, offset = made.flags(answers.filter(pa.array(kind == 1)))
    doc, first, row = made.uses
    later = ids[doc] > ids[made.holder[row]]  # another document of the chunk has the same run text
    cols: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")}
    for a, b in chunk.parts():
        sizes = np.array([len(t) for t in chunk.texts[a:b]], np.int64)
        begin = np.cumsum(sizes) - sizes
        lo, hi = np.searchsorted(doc, [a, b])
        w = made.windows[row[lo:hi]]
        places = spread(begin[doc[lo:hi] - a] + first[lo:hi], w)
        flagged = flags[spread(offset[row[lo:hi]], w)] | np.repeat(later[lo:hi], w)
        gone = covered(places[flagged], int(sizes.sum()), LENGTH)
        removed = np.add.reduceat(np.r_[gone, False], begin, dtype=np.int64) * (sizes > 0)
        for d, at, size, n in zip(range(a, b), begin.tolist(), sizes.tolist(), removed.tolist()):
            left, spans = chunk.texts[d], 0
            if n:
                mine = gone[at : at + size]
                left = np.frombuffer(left, np.uint8)[~mine].tobytes()
                spans = int(mine[0]) + int(np.count_nonzero(mine[1:] > mine[:-1]))
            digest = hashlib.sha256(left).hexdigest()
            if text == "string":
                left = left.decode("utf-8", "ignore").encode()  # without parts of a code point
            for c, v in zip(cols.values(), (chunk.ids[d], size, n, spans, digest, left if text else None)):
                c.append(v)
    kinds = (pa.int64(),) * 4 + (pa.string(), pa.binary())
    out = pa.table({c: pa.array(v, kind) for (c, v), kind in zip(cols.items(), kinds)})
    if text == "string":
        out = out.set_column(5, "text", out.column("text").cast(pa.string()))
    return out if chunk.extra is None else out.append_column("extra", chunk.extra)


def remove_repeats(docs: DataFrame, keep_text: bool = True, extra: bool = False, text: str = "binary") -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_text``,
    the remaining bytes as ``text`` (binary; a cut may part a code point, whose rest is dropped if ``text`` says
    string), and with ``extra`` the other columns as one struct ``extra``, if there are any.

    Packed texts are shuffled once and read three times. One plan, so Spark reuses that exchange."""
    n_chunks = chunk_count(text_bytes(docs))
    n_buckets = n_chunks
    packed = chunked(docs, n_chunks, extra)
    repeated = (
        packed.groupBy("chunk").applyInArrow(trimmed(lambda g: sent_rows(SCHEME, Chunk(g.column("blob").to_pylist()), g, n_buckets)), SENT_ROWS)
        .groupBy("bucket").applyInArrow(trimmed(lambda g: repeated_rows(g, n_chunks)), ANSWERS)
    )
    flags = (
        packed.groupBy("chunk").cogroup(repeated.groupBy("chunk"))
        .applyInArrow(trimmed(lambda g, a: run_rows(g, a, n_buckets)), "bucket int, chunk int, blob binary")
        .groupBy("bucket").applyInArrow(trimmed(flag_rows), "chunk int, bucket int, sent binary")
    )
    answers = repeated.withColumn("kind", F.lit(0)).union(flags.select("*", F.lit(None).cast("binary").alias("hot"), F.lit(1).alias("kind")))
    kind = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").add("text", text)
    if extra and others(docs):
        kind = kind.add("extra", docs.select(others_struct(docs).alias("x")).schema["x"].dataType)
    out = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(trimmed(lambda g, a: cut_rows(g, a, n_buckets, text if keep_text else None)), kind)
    return out if keep_text else out.drop("text")


def cut_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeats cut from their texts, all columns kept; n_chars, if there is one, follows the text.
    The rest of a code point that a cut parts is dropped."""
    made = remove_repeats(docs, extra=True, text="string")
    place = {c: i for i, c in enumerate(others(docs))}
    own = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text"), "n_chars": F.length("text")}
    return made.select(*(
        (own[c].cast(docs.schema[c].dataType) if c in own else F.col(f"extra.c{place[c]}")).alias(c) for c in docs.columns
    ))
