"""What chunks and buckets send each other: anchor hashes one way, run texts the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from . import anchors
from .common import Chunk, cell, uncell


def chunk_number(group: pa.Table) -> int:
    return group.column("chunk")[0].as_py() if group.num_rows else 0


#: A chunk counts an anchor's different run texts up to this; the bit above says that two of its documents have it.
MOST, TWO = 127, 128
#: Different run texts, over all chunks, from which an anchor is hot, but as many as two a chunk at least.
HOT = 1024


def sent_rows(scheme: anchors.Bytes | anchors.Words, chunk: Chunk, group: pa.Table, n_buckets: int) -> pa.Table:
    """Chunk -> (bucket, chunk, sent, times): its different anchor hashes in order, and for each how many different run
    texts it has there, up to ``MOST``, plus ``TWO`` if two documents have it."""
    found = []
    for a, b in chunk.parts():
        text, first, count, value = anchors.runs(scheme, chunk.texts[a:b])
        found.append((text + a, value, anchors.part_hashes(scheme, chunk.texts[a:b], text, first, count)))
    text, value, raw = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    order = np.lexsort((raw, value))
    text, value, raw = text[order], value[order], raw[order]
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
    if len(first):
        other = np.r_[True, (raw[1:] != raw[:-1]) | (value[1:] != value[:-1])]
        times = np.minimum(np.add.reduceat(other.astype(np.int64), first), MOST)
        times += TWO * (np.minimum.reduceat(text, first) != np.maximum.reduceat(text, first))
    else:
        times = first
    bucket, low = anchors.route(value[first], n_buckets)
    rows = []
    for k, at in anchors.by_bucket(bucket, n_buckets):
        at = at[np.argsort(low[at])]
        rows.append((k, anchors.to_bytes(low[at]), times[at].astype(np.uint8).tobytes()))
    return pa.table({
        "bucket": pa.array([k for k, _, _ in rows], pa.int32()), "chunk": pa.array([chunk_number(group)] * len(rows), pa.int32()),
        "sent": pa.array([v for _, v, _ in rows], pa.binary()), "times": pa.array([t for _, _, t in rows], pa.binary()),
    })


SENT_ROWS = "bucket int, chunk int, sent binary, times binary"
ANSWERS = "chunk int, bucket int, sent binary, hot binary"


def answered(group: pa.Table, again: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], n_chunks: int) -> pa.Table:
    """Bucket -> (chunk, bucket, sent, hot): of each row's hashes those that came again, and which of them are hot.

    ``again`` tells, for all hashes in order with their rows' numbers and times, which came again."""
    arrays = [anchors.from_bytes(x) for x in group.column("sent").to_pylist()]
    sizes = np.array([len(x) for x in arrays], np.int64)
    value = np.concatenate(arrays or [np.zeros(0, np.uint64)])
    times = np.concatenate([np.frombuffer(x, np.uint8) for x in group.column("times").to_pylist()] or [np.zeros(0, np.uint8)]).astype(np.int64)
    row = np.repeat(np.arange(len(arrays)), sizes)
    different, where = np.unique(value, return_inverse=True)
    hot = np.bincount(where, times & MOST, len(different)) > max(HOT, 2 * n_chunks)
    keep = again(value, row, times)
    rows, begin = [], 0
    for number, k, n in zip(group.column("chunk").to_pylist(), group.column("bucket").to_pylist(), sizes.tolist()):
        mine = np.flatnonzero(keep[begin : begin + n]) + begin
        begin += n
        if len(mine):
            rows.append((number, k, anchors.to_bytes(value[mine]), np.packbits(hot[where[mine]]).tobytes()))
    return pa.table({
        "chunk": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([r[1] for r in rows], pa.int32()),
        "sent": pa.array([r[2] for r in rows], pa.binary()), "hot": pa.array([r[3] for r in rows], pa.binary()),
    })


def candidate_runs(scheme: anchors.Bytes | anchors.Words, chunk: Chunk, answers: pa.Table, n_buckets: int) -> Iterator[tuple]:
    """For each part of a chunk: the number of its first document, then text number in the part, first window,
    windows, bucket and sent hash of each run with a repeated anchor.

    A hot anchor's runs are parted into their windows, each dealt by a hash of its whole text, so the many texts around
    a frequent phrase don't meet in one bucket; equal windows still do."""
    known = [(anchors.from_bytes(x), k) for k, x in zip(answers.column("bucket").to_pylist(), answers.column("sent").to_pylist())]
    low = np.concatenate([x for x, _ in known] or [np.zeros(0, np.uint64)])
    high = np.repeat(np.array([k for _, k in known], np.uint64), [len(x) for x, _ in known])
    bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(v)) for x, (v, _) in zip(answers.column("hot").to_pylist(), known)]
    key = (high << np.uint64(40)) ^ low
    order = np.argsort(key)
    key, is_hot = key[order], np.concatenate(bits or [np.zeros(0, np.uint8)])[order].astype(bool)
    for a, b in chunk.parts():
        text, first, count, value = anchors.runs(scheme, chunk.texts[a:b])
        bucket, sent = anchors.route(value, n_buckets)
        mine = (bucket.astype(np.uint64) << np.uint64(40)) ^ sent
        hit = hot = np.zeros(len(mine), bool)
        if len(key):
            at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
            hit = key[at] == mine
            hot = is_hot[at[hit]]
        text, first, count, bucket, sent = (x[hit] for x in (text, first, count, bucket, sent))
        if hot.any():
            n = count[hot]
            text1, first1 = np.repeat(text[hot], n), spread(first[hot], n)
            bucket1, sent1 = anchors.route(anchors.part_hashes(scheme, chunk.texts[a:b], text1, first1, np.ones(len(text1), np.int64)), n_buckets)
            new = [np.r_[x[~hot], y] for x, y in zip((text, first, count, bucket, sent), (text1, first1, np.ones(len(text1), np.int64), bucket1, sent1))]
            order = np.lexsort((new[1], new[0]))
            text, first, count, bucket, sent = (x[order] for x in new)
        yield a, text, first, count, bucket, sent


class RunTexts:
    """The different run texts of a chunk in order of appearance, by bucket, and where they stand. Equal run texts have
    equal anchors, so either all of them are parted or none."""

    def __init__(self, scheme: anchors.Bytes | anchors.Words, chunk: Chunk, answers: pa.Table, n_buckets: int):
        number: dict[bytes, int] = {}
        rows: list[tuple[int, int, int, int]] = []  # windows, bucket, sent hash, first document
        uses: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, text, first, count, bucket, sent in candidate_runs(scheme, chunk, answers, n_buckets):
            text = text + a
            at, take, used = -1, None, []
            stop = first + count + scheme.length - 1
            for d, f, e, c, k, v in zip(*(x.tolist() for x in (text, first, stop, count, bucket, sent))):
                if d != at:
                    at, take = d, scheme.taker(chunk.texts[d])
                i = number.setdefault(take(f, e), len(rows))
                if i == len(rows):
                    rows.append((c, k, v, d))
                used.append(i)
            uses.append((text, first, np.array(used, np.int64)))
        #: Run texts in order of appearance.
        self.raws = list(number)
        self.windows, self.buckets, self.sent, self.holder = np.array(rows, np.int64).reshape(-1, 4).T
        #: Of each place of a run text: document, first window, run text.
        self.uses = [np.concatenate(x) for x in zip(*uses)] if uses else [np.zeros(0, np.int64)] * 3
        self.by_bucket = list(anchors.by_bucket(self.buckets, n_buckets)) if rows else []

    def rows(self, group: pa.Table, own: np.ndarray) -> pa.Table:
        """(bucket, chunk, blob): the run texts for each bucket, with ``own``, a 64-bit number for each of them."""
        out = []
        for k, at in self.by_bucket:
            raws = [self.raws[i] for i in at.tolist()]
            lengths = np.array([len(x) for x in raws], np.uint32)
            out.append((k, cell(self.windows[at].astype(np.uint8).tobytes(), anchors.to_bytes(self.sent[at].astype(np.uint64)), own[at].tobytes(), lengths.tobytes(), b"".join(raws))))
        return pa.table({
            "bucket": pa.array([k for k, _ in out], pa.int32()), "chunk": pa.array([chunk_number(group)] * len(out), pa.int32()),
            "blob": pa.array([b for _, b in out], pa.binary()),
        })

    def flags(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The buckets' answers, one flag a window, of all run texts in order, and where each run text's begin."""
        offset = np.cumsum(self.windows) - self.windows
        out = np.zeros(int(self.windows.sum()), bool)
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("sent").to_pylist()))
        for k, at in self.by_bucket:
            places = spread(offset[at], self.windows[at])
            out[places] = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=len(places))
        return out, offset


def read_runs(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Of the run texts of a row: bytes, windows, sent hashes and own numbers."""
    windows, sent, own, lengths, raw = uncell(blob)
    ends = np.cumsum(np.frombuffer(lengths, np.uint32), dtype=np.int64).tolist()
    raws = [raw[a:b] for a, b in zip([0, *ends], ends)]
    return raws, np.frombuffer(windows, np.uint8).astype(np.int64), anchors.from_bytes(sent).astype(np.int64), np.frombuffer(own, np.int64)


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... n[i] of them, for each i."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def covered(places: np.ndarray, size: int, length: int) -> np.ndarray:
    """Which of ``size`` tokens a window at one of the (different) places covers."""
    starts = np.zeros(size, np.int32)
    starts[places] = 1
    total = np.cumsum(starts, dtype=np.int32)
    total[length:] -= total[:-length].copy()
    return total > 0
