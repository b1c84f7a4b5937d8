"""Anchors: a content-defined sample of positions that equal windows share.

A window is ``length`` consecutive tokens (bytes or words). Its anchor is the leftmost of its k-grams with the least
hash, so equal windows have equal anchors at equal offsets, wherever they stand. Consecutive windows with the same
anchor form a run. A window can be repeated only if its anchor's hash is, so only runs whose anchor occurs again are
looked at any further, and none that matters is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_PLACE_BITS = np.uint64(24)
_PLACE = np.uint64((1 << 24) - 1)
#: Windows in a segment: small enough for the cache, and positions inside it fit the place bits.
SEGMENT = 1 << 15

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= _C
    h ^= h >> np.uint64(32)
    h *= _A
    h ^= h >> np.uint64(30)
    return h


@lru_cache(4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _power_table(n: int, base: int) -> np.ndarray:
    return _powers(1 << max(16, int(n).bit_length()), base)[:n]


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end], modulo 2**64, mixed."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power_table(len(values), _BASE), out=total[1:])
    h = (total[ends] - total[starts]) * _power_table(len(values) + 1, _INVERSE)[starts]
    return _mix(h + (ends - starts).astype(np.uint64) * _B)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of ``width`` consecutive values."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Bytes:
    """Tokens are bytes."""

    length, k = 50, 24

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Their array, and where each text's tokens begin and end in it."""
        ends = np.cumsum([len(t) for t in texts])
        return np.frombuffer(b"".join(texts) + bytes(8), np.uint8), np.r_[0, ends[:-1]].astype(np.int64), ends.astype(np.int64)

    def grams(self, tokens: np.ndarray, a: int, b: int) -> np.ndarray:
        """Hashes of the k-grams that start at a to b, without b."""
        eight = np.ndarray((len(tokens) - 7,), "<u8", tokens, strides=(1,))
        h = eight[a:b] * _A
        h ^= h >> np.uint64(29)
        h += eight[a + 8 : b + 8]
        h *= _B
        h ^= h >> np.uint64(32)
        h += eight[a + 16 : b + 16]
        return _mix(h)

    def count(self, tokens: np.ndarray) -> int:
        return len(tokens) - 8

    def taker(self, text: bytes) -> Callable[[int, int], bytes]:
        """What gives the tokens from one place to another as bytes that are equal for equal tokens."""
        return lambda a, b: text[a:b]


class Words:
    """Tokens are runs of bytes that aren't ASCII white space; a token is its hash."""

    length, k = 35, 18

    def spans(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets where words begin and end."""
        inside = ~_SPACE[np.frombuffer(text, np.uint8)]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        return edge[::2], edge[1::2]

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        joined = b"\n".join(texts)
        starts, ends = self.spans(joined)
        words = rolling(np.frombuffer(joined, np.uint8).astype(np.uint64) + np.uint64(1), starts, ends) if len(starts) else np.zeros(0, np.uint64)
        begin = np.cumsum([len(t) + 1 for t in texts]) - [len(t) + 1 for t in texts]
        first = np.searchsorted(starts, begin)
        return words, first, np.r_[first[1:], len(words)].astype(np.int64)

    def grams(self, tokens: np.ndarray, a: int, b: int) -> np.ndarray:
        at = np.arange(b - a)
        return rolling(tokens[a : b + self.k - 1], at, at + self.k)

    def count(self, tokens: np.ndarray) -> int:
        return len(tokens)

    def taker(self, text: bytes) -> Callable[[int, int], bytes]:
        words = text.split()
        return lambda a, b: b" ".join(words[a:b])


def runs(scheme: Bytes | Words, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of all texts in order: text number, first window (token number in the text), windows, anchor hash."""
    tokens, begin, end = scheme.tokens(texts)
    n, length, k = scheme.count(tokens), scheme.length, scheme.k
    found = []
    windows = n - length + 1
    if windows > 0:
        steps = np.zeros(windows + 1, np.int32)
        long = end - begin >= length
        np.add.at(steps, begin[long], 1)
        np.add.at(steps, end[long] - length + 1, -1)
        valid = np.cumsum(steps[:-1]) > 0
        for a in range(0, windows, SEGMENT):
            b = min(windows, a + SEGMENT)
            h = scheme.grams(tokens, a, b + length - k)
            place = sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - k + 1) & _PLACE
            # Between windows of two texts there are always places that start no window.
            ok = valid[a:b]
            change = np.ones(b - a + 1, bool)
            change[1:-1] = (place[1:] != place[:-1]) | (ok[1:] != ok[:-1])
            edge = np.flatnonzero(change)
            real = ok[edge[:-1]]
            first = edge[:-1][real]
            text = np.searchsorted(end, first + a, side="right")
            found.append((text, first + a - begin[text], np.diff(edge)[real], h[place[first].astype(np.int64)]))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found))


def part_hashes(scheme: Bytes | Words, texts: list[bytes], text: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hashes of the tokens of ``count`` consecutive windows, from window ``first`` of text number ``text`` on."""
    tokens, begin, _ = scheme.tokens(texts)
    start = begin[text] + first
    return rolling(tokens.astype(np.uint64) + np.uint64(1), start, start + count + scheme.length - 1) if len(text) else np.zeros(0, np.uint64)


#: Bytes of an anchor hash that are sent; its bucket tells the rest.
SENT = 5
_SENT = np.uint64((1 << (8 * SENT)) - 1)


def route(values: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Each anchor hash's bucket and the low bytes that stand for it there."""
    mixed = values * _B
    return ((mixed >> np.uint64(24)) % np.uint64(n_buckets)).astype(np.int64), mixed & _SENT


def to_bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :SENT].tobytes()


def from_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // SENT, 8), np.uint8)
    out[:, :SENT] = np.frombuffer(raw, np.uint8).reshape(-1, SENT)
    return out.view("<u8").ravel()


def by_bucket(bucket: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has any, with its places in order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=n_buckets))
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(bucket[order[a]]), order[a:b]
