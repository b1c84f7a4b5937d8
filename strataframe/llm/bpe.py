"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pieces are found without a regular expression: a table maps each code point to a class, a look-ahead of two code
points turns classes into symbols, and each symbol is a transition function of a small automaton. Functions compose
associatively, so the state before each code point comes from a blocked prefix scan over function numbers; a second
table says whether a piece starts there. Pieces go through a bounded cache of merged ids, and each token keeps its
end offset, so any part of the ids can be decoded and placed.

Null and empty texts give no ids. Any text that Spark can hold as a string, of any length, is encoded; decoding gives its
UTF-8 bytes. Each row gives a row, equal texts equal ids. Other columns stay; one that has the name of a new column is kept
as ``original_<name>``. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import SLICE_BYTES, quoted, release, set_aside, slices, small_batches

#: Pieces held by a worker's cache, some 40 MB, before it starts anew. It stays from task to task.
CACHE_PIECES = 200_000
BLOCK = 64

# Code point classes.
OTHER, LETTER, NUMBER, SPACE, WHITE = range(5)
# Symbols: letter, number, other, a space that opens the next piece, white space in a run, the last white space of a
# run before something else, an apostrophe with a one-letter or a two-letter contraction behind it.
S_L, S_N, S_O, S_J, S_W, S_Z, S_A1, S_A2 = range(8)
# States: piece must start, in letters, in numbers, in others, behind an opening space, in white space, one or two
# letters of a contraction still to come.
X, IN_L, IN_N, IN_O, IN_J, IN_W, C1, C2 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts at the symbol."""
    if symbol == S_L:
        if state in (IN_L, IN_J):
            return IN_L, False
        if state in (C1, C2):
            return (X, C1)[state - C1], False
        return IN_L, True
    if symbol == S_N:
        return IN_N, state not in (IN_N, IN_J)
    if symbol in (S_O, S_A1, S_A2):
        joined = state in (IN_O, IN_J)
        return (IN_O if joined or symbol == S_O else C1 if symbol == S_A1 else C2), not joined
    if symbol == S_J:
        return IN_J, True
    if symbol == S_W:
        return IN_W, state != IN_W
    return X, True


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function numbers of the 16 symbols (8, and 8 that start a document), the table of compositions (first, then),
    the functions themselves and the table of piece starts. The functions are closed under composition."""
    plain = [tuple(_step(s, y)[0] for s in range(8)) for y in range(8)]
    first = [(_step(X, y)[0],) * 8 for y in range(8)]
    numbers: dict[tuple[int, ...], int] = {}
    for f in [tuple(range(8)), *plain, *first]:
        numbers.setdefault(f, len(numbers))
    todo = list(numbers)
    generators = [*plain, *first]
    while todo:
        f = todo.pop()
        for g in generators:
            h = tuple(g[s] for s in f)
            if h not in numbers:
                numbers[h] = len(numbers)
                todo.append(h)
    funcs = list(numbers)
    assert len(funcs) <= 256
    compose = np.array([[numbers[tuple(g[s] for s in f)] for g in funcs] for f in funcs], np.uint8)
    symbols = np.array([numbers[f] for f in generators], np.uint8)
    starts = np.array([[_step(s, y)[1] for y in range(8)] for s in range(8)])
    return symbols, compose, np.array(funcs, np.uint8), starts


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, as the encoding library's own Unicode tables have it."""
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        one = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(one.encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    out[ord(" ")] = SPACE
    return out


def scan(functions: np.ndarray) -> np.ndarray:
    """The state before each place: the prefix scan of transition functions, applied to the start state."""
    _, compose, funcs, _ = automaton()
    n = len(functions)
    if n <= BLOCK:
        out, state = np.empty(n, np.uint8), X
        for i, f in enumerate(functions.tolist()):
            out[i] = state
            state = int(funcs[f, state])
        return out
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint8)  # number 0 is the identity
    padded[:n] = functions
    lanes = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    flat = compose.ravel()
    width = compose.shape[1]
    before = np.zeros_like(lanes)
    for j in range(1, BLOCK):
        before[j] = flat[before[j - 1].astype(np.intp) * width + lanes[j - 1]]
    whole = flat[before[-1].astype(np.intp) * width + lanes[-1]]
    entry = scan(whole)
    return np.ascontiguousarray(funcs[before, entry[None, :]].T).ravel()[:n]


def piece_starts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined, where pieces start in them, and where each text starts."""
    joined = "".join(texts)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=begins[1:])
    n = len(joined)
    if not n:
        return joined, np.zeros(0, np.int64), begins
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = classes()[points]
    opens = np.zeros(n + 1, bool)
    opens[begins] = True
    # Behind the last code point of a text there is nothing: neither a letter nor anything else that isn't white.
    after = np.empty(n, np.uint8)
    after[:-1] = kind[1:]
    after[opens[1:]] = WHITE
    point1 = np.zeros(n, np.uint32)
    point1[:-1] = points[1:]
    point1[opens[1:]] = 0
    white = kind >= SPACE
    ends_run = white & (after < SPACE)
    symbol = np.array([S_O, S_L, S_N, S_W, S_W], np.uint8)[kind]
    symbol[ends_run] = S_Z
    symbol[ends_run & (kind == SPACE)] = S_J
    quote = np.flatnonzero(points == ord("'"))
    if len(quote):
        one = point1[quote]
        two = point1[np.minimum(quote + 1, n - 1)] * (one > 0)
        r, v, e, ell = map(ord, "rvel")
        long = ((one == r) | (one == v)) & (two == e) | (one == ell) & (two == ell)
        short = np.isin(one, np.array([ord(c) for c in "stmd"], np.uint32))
        symbol[quote[long]] = S_A2
        symbol[quote[short]] = S_A1
    symbols, _, _, starts = automaton()
    first = opens[:-1]
    state = scan(symbols[symbol + 8 * first])
    return joined, np.flatnonzero(starts[state, symbol] | first), begins


class Vocabulary(dict):
    """Pieces to their merged ids, packed as little-endian 32-bit integers; filled on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())})

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        i = self.ranks.get(raw)
        ids = [i] if i is not None else self.merge(raw)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(raw) <= 256:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = packed
        return packed

    def merge(self, raw: bytes) -> list[int]:
        """Merge the pair of least rank, leftmost first, until none is left. A heap keeps long pieces fast."""
        n, ranks = len(raw), self.ranks
        end = list(range(1, n + 1))  # where the part that starts here ends; 0: no part starts here
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(raw[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.read(path)


def encode_texts(texts: list[str], vocab: Vocabulary) -> list[bytes]:
    """The packed ids of each text."""
    joined, starts, begins = piece_starts(texts)
    edges = np.searchsorted(starts, begins).tolist()
    cuts = [*starts.tolist(), len(joined)]
    merged = list(map(vocab.__getitem__, [joined[a:b] for a, b in zip(cuts, cuts[1:])]))
    return [b"".join(merged[a:b]) for a, b in zip(edges, edges[1:])]


def token_ends(ids: bytes, vocab: Vocabulary) -> np.ndarray:
    lengths = np.array([len(b) for b in vocab.bytes], np.int64)
    return np.cumsum(lengths[np.frombuffer(ids, "<u4")])


def decode_span(ids: bytes, first: int, last: int, vocab: Vocabulary) -> bytes:
    """The bytes of tokens ``first`` to ``last``, without ``last``."""
    return b"".join(map(vocab.bytes.__getitem__, np.frombuffer(ids, "<u4")[first:last].tolist()))


def encode(df: DataFrame, path: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """Replace ``text`` by ``ids`` (binary: little-endian unsigned 32-bit ids) and ``token_ends`` (binary:
    little-endian signed 64-bit byte offsets where each token ends; left out without ``offsets``). Other columns stay,
    and so does each row. No shuffle."""
    new = StructType.fromDDL("ids binary, token_ends binary" if offsets else "ids binary")
    df = set_aside(small_batches(df), [n for n in new.names if n != text])
    kept = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                ids = encode_texts(["" if t is None else t for t in part.column(text).to_pylist()], vocab)
                made = [pa.array(ids, pa.binary())]
                if offsets:
                    made.append(pa.array([token_ends(x, vocab).astype("<i8").tobytes() for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), *made], names=[*kept, *new.names]
                )
        release()

    return df.select(*(F.col(quoted(c)) for c in [*kept, text])).mapInArrow(run, StructType([f for f in df.schema.fields if f.name != text] + new.fields))


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary): the bytes that the packed ids stand for. Null ids give no bytes. No shuffle."""
    df = set_aside(df, ["decoded"])
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary(path).bytes.__getitem__
        for batch in batches:
            for part in slices(batch, ids, 2 * SLICE_BYTES):
                texts = [b"".join(map(get, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.binary())], names=[*kept, "decoded"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("decoded", BinaryType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document: encoded, then decoded from the ids."""
    coded = decode(encode(docs.select("doc_id", "text"), path, offsets=False), path)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
