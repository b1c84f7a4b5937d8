"""Language-model scoring with a gated recurrent network and a class-factored output softmax.

A token is a word (a run of bytes that aren't ASCII white space, A-Z lower-cased) or the end of a text. Its probability
is that of its class behind all earlier tokens of the text, times that of the token inside its class. The end is a class
of its own; the ``WORDS`` most frequent words fill ``FREQUENT`` classes in order of their counts; all other words share
``SHARED`` classes by their last two bytes and length. The network, a gated recurrent unit fitted in numpy by truncated
backpropagation through time, reads words (the shared classes for rare ones) and gives from its state both a softmax
over classes and, inside a class of frequent words, a softmax over its words. Inside a shared class, whose words are
without bound, a word has the add-one estimate from the counts of all training documents, with one cell for those never
seen. Texts are read in windows and the state is carried from window to window, so a whole text of any length gets its
complete log-likelihood.

Documents are tokenised once, in chunks. Counts cover all training documents: chunks send the different tokens they
have, with their training counts, to hash buckets, buckets add them up and answer each chunk. The most frequent words
come from these counts. Nothing that grows with the vocabulary reaches the driver.

The network is fitted on all training documents, each in its whole length: in ``ROUNDS`` rounds, each over a part of the
chunks (all of them again where there are fewer chunks than rounds), every chunk starts from the network so far and
fits it to its documents; Spark sums what the chunks changed, weighted by their tokens, as integers, so the order of
the sum doesn't matter, and the mean goes into the next round.

A null or empty text has only its end. Rows with equal ids count each; equal rows score equally. A null id trains. Only
doc_id and text are read, so other columns, whatever their names, change nothing. Without training documents all counts
are 0 and the network is as it was initialised; without documents there are no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import by_bucket, rolling
from .common import Chunk, cell, chunk_count, chunked, cut, id_hash, pack, text_bytes, trimmed, uncell, unpack
from .exchange import chunk_number

#: Classes of frequent words, words in each of them, and classes that the other words share.
FREQUENT, EACH, SHARED = 40, 24, 39
WORDS = FREQUENT * EACH
#: The end has class 0, then frequent and shared classes.
CLASSES = 1 + FREQUENT + SHARED
#: Symbols that the network reads: 0 the end, 1 to WORDS frequent words, then shared classes, last the start of a text.
START = 1 + WORDS + SHARED
HIDDEN = 16
#: Tokens between truncations in training, and in a window of scoring.
TRUNCATE = 24
WINDOW = 128
#: Rounds of fitting; texts that a chunk reads side by side, and windows that it makes of its tokens at least.
ROUNDS = 4
FIT_LANES = 384
FIT_STEPS = 100
#: Changes of weights are summed as multiples of 1 / UNIT, weighted by tokens in thousands.
UNIT = 1 << 20
#: Texts that are scored side by side.
LANES = 1024
#: Weights that are summed as one row, and tasks whose rows are summed together first.
BLOCK = 8192
FAN_IN = 64


class Tokens:
    """The tokens of some texts: lower-cased words, then the end, as numbers. Numbers are places in ``words``, in order
    of appearance; the end is number 0 and the empty string, which no word is."""

    def __init__(self, texts: list[bytes]):
        lowered = pc.ascii_lower(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        split = pc.ascii_split_whitespace(lowered)
        # White space at either end leaves empty strings; they are dropped, and one end a text is put behind its words.
        coded = pa.concat_arrays([pa.array([""], pa.large_string()), split.flatten()]).dictionary_encode()
        self.words: pa.Array = coded.dictionary
        number = coded.indices.to_numpy(zero_copy_only=False)[1:].astype(np.int64)
        real = number > 0
        text = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))[real]
        sizes = np.bincount(text, minlength=len(texts)) + 1
        self.ends = np.cumsum(sizes)
        self.numbers = np.zeros(int(sizes.sum()), np.int64)
        last = np.zeros(len(self.numbers), bool)
        last[self.ends - 1] = True
        self.numbers[~last] = number[real]

    def of_texts(self, values: np.ndarray) -> list[np.ndarray]:
        """``values``, one a token, cut into texts."""
        return np.split(values, self.ends[:-1]) if len(self.ends) else []


class TokenChunk(Tokens):
    """A chunk of documents, already tokenised: ``ids`` beside the tokens."""

    def __init__(self, group: pa.Table):
        docs, numbers, words = (group.column(c).to_pylist() for c in ("docs", "numbers", "words"))
        parts = [unpack(x) for x in docs]
        self.ids = [i for t in parts for i in t.column("doc_id").to_pylist()]
        self.ends = np.concatenate([t.column("end").to_numpy() for t in parts] or [np.zeros(0, np.int64)])
        self.numbers = np.concatenate([np.frombuffer(uncell(x)[0], np.uint32).astype(np.int64) for x in numbers] or [np.zeros(0, np.int64)])
        self.words = strings(*uncell(words[0])) if words else pa.array([""], pa.large_string())


def _buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string array, and where each string begins and ends."""
    words = pa.concat_arrays([words]) if words.offset else words
    raw = words.buffers()[2]
    offsets = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
    return np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8), offsets[:-1], offsets[1:]


def plain(words: pa.Array) -> tuple[bytes, bytes]:
    """Lengths (32 bits) and bytes of a large string array, one behind another."""
    raw, begin, end = _buffers(words)
    return (end - begin).astype(np.uint32).tobytes(), raw[begin[0] : end[-1]].tobytes() if len(begin) else b""


def strings(lengths: bytes, raw: bytes) -> pa.Array:
    n = np.frombuffer(lengths, np.uint32).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(np.r_[0, np.cumsum(n)].astype(np.int64)), pa.py_buffer(raw))


def word_hashes(words: pa.Array) -> np.ndarray:
    raw, begin, end = _buffers(words)
    return rolling(raw.astype(np.uint64) + np.uint64(1), begin, end)


class ClassMap:
    """Words to symbols: 0 for the end, one for each frequent word, shared ones by last two bytes and length."""

    def __init__(self, frequent: list[str]):
        self.frequent = frequent[:WORDS]

    def __call__(self, words: pa.Array) -> np.ndarray:
        raw, begin, end = _buffers(words)
        size = end - begin
        padded = np.r_[np.zeros(2, np.uint8), raw].astype(np.int64)
        one = np.where(size > 0, padded[end + 1], 0)
        two = np.where(size > 1, padded[end], 0)
        shape = (one | two << 8 | np.minimum(size, 12) << 16).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out = 1 + WORDS + ((shape >> np.uint64(40)) % np.uint64(SHARED)).astype(np.int64)
        place = pc.index_in(words, value_set=pa.array(["", *self.frequent], pa.large_string())).fill_null(-1).to_numpy(zero_copy_only=False)
        return np.where(place >= 0, place, out)


def class_of(symbol: np.ndarray) -> np.ndarray:
    """The class of each symbol."""
    return np.where(symbol <= WORDS, (symbol + EACH - 1) // EACH, symbol - WORDS + FREQUENT)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place. States are between -1 and 1, so only huge weights could make an output too large for ``exp``."""
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x /= x.sum(-1, keepdims=True)
    return x


def _by_class(symbols: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each class of frequent words that the symbols have: its number from 0, their places, their words in it."""
    at = np.flatnonzero((symbols >= 1) & (symbols <= WORDS))
    kind, word = np.divmod(symbols[at] - 1, EACH)
    return [(k, at[own], word[own]) for k, own in by_bucket(kind, FREQUENT)] if len(at) else []


class Network:
    """A gated recurrent unit over symbols. Weights: input table (symbols x 3 hidden), recurrent, classes, words inside
    the classes of frequent words."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.p = {
            "wx": draw(START + 1, 3 * HIDDEN), "wh": draw(HIDDEN, 3 * HIDDEN), "wo": draw(HIDDEN, CLASSES), "bo": np.zeros(CLASSES, np.float32),
            "wi": draw(FREQUENT, HIDDEN, EACH), "bi": np.zeros((FREQUENT, EACH), np.float32),
        }

    def weights(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)]).astype(np.float64)

    def set(self, weights: np.ndarray) -> None:
        begin = 0
        for k in sorted(self.p):
            w = self.p[k]
            self.p[k] = weights[begin : begin + w.size].reshape(w.shape).astype(np.float32)
            begin += w.size

    def begin_at(self, counts: np.ndarray) -> None:
        """Biases from the counts of symbols, so that the network begins as a table of frequencies. Places without a
        word have no weight."""
        total = np.bincount(class_of(np.arange(START)), counts, CLASSES)
        self.p["bo"] = np.log((total + 1) / (total + 1).sum()).astype(np.float32)
        inside = counts[1 : WORDS + 1].reshape(FREQUENT, EACH)
        self.p["bi"] = np.where(inside > 0, np.log(np.maximum(inside, 1) / np.maximum(inside.sum(1, keepdims=True), 1)), -30.0).astype(np.float32)

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The state behind inputs ``x``. The reset gate acts on the recurrent part of the candidate."""
        return self._step(x, h)[-1]

    def _step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        n = HIDDEN
        a, u = self.p["wx"][x], h @ self.p["wh"]
        zr = _sigmoid(a[:, : 2 * n] + u[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(a[:, 2 * n :] + r * u[:, 2 * n :])
        return h, z, r, c, u[:, 2 * n :], h + z * (c - h)

    def class_probs(self, h: np.ndarray) -> np.ndarray:
        return _softmax(h @ self.p["wo"] + self.p["bo"])

    def word_probs(self, h: np.ndarray, kind: int) -> np.ndarray:
        """Of the words of a class of frequent words, behind each state."""
        return _softmax(h @ self.p["wi"][kind] + self.p["bi"][kind])

    def fit(self, texts: list[np.ndarray], rate: float = 0.01, seed: int = 0) -> None:
        """Adam on truncated backpropagation over whole texts: gradients stop where a window begins, the state doesn't."""
        targets, inputs = side_by_side(texts, seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        h = np.zeros((targets.shape[1], HIDDEN), np.float32)
        for t, begin in enumerate(range(0, len(targets), TRUNCATE), 1):
            g, h = self.gradients(inputs[begin : begin + TRUNCATE], targets[begin : begin + TRUNCATE], h)
            for k, w in g.items():
                np.clip(w, -1, 1, out=w)
                m[k] += np.float32(0.1) * (w - m[k])
                w *= w
                v[k] += np.float32(0.001) * (w - v[k])
                np.multiply(v[k], np.float32(1 / (1 - 0.999**t)), out=w)
                np.sqrt(w, out=w)
                w += np.float32(1e-8)
                np.divide(m[k], w, out=w)
                w *= np.float32(rate / (1 - 0.9**t))
                self.p[k] -= w

    def gradients(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean negative log-likelihood of a window's classes and frequent words; a target of -1 is none, and
        behind the input START the state is that of a new text."""
        p, n, (steps, lanes) = self.p, HIDDEN, x.shape
        fresh = [np.flatnonzero(row == START) for row in x]
        kept = np.empty((6, steps, lanes, n), p["wh"].dtype)
        for t, (row, new) in enumerate(zip(x, fresh)):
            if len(new):
                h = h.copy()
                h[new] = 0
            for place, made in zip(kept, out := self._step(row, h)):
                place[t] = made
            h = out[-1]
        before, z, r, c, uc, after = kept
        flat, target = after.reshape(-1, n), y.ravel()
        real = target >= 0
        share = 1 / max(int(real.sum()), 1)
        d = self.class_probs(flat)
        d[np.arange(y.size), class_of(np.maximum(target, 0))] -= 1
        d *= (real * share)[:, None].astype(d.dtype)
        g = {"wo": flat.T @ d, "bo": d.sum(0), "wi": np.zeros_like(p["wi"]), "bi": np.zeros_like(p["bi"])}
        out = d @ p["wo"].T
        for k, at, word in _by_class(target):
            own = flat[at]
            q = self.word_probs(own, k)
            q[np.arange(len(at)), word] -= 1
            q *= q.dtype.type(share)
            g["wi"][k], g["bi"][k] = own.T @ q, q.sum(0)
            out[at] += q @ p["wi"][k].T
        out = out.reshape(steps, lanes, n)
        gates = np.empty((steps, lanes, 3 * n), out.dtype)
        # What is left once the gradient of the state is known, for all steps together.
        by_c, by_z, by_r = z * (1 - c * c), (c - before) * z * (1 - z), uc * r * (1 - r)
        back, dh = p["wh"].T, np.zeros_like(h)
        recurrent = np.empty_like(gates)
        for t in range(steps - 1, -1, -1):
            dh = dh + out[t]
            dc = dh * by_c[t]
            gates[t, :, :n], gates[t, :, n : 2 * n], gates[t, :, 2 * n :] = dh * by_z[t], dc * by_r[t], dc
            recurrent[t, :, : 2 * n], recurrent[t, :, 2 * n :] = gates[t, :, : 2 * n], dc * r[t]
            dh = dh * (1 - z[t]) + recurrent[t] @ back
            dh[fresh[t]] = 0
        g["wh"] = before.reshape(-1, n).T @ recurrent.reshape(-1, 3 * n)
        places = (x.reshape(-1, 1) * (3 * n) + np.arange(3 * n)).ravel()
        g["wx"] = np.bincount(places, gates.ravel(), p["wx"].size).reshape(p["wx"].shape).astype(p["wx"].dtype)
        return g, h

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural-log probability of each text's classes and frequent words. Texts run side by side, longest first;
        the state is carried from window to window."""
        out = np.zeros(len(texts))
        lengths_ = np.array([len(x) for x in texts])
        by_length = np.argsort(-lengths_, kind="stable")
        n3 = 3 * HIDDEN
        # One product a step gives the output of a state and what it adds to the next state's gates.
        both = np.concatenate([self.p["wh"], self.p["wo"]], 1)
        wx, bo = self.p["wx"], self.p["bo"]
        for a in range(0, len(texts), LANES):
            which = by_length[a : a + LANES]
            lengths = lengths_[which]
            n = len(which)
            h, before = np.zeros((n, HIDDEN), np.float32), np.full(n, START)
            total, u = np.zeros(n), np.zeros((n, n3), np.float32)
            for begin in range(0, int(lengths.max(initial=0)), WINDOW):
                live = int(np.searchsorted(-lengths, -begin))  # texts longer than begin
                y = np.full((min(WINDOW, int(lengths[0]) - begin), live), -1)
                for j in range(live):
                    part = texts[which[j]][begin : begin + WINDOW]
                    y[: len(part), j] = part
                kinds = class_of(np.maximum(y, 0))
                states = np.zeros((*y.shape, HIDDEN), np.float32)
                going = np.searchsorted(-lengths[:live], -(begin + np.arange(len(y)))).tolist()
                for t, n in enumerate(going):
                    gates = wx[before[:n]]
                    gates[:, : 2 * HIDDEN] += u[:n, : 2 * HIDDEN]
                    zr = _sigmoid(gates[:, : 2 * HIDDEN])
                    c = np.tanh(gates[:, 2 * HIDDEN :] + zr[:, HIDDEN:] * u[:n, 2 * HIDDEN :])
                    h = h[:n]
                    h = h + zr[:, :HIDDEN] * (c - h)
                    states[t, :n] = h
                    made = h @ both
                    u, logits = made[:, :n3], made[:, n3:] + bo
                    before = y[t, :n]
                    total[:n] += logits[np.arange(n), kinds[t, :n]] - np.log(np.exp(logits).sum(1))
                flat = states.reshape(-1, HIDDEN)
                for k, at, word in _by_class(y.ravel()):
                    q = flat[at] @ self.p["wi"][k] + self.p["bi"][k]
                    total[:live] += np.bincount(at % live, q[np.arange(len(at)), word] - np.log(np.exp(q).sum(1)), live)
            out[which] = total
        return out


def side_by_side(texts: list[np.ndarray], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Targets and inputs, steps x lanes: all texts in random order one behind another, cut into lanes of equal length
    (a target of -1 fills the last). A text that a cut parts goes on in the next lane, from a state of zeros."""
    rng = np.random.default_rng(seed)
    order = [texts[i] for i in rng.permutation(len(texts)) if len(texts[i])]
    if not order:
        return np.zeros((0, 1), np.int64), np.zeros((0, 1), np.int64)
    target = np.concatenate(order)
    before = np.concatenate([np.r_[START, x[:-1]] for x in order])
    lanes = min(FIT_LANES, max(1, len(target) // (TRUNCATE * FIT_STEPS)))
    fill = -len(target) % lanes
    return np.r_[target, np.full(fill, -1)].reshape(lanes, -1).T, np.r_[before, np.full(fill, START)].reshape(lanes, -1).T


def held_out():
    return F.coalesce(id_hash() % 7 == 2, F.lit(False))


class Model:
    def __init__(self, classes: ClassMap, network: Network):
        self.classes, self.network = classes, network


# --- counts: chunks to buckets and back ---


def _training(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


def token_rows(group: pa.Table) -> pa.Table:
    """Chunk -> (chunk, docs, numbers, words): its tokens."""
    chunk = Chunk(group.column("blob").to_pylist())
    tokens = Tokens(chunk.texts)
    docs = pack(pa.table({"doc_id": pa.array(chunk.ids, pa.int64()), "end": tokens.ends}))
    return pa.table({
        "chunk": pa.array([chunk_number(group)], pa.int32()), "docs": pa.array([docs], pa.binary()),
        "numbers": pa.array([cell(tokens.numbers.astype(np.uint32).tobytes())], pa.large_binary()), "words": pa.array([cell(*plain(tokens.words))], pa.large_binary()),
    }).cast(pa.schema([("chunk", pa.int32()), *((c, pa.binary()) for c in ("docs", "numbers", "words"))]))


def _routed(tokens: Tokens, n_buckets: int) -> list[tuple[int, np.ndarray]]:
    """The buckets that the different tokens go to, with their numbers."""
    bucket = (word_hashes(tokens.words) % np.uint64(n_buckets)).astype(np.int64)
    return list(by_bucket(bucket, n_buckets))


def count_rows(group: pa.Table, n_buckets: int) -> pa.Table:
    """Chunk -> (bucket, chunk, blob): its different tokens and their counts in training documents."""
    tokens = TokenChunk(group)
    weight = np.repeat([_training(i) for i in tokens.ids], np.diff(tokens.ends, prepend=0))
    counts = np.bincount(tokens.numbers, weight, len(tokens.words)).astype(np.uint32)
    rows = [(k, cell(counts[at].tobytes(), *plain(tokens.words.take(pa.array(at))))) for k, at in _routed(tokens, n_buckets)]
    return pa.table({
        "bucket": pa.array([k for k, _ in rows], pa.int32()), "chunk": pa.array([chunk_number(group)] * len(rows), pa.int32()),
        "blob": pa.array([b for _, b in rows], pa.binary()),
    })


def total_rows(group: pa.Table) -> pa.Table:
    """Bucket -> for each chunk the counts of the tokens it sent, in order; and for chunk -1 - bucket the bucket's own
    sums, tokens and different tokens by shared class, and its most frequent words."""
    parts = [uncell(blob) for blob in group.column("blob").to_pylist()]
    counts = [np.frombuffer(c, np.uint32) for c, _, _ in parts]
    coded = pa.concat_arrays([strings(n, raw) for _, n, raw in parts]).dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False)
    totals = np.bincount(number, np.concatenate(counts), len(coded.dictionary)).astype(np.int64)
    answers = [x.tobytes() for x in np.split(totals[number], np.cumsum([len(c) for c in counts])[:-1])]
    kinds = np.maximum(ClassMap([])(coded.dictionary) - WORDS, 0)
    sums = np.array([np.bincount(kinds, totals, SHARED + 1), np.bincount(kinds, totals > 0, SHARED + 1)]).astype(np.int64)
    # The end may be among them, and words with the least of these counts all are.
    least = max(np.sort(totals)[-min(WORDS + 1, len(totals))], 1)
    top = np.flatnonzero(totals >= least)
    words = sorted(zip((-totals[top]).tolist(), coded.dictionary.take(pa.array(top)).to_pylist()))[: WORDS + 1]
    top = pack(pa.table({"word": pa.array([w for _, w in words], pa.string()), "n": pa.array([-n for n, _ in words], pa.int64())}))
    bucket = group.column("bucket")
    own = bucket[0].as_py()
    return pa.table({
        "chunk": pa.array([*group.column("chunk").to_pylist(), -1 - own], pa.int32()), "bucket": pa.array([*bucket.to_pylist(), own], pa.int32()),
        "counts": pa.array([*answers, sums.tobytes()], pa.binary()), "top": pa.array([*[None] * len(answers), top], pa.binary()),
    })


class Corpus:
    """Documents in chunks of tokens, and the counts of these in training documents."""

    def __init__(self, docs: DataFrame, classes: ClassMap | None = None):
        n_buckets = self.n_chunks = chunk_count(text_bytes(docs))
        self.tokens = cut(chunked(docs, self.n_chunks).groupBy("chunk").applyInArrow(trimmed(token_rows), "chunk int, docs binary, numbers binary, words binary"))
        self.answers = cut(
            self.tokens.groupBy("chunk").applyInArrow(trimmed(lambda g: count_rows(g, n_buckets)), "bucket int, chunk int, blob binary")
            .groupBy("bucket").applyInArrow(trimmed(total_rows), "chunk int, bucket int, counts binary, top binary")
        )
        own = self.answers.where("chunk < 0")
        #: Tokens, and different tokens, of training documents: of the end and of the shared classes.
        self.sums = added(own.select("counts"), 2 * (SHARED + 1)).reshape(2, SHARED + 1)
        self.n_tokens, self.n_words = (int(x) for x in self.sums.sum(1))
        known = self._frequent(own)
        self.classes = classes or ClassMap([w for w, _ in known])
        counts = dict(known)
        #: Tokens of training documents by symbol.
        self.counts = np.zeros(START, np.int64)
        self.counts[1 : 1 + len(self.classes.frequent)] = [counts.get(w, 0) for w in self.classes.frequent]
        # Frequent words leave the classes that all words share.
        shared = ClassMap([])(pa.array(self.classes.frequent, pa.large_string())) - WORDS
        np.subtract.at(self.sums[0], shared, self.counts[1 : 1 + len(shared)])
        np.subtract.at(self.sums[1], shared, self.counts[1 : 1 + len(shared)] > 0)
        self.counts[0], self.counts[1 + WORDS :] = self.sums[0, 0], self.sums[0, 1:]

    def _frequent(self, own: DataFrame) -> list[tuple[str, int]]:
        """The most frequent words of training documents with their counts."""

        def words(batches):
            for batch in batches:
                for blob in batch.column("top").to_pylist():
                    yield from unpack(blob).to_batches()

        rows = own.select("top").mapInArrow(words, "word string, n long").where("word != '' and n > 0").orderBy(F.desc("n"), "word").limit(WORDS).collect()
        return [(r.word, r.n) for r in rows]


def added(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of arrays of 64-bit integers, one binary a row: by task, then by groups of ``FAN_IN`` tasks, then all.
    Arrays are dealt in blocks, so no task holds all of many."""

    def add(batches):
        total = np.zeros(size, np.int64)
        some = False
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
                some = True
        if some:
            parts = [total[a : a + BLOCK].tobytes() for a in range(0, size, BLOCK)]
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(parts)), pa.int32()), "n": pa.array(parts, pa.binary())})

    def together(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in group.column("n").to_pylist())
        return pa.table({"block": group.column("block").slice(0, 1), "n": pa.array([total.tobytes()], pa.binary())})

    kind = "block int, n binary"
    by_task = rows.mapInArrow(add, kind).withColumn("part", F.floor(F.spark_partition_id() / FAN_IN))
    few = by_task.groupBy("block", "part").applyInArrow(lambda g: together(g.select(["block", "n"])), kind)
    out = np.zeros(size, np.int64)
    for r in few.groupBy("block").applyInArrow(together, kind).collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.n, np.int64)
    return out


def fit_rows(group: pa.Table, model: Model, rate: float, seed: int) -> pa.Table:
    """Chunk -> what fitting to its training documents changes, times its weight; the weight and the training tokens."""
    tokens = TokenChunk(group)
    symbols = tokens.of_texts(model.classes(tokens.words)[tokens.numbers])
    mine = [x for i, x in zip(tokens.ids, symbols) if _training(i)]
    before = model.network.weights()
    network = Network()
    network.set(before)
    network.fit(mine, rate, seed)
    n = sum(map(len, mine))
    weight = -(-n // 1024)
    moved = np.rint((network.weights() - before) * UNIT).astype(np.int64) * weight
    return pa.table({"moved": pa.array([np.r_[moved, weight, n].tobytes()], pa.binary())})


def fit(corpus: Corpus) -> Model:
    """The network of all training documents of ``corpus``."""
    model = Model(corpus.classes, Network())
    model.network.begin_at(corpus.counts)
    spark = corpus.tokens.sparkSession
    parts = min(ROUNDS, corpus.n_chunks)
    for k in range(ROUNDS):
        weights, rate = model.network.weights(), 0.01 * (ROUNDS - k) / ROUNDS
        held = spark.sparkContext.broadcast(model)
        rows = corpus.tokens.where(F.pmod("chunk", F.lit(parts)) == k % parts).groupBy("chunk").applyInArrow(
            trimmed(lambda g, held=held, rate=rate, k=k: fit_rows(g, held.value, rate, k)), "moved binary"
        )
        moved = added(rows, len(weights) + 2)
        model = Model(corpus.classes, Network())
        model.network.set(weights + moved[:-2] / (UNIT * max(int(moved[-2]), 1)))
    return model


def train(docs: DataFrame) -> Model:
    """Class list and network from all training documents."""
    return fit(Corpus(docs))


def score_rows(group: pa.Table, answers: pa.Table, n_buckets: int, model: Model, cells: np.ndarray) -> pa.Table:
    """Chunk -> its documents' sums. ``cells`` are, by symbol, the denominators of the estimates inside shared classes as
    logarithms; not a number for the end and frequent words, which need none."""
    tokens = TokenChunk(group)
    told = dict(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist()))
    c = np.zeros(len(tokens.words), np.int64)
    for k, at in _routed(tokens, n_buckets):
        c[at] = np.frombuffer(told[k], np.int64)
    symbols = model.classes(tokens.words)
    likely = model.network.score(tokens.of_texts(symbols[tokens.numbers])) / math.log(10)
    begin = np.r_[0, tokens.ends[:-1]]
    sums = lambda x: np.add.reduceat(x[tokens.numbers], begin)
    counted = np.log10(c + 1.0)
    return pa.table({
        "doc_id": pa.array(tokens.ids, pa.int64()), "n_tokens": np.diff(tokens.ends, prepend=0), "n_known": sums((c > 0).astype(np.int64)),
        "count_score": sums(counted), "score": likely + sums(np.where(symbols > WORDS, counted - cells[symbols], 0.0)),
    })


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    corpus = Corpus(docs, model and model.classes)
    model = model or fit(corpus)
    n_buckets = corpus.n_chunks
    n, v = corpus.n_tokens, corpus.n_words
    cells = np.full(START, np.nan)
    cells[1 + WORDS :] = np.log10(corpus.sums[0, 1:] + corpus.sums[1, 1:] + 1.0)
    held = docs.sparkSession.sparkContext.broadcast(model)
    scored = corpus.tokens.groupBy("chunk").cogroup(corpus.answers.where("chunk >= 0").groupBy("chunk")).applyInArrow(
        trimmed(lambda g, a: score_rows(g, a, n_buckets, held.value, cells)), "doc_id long, n_tokens long, n_known long, count_score double, score double"
    )
    return scored.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("count_score") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"), "score",
    )
