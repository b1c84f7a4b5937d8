"""Quality rules with n-gram perplexity: a model for each script and a band for each language.

A text's script is the one most of its letters have; scripts are ranges of code points, so their number is fixed. Each
script has its own alphabet: all code points of its texts, each a symbol of its own, found by Spark. Each script's model is
a character model of order 4 over whole texts: contexts run across the spaces between words. N-grams are counted by Spark
over all documents, as codes of 6 to 16 bits a symbol. A code point beyond the ``SINGLES`` most frequent ones of a script is
spelled by two symbols, so no two code points share one.

Scripts are measured. Those of up to ``MODEL_CODES`` codes are dealt into blocks of ``BLOCK_CODES``; one block's counts at a
time reach the driver, are made models (8 or 12 bytes a code), broadcast, and score the documents of the block's scripts.
The model of a larger script stays in Spark: probabilities are made by joins and joined to the n-grams of the texts; only
its most frequent codes, ``HOT_CODES`` at most, are broadcast and scored in place, so no code's rows are many.
Probabilities are interpolated modified Kneser-Ney (three discounts an order, continuation counts below the highest
order) and are kept in hash arrays, sorted by hash, one for each order. A document's log-perplexity is a mean over the
symbols of its words and the ends of these. Each language has a lower and an upper band around its median; a document
outside is rejected, and so is one that fails the base rules.

The languages of a script share its model, since a good text may have a passage in another language, or the label of one.

A null or empty text has no words and fails the base rules. A null language is a language of its own, and so is an empty
one. Rows with equal ids are judged each by itself; texts of any length are read whole. Only doc_id, text and lang are
read, so other columns, whatever their names, change nothing. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER, byte_texts, checkpoint_dir, cut, slices, small_batches

ORDER = 4
#: Bits of a symbol, at least and at most.
LEAST_BITS = 6
MOST_BITS = 16
#: First and second symbols of the code points that are spelled by two: enough for all of Unicode.
SPELL = 1025
#: Code points with one symbol; 0 is a space, the last one stands for what was never counted.
SINGLES = (1 << MOST_BITS) - 2 - 2 * SPELL
#: Codes that a worker counts before it hands them on, and symbols that it looks at in one go.
TABLE_CODES = 2_000_000
STEP = 1 << 20
#: Codes of the scripts whose models are broadcast together, and the most of a script whose model is broadcast at all.
BLOCK_CODES = 1 << 21
MODEL_CODES = 1 << 21
#: Codes of larger scripts that are broadcast, the most frequent ones.
HOT_CODES = 1 << 20
#: Units of a log-probability of a larger script: sums of integers don't depend on their order.
UNITS = 1 << 30
#: Half-width of a language's band, in spreads (median to quartile on that side, at least LEAST_SPREAD): wider for
#: shorter texts, whose means vary more.
BAND_SPREADS = 4.0
BAND_SHORT = 30.0
LEAST_SPREAD = 0.01

#: Languages up to which the bands, one short row each, are broadcast.
BROADCAST_BANDS = 10_000

BASE_WORDS = 50
BASE_REPEATS = 50


#: A-Z to a-z, digits to 0, the signs that the rules count as symbols to one of them; other bytes unchanged.
FOLD = LOWER.translate(bytes.maketrans(b"123456789#$%&|<>", b"000000000*******"))
SPACES = b" \t\n\x0b\x0c\r"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _scripts() -> np.ndarray:
    """Code point to script; 0 is no letter of any."""
    out = (2 + (np.arange(0x110000) >> 8)).astype(np.uint16)
    out[:0x250] = 1  # Latin
    out[0x400:0x530] = 2 + 0x04  # Cyrillic
    out[0x600:0x780] = 2 + 0x06  # Arabic
    out[0xAC00:0xD7B0] = 2 + 0xAC  # Hangul
    for a, b in ((0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)):
        out[a:b] = 2 + 0x4E  # Chinese and Japanese
    out[:0x41] = out[0x5B:0x61] = out[0x7B:0xC0] = out[0x2000:0x3040] = out[0xFE00:0xFE70] = out[0xFF00:0xFF66] = 0  # controls, digits, signs
    return out


SCRIPT = _scripts()
LATIN = 1


def script(text: bytes) -> int:
    """The script of most letters of a text, the first of equals; Latin without letters."""
    if text.isascii():
        return LATIN
    points = code_points(text.decode("utf-8", "replace"))
    counts = np.zeros(int(SCRIPT.max()) + 1, np.int64)
    for a in range(0, len(points), STEP):
        counts += np.bincount(SCRIPT[points[a : a + STEP]], minlength=len(counts))
    counts[0] = 0
    return int(counts.argmax()) or LATIN


def by_script(texts: list[bytes]) -> dict[int, list[int]]:
    """Numbers of the texts, by script."""
    out: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        out.setdefault(script(t), []).append(i)
    return out


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys with their summed counts."""
    flat, where = np.unique(np.concatenate(keys), return_inverse=True)
    return flat, np.bincount(where, np.concatenate(counts), len(flat)).astype(np.int64)


class Tally:
    """Counts of keys by script, merged as they come and handed on as rows once there are many."""

    def __init__(self) -> None:
        self.held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        self.size = 0

    def add(self, key: int, keys: np.ndarray) -> None:
        if not len(keys):
            return
        found = np.unique(keys, return_counts=True)
        held = self.held.setdefault(key, ([], []))
        for a, x in zip(held, found):
            a.append(x)
        self.size += len(found[0])

    def rows(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.size > TABLE_CODES or last:
            self.held = {key: tuple([x] for x in merged(*held)) for key, held in self.held.items()}
            self.size = sum(len(keys[0]) for keys, _ in self.held.values())
            if self.size > TABLE_CODES // 2 or last:
                for key, ((keys,), (n,)) in self.held.items():
                    columns = [pa.array(np.full(len(keys), key, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, names=["script", "code", "n"])
                self.held, self.size = {}, 0


TALLY = "script int, code long, n long"


def alphabets(docs: DataFrame) -> dict[int, np.ndarray]:
    """All code points of each script's texts: the ``SINGLES`` most frequent, sorted (ties go to the smaller ones), then
    the others, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = byte_texts(part.column("text"))
                for key, at in by_script(texts).items():
                    points = code_points(b"".join(texts[i].translate(FOLD, SPACES) for i in at).decode("utf-8", "replace"))
                    for a in range(0, len(points), STEP):
                        tally.add(key, points[a : a + STEP])
                    yield from tally.rows()
        yield from tally.rows(last=True)

    counts = small_batches(docs).select("text").mapInArrow(run, TALLY).groupBy("script", "code").agg(F.sum("n").alias("n"))
    rows = counts.toArrow()
    which, points, n = (rows.column(c).to_numpy() for c in ("script", "code", "n"))
    out = {}
    for key in np.unique(which).tolist():
        own = points[which == key]
        own = own[np.lexsort((own, -n[which == key]))]
        out[key] = np.concatenate([np.sort(own[:SINGLES]), np.sort(own[SINGLES:])])
    return out


def folded(texts: Iterable[bytes]) -> list[list[bytes]]:
    return [t.translate(FOLD).split() for t in texts]


class Symbols(NamedTuple):
    """Code point to symbol, bits of a symbol, and code point to second symbol (0: none) if there are such."""

    first: np.ndarray
    bits: int
    second: np.ndarray | None


def symbol_bits(alphabet: np.ndarray) -> int:
    n = 2 + (len(alphabet) if len(alphabet) <= SINGLES else SINGLES + 2 * SPELL)
    return max(LEAST_BITS, (n - 1).bit_length())


def symbol_table(alphabet: np.ndarray) -> Symbols:
    """0 the space, then the alphabet; the last symbol is for code points that aren't in it."""
    bits = symbol_bits(alphabet)
    out = np.full(0x110000, (1 << bits) - 1, np.uint8 if bits <= 8 else np.uint16)
    single, rest = alphabet[:SINGLES], alphabet[SINGLES:]
    out[single] = 1 + np.arange(len(single))
    out[32] = 0
    if not len(rest):
        return Symbols(out, bits, None)
    lead, trail = np.divmod(np.arange(len(rest)), SPELL)
    out[rest] = 1 + SINGLES + lead
    second = np.zeros(0x110000, np.uint16)
    second[rest] = 1 + SINGLES + SPELL + trail
    return Symbols(out, bits, second)


def text_codes(texts: list[list[bytes]], symbols: Symbols) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of the n-grams that predict each symbol of the texts' words and their ends, in steps, with the number of
    the text of each; ``texts`` are words folded by ``FOLD``, and each text begins behind spaces."""
    start = " " * (ORDER - 1)
    whole = [start + b" ".join(words).decode("utf-8", "replace") + " " if words else "" for words in texts]
    lengths = np.fromiter(map(len, whole), np.int64, len(whole))
    number = np.repeat(np.arange(len(whole), dtype=np.int32), lengths)
    own = np.ones(len(number), bool)
    begin = (np.cumsum(lengths) - lengths)[lengths > 0]
    for i in range(ORDER - 1):
        own[begin + i] = False
    points = code_points("".join(whole))
    flat = symbols.first[points]
    if symbols.second is not None:
        flat = np.stack([flat, symbols.second[points]], 1).ravel()
        there = flat > 0
        there[::2] = True
        flat, number, own = flat[there], np.repeat(number, 2)[there], np.repeat(own, 2)[there]
    kind = np.uint32 if symbols.bits * ORDER <= 32 else np.uint64
    for a in range(ORDER - 1, len(flat), STEP):
        b = min(a + STEP, len(flat))
        code = np.zeros(b - a, kind)
        for back in range(ORDER):
            code |= flat[a - back : b - back].astype(kind) << kind(symbols.bits * back)
        yield code[own[a:b]], number[a:b][own[a:b]]


def count_ngrams(docs: DataFrame, letters: dict[int, np.ndarray]) -> DataFrame:
    """(script, code, n): how often each n-gram stands in the documents of a script. Combined in the tasks, then by Spark."""
    held = docs.sparkSession.sparkContext.broadcast(letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = byte_texts(part.column("text"))
                for key, at in by_script(texts).items():
                    if key in held.value:
                        for codes, _ in text_codes(folded(texts[i] for i in at), symbol_table(held.value[key])):
                            tally.add(key, codes)
                    yield from tally.rows()
        yield from tally.rows(last=True)

    return small_batches(docs).select("text").mapInArrow(run, TALLY).groupBy("script", "code").agg(F.sum("n").alias("n"))


class KneserNey:
    """Interpolated modified Kneser-Ney over packed codes, in hash arrays sorted by hash."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, bits: int):
        """``codes`` of the highest order with their counts; both may be empty."""
        self.bits = bits
        codes = codes.astype(np.uint64)
        order = np.argsort(codes)
        grams, n = codes[order], counts[order].astype(np.float64)
        levels = {ORDER: (grams, n)}
        for k in range(ORDER - 1, 0, -1):  # continuation counts: different symbols before the shorter n-gram
            grams, n = np.unique(levels[k + 1][0] & self.mask(k), return_counts=True)
            levels[k] = grams, n.astype(np.float64)
        self.floor = 1.0 / (1 << bits)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.contexts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lower: tuple[np.ndarray, np.ndarray] | None = None
        for k in range(1, ORDER + 1):
            grams, n = levels[k]
            context, where = np.unique(grams >> np.uint64(bits), return_inverse=True)
            total = np.bincount(where, n, len(context))
            d = self.discounts(*(float((n == i).sum()) for i in range(1, 5)))
            level = np.minimum(n, 3).astype(int)
            left = np.bincount(where, d[level], len(context)) / np.maximum(total, 1e-300)
            base = np.full(len(grams), self.floor) if lower is None else lower[1][np.searchsorted(lower[0], grams & self.mask(k - 1))]
            p = np.maximum(n - d[level], 0) / np.maximum(total[where], 1e-300) + left[where] * base
            lower = grams, p
            h = self.hash(grams)
            at = np.argsort(h)
            self.tables[k] = h[at], np.log(p[at]).astype(np.float32)
            h = self.hash(context)
            at = np.argsort(h)
            self.contexts[k] = h[at], np.log(np.maximum(left[at], 1e-300)).astype(np.float32)

    def mask(self, k: int) -> np.uint64:
        return np.uint64((1 << (self.bits * k)) - 1)

    @staticmethod
    def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
        """D for counts 0 to 3 and more, from the counts of counts."""
        if not n1 or not n2:
            return np.array([0.0, 0.5, 0.5, 0.5])
        y = n1 / (n1 + 2 * n2)
        d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / max(n3, 1.0)]
        return np.clip(np.array(d), [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])

    def hash(self, codes: np.ndarray) -> np.ndarray:
        """An odd multiplier modulo 2**32 or 2**64: different codes of so many bits keep different hashes."""
        if self.bits * ORDER <= 32:
            return codes.astype(np.uint32) * np.uint32(0x9E3779B1)
        return codes * np.uint64(0x9E3779B97F4A7C15)

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        """Natural-log probability of each code's last symbol behind the others; unseen n-grams back off."""
        codes = codes.astype(np.uint64)
        out = np.zeros(len(codes))
        todo = np.arange(len(codes))
        for k in range(ORDER, 0, -1):
            known, values = self.tables[k]
            if not len(known):
                continue
            part = codes[todo] & self.mask(k)
            h = self.hash(part)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            seen = known[at] == h
            out[todo[seen]] += values[at[seen]]
            todo, part = todo[~seen], part[~seen]
            known, values = self.contexts[k]
            h = self.hash(part >> np.uint64(self.bits))
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            out[todo] += np.where(known[at] == h, values[at], 0.0)
        out[todo] += np.log(self.floor)
        return out

    def score_texts(self, texts: list[list[bytes]], symbols: Symbols) -> list[float | None]:
        """Mean negative log-probability of each text's symbols; none without words."""
        total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for codes, number in text_codes(texts, symbols):
            known, where = np.unique(codes, return_inverse=True)
            total += np.bincount(number, self.log_p(known)[where], len(texts))
            n += np.bincount(number, minlength=len(texts))
        return [round(-x / k, 9) if k else None for x, k in zip(total.tolist(), n.tolist())]


class Models:
    """The scripts' alphabets and counts, the blocks of scripts whose models go out together, and the scripts whose
    models are joined."""

    def __init__(self, docs: DataFrame):
        self.docs = docs
        self.letters = alphabets(docs)
        self.counts = stored(count_ngrams(docs, self.letters))
        self.blocks: list[list[int]] = []
        self.joined: list[int] = []
        room = 0
        for r in self.counts.groupBy("script").count().orderBy(F.desc("count"), "script").collect():
            if r["count"] > MODEL_CODES:
                self.joined.append(r["script"])
                continue
            if r["count"] > room:
                self.blocks.append([])
                room = BLOCK_CODES
            self.blocks[-1].append(r["script"])
            room -= r["count"]

    def load(self, scripts: list[int]) -> dict[int, tuple[np.ndarray, KneserNey]]:
        """Alphabet and model of each script: counts of one block reach the driver."""
        rows = self.counts.where(F.col("script").isin(scripts)).toArrow()
        which, codes, n = (rows.column(c).to_numpy() for c in ("script", "code", "n"))
        return {key: (self.letters[key], KneserNey(codes[which == key], n[which == key], symbol_bits(self.letters[key]))) for key in scripts}

    @cached_property
    def levels(self) -> dict[int, DataFrame]:
        """(script, bits, code, n) of the joined scripts by order: counts of the highest, continuation counts below."""
        bits = F.coalesce(*(F.when(F.col("script") == key, symbol_bits(self.letters[key])) for key in self.joined))
        out = {ORDER: self.counts.where(F.col("script").isin(self.joined)).select("script", bits.alias("bits"), "code", "n")}
        for k in range(ORDER - 1, 0, -1):
            out[k] = stored(out[k + 1].groupBy("script", "bits", low(k).alias("code")).agg(F.count("*").alias("n")))
        return out

    @cached_property
    def discounted(self) -> dict[int, DataFrame]:
        """``levels`` with each n-gram's context, d, and the context's total and left."""
        out = {}
        for k, level in self.levels.items():
            few = level.groupBy("script").agg(*(F.sum((F.col("n") == i).cast("double")) for i in range(1, 5))).collect()
            d = {r[0]: KneserNey.discounts(*r[1:]).tolist() for r in few}
            by_script = F.coalesce(*(F.when(F.col("script") == key, F.array(*map(F.lit, d[key]))) for key in self.joined))
            own = Window.partitionBy("script", "context")
            out[k] = (
                level.withColumn("context", F.expr("shiftrightunsigned(code, bits)"))
                .withColumn("d", by_script[F.least("n", F.lit(3)).cast("int")])
                .withColumn("total", F.sum("n").over(own))
                .withColumn("left", F.sum("d").over(own) / F.col("total"))
            )
        return out

    @cached_property
    def probabilities(self) -> dict[int, DataFrame]:
        """(script, code, n, p, x) of the joined scripts by order: probability, below the highest order, and log-probability
        in ``UNITS``."""
        out: dict[int, DataFrame] = {}
        for k in range(1, ORDER + 1):
            level = self.discounted[k]
            if k == 1:
                level = level.withColumn("base", F.expr("1D / shiftleft(1L, bits)"))
            else:
                lower = out[k - 1].select("script", F.col("code").alias("lower"), F.col("p").alias("base"))
                level = level.withColumn("lower", low(k - 1)).join(lower, ["script", "lower"])
            p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("left") * F.col("base")
            made = level.select("script", "code", "n", p.alias("p")).withColumn("x", units(F.log("p")))
            out[k] = stored(made if k < ORDER else made.drop("p"))
        return out

    def unseen(self, codes: DataFrame) -> DataFrame:
        """(script, code, x) of those n-grams of (script, code) that weren't counted: they back off."""
        bits = F.coalesce(*(F.when(F.col("script") == key, symbol_bits(self.letters[key])) for key in self.joined))
        todo = codes.select("script", "code").distinct().join(self.probabilities[ORDER], ["script", "code"], "left_anti")
        todo = todo.select("script", bits.alias("bits"), "code", F.lit(0).cast("long").alias("x"), F.lit(False).alias("done"))
        for k in range(ORDER, 0, -1):
            known = self.probabilities[k].select("script", F.col("code").alias("own"), F.col("x").alias("found"))
            contexts = self.discounted[k].groupBy("script", "context").agg(F.first("left").alias("left"))
            contexts = contexts.select("script", "context", units(F.log(F.greatest("left", F.lit(1e-300)))).alias("back"))
            todo = todo.withColumn("own", low(k)).withColumn("context", F.expr("shiftrightunsigned(own, bits)"))
            todo = todo.join(known, ["script", "own"], "left").join(contexts, ["script", "context"], "left")
            step = F.when(F.col("done"), F.lit(0)).otherwise(F.coalesce("found", "back", F.lit(0)))
            todo = todo.select("script", "bits", "code", (F.col("x") + step).alias("x"), (F.col("done") | F.col("found").isNotNull()).alias("done"))
        floor = units(-F.col("bits") * F.lit(math.log(2)))
        return todo.select("script", "code", (F.col("x") + F.when(F.col("done"), F.lit(0)).otherwise(floor)).alias("x"))

    def hot(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Sorted codes of the joined scripts and their x: those from a power of two of places on, ``HOT_CODES`` at most."""
        known = self.probabilities[ORDER]
        power = F.length(F.bin("n"))
        least, room = 64, HOT_CODES
        for r in known.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect():
            room -= r["count"]
            if room < 0:
                break
            least = r["power"]
        rows = known.where(power >= least).select("script", "code", "x").toArrow()
        which, codes, x = (rows.column(c).to_numpy() for c in ("script", "code", "x"))
        out = {}
        for key in self.joined:
            own = codes[which == key].astype(np.uint64)
            order = np.argsort(own)
            out[key] = own[order], x[which == key][order]
        return out


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as Parquet, in which tables of n-grams are smaller."""
    path = f"{checkpoint_dir(df.sparkSession)}/ngrams-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def low(k: int) -> Column:
    """The last ``k`` symbols of a code."""
    return F.expr("code" if k == ORDER else f"code & (shiftleft(1L, bits * {k}) - 1L)")


def units(log_p: Column) -> Column:
    return F.round(log_p.cast("float").cast("double") * UNITS).cast("long")


def train(docs: DataFrame) -> Models:
    """The models of all documents, by script."""
    return Models(docs)


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows found twice or more, the first place included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit = np.zeros(len(words) + 2, bool)
    at = np.flatnonzero(np.fromiter((counts[w] > 1 for w in windows), bool, len(windows)))
    for j in range(3):
        hit[at + j] = True
    return int(hit.sum())


def rule_counts(text: bytes) -> tuple[list[bytes], int, int, int, int]:
    """Words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    words = text.split()
    chars = len(b"".join(words).translate(None, bytes(range(128, 192))))  # without continuation bytes
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return words, chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def score(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_perplexity. No shuffle. With more
    than one block of scripts, each block's rows are written before the next one's models are made."""
    joined = set(models.joined)
    if len(models.blocks) < 2:
        parts = [score_block(docs, models.load(models.blocks[0]) if models.blocks else {}, joined)]
    else:
        parts = []
        for k, block in enumerate(models.blocks):
            others = joined | {x for b in models.blocks for x in b if b is not block}
            # the first block has the texts without a model as well
            parts.append(cut(score_block(docs, models.load(block), others if k == 0 else others | {None})))
    if joined:
        parts.append(score_joined(docs, models))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


RULES = "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def score_block(docs: DataFrame, models: dict[int, tuple[np.ndarray, KneserNey]], others: set[int | None]) -> DataFrame:
    """The rows whose script isn't among ``others``; ``None`` there stands for the scripts without a model."""
    held = docs.sparkSession.sparkContext.broadcast(models)

    def means(key: int, texts: list[bytes]) -> list[pa.Array] | None:
        if key in others or None in others and key not in held.value:
            return None
        mean: list[float | None] = [None] * len(texts)
        if key in held.value:
            alphabet, model = held.value[key]
            mean = model.score_texts(folded(texts), symbol_table(alphabet))
        return [pa.array(mean, pa.float64())]

    return rule_rows(docs, means, "log_perplexity double")


def rule_rows(docs: DataFrame, more: Callable[[int, list[bytes]], list[pa.Array] | None], added: str) -> DataFrame:
    """doc_id, the columns of ``RULES`` and those that ``more`` makes of a script and its texts in a slice; rows of scripts
    for which that is ``None`` are left out."""
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(f"{RULES}, {added}")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = byte_texts(part.column("text"))
                for key, at in by_script(texts).items():
                    picked = [texts[i] for i in at]
                    made = more(key, picked)
                    if made is None:
                        continue
                    numbers = [[len(words), *n] for words, *n in map(rule_counts, picked)]
                    own = part.select([0, 1]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [own.column(0), own.column(1), *(pa.array([n[i] for n in numbers], pa.int64()) for i in range(5)), *made],
                        names=schema.names,
                    )

    rows = small_batches(docs).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(run, schema)


def places(texts: list[list[bytes]], symbols: Symbols) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Number of the text, code and how often it stands there, in steps."""
    for codes, number in text_codes(texts, symbols):
        if len(codes):
            known, where = np.unique(codes.astype(np.uint64), return_inverse=True)
            pairs, n = np.unique(number.astype(np.int64) * len(known) + where, return_counts=True)
            yield pairs // len(known), known[pairs % len(known)], n


def find(known: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each code is among the sorted known ones, and where."""
    if not len(known):
        return np.zeros(len(codes), bool), np.zeros(len(codes), np.int64)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return known[at] == codes, at


def digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def score_joined(docs: DataFrame, models: Models) -> DataFrame:
    """The rows of the scripts whose models are joined. A text is known by its digest; rows with equal texts all send
    their n-grams, so a text's sum is divided by their number."""
    hot = docs.sparkSession.sparkContext.broadcast({key: (models.letters[key], *x) for key, x in models.hot().items()})

    def known(key: int, texts: list[bytes]) -> list[pa.Array] | None:
        if key not in hot.value:
            return None
        alphabet, codes, values = hot.value[key]
        x, n, rest = np.zeros((3, len(texts)), np.int64)
        for number, code, count in places(folded(texts), symbol_table(alphabet)):
            there, at = find(codes, code)
            np.add.at(x, number[there], values[at[there]] * count[there])
            np.add.at(n, number, count)
            np.add.at(rest, number[~there], count[~there])
        return [pa.array([digest(t) for t in texts], pa.binary()), pa.array(x), pa.array(n), pa.array(rest)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = byte_texts(part.column("text"))
                for key, at in by_script(texts).items():
                    if key not in hot.value:
                        continue
                    alphabet, codes, _ = hot.value[key]
                    picked = pa.array([digest(texts[i]) for i in at], pa.binary())
                    for number, code, count in places(folded(texts[i] for i in at), symbol_table(alphabet)):
                        there, _ = find(codes, code)
                        columns = [picked.take(pa.array(number[~there])), pa.array(code[~there].astype(np.int64)), pa.array(count[~there])]
                        keys = pa.array(np.full(len(columns[0]), key, np.int32))
                        yield pa.RecordBatch.from_arrays([keys, *columns], names=["script", "digest", "code", "times"])

    rows = rule_rows(docs, known, "digest binary, x long, n long, rest long")
    sent = small_batches(docs).select("text").mapInArrow(send, "script int, digest binary, code long, times long")
    values = models.probabilities[ORDER].select("script", "code", F.col("x").alias("value"))
    if docs is not models.docs:  # else all were counted
        values = values.unionByName(models.unseen(sent).withColumnRenamed("x", "value"))
    sums = sent.join(values, ["script", "code"]).groupBy("digest").agg(F.sum(F.col("value") * F.col("times")).alias("sum"), F.sum("times").alias("times"))
    total = F.col("x") + F.when(F.col("rest") > 0, F.expr("sum div (times div rest)")).otherwise(F.lit(0))
    mean = F.when(F.col("n") > 0, F.round(-total / (F.lit(float(UNITS)) * F.col("n")), 9))
    return rows.join(sums, "digest", "left").select("doc_id", *StructType.fromDDL(RULES).names, mean.alias("log_perplexity"))


def base_failed():
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATS * F.col("n_words"))


def bands(scored: DataFrame) -> DataFrame:
    """(band_lang, mid, below, above): each language's median of different results and its spreads, from quartiles: the
    wider ones of those of different results and those of all rows, so a large group of copies, which the model knows
    well, neither closes the band to others nor falls out of it."""
    rows = scored.where(~base_failed()).select("lang", "n_words", F.col("log_perplexity").alias("x"))
    none = F.lit(None).cast("double")
    both = rows.select("lang", "x", none.alias("once")).unionByName(rows.distinct().select("lang", none.alias("x"), F.col("x").alias("once")))
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    q = both.groupBy(F.col("lang").alias("band_lang")).agg(
        F.percentile_approx("x", quarters, F.lit(10_000)).alias("q"), F.percentile_approx("once", quarters, F.lit(10_000)).alias("once")
    )
    mid = F.col("once")[1]
    return q.select(
        "band_lang", mid.alias("mid"),
        F.greatest(mid - F.col("once")[0], mid - F.col("q")[0], F.lit(LEAST_SPREAD)).alias("below"),
        F.greatest(F.col("once")[2] - mid, F.col("q")[2] - mid, F.lit(LEAST_SPREAD)).alias("above"),
    )


def in_band():
    width = BAND_SPREADS + BAND_SHORT / F.sqrt(F.greatest("n_words", F.lit(1)))
    x = F.col("log_perplexity") - F.col("mid")
    return F.coalesce(x.between(-width * F.col("below"), width * F.col("above")), F.lit(True))


def judge(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): the rule counts, log_perplexity, base_failed and kept.

    The scored rows, which hold no text, are written once to the shared checkpoint folder: bands and verdicts read
    them from there."""
    scored = cut(score(docs, train(docs)))
    limits = cut(bands(scored))
    if limits.count() <= BROADCAST_BANDS:  # else a shuffle join
        limits = F.broadcast(limits)
    joined = scored.join(limits, F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & in_band()).alias("kept"), "log_perplexity",
    )
