"""Near-duplicate classes by BagMinHash.

A text is the multiset of its shingles of ``SHINGLE`` words (runs of bytes that aren't ASCII white space). Two texts
are linked if the weighted Jaccard similarity of their multisets is at least 0.8; classes are the connected components
of links, named by their smallest id.

Signatures. The weight axis is cut into dyadic intervals [0,1), [1,2), [2,4), ... Each shingle has one Poisson process
for each interval below its count, over time, registers and unit weights; a point counts if its weight is below the
count. A register's value names its first point (shingle, interval and place in the process, no floating-point number,
so different machines agree), so two texts agree in a register with the probability of their weighted Jaccard
similarity. Points come in order of time and stop where they can't lower any register.

Candidates. Texts with equal words are one text, the smallest id standing for it. ``BANDS`` bands of ``ROWS`` registers
give keys. Texts with a common key are compared with the smallest id that has it, never all with all. A text that this
leaves outside the class of a key's smallest id, while the key has others left, is searched for: it travels once to each
chunk of documents that has texts with one of its keys, and is looked up there in an inverted index. So nothing that
shares a key is missed, a group of copies costs one comparison a text, and only links that join something are passed on.

Verification is exact on the multisets of the shingles' 64-bit hashes: a pivot's text travels once to each chunk that has
texts to compare with it, by way of relays, so that no task sends a pivot of a huge class to all chunks.

Texts without words belong to nobody else's class; texts of fewer words than a shingle only equal themselves. A null
text is empty. Rows with equal ids share a class, whatever their texts; a null id has a null class. Repeated rows each
give a row. Texts may be of any length; they are sketched in slices, one text at least. Other columns, whatever their
names, are ignored (``classes``) or kept (``keep_one``). An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import Chunk, byte_texts, chunk_count, chunked, cut, pack, quoted, release, slices, small_batches, text_bytes, trimmed, unpack
from .components import components
from .exchange import chunk_number, spread

SHINGLE = 5
BANDS, ROWS = 24, 6
REGISTERS = BANDS * ROWS
#: Bytes of text that are sketched at a time.
SKETCH_BYTES = 256 << 10
#: Texts that are searched for together in one chunk, and postings (one for each shared shingle of each of them) that are
#: counted at a time; a single shingle has no more than ``SEARCH_BLOCK``.
SEARCH_BLOCK = 20_000
POSTINGS = 1 << 20

_WORDS = anchors.Words()


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each different shingle, by text and hash."""
    words, begin, end = _WORDS.tokens(texts)
    n = np.maximum(end - begin - SHINGLE + 1, 0)
    text = np.repeat(np.arange(len(texts)), n)
    at = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)
    h = anchors.rolling(words, at, at + SHINGLE) if len(at) else np.zeros(0, np.uint64)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    return text[first], h[first], np.diff(np.r_[first, len(h)])


def _random(state: np.ndarray) -> np.ndarray:
    z = state.copy()
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def signatures(n: int, text: np.ndarray, h: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The name of each register's first point, texts x registers (0 for texts without shingles), of weighted multisets."""
    out = np.full((n, registers), np.inf)
    first = np.zeros(n * registers, np.uint64)
    # One row a shingle and dyadic interval: [0,1) is interval 0, [2**(k-1), 2**k) is interval k.
    top = np.zeros(len(weight), np.int64)
    more = weight > 1
    top[more] = np.ceil(np.log2(weight[more])).astype(np.int64)
    row = np.repeat(np.arange(len(h)), top + 1)
    k = np.arange(len(row)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    low = np.where(k > 0, 1 << np.maximum(k - 1, 0), 0)
    wide = np.maximum(low, 1)
    doc, limit = text[row], weight[row]
    state = _random(h[row] + (k.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    time = np.zeros(len(row))
    bound = np.full(n, np.inf)
    flat = out.ravel()
    step = np.uint64(0x9E3779B97F4A7C15)
    while len(doc):
        state = state + step
        r = _random(state)
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (wide * registers)
        live = time < bound[doc]
        if not live.all():
            doc, limit, low, wide, state, time = (x[live] for x in (doc, limit, low, wide, state, time))
        r = _random(state ^ np.uint64(0x5851F42D4C957F2D))
        register = (r % np.uint64(registers)).astype(np.int64)
        level = low + (((r >> np.uint64(24)) % wide.astype(np.uint64)).astype(np.int64))
        counts = level < limit
        place, at, name = (doc * registers + register)[counts], time[counts], state[counts]
        np.minimum.at(flat, place, at)
        won = flat[place] == at
        first[place[won]] = name[won]
        some = np.unique(doc) if len(doc) < 4 * n else np.arange(n)
        bound[some] = out[some].max(1)
    return first.reshape(n, registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bits.shape[:2]).copy()
    for j in range(ROWS):
        key = _random((key ^ bits[:, :, j]) + np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, content (128-bit hash of the words, null without any), keys array<long> (none for short texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SKETCH_BYTES):
                texts = byte_texts(part.column("text"))
                text, h, weight = shingles(texts)
                keys = band_keys(signatures(len(texts), text, h, weight))
                have = np.zeros(len(texts), bool)
                have[text] = True
                words = [t.split() for t in texts]
                content = [xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in words]
                rows = [k.tolist() if y else [] for k, y in zip(keys, have.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(content, pa.binary()), pa.array(rows, pa.list_(pa.int64()))],
                    names=["doc_id", "content", "keys"],
                )
        release()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, content binary, keys array<long>")


# --- verification ---


def _chunk_of(column: str, n_chunks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(n_chunks)).cast("int")


def multiset(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    _, h, n = shingles([text])
    return h, n


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sizes of the intersection and the union of two multisets."""
    (h, n), (g, m) = a, b
    at = np.minimum(np.searchsorted(h, g), max(len(h) - 1, 0))
    both = h[at] == g if len(h) else np.zeros(len(g), bool)
    common = int(np.minimum(n[at[both]], m[both]).sum())
    return common, int(n.sum()) + int(m.sum()) - common


def linked(common: int, union: int) -> bool:
    """Whether the similarity is 0.8 or more."""
    return union > 0 and 5 * common >= 4 * union


def _by_id(chunk: Chunk) -> dict[int, list[bytes]]:
    """The texts of each id; rows with equal ids may have several."""
    out: dict[int, list[bytes]] = {}
    for i, text in zip(chunk.ids, chunk.texts):
        out.setdefault(i, []).append(text)
    return out


def _send(group: pa.Table, asked: pa.Table, span: int) -> pa.Table:
    """Pivots' texts, once for each block of ``span`` chunks of which some asked: (relay, blob)."""
    chunk = Chunk(group.column("blob").to_pylist())
    text = _by_id(chunk)
    relays: dict[int, dict[int, list[int]]] = {}
    for target, pivot in zip(asked.column("target").to_pylist(), asked.column("pivot").to_pylist()):
        relays.setdefault(target // span, {}).setdefault(pivot, []).append(target)
    blobs = []
    for wanted in relays.values():
        rows = [(p, x, targets) for p, targets in wanted.items() for x in text[p]]
        blobs.append(pack(pa.table({
            "pivot": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.binary()), "targets": pa.array([r[2] for r in rows], pa.list_(pa.int32())),
        })))
    return pa.table({"relay": pa.array([chunk_number(group) * 1_000_003 + r for r in relays], pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _relay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Relay -> (chunk, blob): the texts for each chunk that asked."""
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            t = unpack(blob)
            targets = t.column("targets").combine_chunks()
            row = np.repeat(np.arange(t.num_rows), np.diff(targets.offsets.to_numpy()))
            target = targets.flatten().to_numpy()
            for k in np.unique(target).tolist():
                some = t.select(["pivot", "text"]).take(pa.array(row[target == k]))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(some)], pa.binary())], names=["chunk", "blob"])


def sent_texts(packed: DataFrame, asked: DataFrame, n_chunks: int) -> DataFrame:
    """(chunk, blob): the texts of ``pivot`` for chunk ``target``, of rows (chunk, pivot, target) with the pivot's chunk. In two
    hops of about the square root of the chunks each."""
    span = max(1, math.isqrt(n_chunks))
    by_relay = packed.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(trimmed(lambda g, a: _send(g, a, span)), "relay long, blob binary")
    return by_relay.repartition("relay").mapInArrow(_relay, "chunk int, blob binary")


def _compare(group: pa.Table, work: pa.Table) -> pa.Table:
    text = _by_id(Chunk(group.column("blob").to_pylist()))
    pivots: dict[int, list[bytes]] = {}
    pairs = []
    for a, b, blob in zip(*(work.column(c).to_pylist() for c in ("a", "b", "blob"))):
        if blob is None:
            pairs.append((b, a))
        else:
            t = unpack(blob)
            for p, x in zip(t.column("pivot").to_pylist(), t.column("text").to_pylist()):
                pivots.setdefault(p, []).append(x)
    found = []
    at, pivot = None, []
    for b, a in sorted(pairs):
        if b != at:
            at, pivot = b, [multiset(x) for x in pivots[b]]
        found.append((a, b, any(linked(*overlap(multiset(x), p)) for x in text[a] for p in pivot)))
    return pa.table({
        "a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64()),
        "linked": pa.array([f[2] for f in found], pa.bool_()),
    })


#: Bits of the filter that keeps documents without a pair out of the text shuffle; a bound on what the driver gets.
FILTER_BITS = 1 << 20


def pack_some(docs: DataFrame, ids: DataFrame, n_chunks: int) -> DataFrame:
    """The documents whose id is in ``ids``, packed by chunk, and a few others that share a filter bit with one."""
    bit = F.pmod(F.xxhash64("id", F.lit("bit")), F.lit(FILTER_BITS)).cast("int")
    have = np.zeros(FILTER_BITS, bool)
    have[ids.select(bit.alias("bit")).distinct().toPandas()["bit"].to_numpy(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(have[batch.column("bit").to_numpy()])).select(["doc_id", "text"])

    some = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("bit")), F.lit(FILTER_BITS)).cast("int").alias("bit"),
    ).mapInArrow(run, "doc_id long, text string")
    return chunked(some, n_chunks)


def verify(packed: DataFrame, pairs: DataFrame, n_chunks: int) -> DataFrame:
    """(a, b, linked) for each pair (a, b) of ids whose documents are in ``packed``."""
    asked = pairs.select(_chunk_of("b", n_chunks).alias("chunk"), F.col("b").alias("pivot"), _chunk_of("a", n_chunks).alias("target")).distinct()
    nothing = F.lit(None).cast("long")
    texts = sent_texts(packed, asked, n_chunks).select("chunk", nothing.alias("a"), nothing.alias("b"), "blob")
    work = texts.union(pairs.select(_chunk_of("a", n_chunks).alias("chunk"), "a", "b", F.lit(None).cast("binary").alias("blob")))
    return packed.groupBy("chunk").cogroup(work.groupBy("chunk")).applyInArrow(trimmed(_compare), "a long, b long, linked boolean")


def elements(text: bytes) -> np.ndarray:
    """The multiset as a set of sorted hashes: the k-th copy of a shingle is an element of its own."""
    h, n = multiset(text)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.sort(_random(np.repeat(h, n) + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _search(group: pa.Table, asked: pa.Table) -> pa.Table:
    """Links between the texts that are searched for and the chunk's texts, as a forest: what is connected already
    isn't told again."""
    chunk = Chunk(group.column("blob").to_pylist())
    ids: list[int] = []
    sets: list[np.ndarray] = []
    for blob in asked.column("blob").to_pylist():
        t = unpack(blob)
        ids += t.column("pivot").to_pylist()
        sets += map(elements, t.column("text").to_pylist())
    out: list[tuple[int, int]] = []
    if sets:
        sizes = np.array([len(x) for x in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        owner = owner[order]
        known, begin = np.unique(flat[order], return_index=True)
        end = np.r_[begin[1:], len(flat)]
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for doc, text in zip(chunk.ids, chunk.texts):
            if doc is None:
                continue
            mine = elements(text)
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            at = at[known[at] == mine]
            if not len(at):
                continue
            # Postings are read in portions, so a text that shares much with many takes no more memory than one portion.
            common = np.zeros(len(sets), np.int64)
            portion = np.cumsum(end[at] - begin[at]) // POSTINGS
            for own in np.split(at, np.flatnonzero(np.diff(portion)) + 1):
                common += np.bincount(owner[spread(begin[own], end[own] - begin[own])], minlength=len(sets))
            union = sizes + len(mine) - common
            for i in np.flatnonzero(5 * common >= 4 * union).tolist():
                a, b = find(doc), find(ids[i])
                if a != b:
                    parent[a] = b
                    out.append((doc, ids[i]))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def search(packed: DataFrame, asked: DataFrame, n_chunks: int) -> DataFrame:
    """(a, b) links found for rows (pivot, target): the text ``pivot`` among all texts of chunk ``target``. A chunk that
    many are searched in is searched in blocks."""
    asked = cut(asked.distinct())
    most = asked.groupBy("target").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // SEARCH_BLOCK))
    here = asked.select(_chunk_of("pivot", n_chunks).alias("chunk"), "pivot", (F.col("target") * blocks + F.pmod(F.xxhash64("pivot", F.lit("block")), F.lit(blocks))).cast("int").alias("target"))
    texts = sent_texts(packed, here, n_chunks * blocks)
    parts = packed.select(F.explode(F.sequence(F.col("chunk") * blocks, F.col("chunk") * blocks + (blocks - 1))).alias("chunk"), "blob")
    return parts.groupBy("chunk").cogroup(texts.groupBy("chunk")).applyInArrow(trimmed(_search), "a long, b long")


# --- classes ---


def link_texts(docs: DataFrame, members: DataFrame, given: DataFrame, n_chunks: int) -> DataFrame:
    """(id, root) of the different texts that share keys: ``members`` has rows (key, pivot, doc), the pivot being the
    key's smallest id. ``given`` has links (a, b) that hold in any case.

    All texts of a key are compared with its pivot. Then each text outside the pivot's class is searched for among all
    others of the key, if there are any besides the pivot and its own class. So each pair of a key is compared, or
    both are in one class."""
    packed = cut(pack_some(docs, members.select(F.col("doc").alias("id")), n_chunks))
    pairs = cut(members.where("doc != pivot").select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct())
    found = cut(verify(packed, pairs, n_chunks).where("linked").select("a", "b").union(given))
    roots = cut(components(found))
    named = members.join(roots, members.doc == roots.id, "left").select("key", "pivot", "doc", F.coalesce("root", "doc").alias("root"))
    in_key = named.groupBy("key").agg(F.count("*").alias("n"), F.max(F.when(F.col("doc") == F.col("pivot"), F.col("root"))).alias("main"), F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = cut(named.join(in_key.where("low != high and n > 2").select("key", "n", "main"), "key"))
    like = mixed.groupBy("key", "root").agg(F.count("*").alias("like"))
    outside = mixed.where("root != main").join(like, ["key", "root"]).where("n - like - 1 > 0").select("key", F.col("doc").alias("pivot"))
    places = mixed.select("key", _chunk_of("doc", n_chunks).alias("target")).distinct()
    more = search(packed, outside.join(places, "key").select("pivot", "target"), n_chunks)
    return cut(components(found.union(more)))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for each row of ``docs``."""
    n_chunks = chunk_count(text_bytes(docs))
    made = cut(sketch(docs))
    # Written before it is joined: the join is then between two shuffles, of which Spark parts the one with a hot content.
    rep = cut(made.where(F.col("content").isNotNull()).groupBy("content").agg(F.min("doc_id").alias("rep")))
    keyed = cut(made.join(rep, "content", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "keys"))
    several = keyed.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("doc_id")
    same_id = cut(keyed.select("doc_id", "rep").join(several, "doc_id", "left_semi").where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())
    every = keyed.where("doc_id = rep").select(F.explode("keys").alias("key"), F.col("doc_id").alias("doc")).distinct()
    shared = every.groupBy("key").agg(F.min("doc").alias("pivot"), F.max("doc").alias("last")).where("pivot < last").select("key", "pivot")
    members = cut(every.join(shared, "key"))
    roots = link_texts(docs, members, same_id, n_chunks)
    named = keyed.join(roots, keyed.rep == roots.id, "left")
    return named.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep")).alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each class; all columns stay. Of rows with equal ids one stays; rows with a
    null id stay, one for each text.

    Ids are marked first, without texts: those whose rows go, those that several rows have, and null. Only rows with
    such an id are looked at again, and combined in the tasks."""
    columns = [F.col(quoted(c)) for c in docs.columns]
    whole = F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns)))
    back = [F.col(f"r.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    marked = cut(
        classes(docs.select("doc_id", "text")).groupBy(F.col("doc_id").alias("id")).agg(F.min("class_id").alias("class_id"), F.count("*").alias("n"))
        .where("id IS NULL OR class_id != id OR n > 1")
    )
    own = F.col("doc_id").cast("long") == F.col("id")
    kept = docs.join(marked.select(F.col("id")), own, "left_anti").where(F.col("doc_id").isNotNull()).select(*columns)
    again = marked.where("id = class_id AND n > 1").select("id")
    if not again.isEmpty():
        rows = docs.join(again, own, "left_semi").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), whole.alias("w"))
        kept = kept.union(rows.groupBy("id").agg(F.min_by("w", "h").alias("r")).select(*back))
    if not marked.where("id IS NULL").isEmpty():
        rows = docs.where(F.col("doc_id").isNull()).select(F.xxhash64("text").alias("h"), whole.alias("w"))
        kept = kept.union(rows.groupBy("h").agg(F.first("w").alias("r")).select(*back))
    return kept
