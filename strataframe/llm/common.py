"""Shared pieces of the training-data operators: reading, batching, byte-level words, text chunks.

Whole texts never meet on one task unless they are in one *chunk*: a bounded group of documents chosen by a
hash of ``doc_id``. Operators that must compare documents send packed arrays between chunks and hash *buckets*,
so Spark moves few, large, evenly spread rows instead of one row per window.
"""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import math
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a worker handles at a time inside a batch.
SLICE_BYTES = 1 << 20
#: Bytes of text of a chunk that a worker looks at at a time: arrays over them take some 100 times that.
PART_BYTES = 1 << 18
#: Bytes of text that a task holds before it packs them.
PACK_BYTES = 24 << 20
#: Bytes of text in a chunk, on average; a single longer document makes its chunk longer.
CHUNK_BYTES = 8 << 20

#: Bytes of an Arrow batch between Spark and a worker; Spark's own bound is 64 MB, of which both sides hold copies.
BATCH_BYTES = 4 << 20

#: Bytes from which a cell between a chunk and a bucket is compressed.
CELL_BYTES = 256

ASCII_UPPER = bytes(range(65, 91))
#: A-Z to a-z, all other bytes unchanged.
LOWER = bytes.maketrans(ASCII_UPPER, ASCII_UPPER.lower())
#: Lower-case A-Z; every byte outside 0-9, a-z and 0x80-0xFF becomes a space.
ALNUM = bytes(
    b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else (b + 32 if 65 <= b < 91 else 32) for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame; its session exchanges batches of ``BATCH_BYTES`` with workers from now on, if not smaller ones."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key).rstrip("b")) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def release() -> None:
    """Give freed memory back: Spark keeps workers for later stages, and else each keeps the most it ever had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(f: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The function on groups, with its memory given back behind each group."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right)
        finally:
            release()

    def alone(left: pa.Table) -> pa.Table:
        try:
            return f(left)
        finally:
            release()

    return run if len(inspect.signature(f).parameters) == 2 else alone


def id_hash(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII code points, A-Z lower-cased."""
    return text.translate(ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    """Runs without the six ASCII white-space characters: what ``bytes.split`` gives."""
    return text.split()


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def set_aside(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The frame, with columns that have one of the names (upper or lower case) renamed to ``original_<name>``."""
    taken = {n.lower() for n in names}
    new, used = [], {c.lower() for c in df.columns} | taken
    for c in df.columns:
        name = c
        if c.lower() in taken:
            while name.lower() in used:
                name = f"original_{name}"
            used.add(name.lower())
        new.append(name)
    return df if new == df.columns else df.toDF(*new)


def map_texts(
    df: DataFrame, score: Callable[[list[bytes]], dict[str, object]], schema: str, text: str = "text"
) -> DataFrame:
    """Add the columns that ``score`` gives for a list of texts; all columns of ``df`` but the text are kept.

    ``score`` is built on the worker by calling it with the texts of a slice only, so memory is bounded by a slice
    and not by the partition. A column that has the name of a new one is kept as ``original_<name>``. No shuffle.
    """
    added = StructType.fromDDL(schema)
    df = set_aside(small_batches(df), added.names)
    kept = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                made = score(byte_texts(part.column(text)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), *(v if isinstance(v, pa.Array) else pa.array(v) for v in made.values())],
                    names=[*kept, *made],
                )
        release()

    return df.mapInArrow(run, StructType([f for f in df.schema.fields if f.name != text] + added.fields))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``, else one below the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return found or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut: written to the shared checkpoint folder, reread from there after a loss."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; reads the text column only, no shuffle beyond one row a task."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def chunk_count(total_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> int:
    return max(1, math.ceil(total_bytes / chunk_bytes))


def pack(table_: pa.Table) -> bytes:
    """A table as one zstd-compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table_.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table_)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


@lru_cache(1)
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def cell(*parts: bytes) -> bytes:
    """What a chunk sends a bucket: a few byte strings as one, with 5 bytes and 4 a part on top; compressed from
    ``CELL_BYTES`` on. Unlike a packed table it costs next to nothing where a chunk and a bucket share little."""
    head = struct.pack(f"<{len(parts)}I", *map(len, parts))
    body = b"".join(parts)
    small = len(body) < CELL_BYTES
    return struct.pack("<BI", small, len(parts)) + head + (body if small else _codec()[0].compress(body))


def uncell(raw: bytes) -> list[bytes]:
    small, n = struct.unpack_from("<BI", raw)
    sizes = struct.unpack_from(f"<{n}I", raw, 5)
    body = raw[5 + 4 * n :] if small else _codec()[1].decompress(raw[5 + 4 * n :])
    ends = np.cumsum(sizes).tolist()
    return [body[e - s : e] for s, e in zip(sizes, ends)]


def others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def others_struct(docs: DataFrame) -> Column:
    """The other columns as a struct of c0, c1 ..., so that their names, whatever they are, don't matter."""
    return F.struct(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(others(docs))))


def quoted(name: str) -> str:
    """A column's name, literally."""
    return f"`{name.replace('`', '``')}`"


def chunked(docs: DataFrame, n_chunks: int, extra: bool = False) -> DataFrame:
    """Documents as packed rows (chunk, blob): ids and texts of the documents of a chunk, by a hash of the id, and with
    ``extra`` their other columns as one struct.

    Only packed rows are shuffled, once, by chunk; both uses of the result in one plan share that exchange.
    A null text counts as empty; rows with equal ids share a chunk.
    """
    keyed = small_batches(docs).select(
        F.pmod(F.xxhash64("doc_id"), F.lit(n_chunks)).cast("int").alias("chunk"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
        *([others_struct(docs).alias("extra")] if extra and others(docs) else []),
    )
    columns = keyed.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            order = np.argsort(key := whole.column("chunk").to_numpy(), kind="stable")
            edges = np.flatnonzero(np.diff(key[order], prepend=-1, append=n_chunks))
            for a, b in zip(edges[:-1], edges[1:]):
                part = whole.select(columns).take(pa.array(order[a:b]))
                yield pa.RecordBatch.from_pydict(
                    {"chunk": pa.array([int(key[order[a]])], pa.int32()), "blob": pa.array([pack(part)], pa.binary())}
                )

        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                held.append(part)
                size += part.nbytes
                if size > PACK_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()
        held = []
        release()

    return keyed.mapInArrow(run, "chunk int, blob binary")


class Chunk:
    """The documents of a chunk in a fixed order: by id (null last), then text."""

    def __init__(self, blobs: list[bytes]):
        tables = [unpack(blob) for blob in blobs]
        ids = [i for t in tables for i in t.column("doc_id").to_pylist()]
        texts = [x for t in tables for x in t.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in order]
        self.texts = [texts[i] for i in order]
        #: The other columns, where they were packed.
        self.extra = None
        if tables and "extra" in tables[0].column_names:
            self.extra = pa.concat_tables(t.select(["extra"]) for t in tables).column("extra").take(pa.array(order))

    def parts(self, limit: int = PART_BYTES) -> Iterator[tuple[int, int]]:
        """Index ranges of documents with about ``limit`` bytes together."""
        a = size = 0
        for i, t in enumerate(self.texts):
            size += len(t)
            if size >= limit:
                yield a, i + 1
                a, size = i + 1, 0
        if a < len(self.texts):
            yield a, len(self.texts)
