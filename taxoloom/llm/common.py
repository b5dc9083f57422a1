"""What the text operators share: session limits, words, packed arrays and keyed exchanges."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space of the word rules: blank and the controls tab to carriage return.
BLANKS = b" \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bytes of text for one slice of a keyed exchange.
BYTES_PER_SLICE = 4 << 20
#: Bytes of text for one partition of a keyed exchange.
BYTES_PER_PARTITION = 16 << 20
#: Words that a task holds before it closes a block of documents.
BLOCK_WORDS = 2_000_000
_BLOCKS_PER_TASK = 24
#: Rows of a keyed exchange; ``slice`` is negative for what belongs to the block itself.
EXCHANGE = "block long, slice int, data binary"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes: texts may be long, so a row count is no bound."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mod_of_id(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(33)
    return x


def windows(words: np.ndarray, n: int, multiplier: np.uint64 = _MULTIPLIER) -> np.ndarray:
    """One 64-bit key for each run of ``n`` consecutive word keys."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out *= multiplier
        out += words[k : len(words) - n + 1 + k]
    return mix(out)


def pack(values: np.ndarray) -> bytes:
    """An integer array as compressed planes of bytes: the high planes are nearly empty."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    planes = planes.reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """A rising array as packed differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


def pack_flags(flags: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(flags).tobytes())


def unpack_flags(data: bytes, n: int) -> np.ndarray:
    bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.unpackbits(bits, count=n).astype(bool)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it differ from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without_ids(docs: DataFrame, judged: DataFrame, out: Column, doc_id: str) -> DataFrame:
    """``docs`` without the ids for which ``out`` holds in ``judged`` (``doc_id``); columns as they were.

    Rows that share an id, or have none, go only if ``out`` holds for all of them.
    """
    name = free_name(docs, "gone")
    gone = judged.groupBy("doc_id").agg(F.bool_and(out).alias("out")).filter("out").select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col(doc_id).eqNullSafe(F.col(name)), "left_anti")


class Block:
    """Documents of one task as word numbers, small enough to hold and to send as one row.

    ``ids`` and ``starts`` describe the documents; ``codes`` are their words one after another,
    as places in ``vocab``. ``extra`` holds one array of whatever else an operator needs.
    """

    def __init__(self, ids: list, starts: np.ndarray, codes: np.ndarray, vocab: list[bytes], extra: list):
        self.ids, self.starts, self.codes, self.vocab, self.extra = ids, starts, codes, vocab, extra

    def keys(self) -> np.ndarray:
        """A 64-bit key for each entry of ``vocab``."""
        return np.fromiter(map(xxhash.xxh64_intdigest, self.vocab), np.uint64, len(self.vocab))

    def owners(self) -> np.ndarray:
        """The place of its document for each word."""
        return np.repeat(np.arange(len(self.ids)), np.diff(self.starts))

    def dump(self) -> bytes:
        parts = (self.ids, pack(self.starts), pack(self.codes.astype(np.int32)), b" ".join(self.vocab), self.extra)
        return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(parts))

    @staticmethod
    def load(data: bytes) -> Block:
        ids, starts, codes, vocab, extra = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
        return Block(ids, unpack(starts, np.int64), unpack(codes, np.int32).astype(np.int64), vocab.split(b" ") if vocab else [], extra)


def blocks_of(
    batches: Iterator[pa.RecordBatch], task: int, fold: Callable[[bytes], bytes], extra: str | None = None,
    most_words: int = BLOCK_WORDS,
) -> Iterator[tuple[int, Block]]:
    """Numbered blocks of a task's documents (columns ``doc_id`` and ``text``)."""
    number = task << _BLOCKS_PER_TASK
    vocab: dict[bytes, int] = {}
    ids, codes, kept, held = [], [], [], 0

    def close():
        starts = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
        return Block(list(ids), starts, np.concatenate(codes), list(vocab), list(kept))

    for batch in batches:
        more = batch.column(extra).to_pylist() if extra else [None] * batch.num_rows
        for doc_id, text, value in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), more):
            words = fold(text).split()
            for w in dict.fromkeys(words):
                if w not in vocab:
                    vocab[w] = len(vocab)
            ids.append(doc_id)
            codes.append(np.fromiter(map(vocab.__getitem__, words), np.int64, len(words)))
            kept.append(value)
            held += len(words) + 1
            if held > most_words:
                yield number, close()
                number += 1
                vocab, ids, codes, kept, held = {}, [], [], [], 0
    if ids:
        yield number, close()


def exchange_batches(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows of ``EXCHANGE`` in batches of bounded bytes."""
    held, size = [], 0

    def batch():
        arrays = [pa.array(c, t) for c, t in zip(zip(*held), (pa.int64(), pa.int32(), pa.binary()))]
        return pa.RecordBatch.from_arrays(arrays, names=["block", "slice", "data"])

    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > 4 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def answer(requests: DataFrame, merge: Callable[[list[bytes]], list[bytes]], n: int) -> DataFrame:
    """Bring the requests of all blocks for a slice together; ``merge`` gives each its answer."""

    def run(batches):
        def rows():
            for at, group in runs(batches, "slice"):
                for row, data in zip(group, merge([r["data"] for r in group])):
                    yield row["block"], at, data

        return exchange_batches(rows())

    return requests.repartition(n, "slice").sortWithinPartitions("slice", "block").mapInArrow(run, EXCHANGE)


def by_block(n: int, *tables: DataFrame) -> DataFrame:
    """All rows of a block in one of ``n`` partitions, in the order of their slices."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.repartition(n, "block").sortWithinPartitions("block", "slice")


def slices_of(docs: DataFrame, text: str) -> tuple[int, int]:
    """Number of slices of a keyed exchange, and the bytes of text that it grows with."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return int(max(8, -(-total // BYTES_PER_SLICE))), total


def partitions_of(spark: SparkSession, total: int) -> int:
    """Partitions of an exchange, so that what one task reads does not grow with the ``total`` bytes of text."""
    return int(max(spark.sparkContext.defaultParallelism, -(-total // BYTES_PER_PARTITION)))


def cut_by_slice(keys: np.ndarray, bits: int, n_slices: int) -> dict[int, tuple[int, int]]:
    """Bounds of each slice that a rising array of ``bits``-wide keys has a key in; the others cost nothing."""
    if not len(keys):
        return {}
    high = keys >> np.uint64(max(bits - 32, 0))
    slices = (high * np.uint64(n_slices) >> np.uint64(min(bits, 32))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], slices[1:] != slices[:-1]]))
    return dict(zip(slices[first].tolist(), zip(first.tolist(), [*first[1:].tolist(), len(keys)])))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of equal ``key`` from batches that are sorted by it; one key's rows are held at a time."""
    held, at = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != at and held:
                yield at, held
                held = []
            at = row[key]
            held.append(row)
    if held:
        yield at, held
