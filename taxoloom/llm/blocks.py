"""Blocks of whole texts and rows of packed data, for operators whose cost is linear in the input.

A task cuts its documents into blocks of bounded bytes. What a block has to say about a part of
some key space goes into one row per non-empty part, so rows and steps per block depend on the
block's own keys and never on the number of parts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_bytes

#: Bytes of text that a task holds before it closes a block; one longer text is a block by itself.
BLOCK_BYTES = 8 << 20
#: Bytes of text for one partition of a shuffle.
BYTES_PER_PARTITION = 32 << 20
_BLOCKS_PER_TASK = 24
ROWS = "block long, part long, data binary"


def text_blocks(
    batches: Iterator[pa.RecordBatch], task: int, most_bytes: int = BLOCK_BYTES, extra: str | None = None
) -> Iterator[tuple[int, list, list[bytes], list]]:
    """Numbered blocks ``(number, ids, texts, extras)`` of rows ``doc_id, text``."""
    number, held = task << _BLOCKS_PER_TASK, 0
    ids: list = []
    texts: list[bytes] = []
    extras: list = []
    for batch in batches:
        more = batch.column(extra).to_pylist() if extra else [None] * batch.num_rows
        for doc_id, text, value in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), more):
            ids.append(doc_id)
            texts.append(text)
            extras.append(value)
            held += len(text) + 16
            if held > most_bytes:
                yield number, ids, texts, extras
                number, held, ids, texts, extras = number + 1, 0, [], [], []
    if ids:
        yield number, ids, texts, extras


def joined(texts: list[bytes], before: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, ``before`` ahead of each, and where each begins (and the end)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(before)
    return np.frombuffer(before + before.join(texts), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def distinct_runs(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Code of each run of bytes (``starts``, and the end of ``buf``), and the distinct runs."""
    offsets = np.append(starts, len(buf)).astype(np.int64)
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf)])
    coded = runs.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in rising order, and how often each occurs."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    ranked = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return ranked[first], np.diff(np.append(first, len(ranked)))


def summed(keys: list[np.ndarray], *values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct keys of several arrays in rising order, and for each the sum of its values."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    out = [np.add.reduceat(np.concatenate(v)[order], first) if len(first) else np.zeros(0, np.int64) for v in values]
    return (every[first], *out)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``starts[k] … starts[k] + counts[k] - 1`` of all k, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def dump(*parts) -> bytes:
    """Arrays and small values as one compressed value; integer arrays as planes of bytes."""
    packed = []
    for x in parts:
        if isinstance(x, np.ndarray) and x.dtype.itemsize > 1:
            x = np.ascontiguousarray(x)
            packed.append((str(x.dtype), len(x), x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()))
        else:
            packed.append(x)
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(packed, protocol=5))


def load(data: bytes) -> list:
    out = []
    for x in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        if isinstance(x, tuple) and len(x) == 3 and isinstance(x[2], bytes):
            planes = np.frombuffer(x[2], np.uint8).reshape(np.dtype(x[0]).itemsize, x[1])
            x = np.ascontiguousarray(planes.T).view(x[0]).reshape(-1)
        out.append(x)
    return out


def row_batches(rows: Iterator[tuple[int, int, bytes]], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of ``ROWS`` in batches of bounded bytes."""
    held: list = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[2]) + 64
        if size > most_bytes:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list) -> pa.RecordBatch:
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))]
    return pa.RecordBatch.from_arrays(arrays, names=["block", "part", "data"])


def table_batches(rows: Iterator[tuple], schema: pa.Schema, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of any schema in batches of bounded bytes; texts and lists count by their length."""
    held: list = []
    size = 0
    for row in rows:
        held.append(row)
        size += 32 * len(row) + sum(len(x) for x in row if isinstance(x, (str, bytes, list)))
        if size > most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one; only their batch is held."""
    for batch in batches:
        yield from batch.to_pylist()


def text_total(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def partitions_for(docs: DataFrame, total: int) -> int:
    """Partitions of a shuffle that moves about ``total`` bytes."""
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // BYTES_PER_PARTITION))


def salt_of(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("long")
