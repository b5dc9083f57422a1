"""Repeated passages: word windows found by doubling their length.

A window of n words is made of two windows of half its length, so it can only repeat where both
halves repeat. The first level sends a short key for every window of the shortest length; each
further level sends keys only for windows whose halves survived, at twice the length, until
the asked length is reached or no candidate survives.

A task packs its documents into a block and sends, for every slice of the key space, its
distinct keys as one sorted, compressed row. So a passage in thousands of documents leaves a
task once, and a slice's answer needs one bit or one id for each key. The short keys of the
lower levels only select candidates; the last level compares 64-bit keys of windows whose halves
are known to repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..plans.scratch import settle
from .common import (
    EXCHANGE, Block, answer, blocks_of, by_block, cut_by_slice, exchange_batches, pack, pack_flags,
    pack_sorted, partitions_of, prepare, runs, slices_of, unpack, unpack_flags, unpack_sorted, windows,
)

#: Words of a window.
WINDOW = 13
#: The shortest length that a level may have.
FIRST = 5
_BLOCK, _MASK = -2, -1
_LAST = np.iinfo(np.int64).max
# Each level has its own multiplier, so that keys of different levels are independent.
_MULTIPLIERS = [np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0xD6E8FEB86659FD93 & (1 << 64) - 1) for k in range(64)]


def levels(window: int) -> list[int]:
    """Window lengths, each at most twice the one before; the last is ``window``."""
    found = [window]
    while (half := -(-found[0] // 2)) >= FIRST:
        found.insert(0, half)
    return found


def _positions(block: Block, n: int) -> np.ndarray:
    """Where windows of ``n`` words begin inside one document."""
    fits = np.ones(len(block.codes), bool)
    for stop in block.starts[1:]:
        fits[max(stop - n + 1, 0) : stop] = False
    for start, stop in zip(block.starts[:-1], block.starts[1:]):
        if stop - start < n:
            fits[start:stop] = False
    return np.flatnonzero(fits)


def _sorted_keys(block: Block, at: np.ndarray, level: int, n: int, bits: int):
    """Keys of the windows at ``at``: the distinct ones in rising order, and how to come back to ``at``."""
    keys = windows(block.keys()[block.codes], n, _MULTIPLIERS[level])
    keys = keys[at] >> np.uint64(64 - bits)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(ranked)))
    return ranked[first], order, first, counts


def _requests(number: int, block: Block, at: np.ndarray, level: int, n: int, bits: int, n_slices: int, last: bool):
    keys, order, first, counts = _sorted_keys(block, at, level, n, bits)
    if last:
        ids = np.array([_LAST if i is None else i for i in block.ids], np.int64)
        value = np.minimum.reduceat(ids[block.owners()[at]][order], first) if len(first) else np.zeros(0, np.int64)
    else:
        owner = block.owners()[at][order]
        value = owner[first] != owner[first + counts - 1]
    for k, (a, b) in cut_by_slice(keys, bits, n_slices).items():
        packed = pack(value[a:b]) if last else pack_flags(value[a:b])
        part = pack_sorted(keys[a:b])
        yield number, k, len(part).to_bytes(4, "little") + part + packed


def _opened(data: bytes, last: bool) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    keys = unpack_sorted(data[4 : 4 + n], np.uint64)
    return keys, unpack(data[4 + n :], np.int64) if last else unpack_flags(data[4 + n :], len(keys))


def _merge_flags(requests: list[bytes]) -> list[bytes]:
    """Does a key occur in more than one document?"""
    opened = [_opened(r, False) for r in requests]
    keys, place, counts = np.unique(np.concatenate([k for k, _ in opened]), return_inverse=True, return_counts=True)
    many = counts > 1
    np.logical_or.at(many, place, np.concatenate([f for _, f in opened]))
    many, out, at = many[place], [], 0
    for k, _ in opened:
        out.append(pack_flags(many[at : at + len(k)]))
        at += len(k)
    return out


def _merge_ids(requests: list[bytes]) -> list[bytes]:
    """The smallest document id with a key."""
    opened = [_opened(r, True) for r in requests]
    keys, place = np.unique(np.concatenate([k for k, _ in opened]), return_inverse=True)
    least = np.full(len(keys), _LAST)
    np.minimum.at(least, place, np.concatenate([v for _, v in opened]))
    least, out, at = least[place], [], 0
    for k, _ in opened:
        out.append(pack(least[at : at + len(k)]))
        at += len(k)
    return out


def _first_level(batches: Iterator[pa.RecordBatch], n: int, bits: int, n_slices: int, last: bool):
    def rows():
        for number, block in blocks_of(batches, TaskContext.get().partitionId(), bytes):
            yield number, _BLOCK, block.dump()
            at = _positions(block, n)
            yield number, _MASK, _mask(block, at)
            yield from _requests(number, block, at, 0, n, bits, n_slices, last)

    return exchange_batches(rows())


def _mask(block: Block, at: np.ndarray) -> bytes:
    flags = np.zeros(len(block.codes), bool)
    flags[at] = True
    return pack_flags(flags)


def _split_group(group: list[dict]) -> tuple[Block, np.ndarray, list[dict]]:
    block = Block.load(group[0]["data"])
    return block, np.flatnonzero(unpack_flags(group[1]["data"], len(block.codes))), group[2:]


def _answers(block: Block, at: np.ndarray, level: int, n: int, bits: int, n_slices: int, group: list[dict], last: bool):
    """The answer for each window at ``at``."""
    keys, order, _, counts = _sorted_keys(block, at, level, n, bits)
    value = np.zeros(len(keys), np.int64 if last else bool)
    bounds = cut_by_slice(keys, bits, n_slices)
    for row in group:
        a, b = bounds[row["slice"]]
        value[a:b] = unpack(row["data"], np.int64) if last else unpack_flags(row["data"], b - a)
    found = np.empty(len(at), value.dtype)
    found[order] = np.repeat(value, counts)
    return found


def _next_level(batches, level: int, n: int, longer: int, bits: tuple[int, int], n_slices: int, last: bool):
    def rows():
        for number, group in runs(batches, "block"):
            block, at, rest = _split_group(group)
            alive = np.zeros(len(block.codes) + longer, bool)
            alive[at[_answers(block, at, level, n, bits[0], n_slices, rest, False)]] = True
            # Both halves survived, and the longer window lies within its document.
            into = _positions(block, longer)
            into = into[alive[into] & alive[into + longer - n]]
            yield number, _MASK, _mask(block, into)
            yield from _requests(number, block, into, level + 1, longer, bits[1], n_slices, last)

    return exchange_batches(rows())


def _without_repeats(batches, level: int, n: int, bits: int, n_slices: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
         ("spans", pa.list_(pa.int32())), ("kept", pa.string())]
    )
    for _, group in runs(batches, "block"):
        block, at, rest = _split_group(group)
        ids = np.array([_LAST if i is None else i for i in block.ids], np.int64)
        least = _answers(block, at, level, n, bits, n_slices, rest, True)
        repeat = at[least < ids[block.owners()[at]]]
        edge = np.zeros(len(block.codes) + n + 1, np.int64)
        np.add.at(edge, repeat, 1)
        np.add.at(edge, repeat + n, -1)
        gone = np.cumsum(edge)[: len(block.codes)] > 0
        vocab, out, size = block.vocab, [], 0
        for k, doc_id in enumerate(block.ids):
            a, b = block.starts[k], block.starts[k + 1]
            here = gone[a:b]
            steps = np.flatnonzero(np.diff(np.concatenate([[0], here.view(np.int8), [0]])))
            kept = b" ".join([vocab[c] for c in block.codes[a:b][~here].tolist()])
            out.append((doc_id, int(b - a), int(here.sum()), steps.tolist(), kept.decode()))
            size += len(kept)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, spans, kept``.

    Words are runs without blank, tab, line feed, vertical tab, form feed and carriage return.
    A word is removed if a window of ``window`` words of its document covers it whose words
    also follow one another in a document with a smaller id; windows are judged on the input.
    ``spans`` are starts and stops (exclusive, in words) of what is removed, ``kept`` is the
    remaining words joined by one blank.

    A null or empty text has no words; a document shorter than a window loses none. A row with
    a null id counts as larger than all others. Rows that repeat an id do not remove each
    other's words. An empty table gives an empty result. Other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n_slices, total = slices_of(rows, "text")
    n = partitions_of(docs.sparkSession, total)
    lengths = levels(window)
    # A short key tells most windows apart: collisions only let a candidate through.
    widths = [min(64, total.bit_length() + 4)] * (len(lengths) - 1) + [64]
    last = len(lengths) == 1
    found = settle(
        rows.mapInArrow(partial(_first_level, n=lengths[0], bits=widths[0], n_slices=n_slices, last=last), EXCHANGE),
        "windows",
    )
    blocks = found.filter(F.col("slice") == _BLOCK)
    for level in range(len(lengths) - 1):
        mask, requests = found.filter(F.col("slice") == _MASK), found.filter("slice >= 0")
        grow = partial(
            _next_level, level=level, n=lengths[level], longer=lengths[level + 1],
            bits=(widths[level], widths[level + 1]), n_slices=n_slices, last=level + 2 == len(lengths),
        )
        found = settle(by_block(n, blocks, mask, answer(requests, _merge_flags, n)).mapInArrow(grow, EXCHANGE), "windows")
    end = partial(_without_repeats, level=len(lengths) - 1, n=window, bits=64, n_slices=n_slices)
    mask, requests = found.filter(F.col("slice") == _MASK), found.filter("slice >= 0")
    return by_block(n, blocks, mask, answer(requests, _merge_ids, n)).mapInArrow(
        end, "doc_id long, n_words long, n_removed long, spans array<int>, kept string"
    )


def repeats_digest(docs: DataFrame) -> DataFrame:
    """``remove_repeats`` with a digest in place of spans and text."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
