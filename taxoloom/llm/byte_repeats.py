"""Repeated byte strings, found with run-compressed Burrows-Wheeler indexes of what repeats.

A window of ``WINDOW`` bytes is known by its anchor: of its strings of ``SEED`` bytes the one with the
smallest hash. Windows that are equal have equal anchors at equal places, so neighbours with one anchor
travel as one short text, and only if the anchor occurs again anywhere (a keyed exchange of sorted hashes
tells). A block of documents sends each distinct short text once, to the part of its anchor's hash.

A part adds up equal texts and builds the Burrows-Wheeler transform of what is left, as runs of equal
letters. Only where a run begins, the place in the text is sampled and its match with the neighbour above
measured; from sample to sample the match of each following place is shorter by one, so all matching
statistics come from one stream over the text. Rows whose matches reach a window's length in a row are
occurrences of one string, and the earliest document and place among them is the one that stays.

Anchors that occur more often than ``HOT`` are replaced by the windows themselves: each window is a
text of its own and equal ones leave a task once, so no anchor gathers the neighbourhoods of a
passage that a third of all documents hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..plans.scratch import settle
from .blocks import (
    BLOCK_BYTES, ROWS, counted, distinct_runs, dump, joined, load, partitions_for, row_batches, spread, streamed, summed,
    table_batches, text_blocks, text_total,
)
from .common import mix, prepare

WINDOW = 100
#: Bytes of an anchor.
SEED = 40
#: Occurrences of an anchor from which its windows are sent one by one.
HOT = 50_000
#: Bytes of text whose anchors meet in one part of the exchange, and in one index.
BYTES_PER_PART, BYTES_PER_INDEX = 64 << 20, 4 << 20

_TEXT, _STATE = -2, -1
_UNIQUE, _REPEATED, _OFTEN = 0, 1, 2
_CHUNK = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)
_LAST = np.iinfo(np.int64).max
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hashes(buf: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each string of ``n`` bytes, from hashes of halves."""
    h, size = mix((buf.astype(np.uint64) + np.uint64(1)) * _ODD), 1
    while size < n:
        step = min(size, n - size)
        h = h[:-step] * _ODD ^ h[step:]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        size += step
    return h


def _least(h: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while size < n:
        step = min(size, n - size)
        h = np.minimum(h[:-step], h[step:])
        size += step
    return h


def anchored(buf: np.ndarray, starts: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, hash of the anchor."""
    alive = np.ones(len(buf), bool)
    short = np.maximum(starts[1:] - window + 1, starts[:-1])
    alive[spread(short, starts[1:] - short)] = False
    ats, sizes, keys = [], [], []
    for c in range(0, max(len(buf) - window + 1, 0), _CHUNK):
        h = _hashes(buf[c : c + _CHUNK + window - 1], seed)
        # Equal hashes: the leftmost place.
        place = _least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), window - seed + 1) & _PLACE
        live = alive[c : c + len(place)]
        place = np.where(live, place.astype(np.int64), -1)
        first = np.flatnonzero(np.diff(place, prepend=-2))
        length = np.diff(np.append(first, len(place)))
        keep = place[first] >= 0
        ats.append(first[keep] + c)
        sizes.append(length[keep])
        keys.append(h[place[first[keep]]])
    if not ats:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(ats), np.concatenate(sizes), mix(np.concatenate(keys))


def _part(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _asked(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct short keys of a block's anchors and their counts; order and parts are those of the keys."""
    return counted(keys >> np.uint64(64 - bits))


def _first(batches, window: int, seed: int, bits: int, n_parts: int, most_bytes: int):
    def rows():
        for number, ids, texts, _ in text_blocks(batches, TaskContext.get().partitionId(), most_bytes):
            buf, starts = joined(texts, b"")
            ids = np.array([_LAST if i is None else i for i in ids], np.int64), np.array([i is None for i in ids])
            yield number, _TEXT, dump(ids[0], ids[1].tobytes(), starts, zstandard.ZstdCompressor(level=6).compress(buf.tobytes()))
            short, times = _asked(anchored(buf, starts, window, seed)[2], bits)
            part = _part(short << np.uint64(64 - bits), n_parts)
            cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
            for x, y in zip(cuts[:-1], cuts[1:]):
                yield number, int(part[x]), dump(np.diff(short[x:y], prepend=np.uint64(0)), times[x:y].astype(np.int32))

    return row_batches(rows())


def _count(batches, hot: int):
    """Whether the anchors of a part are unique, repeated or hot, for each block that asks."""

    def answers(part: int, asked: list):
        opened = [(np.cumsum(k, dtype=np.uint64), t.astype(np.int64)) for k, t in (load(data) for _, data in asked)]
        keys, total = summed([k for k, _ in opened], [t for _, t in opened])
        state = np.where(total > hot, _OFTEN, np.where(total > 1, _REPEATED, _UNIQUE)).astype(np.uint8)
        for (block, _), (own, _) in zip(asked, opened):
            yield block, part, dump(state[np.searchsorted(keys, own)].tobytes())

    return row_batches(_by_part(batches, answers))


def _by_part(batches, answers):
    at, held = None, []
    for row in streamed(batches):
        if row["part"] != at and held:
            yield from answers(at, held)
            held = []
        at = row["part"]
        held.append((row["block"], row["data"]))
    if held:
        yield from answers(at, held)


class _Block:
    """The short texts of a block: ``at``, ``size`` and ``code`` of each run, and the distinct texts."""

    def __init__(self, data: bytes):
        self.ids, nulls, self.starts, text = load(data)
        self.nulls = np.frombuffer(nulls, bool)
        self.buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)

    def choose(self, states: dict[int, bytes], window: int, seed: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs that are sent: all windows of repeated anchors, and the single windows of hot ones."""
        at, size, keys = anchored(self.buf, self.starts, window, seed)
        short, _ = _asked(keys, bits)
        state = np.frombuffer(b"".join(states[p] for p in sorted(states)), np.uint8)
        state = state[np.searchsorted(short, keys >> np.uint64(64 - bits))]
        often = state == _OFTEN
        alone = spread(at[often], size[often])
        same = state == _REPEATED
        at, size, keys = at[same], size[same], keys[same]
        if len(alone):
            single = np.array([xxhash.xxh64_intdigest(self.buf[i : i + window]) for i in alone.tolist()], np.uint64)
            at, size, keys = np.append(at, alone), np.append(size, np.ones(len(alone), np.int64)), np.append(keys, single)
        return at, size, keys

    def texts(self, at: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Code of each run's text, the distinct texts, and the earliest run of each."""
        owner = np.searchsorted(self.starts, at, "right") - 1
        doc, place = self.ids[owner], at - self.starts[owner]
        order = np.lexsort((place, doc))
        codes = np.empty(len(at), np.int64)
        named: dict[bytes, int] = {}
        first: list[int] = []
        # A bounded number of runs is laid out at a time.
        for c in range(0, len(order), 1 << 15):
            runs = order[c : c + (1 << 15)]
            laid = self.buf[spread(at[runs], size[runs] + window - 1)]
            own, texts = distinct_runs(laid, np.cumsum(size[runs] + window - 1) - (size[runs] + window - 1))
            number = np.empty(len(texts), np.int64)
            earliest = runs[np.unique(own, return_index=True)[1]].tolist()
            for k, t in enumerate(texts):
                number[k] = named.setdefault(t, len(named))
                if number[k] == len(first):
                    first.append(earliest[k])
            codes[runs] = number[own]
        return codes, list(named), np.array(first, np.int64)


def _send(batches, window: int, seed: int, bits: int, n_index: int):
    def block(number: int, data: bytes, states: dict[int, bytes]):
        here = _Block(data)
        at, size, keys = here.choose(states, window, seed, bits)
        codes, texts, first = here.texts(at, size, window)
        owner = np.searchsorted(here.starts, at[first], "right") - 1
        doc, place = here.ids[owner], at[first] - here.starts[owner]
        part = _part(keys[first], n_index)
        order = np.argsort(part, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order))
        for x, y in zip(cuts[:-1], cuts[1:]):
            some = order[x:y]
            chosen = [texts[k] for k in some.tolist()]
            packed = zstandard.ZstdCompressor(level=3).compress(b"".join(chosen))
            yield number, int(part[some[0]]), dump(size[first[some]].astype(np.int32), packed, doc[some], place[some])

    return row_batches(_by_block(batches, block))


def _by_block(batches, block):
    at, text, answered = None, None, {}
    for row in streamed(batches):
        if row["part"] == _TEXT:
            if text is not None:
                yield from block(at, text, answered)
            at, text, answered = row["block"], row["data"], {}
        else:
            answered[row["part"]] = load(row["data"])[0]
    if text is not None:
        yield from block(at, text, answered)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of a text of small integers in order, by doubling; only open groups are sorted again."""
    n = len(text)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(6):
        key = key * 512 + padded[k : k + n]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = head
    depth = 6
    rows = np.flatnonzero(~new | ~np.append(new[1:], True))
    while len(rows):
        at = order[rows]
        key = rank[at] << 32 | (rank[np.minimum(at + depth, n)] + 1)
        again = np.argsort(key)
        at, key = at[again], key[again]
        order[rows] = at
        new = np.ones(len(rows), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        rows = rows[~new | ~np.append(new[1:], True)]
        depth *= 2
    return order


class RunIndex:
    """Burrows-Wheeler transform of several texts as runs, with places and matches sampled at run starts.

    ``order`` is the suffix order it is read from; ``heads`` are the rows where a run begins, ``letters``
    what precedes the suffixes of a run, ``places`` where the text is sampled and ``matches`` the match
    there with the suffix above.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.starts = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.int16)
        flat[spread(self.starts, sizes - 1)] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
        self.text, self.sizes = flat, sizes
        self.order = suffix_order(flat)
        before = flat[self.order - 1]
        # The first suffix of the whole text has nothing before it and is a run of its own.
        before[self.order == 0] = -1
        self.heads = np.flatnonzero(np.diff(before, prepend=-2))
        self.letters = before[self.heads]
        self.places = self.order[self.heads]
        above = self.order[np.maximum(self.heads - 1, 0)]
        self.matches = self._match(self.places[1:], above[1:])
        self.matches = np.append(0, self.matches)

    def _match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at ``a`` and ``b``."""
        n, out = len(self.text), np.zeros(len(a), np.int64)
        padded = np.concatenate([self.text, np.arange(-4, 0, dtype=np.int16)])
        # Four letters at a time as long as all four agree, then the last ones one by one.
        fours = np.lib.stride_tricks.sliding_window_view(padded, 4).copy().view(np.int64).reshape(-1)
        live = np.flatnonzero(np.maximum(a, b) + 4 <= n)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            live = live[(np.maximum(x, y) + 4 <= n) & (fours[np.minimum(x, n)] == fours[np.minimum(y, n)])]
            out[live] += 4
            live = live[out[live] < n]
        live = np.arange(len(a))
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            inside = np.maximum(x, y) < n
            live, x, y = live[inside], x[inside], y[inside]
            same = padded[x] == padded[y]
            out[live[same]] += 1
            live = live[same]
        return out

    def matching(self) -> np.ndarray:
        """For each place of the text, its match with the suffix above: a stream from sample to sample."""
        at = np.argsort(self.places)
        places, matches = self.places[at], self.matches[at]
        last = np.zeros(len(self.text), np.int64)
        last[places] = np.arange(len(places))
        last = np.maximum.accumulate(last)
        here = np.arange(len(self.text)) - places[last]
        return np.maximum(matches[last] - here, 0)

    def earliest(self, value: np.ndarray, window: int) -> np.ndarray:
        """For each place, the least ``value`` of the places with the same ``window`` letters."""
        head = np.flatnonzero(self.matching()[self.order] < window)
        least = np.minimum.reduceat(value[self.order], head)
        out = np.empty(len(value), np.int64)
        out[self.order] = np.repeat(least, np.diff(np.append(head, len(value))))
        return out


def _mark(batches, window: int):
    """For each text that a block sent, which of its windows also start earlier."""

    def answers(part: int, asked: list):
        opened, named = [], {}
        for _, data in asked:
            size, packed, doc, place = load(data)
            flat, stops = zstandard.ZstdDecompressor().decompress(packed), np.cumsum(size.astype(np.int64) + window - 1).tolist()
            texts = [flat[x:y] for x, y in zip([0, *stops[:-1]], stops)]
            codes = np.fromiter((named.setdefault(t, len(named)) for t in texts), np.int64, len(texts))
            opened.append((size.astype(np.int64), codes, doc, place))
        docs = np.unique(np.concatenate([d for _, _, d, _ in opened]))
        # Documents by rank and places share one number.
        spots = [np.searchsorted(docs, d) << 32 | p for _, _, d, p in opened]
        spot = np.full(len(named), _LAST)
        for (_, codes, _, _), own in zip(opened, spots):
            np.minimum.at(spot, codes, own)
        index = RunIndex(list(named))
        offset = np.arange(len(index.text)) - np.repeat(index.starts, index.sizes)
        value = np.repeat(spot, index.sizes) + offset
        value[offset + window >= np.repeat(index.sizes, index.sizes)] = _LAST
        least = index.earliest(value, window)
        for (block, _), (size, codes, _, _), own in zip(asked, opened, spots):
            mine = np.repeat(own, size) + spread(np.zeros(len(size), np.int64), size)
            yield block, part, dump(np.packbits(least[spread(index.starts[codes], size)] < mine).tobytes())

    return row_batches(_by_part(batches, answers))


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())]
)


def _without(batches, window: int, seed: int, bits: int, n_index: int):
    def block(number: int, data: bytes, answered: dict[int, bytes]):
        here = _Block(data)
        # States come under the numbers of their parts, answers of the indexes under those below the text's.
        states = {p: v for p, v in answered.items() if p >= 0}
        marks = {-3 - p: v for p, v in answered.items() if p < 0}
        at, size, keys = here.choose(states, window, seed, bits)
        codes, texts, first = here.texts(at, size, window)
        part = _part(keys[first], n_index)
        order = np.argsort(part, kind="stable")
        width = size[first]
        offset = np.zeros(len(first), np.int64)
        flags = []
        total = 0
        cuts = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order))
        for x, y in zip(cuts[:-1], cuts[1:]):
            some = order[x:y]
            n = int(width[some].sum())
            flags.append(np.unpackbits(np.frombuffer(marks[int(part[some[0]])], np.uint8), count=n))
            offset[some] = total + np.cumsum(width[some]) - width[some]
            total += n
        flags = np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool)
        owner = np.searchsorted(here.starts, at, "right") - 1
        doc, place = here.ids[owner], at - here.starts[owner]
        # A text that the block holds earlier is a repeat as a whole.
        later = (doc != doc[first[codes]]) | (place != place[first[codes]])
        gone = flags[spread(offset[codes], size)] | np.repeat(later, size)
        edge = np.zeros(len(here.buf) + window + 1, np.int32)
        starts = spread(at, size)[gone]
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
        removed = np.cumsum(edge)[: len(here.buf)] > 0
        for k, (doc_id, null) in enumerate(zip(here.ids.tolist(), here.nulls.tolist())):
            a, b = here.starts[k], here.starts[k + 1]
            out = removed[a:b]
            steps = np.flatnonzero(np.diff(out.view(np.int8), prepend=0, append=0))
            yield None if null else doc_id, int(b - a), int(out.sum()), steps.tolist(), here.buf[a:b][~out].tobytes()

    return table_batches(_by_block(batches, block), _SCHEMA)


def remove_byte_repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, seed: int = SEED, hot: int = HOT,
    block_bytes: int = BLOCK_BYTES, index_bytes: int = BYTES_PER_INDEX,
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, spans, kept``.

    A byte of a text (in UTF-8) is removed if ``window`` bytes of its document cover it that also start
    earlier: in a document with a smaller id, or in the same document at an earlier place, overlaps
    included. Windows never cross documents and are judged on the input. ``spans`` are starts and stops
    (exclusive, in bytes) of maximal removed runs; ``kept`` are the other bytes, which need not be whole
    characters.

    A null or empty text has no bytes; one shorter than a window loses none. A row with a null id comes after
    all others, such rows among each other by place. Rows that share an id count as one document: only what starts
    at a smaller place in one of them removes from another. An empty table gives no rows. Other columns are
    not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = text_total(rows)
    n, n_parts, n_index = partitions_for(docs, total), max(1, -(-total // BYTES_PER_PART)), max(1, -(-total // index_bytes))
    # A short key tells most anchors apart; two with one key only let a candidate through.
    bits = min(64, total.bit_length() + 6)
    found = settle(
        rows.mapInArrow(partial(_first, window=window, seed=seed, bits=bits, n_parts=n_parts, most_bytes=block_bytes), ROWS), "anchors"
    )
    asked = found.filter("part >= 0").repartition(min(n, n_parts), "part").sortWithinPartitions("part", "block")
    states = settle(asked.mapInArrow(partial(_count, hot=hot), ROWS), "states")
    base = found.filter(F.col("part") == _TEXT).unionByName(states)
    layout = {"window": window, "seed": seed, "bits": bits, "n_index": n_index}
    sent = base.repartition(n, "block").sortWithinPartitions("block", "part").mapInArrow(partial(_send, **layout), ROWS)
    marks = sent.repartition(min(n_index, 4 * n), "part").sortWithinPartitions("part", "block").mapInArrow(partial(_mark, window=window), ROWS)
    back = base.unionByName(marks.withColumn("part", -3 - F.col("part")))
    is_text = (F.col("part") == _TEXT).cast("int")
    return back.repartition(n, "block").sortWithinPartitions("block", F.desc(is_text), "part").mapInArrow(
        partial(_without, **layout), "doc_id long, n_bytes long, n_removed long, spans array<long>, kept binary"
    )


def byte_repeats_digest(docs: DataFrame) -> DataFrame:
    """``remove_byte_repeats`` with counts and a digest in place of spans and bytes."""
    return remove_byte_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
