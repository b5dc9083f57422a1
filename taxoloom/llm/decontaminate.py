"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' word sequences go into one automaton per shard of items; a shard holds a bounded
number of words, so each automaton has a proven size and is sent to every task. Documents
are streamed once through each shard's automaton inside the same stage: the state after a word
knows the longest match that ends there. No document is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import prepare, text_bytes, without_ids

#: Words of a window.
WINDOW = 13
#: Words of the items in one automaton; an item that is longer by itself gets its own.
SHARD_WORDS = 500_000
#: Share of a document's words, in parts of 100, from which it is contaminated.
COVERAGE_PERCENT = 5

# Letters and digits are kept in lower case, bytes of other characters as they are; the rest parts words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

_STATE = "doc_id long, n_words long, spans array<int>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(_FOLD).split()


class ItemAutomaton:
    """Suffix automaton of several word sequences, and which windows its states stand for.

    ``step`` holds the arcs of each state, ``length`` its longest match and ``link`` the state
    of its longest proper suffix with other continuations. ``full`` names the items of a state
    that stands for a window, ``short`` those of an item that is shorter than a window.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        self.shortest = min([window, *(len(codes) for _, codes in coded if codes)])
        for name, codes in coded:
            state = 0
            for i, c in enumerate(codes):
                state = self.step[state][c]
                if i + 1 >= window:
                    # The window is a suffix of what was read: go to the state that covers its length.
                    while self.length[self.link[state]] >= window:
                        state = self.link[state]
                    self.full.setdefault(state, set()).add(name)
            if 0 < len(codes) < window:
                self.short.setdefault(state, (len(codes), set()))[1].add(name)
        # The next state on the way to the root that ends a short item, itself included.
        self.ends = [-1] * len(self.step)
        for s in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            self.ends[s] = s if s in self.short else self.ends[self.link[s]]

    def _new(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.step) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of ``q`` for the matches that are no longer than by one word from ``p``."""
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = copy
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words inside occurrences of windows, and the items of these windows."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if len(words) < self.shortest:
            return spans, items
        codes = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        # A match lies within a run of words that items have; shorter runs hold no window.
        gaps = np.flatnonzero(codes < 0)
        starts = np.concatenate([[0], gaps + 1])
        stops = np.append(gaps, len(codes))
        for i in np.flatnonzero(stops - starts >= self.shortest):
            self._scan_run(codes[starts[i] : stops[i]].tolist(), int(starts[i]), spans, items)
        return _merged(spans), items

    def _scan_run(self, codes: list[int], at: int, spans: list, items: set[str]) -> None:
        step, length, link, window = self.step, self.length, self.link, self.window
        state = matched = 0
        for i, c in enumerate(codes, at + 1):
            to = step[state].get(c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = step[state].get(c)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= window:
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                items |= self.full[s]
                spans.append((i - window, i))
            s = self.ends[state]
            while s > 0:
                n, names = self.short[s]
                if n <= matched:
                    items |= names
                    spans.append((i - n, i))
                s = self.ends[link[s]]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _scanner(shared: Broadcast, first: bool, last: bool):
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]
    schema = pa.schema(fields if last else [*fields, ("text", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            counts, spans, items = [], [], []
            for text in text_bytes(batch.column("text")):
                words = words_of(text)
                found, names = automaton.scan(words)
                counts.append(len(words))
                spans.append([x for span in found for x in span])
                items.append(sorted(names))
            if not first:
                before = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                for k, (old, names) in enumerate(zip(*before)):
                    pairs = [*zip(old[::2], old[1::2]), *zip(spans[k][::2], spans[k][1::2])]
                    spans[k] = [x for span in _merged(pairs) for x in span]
                    items[k] = sorted({*names, *items[k]})
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()),
                       pa.array(spans, schema.field("spans").type), pa.array(items, schema.field("items").type)]
            columns += [] if last else [batch.column("text").cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return scan


def _automata(items: DataFrame, window: int, shard_words: int) -> list[Broadcast]:
    """Automata over shards of items; each shard is collected alone and holds a bounded number of words."""
    sc = items.sparkSession.sparkContext
    sized = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"),
        F.col("text"),
        (F.octet_length("text") / 2 + 1).alias("most_words"),
    ).filter("text IS NOT NULL")
    total = sized.agg(F.sum("most_words")).first()[0] or 0
    shards = int(max(1, -(-total // shard_words)))
    number = F.pmod(F.xxhash64("name", "text"), F.lit(shards))
    found = []
    for k in range(shards):
        rows = sized.filter(number == k).orderBy("name", "text").collect()
        pairs = [(r["name"], words) for r in rows if (words := words_of(r["text"].encode()))]
        if pairs or k == 0:
            found.append(sc.broadcast(ItemAutomaton(pairs, window)))
    return found


def contamination(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    window: int = WINDOW,
    percent: int = COVERAGE_PERCENT,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, spans, items, n_hit, contaminated``.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z
    lower-cased. A window is ``window`` consecutive words of an item; an item with fewer words
    is one window. ``spans`` are the starts and stops (exclusive, in words) of what lies
    inside occurrences of windows, ``items`` the sorted ids of items with occurring windows.
    A document is contaminated if some word is hit and hits are at least ``percent`` of 100
    of its words.

    A null or empty text has no words and no hits. Items without words are ignored; an item
    with a null id hits like any other and is listed as the empty text; repeated items count once.
    Rows that repeat a document are judged each. Empty tables give no rows, or no hits.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    automata = _automata(items, window, shard_words)
    for k, automaton in enumerate(automata):
        last = k + 1 == len(automata)
        rows = rows.mapInArrow(_scanner(automaton, k == 0, last), _STATE if last else f"{_STATE}, text string")
    hit = F.aggregate(
        F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1),
        F.lit(0).cast("long"),
        lambda n, i: n + F.col("spans")[2 * i + 1] - F.col("spans")[2 * i],
    )
    return rows.withColumn("n_hit", F.when(F.size("spans") > 0, hit).otherwise(F.lit(0).cast("long"))).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)
    )


def contamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``contamination`` with counts and digests in place of texts and lists."""
    return contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without contaminated documents; columns as they were.

    Rows that share an id, or have none, go only if all of them are contaminated.
    """
    return without_ids(docs, contamination(docs, items, text, doc_id), F.col("contaminated"), doc_id)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(text_bytes(batch.column("text")), batch.column("spans").to_pylist()):
            words, parts, at = _bounds(text), [], 0
            for first, stop in zip(spans[::2], spans[1::2]):
                parts.append(text[at : words[first][0]])
                at = words[stop - 1][1]
            texts.append(b"".join([*parts, text[at:]]).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"]
        )


def _bounds(text: bytes) -> list[tuple[int, int]]:
    """Byte offsets of the words."""
    gaps = np.frombuffer(b" " + text.translate(_FOLD) + b" ", np.uint8) == 32
    edges = np.flatnonzero(np.diff(gaps)).tolist()
    return list(zip(edges[::2], edges[1::2]))


def without_hits(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, text`` of the documents with hits that are not contaminated, hit words taken out.

    Ids must be unique here, since the texts are found by them.
    """
    found = contamination(docs, items, text, doc_id).filter("n_hit > 0 AND NOT contaminated")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.join(found.select("doc_id", "spans"), "doc_id").mapInArrow(_without, "doc_id long, text string")
