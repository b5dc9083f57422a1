"""Language-model scores from a weighted backoff automaton.

States are word histories (one word, the start of a text, or nothing). A state has an arc with a
log-probability for every word seen after it in training, and a failure arc whose weight is what
the state leaves for the rest. A text is scored in one traversal from left to right that
carries the state and adds up weights.

The model has an entry for every pair of words in the training texts, so it grows with the corpus
and is never held in one place. Each task packs its documents into blocks and asks, by hashed and
sorted keys, for the counts of the words and pairs that occur in a block; a slice of the key
space adds up all blocks' training counts and answers in the order of the keys. A block then
builds the part of the automaton that its own texts can reach.

    p(w)     = (1 - g0) c(w) / N          for known words, g0 for the class of unknown ones
    p(w | h) = (1 - g) c(h w) / c(h) + g p(w)

``g`` depends on the size of ``c(h)`` and is the leave-one-out rate of unseen followers: the share
of occurrences in contexts seen once more often whose pair occurs only there. ``g0`` is the
rate of words that occur once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.scratch import settle
from .common import (
    EXCHANGE, Block, answer, blocks_of, by_block, cut_by_slice, exchange_batches, mix, mod_of_id, pack, pack_sorted,
    partitions_of, prepare, runs, slices_of, unpack, unpack_sorted,
)

#: Documents whose crc32 of the id has this remainder are held out of training.
FOLDS, HELD_OUT = 7, 2
#: Words of a block; the automaton of a block has an arc for each of its distinct pairs.
BLOCK_WORDS = 700_000
_BLOCK = -1
# Keys of the end of a text and of its start; no word has them, as words are not empty and have no blank.
_END, _START = xxhash.xxh64_intdigest(b""), xxhash.xxh64_intdigest(b" ")
_CLASSES = 80


def count_class(c: np.ndarray) -> np.ndarray:
    """Contexts of 1 to 8 occurrences stand for themselves, larger ones by powers of two."""
    return np.where(c <= 8, c, 5 + np.floor(np.log2(np.maximum(c, 1))).astype(np.int64))


class _Texts:
    """A block's texts as keys: ``tokens`` follow ``contexts``; places point into the sorted ``keys``."""

    def __init__(self, block: Block):
        keys = np.append(block.keys(), np.array([_END, _START], np.uint64))
        order = np.argsort(keys)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        self.ids, self.starts, self.held, self.keys = block.ids, block.starts, np.array(block.extra, bool), keys[order]
        self.words = place[block.codes]
        self._arrange()

    def _arrange(self):
        self.end, self.start = (int(np.searchsorted(self.keys, np.uint64(k))) for k in (_END, _START))
        n = np.diff(self.starts)
        self.bounds = np.concatenate([[0], np.cumsum(n + 1)])
        self.tokens = np.full(self.bounds[-1], self.end)
        self.contexts = np.full(self.bounds[-1], self.start)
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(self.words)) + doc
        self.tokens[at] = self.words
        self.contexts[at + 1] = self.words
        self.learn = np.repeat(~self.held, n + 1)

    def pairs(self):
        """Distinct pairs in the order of their keys: keys, contexts, words and training counts in the block."""
        size = len(self.keys)
        code, place = np.unique(self.contexts * size + self.tokens, return_inverse=True)
        counts = np.bincount(place, self.learn, len(code)).astype(np.int64)
        context, word = code // size, code % size
        keys = mix(self.keys[context] * np.uint64(0x9E3779B97F4A7C15) + self.keys[word])
        order = np.argsort(keys)
        return keys[order], context[order], word[order], counts[order]

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens, self.learn, len(self.keys)).astype(np.int64)

    def context_counts(self) -> np.ndarray:
        return np.bincount(self.contexts, self.learn, len(self.keys)).astype(np.int64)

    def dump(self) -> bytes:
        return Block(self.ids, self.starts, self.words, [], [pack_sorted(self.keys), self.held]).dump()

    @staticmethod
    def load(data: bytes) -> _Texts:
        block, texts = Block.load(data), _Texts.__new__(_Texts)
        texts.ids, texts.starts, texts.words = block.ids, block.starts, block.codes
        texts.keys, texts.held = unpack_sorted(block.extra[0], np.uint64), block.extra[1]
        texts._arrange()
        return texts


def _requests(number: int, keys: np.ndarray, counts: np.ndarray, n_slices: int, first: int):
    for k, (a, b) in cut_by_slice(keys, 64, n_slices).items():
        part = pack_sorted(keys[a:b])
        yield number, first + k, len(part).to_bytes(4, "little") + part + pack(counts[a:b])


def _merge(requests: list[bytes]) -> list[bytes]:
    """Training counts of each request's keys, added over all blocks."""
    keys, counts = [], []
    for r in requests:
        n = int.from_bytes(r[:4], "little")
        keys.append(unpack_sorted(r[4 : 4 + n], np.uint64))
        counts.append(unpack(r[4 + n :], np.int64))
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, np.concatenate(counts))
    total, out, at = total[place], [], 0
    for k in keys:
        out.append(pack(total[at : at + len(k)]))
        at += len(k)
    return out


def _pack_blocks(batches: Iterator[pa.RecordBatch]):
    def rows():
        for number, block in blocks_of(batches, TaskContext.get().partitionId(), bytes.lower, "held", BLOCK_WORDS):
            yield number, _BLOCK, _Texts(block).dump()

    return exchange_batches(rows())


def _ask(batches: Iterator[pa.RecordBatch], n_slices: int):
    def rows():
        for number, group in runs(batches, "block"):
            texts = _Texts.load(group[0]["data"])
            # The start is a context only: its count is asked for among the words.
            counts = texts.word_counts()
            counts[texts.start] = texts.context_counts()[texts.start]
            yield from _requests(number, texts.keys, counts, n_slices, 0)
            keys, _, _, counts = texts.pairs()
            yield from _requests(number, keys, counts, n_slices, n_slices)

    return exchange_batches(rows())


def _counts(group: list[dict], keys: np.ndarray, n_slices: int, first: int) -> np.ndarray:
    bounds, out = cut_by_slice(keys, 64, n_slices), np.zeros(len(keys), np.int64)
    for row in group:
        k = row["slice"] - first
        if 0 <= k < n_slices:
            out[slice(*bounds[k])] = unpack(row["data"], np.int64)
    return out


def _opened(group: list[dict], n_slices: int):
    """A block's texts, its pairs, and the corpus counts of its words and pairs."""
    texts = _Texts.load(group[0]["data"])
    pairs = texts.pairs()
    return texts, pairs, _counts(group[1:], texts.keys, n_slices, 0), _counts(group[1:], pairs[0], n_slices, n_slices)


def _statistics(batches: Iterator[pa.RecordBatch], n_slices: int):
    """Sums over blocks: tokens, distinct words, words seen once; followers and new followers by class.

    A key of ``c`` occurrences, ``b`` of them in a block, adds ``b / c`` there, so one over all blocks.
    """
    for _, group in runs(batches, "block"):
        texts, (_, context, _, in_block), words, pairs = _opened(group, n_slices)
        mine = texts.word_counts()
        seen = mine > 0
        rows = [(0, 0, mine.sum()), (1, 0, (mine[seen] / words[seen]).sum()), (2, 0, mine[words == 1].sum())]
        followers = texts.context_counts()
        for c in (3, 4):
            # One occurrence is left out, so a context of c occurrences speaks for those of c - 1.
            kind = count_class(np.maximum(words - 1, 0))
            if c == 3:
                sums = np.bincount(kind, followers, _CLASSES)
            else:
                sums = np.bincount(kind[context], in_block * (pairs == 1), _CLASSES)
            rows += [(c, k, sums[k]) for k in range(1, _CLASSES)]
        kinds, classes, values = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.int32()), pa.array(classes, pa.int32()), pa.array(values, pa.float64())],
            names=["kind", "class", "value"],
        )


class BackoffAutomaton:
    """The part of the model that a set of words and pairs can reach.

    ``root`` are the arcs of the empty history, ``arcs`` those of a word's state by state and
    word, ``fail`` the weights of the failure arcs to the root; a word never seen in training has no
    state, and leads to the root.
    """

    def __init__(self, words: np.ndarray, pairs, pair_counts: np.ndarray, end: int, model: dict):
        n, g0, g = model["tokens"], model["new"], model["unseen"]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(words > 0, (1 - g0) * words / max(n, 1), g0)
            leave = g[count_class(words)]
            _, context, word, _ = pairs
            seen = pair_counts > 0
            context, word, c = context[seen], word[seen], pair_counts[seen]
            arc = np.log10((1 - leave[context]) * c / words[context] + leave[context] * p[word])
        self.size = len(words)
        self.root = np.log10(p).tolist()
        self.fail = np.log10(leave).tolist()
        self.arcs = dict(zip((context * self.size + word).tolist(), arc.tolist()))
        self.state = [k if c > 0 and k != end else -1 for k, c in enumerate(words.tolist())]

    def score(self, tokens: list[int], start: int) -> float:
        """Log10 probability of a token sequence that begins in the state of ``start``."""
        arcs, root, fail, states, size = self.arcs, self.root, self.fail, self.state, self.size
        total, state = 0.0, states[start]
        for t in tokens:
            if state < 0:
                total += root[t]
            else:
                weight = arcs.get(state * size + t)
                total += fail[state] + root[t] if weight is None else weight
            state = states[t]
        return total


def _scores(batches: Iterator[pa.RecordBatch], n_slices: int, model: dict):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
         ("base_score", pa.float64()), ("score", pa.float64())]
    )
    for _, group in runs(batches, "block"):
        texts, pairs, words, pair_counts = _opened(group, n_slices)
        automaton = BackoffAutomaton(words, pairs, pair_counts, texts.end, model)
        del group, pairs, pair_counts  # as large as the automaton
        base = np.log10((words + 1) / (model["tokens"] + 1 * (model["distinct"] + 1)))
        sums = np.add.reduceat(base[texts.tokens], texts.bounds[:-1])
        known = np.add.reduceat((words[texts.tokens] > 0).astype(np.int64), texts.bounds[:-1])
        scores = [automaton.score(texts.tokens[a:b].tolist(), texts.start) for a, b in zip(texts.bounds[:-1], texts.bounds[1:])]
        columns = texts.ids, texts.held, np.diff(texts.bounds), known, sums, scores
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _model(statistics: DataFrame) -> dict:
    """The model's numbers that do not depend on words: a bounded table of sums."""
    sums = {(r["kind"], r["class"]): r["value"] for r in statistics.groupBy("kind", "class").agg(F.sum("value").alias("value")).collect()}
    tokens, distinct, once = (sums.get((k, 0), 0.0) for k in range(3))
    unseen = np.ones(_CLASSES)
    rate = 0.5
    for k in range(1, _CLASSES):
        followers, new = sums.get((3, k), 0.0), sums.get((4, k), 0.0)
        # A class without examples takes the rate of the class below.
        rate = unseen[k] = (new + 1) / (followers + 2) if followers else rate
    return {"tokens": int(tokens), "distinct": round(distinct), "new": (once + 1) / (tokens + 2), "unseen": unseen}


def score_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", held: Column | None = None) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are runs without blank, tab, line feed, vertical tab, form feed and carriage return,
    with A-Z lower-cased, then one end. ``held`` says which documents the model does not
    learn from (by default those whose crc32 of the id, modulo 7, is 2). ``base_score`` adds
    up log10((c + 1) / (N + V + 1)); ``score`` is the log10 probability under the automaton.

    A null or empty text is its end alone. A null id counts as the empty text for the crc32. Rows
    that repeat a document are learnt from and scored each. Without training documents all words
    are unknown and have the same probability. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
        F.coalesce(mod_of_id(doc_id, FOLDS) == HELD_OUT if held is None else held, F.lit(False)).alias("held"),
    )
    n_slices, total = slices_of(rows, "text")
    n = partitions_of(docs.sparkSession, total)
    blocks = settle(rows.mapInArrow(_pack_blocks, EXCHANGE), "texts")
    asked = blocks.mapInArrow(partial(_ask, n_slices=n_slices), EXCHANGE)
    answers = settle(answer(asked, _merge, n), "counts")
    grouped = by_block(n, blocks, answers)
    model = _model(grouped.mapInArrow(partial(_statistics, n_slices=n_slices), "kind int, class int, value double"))
    scored = grouped.mapInArrow(
        partial(_scores, n_slices=n_slices, model=model),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return scored.withColumn("train_tokens", F.lit(model["tokens"]).cast("long"))
