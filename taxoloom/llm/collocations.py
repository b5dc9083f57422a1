"""Collocations: phrases scored against their parts, from suffix subtrees built group by group.

Vertical partitioning in the manner of ERA: word prefixes are grouped by a memory budget, and for each
group one task builds the subtree of all suffixes that begin with its prefixes, cut off at the greatest
phrase length. A prefix that exceeds the budget alone is extended by its next word, and by the one
after that where both words exceed it, and its parts go to groups of their own. The sorted suffixes of
a group are the leaves of its subtree; the count of a phrase is the sum of the leaf totals below
its node. Suffixes of a block of documents are added up before they are sent, so a prefix that is in
every text leaves a task once per distinct continuation.

Words below the least count cannot be part of a candidate. They end a suffix like a mark does.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.scratch import settle
from .blocks import (
    ROWS, counted, distinct_runs, dump, joined, load, partitions_for, row_batches, streamed, table_batches,
    text_blocks, text_total,
)
from .common import mix, prepare

#: Words of the longest phrase.
MOST_WORDS = 3
LEAST_COUNT = 10
#: A phrase goes where a longer one around it has this share of its count, in parts of 100.
CONTAINED_PERCENT = 50
#: Phrases that are listed for each language.
TOP = 2000
#: Shares of a language that are cut to ``TOP`` before they meet.
SHARES = 16
#: Suffixes of the prefixes in one group.
GROUP_SUFFIXES = 500_000
#: Bytes of text that a task holds before it closes a block: its words take a multiple of them.
BLOCK_BYTES = 4 << 20
#: Bytes of text whose words meet in one part of the vocabulary.
BYTES_PER_PART = 16 << 20

_BASE, _TOTALS, _VOCABULARY = -2, -1, -1
_ID, _GROUP = 26, 24  # an id is the number of its part << 26 | rank, a group part << 24 | place

#: Marks that end a piece, and blanks; all else is part of a word.
_MARKS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_FOLD = bytes(10 if b in _MARKS else 32 if b in _BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _words(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Word codes of all texts, the distinct words, and which words begin a piece."""
    buf, _ = joined([t.translate(_FOLD) for t in texts], b"\n")
    visible = (buf != 10) & (buf != 32)
    edges = np.flatnonzero(np.diff(visible.view(np.int8), prepend=0, append=0))
    starts, stops = edges[::2], edges[1::2]
    marks = np.cumsum(buf == 10)[starts]
    codes, named = distinct_runs(buf[visible], np.cumsum(stops - starts) - (stops - starts))
    return codes, named, np.diff(marks, prepend=-1) != 0


def _block_rows(number: int, texts: list[bytes], langs: list[str], n_parts: int) -> Iterator[tuple[int, int, bytes]]:
    codes, begins, entries, totals = [], [], [], []
    of: dict[str, list[bytes]] = {}
    for text, lang in zip(texts, langs):
        of.setdefault(lang, []).append(text)
    for lang, chosen in of.items():
        c, words, b = _words(chosen)
        # A word holds no tab, so the last one parts it from its language.
        codes.append(c + len(entries))
        begins.append(b)
        entries += [lang.encode() + b"\t" + w for w in words]
        totals.append((lang, len(c)))
    codes, begins = np.concatenate(codes), np.concatenate(begins)
    yield number, _TOTALS, dump(totals)
    part = np.fromiter(map(xxhash.xxh64_intdigest, entries), np.uint64, len(entries)) % np.uint64(n_parts)
    order = np.argsort(part, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes, part = rank[codes], part[order].astype(np.int64)
    times = np.bincount(codes, minlength=len(entries))
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=n_parts))
    yield number, _BASE, dump(codes, np.packbits(begins).tobytes(), part[cuts[:-1]], cuts)
    for x, y in zip(cuts[:-1], cuts[1:]):
        yield number, int(part[x]), dump([entries[k] for k in order[x:y]], times[x:y])


def _blocks(batches, n_parts: int, most_bytes: int):
    def rows():
        for number, _, texts, langs in text_blocks(batches, TaskContext.get().partitionId(), most_bytes, extra="lang"):
            yield from _block_rows(number, texts, langs, n_parts)

    return row_batches(rows())


def _vocabulary(batches, least: int, budget: int):
    """Add up the words of a part; give frequent ones an id, a group and a number of splits."""

    def answers(part: int, asked: list[tuple[int, bytes]]):
        opened = [load(data) for _, data in asked]
        coded = pa.array([e for entries, _ in opened for e in entries], pa.binary()).dictionary_encode()
        place = coded.indices.to_numpy()
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, place, np.concatenate([t for _, t in opened]))
        entries = coded.dictionary.to_pylist()
        frequent = sorted(np.flatnonzero(total >= least).tolist(), key=entries.__getitem__)
        mass = total[frequent]
        splits = -(-mass // budget)
        ids = np.zeros(len(entries), np.int64)
        ids[frequent] = (part << _ID) + 1 + np.arange(len(frequent))
        small = np.where(splits > 1, 0, mass)
        group = np.cumsum(small) // budget
        after = int(group[-1]) + 1 if len(group) else 0
        group = np.where(splits > 1, after + np.cumsum(np.where(splits > 1, splits, 0)) - splits, group)
        groups, parted = np.zeros(len(entries), np.int64), np.ones(len(entries), np.int64)
        groups[frequent] = (part << _GROUP) + group
        parted[frequent] = splits
        yield _VOCABULARY, part, dump(ids[frequent], [entries[k] for k in frequent], mass)
        at = 0
        for (block, _), (own, _) in zip(asked, opened):
            here = place[at : at + len(own)]
            at += len(own)
            yield block, part, dump(ids[here], groups[here], parted[here])

    def rows():
        at, held = None, []
        for row in streamed(batches):
            if row["part"] != at and held:
                yield from answers(at, held)
                held = []
            at = row["part"]
            held.append((row["block"], row["data"]))
        if held:
            yield from answers(at, held)

    return row_batches(rows())


def _suffixes(codes: np.ndarray, begins: np.ndarray, n: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of up to ``depth`` words as rows of codes (0 after their end), and their counts.

    ``codes`` holds 1 … n, or 0 for words that end a run; a run also ends before a word of ``begins``.
    """
    at = np.flatnonzero(codes)
    columns, alive = [codes[at]], np.ones(len(at), bool)
    longer = np.append(codes, np.zeros(depth, np.int64))
    ends = np.append(begins, np.ones(depth, bool))
    for d in range(1, depth):
        alive = alive & ~ends[at + d] & (longer[at + d] > 0)
        columns.append(np.where(alive, longer[at + d], 0))
    # Columns that fit into one number together are sorted as one.
    if (n + 1) ** depth < 1 << 62:
        key = columns[0]
        for c in columns[1:]:
            key = key * (n + 1) + c
        keys, times = counted(key)
        found = []
        for _ in range(depth):
            keys, last = np.divmod(keys, n + 1)
            found.insert(0, last)
        return np.array(found, np.int64).reshape(depth, -1), times
    return _merged(np.array(columns), np.ones(len(at), np.int64))


def _merged(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of ``rows`` in lexicographic order, and the sum of their times."""
    order = np.lexsort(rows[::-1])
    rows = rows[:, order]
    fresh = np.ones(rows.shape[1], bool)
    fresh[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
    first = np.flatnonzero(fresh)
    return rows[:, first], np.add.reduceat(times[order], first) if len(first) else times


def _send(batches, depth: int):
    """The suffixes of each block, by the group of their prefix."""

    def block(number: int, base: list, answered: dict[int, list]):
        codes, begins, parts, cuts = base
        begins = np.unpackbits(np.frombuffer(begins, np.uint8), count=len(codes)).astype(bool)
        ids, groups, splits = (np.zeros(cuts[-1], np.int64) for _ in range(3))
        for part, x, y in zip(parts.tolist(), cuts[:-1], cuts[1:]):
            ids[x:y], groups[x:y], splits[x:y] = answered[part]
        # Frequent words by rising id; 0 stands for all others.
        known = np.flatnonzero(ids)
        known = known[np.argsort(ids[known])]
        local = np.zeros(len(ids), np.int64)
        local[known] = np.arange(1, len(known) + 1)
        rows, times = _suffixes(local[codes], begins, len(known), depth)
        ids, groups, splits = (np.append(0, x[known]) for x in (ids, groups, splits))
        # Prefixes over the budget go on by their next word, or by the next two.
        second, third = rows[1], rows[2] if depth > 2 else np.zeros_like(rows[1])
        spread = mix(ids[second].astype(np.uint64))
        both = (splits[rows[0]] > 1) & (splits[second] > 1)
        spread = np.where(both, mix(spread ^ ids[third].astype(np.uint64)), spread)
        group = groups[rows[0]] + (spread % np.maximum(splits[rows[0]], 1).astype(np.uint64)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        group, both = group[order], both[order]
        found, times = ids[rows[:, order]], times[order]
        cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
        for x, y in zip(cuts[:-1], cuts[1:]):
            first = np.diff(found[0, x:y], prepend=0)
            yield number, int(group[x]), dump(first, *found[1:, x:y], times[x:y], np.packbits(both[x:y]).tobytes())

    def rows():
        at = base = None
        answered: dict[int, list] = {}
        for row in streamed(batches):
            if row["block"] != at:
                if base:
                    yield from block(at, base, answered)
                at, base, answered = row["block"], load(row["data"]), {}
            else:
                answered[row["part"]] = load(row["data"])
        if base:
            yield from block(at, base, answered)

    return row_batches(rows())


def _subtrees(batches, least: int, most: int):
    """Counts of the nodes of each group's subtree; nodes of a prefix that was split are counted in part."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("f", pa.int64())])

    def nodes(leaves: np.ndarray, times: np.ndarray, shared: np.ndarray):
        new = np.ones(leaves.shape[1], bool)
        new[1:] = leaves[0, 1:] != leaves[0, :-1]
        for depth in range(2, leaves.shape[0] + 1):
            new[1:] |= leaves[depth - 1, 1:] != leaves[depth - 1, :-1]
            first = np.flatnonzero(new)
            f = np.add.reduceat(times, first)
            keep = (leaves[depth - 1, first] > 0) & ((f >= least) | shared[first])
            flat = leaves[:depth, first[keep]].T.reshape(-1)
            offsets = np.arange(0, len(flat) + 1, depth, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(f[keep])], schema=schema)

    def close(held: list):
        rows = np.concatenate([r for r, _ in held], axis=1)
        return _merged(rows, np.concatenate([t for _, t in held]))

    at, held, size = None, [], 0
    for row in streamed(batches):
        if row["part"] != at and held:
            rows, times = close(held)
            yield from nodes(rows[:-1], times, rows[-1] > 0)
            held, size = [], 0
        at = row["part"]
        first, *others, times, both = load(row["data"])
        both = np.unpackbits(np.frombuffer(both, np.uint8), count=len(first)).astype(np.int64)
        held.append((np.array([np.cumsum(first), *others, both]), times))
        size += len(times)
        if size > most:
            held = [close(held)]
            size = 0
    if held:
        rows, times = close(held)
        yield from nodes(rows[:-1], times, rows[-1] > 0)


def _as_words(batches):
    schema = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])

    def rows():
        for row in streamed(batches):
            ids, entries, f = load(row["data"])
            for i, entry, n in zip(ids.tolist(), entries, f.tolist()):
                lang, word = entry.rsplit(b"\t", 1)
                yield i, lang.decode(), word.decode("utf-8", "replace"), n

    return table_batches(rows(), schema)


def _as_totals(batches):
    schema = pa.schema([("lang", pa.string()), ("n", pa.int64())])
    return table_batches((pair for row in streamed(batches) for pair in load(row["data"])[0]), schema)


def phrase_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", most_words: int = MOST_WORDS, least: int = LEAST_COUNT,
    group_suffixes: int = GROUP_SUFFIXES, block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of all frequent phrases: ``phrases (ids, f)``, ``words (id, lang, word, f)``, ``totals (lang, n)``.

    ``ids`` are the words of a phrase of two to ``most_words`` words; only counts of ``least`` or more are
    listed. ``n`` counts all words of a language.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.lit(0).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
    )
    total = text_total(rows)
    n, n_parts = partitions_for(docs, total), max(1, -(-total // BYTES_PER_PART))
    found = settle(rows.mapInArrow(partial(_blocks, n_parts=n_parts, most_bytes=block_bytes), ROWS), "words")
    asked = found.filter("part >= 0").repartition(n, "part").sortWithinPartitions("part", "block")
    answers = settle(asked.mapInArrow(partial(_vocabulary, least=least, budget=group_suffixes), ROWS), "vocabulary")
    base = found.filter(F.col("part") == _BASE).unionByName(answers.filter("block >= 0"))
    sent = base.repartition(n, "block").sortWithinPartitions("block", "part").mapInArrow(partial(_send, depth=most_words), ROWS)
    counts = sent.repartition(n, "part").sortWithinPartitions("part").mapInArrow(
        partial(_subtrees, least=least, most=2 * group_suffixes), "ids array<long>, f long"
    )
    phrases = settle(counts.groupBy("ids").agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "phrases")
    words = answers.filter(F.col("block") == _VOCABULARY).mapInArrow(_as_words, "id long, lang string, word string, f long")
    totals = found.filter(F.col("part") == _TOTALS).mapInArrow(_as_totals, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))
    return phrases, words, totals


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", most_words: int = MOST_WORDS, least: int = LEAST_COUNT,
    contained_percent: int = CONTAINED_PERCENT, top: int = TOP, **options,
) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A-Z are lower-cased. Marks ``.,;:!?`` and line breaks part a text into pieces, blanks and tabs pieces into words;
    phrases lie within pieces, and overlapping occurrences all count. A candidate has 2 to ``most_words`` words and a
    count ``a`` of ``least`` or more. Cut after its first words it has parts with the counts ``l`` and ``r`` and the score
    floor(1000000 a a / (l r)); the lowest-scoring cut counts, the earliest of equal ones. A candidate goes where a
    longer one that contains it has at least ``contained_percent`` of 100 of its count. The first ``top`` of each
    language are listed by score, count (both falling) and phrase. ``n`` is the number of words of the language.

    A null text is empty; a null language counts as ``und``. Repeated rows count each. Empty tables, or texts without
    frequent phrases, give no rows. Other columns are not read.
    """
    phrases, words, totals = phrase_counts(docs, text, lang, most_words, least, **options)
    known = phrases.unionByName(words.select(F.array("id").alias("ids"), "f"))
    cuts = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.slice("ids", F.lit(1), F.col("k"))).withColumn("tail", F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")))
    cuts = cuts.join(known.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head")
    cuts = cuts.join(known.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    # 10^15 words are beyond any corpus, and the products then fit into 38 digits.
    exact = "1000000BD * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0)) div (CAST(l AS DECIMAL(15, 0)) * CAST(r AS DECIMAL(15, 0)))"
    scored = (
        cuts.withColumn("score", F.expr(exact)).groupBy("ids")
        .agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("ids", "a", "cut.score", "cut.l", "cut.r")
    )
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("ids") - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.size("ids") - m + 1), lambda i: F.slice(F.col("ids"), i, m)),
    ))
    around = phrases.filter(F.size("ids") > 2).select(F.explode(inner).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("most"))
    kept = scored.join(around, "ids", "left").filter(
        F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * contained_percent)
    )
    kept = kept.join(words.select(F.col("id").alias("first"), "lang"), F.col("ids")[0] == F.col("first")).drop("first", "most")
    # Phrases are spelled only for rows that can be listed; ties with the last one are all among them. A language is
    # first cut down in shares, so that what its last task reads does not grow with the number of tasks.
    order = [F.desc("score"), F.desc("a")]
    kept = kept.withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(SHARES)))
    for by in (["lang", "share"], ["lang"]):
        kept = kept.withColumn("place", F.rank().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= top).drop("place")
    listed = settle(kept.drop("share"), "listed")
    spelled = (
        listed.select("ids", F.posexplode("ids").alias("pos", "id")).join(words.select("id", "word"), "id").groupBy("ids")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    best = Window.partitionBy("lang").orderBy(*order, "phrase")
    return (
        listed.join(spelled, "ids").withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top)
        .join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
