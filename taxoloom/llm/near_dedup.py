"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations make the whole signature: the first scatters the shingles over the positions
of a ring, the second gives each position a rank and is turned by one position for each further
coordinate. Bands of coordinates name buckets; only documents that share a bucket are compared.

1. Documents with equal shingle sets are one class, kept by its smallest id.
2. In each bucket every class is compared with two pivots, the smallest id and one drawn by hash.
   Pairs are verified on their full sets, and the links that hold are contracted to components.
3. A bucket that still holds several components has members outside its largest one. Those are
   compared with all members, in tiles of bounded size, inside tasks that give back links only.
   So no link of a bucket is lost, and a large group of copies costs a star, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..plans.scratch import settle
from .common import mix, pack_sorted, prepare, text_bytes, unpack_sorted, windows, without_ids
from .graph import components

#: Words of a shingle, and parts of 100 that two sets must share.
SHINGLE = 5
PERCENT = 80
#: With 36 bands of 6 coordinates a pair at 0.8 shares no bucket in 2 of 100,000 cases, at 0.85 in 4 of 100 million.
BANDS, ROWS = 36, 6
#: Members of a bucket in one tile.
TILE = 512
#: A verified set holds the upper bits of each shingle's key.
_SET_SHIFT = np.uint64(16)
_VOCAB = 1_000_000


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Distinct keys of the ``n``-word shingles in rising order; fewer words are one shingle."""
    if not len(words):
        return words
    if len(words) < n:
        return mix(windows(words, len(words)) + np.uint64(len(words)))
    return np.unique(windows(words, n))


def _ranks(positions: np.ndarray) -> np.ndarray:
    """The turned permutation's rank of each position of the ring of 2**32."""
    x = positions
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(keys: np.ndarray, k: int) -> np.ndarray:
    """``k`` coordinates; coordinate ``j`` ranks the positions turned by ``j``."""
    place = (mix(keys) >> np.uint64(32)).astype(np.uint32)
    turns = np.arange(1, k + 1, dtype=np.uint32)
    least = np.full(k, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(place), 256):  # a tile of ranks stays in the processor's cache
        ranks = _ranks(place[at : at + 256, None] + turns[None, :])
        np.minimum(least, ranks.min(axis=0), out=least)
    return least


def _word_keys(batches: Iterator[pa.RecordBatch]):
    """Documents of a task with the keys of their words."""
    vocab: dict[bytes, int] = {}
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
            words = text.lower().split()
            if len(vocab) > _VOCAB:
                vocab.clear()
            for w in dict.fromkeys(words):
                if w not in vocab:
                    vocab[w] = xxhash.xxh64_intdigest(w)
            yield doc_id, np.fromiter(map(vocab.__getitem__, words), np.uint64, len(words))


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _sketches(batches, shingle: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64()))]
    )

    def rows():
        salt = np.arange(1, BANDS + 1, dtype=np.uint64)
        for doc_id, words in _word_keys(batches):
            keys = shingles(words, shingle)
            if not len(keys):
                yield doc_id, 0, None, None
                continue
            bands = signature(keys, BANDS * ROWS).reshape(BANDS, ROWS).astype(np.uint64)
            code = salt.copy()
            for k in range(ROWS):
                code = mix(code * np.uint64(0x9E3779B97F4A7C15) + bands[:, k])
            yield doc_id, len(keys), xxhash.xxh3_128_digest(keys.tobytes()), code.view(np.int64)

    return _batches(rows(), schema)


def _sets(batches, shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("keys", pa.binary())])
    rows = (
        (doc_id, pack_sorted(np.unique(shingles(words, shingle) >> _SET_SHIFT)))
        for doc_id, words in _word_keys(batches)
    )
    return _batches(rows, schema, 500)


def _close(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def _verify(batches, percent: int):
    """Links among pairs that carry both sets."""
    for batch in batches:
        out = []
        for u, v, a, b in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "a", "b"))):
            a, b = unpack_sorted(a, np.uint64), unpack_sorted(b, np.uint64)
            if percent * max(len(a), len(b)) <= 100 * min(len(a), len(b)):
                both = np.concatenate([a, b])
                both.sort()
                if _close(int((both[1:] == both[:-1]).sum()), len(a), len(b), percent):
                    out.append((u, v))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"]
        )


class _Tile:
    """Members of one tile of a bucket, as an inverted index of their shingles."""

    def __init__(self):
        self.ids, self.parts, self.sets = [], [], []
        self.index = None

    def add(self, doc_id: int, part: int, keys: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.parts.append(part)
        self.sets.append(keys)

    def links(self, doc_id: int, part: int, keys: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
        """Members of other components that are close to ``keys``, one for each component."""
        if self.index is None:
            if not self.ids:
                return
            flat = np.concatenate(self.sets)
            order = np.argsort(flat, kind="stable")
            self.index = flat[order], np.repeat(np.arange(len(self.ids)), [len(s) for s in self.sets])[order]
            self.sizes = np.array([len(s) for s in self.sets])
            self.part = np.array(self.parts)
        flat, member = self.index
        a, b = np.searchsorted(flat, keys, "left"), np.searchsorted(flat, keys, "right")
        counts = b - a
        steps = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        shared = np.bincount(member[np.repeat(a, counts) + steps], minlength=len(self.ids))
        union = self.sizes + len(keys) - shared
        near = np.flatnonzero((100 * shared >= percent * union) & (self.part != part))
        for k in near[np.unique(self.part[near], return_index=True)[1]].tolist():
            yield doc_id, self.ids[k]


def _tile_links(batches, percent: int):
    """Rows come sorted by tile, members (role 0) before the ones to compare (role 1)."""
    at, tile = None, _Tile()
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("bucket", "tile", "chunk", "role", "doc_id", "part", "keys"))
        for bucket, t, c, role, doc_id, part, keys in zip(*columns):
            if (bucket, t, c) != at:
                at, tile = (bucket, t, c), _Tile()
            keys = unpack_sorted(keys, np.uint64)
            if role == 0:
                tile.add(doc_id, part, keys)
            else:
                out.extend(tile.links(doc_id, part, keys, percent))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"]
        )


def _tiled(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that share a bucket, found without leaving a pair of them out."""
    parted = members.join(labels, members["doc_id"] == labels["u"], "left").select(
        "bucket", "doc_id", F.coalesce("v", "doc_id").alias("part")
    )
    sized = parted.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    open_buckets = (
        sized.groupBy("bucket")
        .agg(F.sum("n").alias("members"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("parts"),
             F.max_by("part", F.struct("n", "part")).alias("main"))
        .filter("parts > 1")
        .select(
            "bucket", "main",
            F.ceil(F.col("members") / TILE).cast("int").alias("tiles"),
            F.ceil((F.col("members") - F.col("largest")) / TILE).cast("int").alias("chunks"),
        )
    )
    rows = settle(parted.join(open_buckets, "bucket"), "open")
    spread = F.xxhash64("doc_id", "bucket")
    tile, chunk = F.pmod(spread, "tiles").cast("int"), F.pmod(F.shiftright(spread, 20), "chunks").cast("int")
    inside = rows.select(
        "bucket", tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.lit(0).alias("role"), "doc_id", "part",
    )
    outside = rows.filter("part != main").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), chunk.alias("chunk"),
        F.lit(1).alias("role"), "doc_id", "part",
    )
    return (
        inside.unionByName(outside)
        .join(sets, "doc_id")
        .repartition("bucket", "tile", "chunk")
        .sortWithinPartitions("bucket", "tile", "chunk", "role")
        .mapInArrow(partial(_tile_links, percent=percent), "u long, v long")
    )


def near_components(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, shingle: int = SHINGLE
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Words are runs without blank, tab, line feed, vertical tab, form feed and carriage return,
    with A-Z lower-cased; a document's set are its distinct shingles of ``shingle`` words, or
    its whole word sequence if it has fewer. Two documents are linked if their sets share at
    least ``percent`` of 100 of their union. ``component_id`` is the smallest id that links lead
    to, and the document with that id is kept.

    A document without words, or with a null text, is linked with nothing. A row with a null id
    is linked with nothing, has a null component and is kept. Rows that repeat an id share its
    component. An empty table gives an empty result. Other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketches = settle(
        rows.mapInArrow(
            partial(_sketches, shingle=shingle), "doc_id long, n_shingles long, set_id binary, bands array<long>"
        ),
        "sketches",
    )
    known = sketches.filter("doc_id IS NOT NULL AND set_id IS NOT NULL")
    classes = settle(known.groupBy("set_id").agg(F.min("doc_id").alias("rep")), "classes")
    # A class's bands are those of its keeper, so that no group of copies is expanded.
    kept = known.join(classes, (known["set_id"] == classes["set_id"]) & (known["doc_id"] == classes["rep"]), "left_semi")
    banded = kept.dropDuplicates(["doc_id"]).select("doc_id", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"),
        F.min_by("doc_id", F.xxhash64("doc_id", "bucket")).alias("drawn"),
    ).filter("n > 1")
    members = settle(banded.join(shared, "bucket").select("bucket", "doc_id", "first", "drawn"), "members")
    pairs = (
        members.select(F.col("doc_id").alias("u"), F.explode(F.array_distinct(F.array("first", "drawn"))).alias("v"))
        .filter("u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    named = members.select("doc_id").distinct()
    sets = settle(
        rows.join(named, "doc_id", "left_semi").mapInArrow(partial(_sets, shingle=shingle), "doc_id long, keys binary")
        .dropDuplicates(["doc_id"]),
        "sets",
    )
    verified = (
        pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("keys").alias("a")), "u")
        .join(sets.select(F.col("doc_id").alias("v"), F.col("keys").alias("b")), "v")
        .mapInArrow(partial(_verify, percent=percent), "u long, v long")
    )
    labels = components(verified)
    more = settle(_tiled(members.select("bucket", "doc_id"), labels, sets, percent), "links")
    labels = components(labels.unionByName(more))
    named = classes.join(labels, classes["rep"] == labels["u"], "left").select(
        "set_id", F.coalesce("v", "rep").alias("component")
    )
    judged = sketches.filter("doc_id IS NOT NULL AND set_id IS NOT NULL").join(named, "set_id").select(
        "doc_id", "n_shingles", F.col("component").alias("component_id")
    )
    alone = sketches.filter("doc_id IS NULL OR set_id IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return judged.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, shingle: int = SHINGLE
) -> DataFrame:
    """``docs`` with one document of each component, and rows without an id; columns as they were."""
    return without_ids(docs, near_components(docs, text, doc_id, percent, shingle), ~F.col("kept"), doc_id)
