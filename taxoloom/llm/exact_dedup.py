"""Exact duplicates: every distinct text has one owner, found in compressed radix tries.

1. Each task inserts its own texts into a trie and passes on every distinct text once, with
   the best row and the number of rows behind it. A text that a third of all rows share leaves
   a task as one row.
2. Those rows are partitioned by length and content hash and sorted by length, hash and bytes.
   A partition inserts the full byte strings into a radix trie. As they arrive in order, only
   the path of the latest string can still grow; a subtree left of it is finished, its owners
   are written out and its memory is freed. Spark's sort spills, so neither the strings nor the
   trie need to fit in memory.
3. Every row joins the owner of its text by the number of its local group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..plans.scratch import settle
from .common import BLANKS, prepare, text_bytes, without_ids

#: Bytes that a task holds for distinct texts before it passes its groups on.
HELD_BYTES = 48 << 20
#: Bytes that a group takes besides its text: trie, node, digest and its place in the lists.
GROUP_BYTES = 1200
_GROUPS_PER_TASK = 33

_LOCAL = (
    "group long, doc_id long, points long, sha string, length long, hash long, "
    "bytes binary, best_points long, best_id long, rows long"
)
_OWNED = "group long, keep_id long, group_size long"


def _better(a: tuple, b: tuple) -> bool:
    """More code points first, then the smaller id; a missing id comes last."""
    if a[0] != b[0]:
        return a[0] > b[0]
    return a[1] is not None and (b[1] is None or a[1] < b[1])


class _Node:
    __slots__ = ("label", "edges", "owner", "rows", "groups")

    def __init__(self, label: bytes):
        self.label, self.edges, self.owner, self.rows, self.groups = label, {}, None, 0, []


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common start."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:  # the longest start on which both agree, by halving
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


class Trie:
    """A compressed radix trie of byte strings; a terminal node holds the best row of its string."""

    def __init__(self):
        self.root = _Node(b"")

    def insert(self, text: bytes, owner: tuple, rows: int = 1, closed: list | None = None) -> _Node:
        """Add ``rows`` rows of ``text``; give its terminal node.

        With ``closed``, strings arrive in rising order: subtrees that later strings
        cannot enter are taken out of the trie and appended to the list.
        """
        node, at = self.root, 0
        while at < len(text):
            edge = node.edges.get(text[at])
            if edge is None:
                if closed is not None:
                    closed += node.edges.values()
                    node.edges.clear()
                edge = node.edges[text[at]] = _Node(text[at:])
                node, at = edge, len(text)
                break
            same = _shared(edge.label, text[at : at + len(edge.label)])
            if same < len(edge.label):
                upper = _Node(edge.label[:same])
                edge.label = edge.label[same:]
                upper.edges[edge.label[0]] = edge
                node.edges[text[at]] = upper
                edge = upper
            node, at = edge, at + same
        if node.owner is None or _better(owner, node.owner):
            node.owner = owner
        node.rows += rows
        return node

    @staticmethod
    def terminals(top: _Node) -> Iterator[_Node]:
        stack = [top]
        while stack:
            node = stack.pop()
            if node.rows:
                yield node
            stack += node.edges.values()


def _local_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one task: every document with its local group, and every local group once."""
    schema = pa.schema(
        [("group", pa.int64()), ("doc_id", pa.int64()), ("points", pa.int64()), ("sha", pa.string()),
         ("length", pa.int64()), ("hash", pa.int64()), ("bytes", pa.binary()),
         ("best_points", pa.int64()), ("best_id", pa.int64()), ("rows", pa.int64())]
    )
    number = TaskContext.get().partitionId() << _GROUPS_PER_TASK
    tries: dict[tuple[int, int], Trie] = {}
    found: list[tuple] = []
    held = 0

    def flush():
        out = [(node.groups[0], None, None, None, *key, text, *node.owner, node.rows) for key, text, node in found]
        tries.clear()
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        points = batch.column("points").to_pylist()
        members = []
        for doc_id, n, text in zip(ids, points, text_bytes(batch.column("text"))):
            plain = text.translate(None, BLANKS)
            key = (len(plain), xxhash.xxh64_intdigest(plain) - (1 << 63))
            node = tries.setdefault(key, Trie()).insert(plain, (n, doc_id))
            if not node.groups:
                node.groups = [number, hashlib.sha256(plain).hexdigest()]
                found.append((key, plain, node))
                held += len(plain) + GROUP_BYTES
                number += 1
            members.append((node.groups[0], doc_id, n, node.groups[1]))
        arrays = [pa.array(c, f.type) for c, f in zip(zip(*members), schema)] if members else []
        if arrays:
            arrays += [pa.nulls(len(members), f.type) for f in list(schema)[4:]]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        if held > HELD_BYTES:
            yield flush()
            held = 0
    if found:
        yield flush()


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owners of the texts of one partition, which come sorted by length, hash and bytes."""
    schema = pa.schema([("group", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
    out: list[tuple] = []

    def write(tops):
        for top in tops:
            for node in Trie.terminals(top):
                out.extend((group, node.owner[1], node.rows) for group in node.groups)

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        out.clear()
        return made

    trie, at = Trie(), None
    for rows in batches:
        columns = [rows.column(c).to_pylist() for c in ("length", "hash", "bytes", "best_points", "best_id", "rows", "group")]
        for length, key, text, points, best, n, group in zip(*columns):
            if (length, key) != at:
                write([trie.root])
                trie, at = Trie(), (length, key)
            closed: list[_Node] = []
            node = trie.insert(text, (points, best), n, closed)
            node.groups.append(group)
            write(closed)
        if out:
            yield batch()
    write([trie.root])
    if out:
        yield batch()


def exact_owners(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are the same after deleting blank, tab, line feed,
    vertical tab, form feed and carriage return. The row with the most code points in the
    original text stays, then the one with the smallest id.

    A null text counts as empty; all texts without a visible character are one group. A null
    id is kept and ranks last. Rows that repeat an id are separate members of their group.
    An empty table gives an empty result. Other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("points"),
        F.col(text).alias("text"),
    )
    local = settle(rows.mapInArrow(_local_groups, _LOCAL), "local_texts")
    owned = (
        local.filter("bytes IS NOT NULL")
        .select("length", "hash", "bytes", "best_points", "best_id", "rows", "group")
        .repartition("length", "hash")
        .sortWithinPartitions("length", "hash", "bytes")
        .mapInArrow(_owners, _OWNED)
    )
    members = local.filter("bytes IS NULL").select("group", "doc_id", F.col("sha").alias("text_sha256"))
    return members.join(owned, "group").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that another one owns; columns as they were.

    Rows that share an id, or have none, go only if others own them all.
    """
    return without_ids(docs, exact_owners(docs, text, doc_id), ~F.col("kept"), doc_id)
