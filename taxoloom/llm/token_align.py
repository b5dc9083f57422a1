"""Which tokens of two tokenizers end together, and how often: inverted bitmaps per id pair.

Both encodings of a text spell the same bytes. Offsets where a token of each ends cut the tokens
into groups; the two tokens that end there are linked. For every block of documents and every
linked id pair the index holds a bitmap of the documents with such a link, compressed as gaps or as
bits, and planes with the binary digits of the number of links of each of these documents. Bitmaps
of one pair are merged by OR over blocks (a document lies in one block) and popcounted: bits give the
documents, planes weighted by powers of two the links. The postings then carry the pairs' counts
back to the documents.

A text is cut before each run of blanks that follows a visible character: no token of either
tokenizer crosses such a place, so each distinct piece of a block is encoded once.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.scratch import settle
from .blocks import (
    BLOCK_BYTES, ROWS, counted, distinct_runs, dump, joined, load, partitions_for, row_batches, salt_of, spread,
    streamed, summed, table_batches, text_blocks, text_total,
)
from .common import prepare

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Parts of the pair space, by id of the second tokenizer.
PARTS = 32
#: Bytes of text whose postings meet one copy of a part's pair table.
BYTES_PER_SALT = 512 << 20
#: Pairs of a task's tally before it is sent on.
TALLY_PAIRS = 4_000_000

_BASE = -1
_A, _B = 24, 48  # a pair is the number part << 48 | b << 24 | a
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
     ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())]
)


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: visible ones stand for themselves."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class TwoTokenizers:
    """Encodes pieces with both tokenizers; ``bytes_a`` and ``bytes_b`` are the tokens' spellings."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.first = tokenizers.Tokenizer.from_str(byte_bpe.decode())
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        letters = _byte_letters()
        names = sorted((i, t) for t, i in self.first.get_vocab(with_added_tokens=True).items())
        self.bytes_a = [b""] * (names[-1][0] + 1)
        for i, t in names:
            self.bytes_a[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode()
            for i in range(self.second.get_piece_size()) for p in [self.second.id_to_piece(i)]
        ]
        self.size_a = np.fromiter(map(len, self.bytes_a), np.int64, len(self.bytes_a))
        self.size_b = np.fromiter(map(len, self.bytes_b), np.int64, len(self.bytes_b))

        # Every id as text with each of the signs that may follow it.
        names = max(len(self.bytes_a), len(self.bytes_b))
        signed = [str(i).encode() + sign for i in range(names) for sign in (b",", b"|", b";")]
        self.signed = np.frombuffer(b"".join(signed), np.uint8)
        self.signed_size = np.fromiter(map(len, signed), np.int64, len(signed))
        self.signed_at = np.cumsum(self.signed_size) - self.signed_size

    def encode(self, pieces: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of pieces that begin with a blank; the second tokenizer adds that blank itself."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        a = [e.ids for e in self.first.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.second.encode([t[1:] for t in texts], num_threads=1) if texts else []
        return a, b

    def spelled(self, pieces: list[bytes], a: list[list[int]], b: list[list[int]]) -> list[bool]:
        """Which pieces both encodings spell byte by byte."""
        return [
            b"".join(map(self.bytes_a.__getitem__, x)) == p and b"".join(map(self.bytes_b.__getitem__, y)) == p
            for p, x, y in zip(pieces, a, b)
        ]


@lru_cache(maxsize=1)
def _tokenizers(byte_bpe: bytes, piece_bpe: bytes) -> TwoTokenizers:
    """One per Python worker."""
    return TwoTokenizers(byte_bpe, piece_bpe)


def _pieces(buf: np.ndarray, starts: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Where the pieces of a block begin."""
    blank = np.flatnonzero(buf == 32)
    before = buf[blank - 1]
    p2, p3 = buf.take(blank - 2, mode="wrap"), buf.take(blank - 3, mode="wrap")
    # White space of either tokenizer: ASCII blanks and separators, and these characters beyond ASCII:
    # U+0085, U+00A0, U+1680, U+2000 to U+206F, U+3000 to U+303F (some of the last two are visible, which does no harm).
    space = ((before >= 9) & (before <= 13)) | ((before >= 28) & (before <= 32))
    space |= (p2 == 0xC2) & ((before == 0x85) | (before == 0xA0))
    space |= ((p3 == 0xE1) & (p2 == 0x9A)) | ((p3 == 0xE2) & ((p2 == 0x80) | (p2 == 0x81))) | ((p3 == 0xE3) & (p2 == 0x80))
    cuts = blank[~space]
    owner = np.searchsorted(starts, cuts, "right") - 1
    # Blanks at the end of a text stay with the piece before them.
    visible = starts[:-1] + np.fromiter((len(t.rstrip(b" ")) for t in texts), np.int64, len(texts))
    cuts = cuts[cuts <= visible[owner]]
    return np.union1d(cuts, starts[:-1])


_OF_ONE_GO = 1 << 15


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes


class PieceLinks:
    """Tokens, groups and links of the distinct pieces of a block, each as counts and one long array.

    ``texts`` are the groups of each piece as text, every group with its closing sign.
    """

    def __init__(self, tokenizers: TwoTokenizers, pieces: list[bytes]):
        parts = [self._some(tokenizers, pieces[k : k + _OF_ONE_GO]) for k in range(0, len(pieces), _OF_ONE_GO)]
        *columns, texts = zip(*parts)
        self.valid, self.n_a, self.n_b, self.n_links, self.pairs = map(np.concatenate, columns)
        self.texts = [t for part in texts for t in part]

    @staticmethod
    def _some(tokenizers: TwoTokenizers, pieces: list[bytes]):
        a, b = tokenizers.encode(pieces)
        valid = np.ones(len(pieces), bool)
        whole = b"".join(pieces)
        (flat_a, n_a), (flat_b, n_b) = _flat(a), _flat(b)
        ends_a, ends_b = np.cumsum(tokenizers.size_a[flat_a]), np.cumsum(tokenizers.size_b[flat_b])
        stops = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        same = all(
            b"".join(map(spell.__getitem__, flat.tolist())) == whole and (np.append(0, ends)[np.cumsum(n)] == stops).all()
            for spell, flat, ends, n in ((tokenizers.bytes_a, flat_a, ends_a, n_a), (tokenizers.bytes_b, flat_b, ends_b, n_b))
        )
        if not same:
            # Pieces that are not spelled byte by byte have no tokens.
            valid = np.array(tokenizers.spelled(pieces, a, b), bool)
            a, b = ([x if ok else [] for x, ok in zip(ids, valid)] for ids in (a, b))
            (flat_a, n_a), (flat_b, n_b) = _flat(a), _flat(b)
            ends_a, ends_b = np.cumsum(tokenizers.size_a[flat_a]), np.cumsum(tokenizers.size_b[flat_b])
        # Pieces follow one another in both, so equal ends are common ends of one piece.
        _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        owner = np.repeat(np.arange(len(pieces)), n_a)[at_a]
        n_links = np.bincount(owner, minlength=len(pieces)).astype(np.int64)
        pairs = (flat_b[at_b] << _A) | flat_a[at_a]
        return valid, n_a, n_b, n_links, pairs, _group_texts(tokenizers, flat_a, flat_b, at_a, at_b, n_a + n_b)


def _group_texts(tokenizers: TwoTokenizers, flat_a, flat_b, at_a, at_b, n_tokens: np.ndarray) -> list[bytes]:
    """The groups of each piece: ids of the first tokenizer, then of the second, with the signs between them."""
    sign_a, sign_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
    sign_a[at_a], sign_b[at_b] = 1, 2
    # Tokens of the second tokenizer before a token's group, and of the first up to its group's end.
    group_a = np.cumsum(sign_a > 0) - (sign_a > 0)
    group_b = np.cumsum(sign_b > 0) - (sign_b > 0)
    place_a = np.arange(len(flat_a)) + np.append(0, at_b + 1)[group_a]
    place_b = np.arange(len(flat_b)) + (at_a + 1)[group_b] if len(flat_b) else flat_b
    element = np.empty(len(flat_a) + len(flat_b), np.int64)
    element[place_a], element[place_b] = 3 * flat_a + sign_a, 3 * flat_b + sign_b
    sizes = tokenizers.signed_size[element]
    text = tokenizers.signed[spread(tokenizers.signed_at[element], sizes)].tobytes()
    stops = np.append(0, np.cumsum(sizes))[np.cumsum(n_tokens)].tolist()
    return [text[x:y] for x, y in zip([0, *stops[:-1]], stops)]


class Postings:
    """Documents of each pair as bitmaps, and links per document as planes of binary digits.

    ``pairs`` rise; the documents of pair k are ``docs[starts[k]:starts[k + 1]]``, rising, with
    ``links`` links each.
    """

    def __init__(self, pairs: np.ndarray, starts: np.ndarray, docs: np.ndarray, links: np.ndarray):
        self.pairs, self.starts, self.docs, self.links = pairs, starts, docs, links

    def dump(self, n_docs: int) -> bytes:
        """Pairs in many documents as rows of bits, others as gaps; the planes in the order of the postings."""
        sizes = np.diff(self.starts)
        dense = np.flatnonzero(sizes * 16 >= n_docs)
        bits = np.zeros((len(dense), n_docs), bool)
        row = np.repeat(np.arange(len(dense)), sizes[dense])
        bits[row, self.docs[spread(self.starts[dense], sizes[dense])]] = True
        thin = np.flatnonzero(sizes * 16 < n_docs)
        gaps = np.diff(self.docs[spread(self.starts[thin], sizes[thin])], prepend=0).astype(np.int32)
        planes = [
            np.packbits((self.links >> j) & 1 == 1) for j in range(int(self.links.max()).bit_length() if len(self.links) else 0)
        ]
        return dump(
            np.diff(self.pairs, prepend=0), sizes.astype(np.int32), n_docs, np.packbits(bits, axis=1).tobytes(), gaps,
            [p.tobytes() for p in planes],
        )

    @staticmethod
    def _opened(data: bytes):
        pairs, sizes, n_docs, bits, gaps, planes = load(data)
        sizes = sizes.astype(np.int64)
        n = int(sizes.sum())
        digits = [np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes]
        return np.cumsum(pairs), sizes, n_docs, bits, gaps, digits

    @staticmethod
    def counts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs, their documents (popcount of bits) and links (popcounts of planes)."""
        pairs, sizes, n_docs, bits, _, digits = Postings._opened(data)
        rows = np.frombuffer(bits, np.uint8).reshape(-1, -(-n_docs // 8)) if len(bits) else np.zeros((0, 1), np.uint8)
        found = sizes.copy()
        found[sizes * 16 >= n_docs] = np.bitwise_count(rows).sum(1, dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        links = np.zeros(len(pairs), np.int64)
        for j, plane in enumerate(digits):
            links += np.add.reduceat(plane.astype(np.int64), first) << j
        return pairs, found, links

    @staticmethod
    def load(data: bytes) -> Postings:
        pairs, sizes, n_docs, bits, gaps, digits = Postings._opened(data)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        docs = np.zeros(starts[-1], np.int64)
        dense, thin = np.flatnonzero(sizes * 16 >= n_docs), np.flatnonzero(sizes * 16 < n_docs)
        if len(dense):
            rows = np.frombuffer(bits, np.uint8).reshape(len(dense), -1)
            docs[spread(starts[dense], sizes[dense])] = np.nonzero(np.unpackbits(rows, axis=1, count=n_docs))[1]
        docs[spread(starts[thin], sizes[thin])] = np.cumsum(gaps)
        links = np.zeros(len(docs), np.int64)
        for j, plane in enumerate(digits):
            links += plane.astype(np.int64) << j
        return Postings(pairs, starts, docs, links)


def _block_rows(number: int, ids: list, texts: list[bytes], tokenizers: TwoTokenizers) -> Iterator[tuple[int, int, bytes]]:
    buf, starts = joined(texts, b" ")
    at = _pieces(buf, starts, texts)
    codes, pieces = distinct_runs(buf, at)
    links = PieceLinks(tokenizers, pieces)
    first = np.searchsorted(at, starts[:-1])
    sizes = np.diff(np.append(first, len(at)))
    full = np.fromiter(map(len, texts), np.int64, len(texts)) > 0
    valid = np.logical_and.reduceat(links.valid[codes], first) & full
    owner = np.repeat(np.arange(len(texts)), sizes)
    keep = valid[owner]
    codes, owner = codes[keep], owner[keep]

    def per_doc(values):
        return np.bincount(owner, weights=values[codes], minlength=len(texts)).astype(np.int64)

    shas, stop = [], np.cumsum(np.where(valid, sizes, 0))
    for ok, x, y in zip(valid, stop - sizes, stop):
        text = b"".join(map(links.texts.__getitem__, codes[x:y].tolist()))
        # The sign after the last group is left out.
        shas.append(hashlib.sha256(text[:-1]).hexdigest() if ok else "")
    n_links = per_doc(links.n_links)
    yield number, _BASE, dump(ids, per_doc(links.n_a), per_doc(links.n_b), n_links, shas)
    # One number per (pair, document), in the order of part, pair and document.
    piece_first = np.cumsum(links.n_links) - links.n_links
    docs = np.repeat(owner, links.n_links[codes])
    named, place = np.unique(links.pairs, return_inverse=True)
    named |= ((named >> _A) % PARTS) << _B
    order = np.argsort(named)
    rank = np.empty(len(named), np.int64)
    rank[order] = np.arange(len(named))
    ranks = rank[place][spread(piece_first[codes], links.n_links[codes])]
    posted, times = counted(ranks * len(texts) + docs)
    pair, doc = posted // len(texts), posted % len(texts)
    named = named[order]
    held, first = np.unique(pair, return_index=True)
    bounds = np.append(first, len(pair))
    part = named[held] >> _B
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=PARTS))
    for x, y in zip(cuts[:-1], cuts[1:]):
        lo, hi = bounds[x], bounds[y]
        found = Postings(named[held[x:y]], bounds[x : y + 1] - lo, doc[lo:hi], times[lo:hi])
        yield number, int(part[x]), found.dump(len(texts))


def _index(batches, files: Broadcast, most_bytes: int):
    def rows():
        tokenizers = _tokenizers(*files.value)
        for number, ids, texts, _ in text_blocks(batches, TaskContext.get().partitionId(), most_bytes):
            yield from _block_rows(number, ids, texts, tokenizers)

    return row_batches(rows())


def _tally(batches):
    """Counts of a task's pairs, added up over its blocks before they are sent to their part."""

    def rows():
        held: dict[int, list] = {}
        size = 0
        for row in streamed(batches):
            held.setdefault(row["part"], []).append(Postings.counts(row["data"]))
            size += len(held[row["part"]][-1][0])
            if size > TALLY_PAIRS:
                held = {k: [summed(*map(list, zip(*v)))] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if 2 * size > TALLY_PAIRS:
                    yield from ((0, k, dump(*v[0])) for k, v in held.items())
                    held, size = {}, 0
        yield from ((0, k, dump(*summed(*map(list, zip(*v))))) for k, v in held.items())

    return row_batches(rows())


def _pair_table(batches):
    """Per part: pairs, documents, links and whether no other pair of the second id has more links."""

    def rows():
        at, held = None, None
        for row in streamed(batches):
            if row["part"] != at:
                if held:
                    yield 0, at, _with_best(*held)
                at, held = row["part"], None
            new = tuple(load(row["data"]))
            held = summed(*map(list, zip(held, new))) if held else new
        if held:
            yield 0, at, _with_best(*held)

    return row_batches(rows())


def _with_best(pairs: np.ndarray, docs: np.ndarray, links: np.ndarray) -> bytes:
    second = pairs >> _A
    first = np.flatnonzero(np.diff(second, prepend=-1))
    most = np.repeat(np.maximum.reduceat(links, first), np.diff(np.append(first, len(pairs))))
    return dump(pairs, docs, links, (links == most).tobytes())


def _return_scores(batches):
    """Sums per document of a block over the postings of one part."""

    def rows():
        at, table = None, None
        for row in streamed(batches):
            if row["block"] == _BASE:
                pairs, _, counts, best = load(row["data"])
                at, table = row["part"], (pairs, counts, np.frombuffer(best, bool))
                continue
            assert row["part"] == at
            found = Postings.load(row["data"])
            place = np.repeat(np.searchsorted(table[0], found.pairs), np.diff(found.starts))
            n = int(found.docs.max()) + 1
            n_best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(n_best, found.docs, np.where(table[2][place], found.links, 0))
            np.add.at(total, found.docs, found.links * table[1][place])
            yield row["block"], at, dump(n_best, total)

    return row_batches(rows())


def _documents(batches):
    def rows():
        base = best = total = at = None

        def out():
            ids, n_a, n_b, n_links, shas = base
            yield from zip(ids, n_a.tolist(), n_b.tolist(), n_links.tolist(), n_links.tolist(), best.tolist(), total.tolist(), shas)

        for row in streamed(batches):
            if row["block"] != at:
                if base:
                    yield from out()
                at, base = row["block"], load(row["data"])
                best, total = np.zeros(len(base[0]), np.int64), np.zeros(len(base[0]), np.int64)
                continue
            more, counts = load(row["data"])
            best[: len(more)] += more
            total[: len(counts)] += counts
        if base:
            yield from out()

    return table_batches(rows(), _SCHEMA)


class Alignment:
    """The settled index of a table of documents, and what is read from it."""

    def __init__(
        self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE,
        block_bytes: int = BLOCK_BYTES,
    ):
        spark = prepare(docs.sparkSession)
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        self._total = text_total(rows)
        self._n = partitions_for(docs, self._total)
        files = _files(spark, byte_bpe, piece_bpe)
        self._index = settle(rows.mapInArrow(partial(_index, files=files, most_bytes=block_bytes), ROWS), "postings")
        tallies = self._index.filter("part >= 0").mapInArrow(_tally, ROWS)
        merged = tallies.repartition(PARTS, "part").sortWithinPartitions("part")
        self._pairs = settle(merged.mapInArrow(_pair_table, ROWS), "pairs")

    def pairs(self) -> DataFrame:
        """``a, b, n_docs, n_links, best``: one row per id pair that is linked anywhere."""

        def rows(batches):
            schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_docs", pa.int64()), ("n_links", pa.int64()), ("best", pa.bool_())])
            for row in streamed(batches):
                pairs, docs, links, best = load(row["data"])
                low = (1 << _A) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (pairs & low, (pairs >> _A) & low, docs, links, np.frombuffer(best, bool))], schema=schema
                )

        return self._pairs.mapInArrow(rows, "a long, b long, n_docs long, n_links long, best boolean")

    def documents(self) -> DataFrame:
        """One row per document, as ``align_tokens`` describes."""
        salts = max(1, -(-self._total // BYTES_PER_SALT))
        postings = self._index.filter("part >= 0").withColumn("salt", salt_of("block", salts))
        tables = self._pairs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        met = tables.withColumn("block", F.lit(_BASE).cast("long")).unionByName(postings)
        n = max(self._n, min(PARTS * salts, 4 * self._n))
        scores = met.repartition(n, "part", "salt").sortWithinPartitions("part", "salt", "block").drop("salt").mapInArrow(_return_scores, ROWS)
        back = self._index.filter(F.col("part") == _BASE).unionByName(scores)
        return back.repartition(self._n, "block").sortWithinPartitions("block", "part").mapInArrow(
            _documents,
            "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
        )


def _files(spark: SparkSession, byte_bpe: str, piece_bpe: str) -> Broadcast:
    """The two vocabulary files, a few MB whatever the input."""
    found = []
    for path in (byte_bpe, piece_bpe):
        with open(path, "rb") as f:
            found.append(f.read())
    return spark.sparkContext.broadcast(tuple(found))


def align_tokens(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    The text with a blank before it is encoded by a byte-level tokenizer (A) and by a piece
    tokenizer that adds the blank itself (B); strings of special tokens are plain text. Byte offsets
    where tokens of both end cut them into groups, and the two tokens that end there are a link. A pair's
    count is its number of links in the whole table; ``n_best`` counts links whose pair has the highest
    count of its B id (ties included), ``count_sum`` adds up the counts over links. The digest is of
    the groups, ids in order, as ``a1,a2|b1;a3|b2,b3``.

    A null or empty text, or one that either tokenizer does not spell byte by byte, has zeros and an
    empty digest, and adds no links. Rows that repeat an id, or have none, are documents of their own. An
    empty table gives no rows. Other columns are not read; texts of any length are encoded whole.
    """
    return Alignment(docs, text, doc_id, **options).documents()
