"""Language identification by unigram pieces, summed over all segmentations.

A text's words are cut into pieces of a fixed public vocabulary. Each language has a probability
for every piece, and a word's probability is the sum over all ways to cut it, found by a forward
pass over its characters. Piece probabilities come from expectation-maximisation on words of
labelled documents; an iteration is one Spark job whose result has one number per language and
piece. Words are scored once per task and looked up after that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.scratch import settle
from .common import mod_of_id, prepare, without_ids

#: A public vocabulary of pieces, read on the driver.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents whose crc32 of the id has this remainder are held out of training.
FOLDS, HELD_OUT = 4, 2
#: Distinct labelled texts per language that the pieces are fitted on (expected number, drawn by hash).
LEARN_DOCUMENTS = 1000
ITERATIONS = 3
UNDECIDED = "und"
#: Longer words are cut into stretches of this many characters.
_STRETCH = 32
_WORDS_HELD = 400_000
#: Probability of a character that no piece has, and weight of a piece not seen in a language.
_UNKNOWN, _PSEUDO = 1e-7, 0.01
_BASE = np.uint64(0x100000001B3)
_LETTER = "\\p{L}"


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces of text; a leading mark stands for the start of a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)))
    return sorted({p.lower() for k in plain if len(p := model.id_to_piece(k)) <= _STRETCH})


def stretches(word: str) -> list[str]:
    """A word in lower case, marked at its start, in stretches of bounded length."""
    marked = "▁" + word
    return [marked[k : k + _STRETCH] for k in range(0, len(marked), _STRETCH)]


class PieceTable:
    """Pieces by their hash, to look up the substrings of many words at once."""

    def __init__(self, pieces: list[str]):
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        self.n = len(pieces)
        self.longest = max(map(len, pieces), default=1)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
        return h

    def find(self, words: list[str], n: int):
        """``(start, stop, piece numbers)`` of the substrings of words of ``n`` characters; number ``n`` of the table: none."""
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)
        prefix = np.zeros((n + 1, len(words)), np.uint64)
        for j in range(n):
            prefix[j + 1] = prefix[j] * _BASE + letters[:, j].astype(np.uint64) + np.uint64(1)
        powers = np.cumprod(np.full(n + 1, _BASE, np.uint64))
        for j in range(1, n + 1):
            for size in range(1, min(j, self.longest) + 1):
                wanted = prefix[j] - prefix[j - size] * powers[size - 1]
                at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
                yield j - size, j, np.where(self.hashes[at] == wanted, self.numbers[at], self.n)


def _by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    return groups


def log_likelihoods(words: list[str], table: PieceTable, weights: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language; ``weights`` has a row per piece and one of zeros."""
    out = np.empty((len(words), weights.shape[1]))
    for n, members in _by_length(words).items():
        for a in range(0, len(members), 20_000):
            part = members[a : a + 20_000]
            forward = np.zeros((n + 1, len(part), weights.shape[1]))
            forward[0] = 1.0
            for start, stop, piece in table.find([words[k] for k in part], n):
                step = weights[piece]
                if stop - start == 1:
                    step = np.where((piece == table.n)[:, None], _UNKNOWN, step)
                forward[stop] += forward[start] * step
            out[part] = np.log(forward[n])
    return out


def expected_counts(words: list[str], counts: np.ndarray, table: PieceTable, weights: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in words of one language, over all segmentations."""
    total = np.zeros(table.n + 1)
    for n, members in _by_length(words).items():
        found = list(table.find([words[k] for k in members], n))
        step = [np.where((piece == table.n) & (stop - start == 1), _UNKNOWN, weights[piece]) for start, stop, piece in found]
        forward, backward = np.zeros((2, n + 1, len(members)))
        forward[0] = backward[n] = 1.0
        for (start, stop, _), p in zip(found, step):
            forward[stop] += forward[start] * p
        for (start, stop, _), p in sorted(zip(found, step), key=lambda x: -x[0][1]):
            backward[start] += p * backward[stop]
        share = counts[members] / forward[n]
        for (start, stop, piece), p in zip(found, step):
            total += np.bincount(piece, forward[start] * p * backward[stop] * share, table.n + 1)
    return total[:-1]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, Counter] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            found.setdefault(lang, Counter()).update((text or "").lower().split())
        rows = [(lang, w, n) for lang, words in found.items() for w, n in words.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"],
        )


def _expectation(batches: Iterator[pa.RecordBatch], pieces: list[str], weights: dict[str, np.ndarray]):
    table = PieceTable(pieces)
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        words, n = batch.column("word").to_pylist(), np.array(batch.column("n").to_pylist(), float)
        for lang in dict.fromkeys(langs.tolist()):
            cut = [(s, n[k]) for k in np.flatnonzero(langs == lang) for s in stretches(words[k])]
            total = expected_counts([s for s, _ in cut], np.array([c for _, c in cut]), table, weights[lang])
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(total[used], pa.float64())],
                names=["lang", "piece", "n"],
            )


class LanguageModel:
    """Languages, the pieces that their words use, their log-probabilities and the languages' shares."""

    def __init__(self, langs: list[str], pieces: list[str], weights: np.ndarray, prior: np.ndarray):
        self.langs, self.pieces, self.weights, self.prior = langs, pieces, weights, prior


def draw(labelled: DataFrame, documents: int) -> tuple[DataFrame, dict[str, int]]:
    """About ``documents`` distinct texts of each language (``lang, text``), or all of fewer, and the languages' rows.

    Texts are drawn by their hash and stay once each, so copies neither add to a language's
    texts nor keep others out. Texts without a letter are never judged, so none is drawn.
    """
    rows = labelled.filter("lang IS NOT NULL").select("text", "lang").filter(F.col("text").rlike(_LETTER))
    hashed = F.xxhash64("text")
    found = (
        rows.groupBy("lang", hashed.alias("hash")).agg(F.count(F.lit(1)).alias("n"))
        .groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")).orderBy("lang").collect()
    )
    whole = 1 << 40
    shares = [F.lit(x) for r in found for x in (r["lang"], min(whole, -(-documents * whole // r["texts"])))]
    share = F.create_map(*shares)[F.col("lang")] if shares else F.lit(0)
    return rows.filter(F.pmod(hashed, F.lit(whole)) < share).select("lang", "text").distinct(), {r["lang"]: r["n"] for r in found}


def fit(labelled: DataFrame, vocabulary: str = VOCABULARY, documents: int = LEARN_DOCUMENTS) -> LanguageModel:
    """Fit piece probabilities on ``text`` and non-null ``lang`` of ``labelled``.

    About ``documents`` distinct texts of each language are used, so a language with a large share
    of the rows costs no more than another. The number of languages is assumed to be that of a
    label set. Without a labelled text that has a letter and a piece, the model has no languages.
    """
    pieces = read_pieces(vocabulary)
    drawn, sizes = draw(labelled, documents)
    if not sizes or not pieces:
        return LanguageModel([], [], np.zeros((1, 0)), np.zeros(0))
    words = settle(
        drawn.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")),
        "words",
    )
    weights = {lang: np.append(np.full(len(pieces), 1 / len(pieces)), 0.0) for lang in sizes}
    totals = {}
    for _ in range(ITERATIONS):
        counted = (
            words.mapInArrow(partial(_expectation, pieces=pieces, weights=weights), "lang string, piece int, n double")
            .groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        )
        totals = {lang: np.zeros(len(pieces)) for lang in sizes}
        for r in counted:
            totals[r["lang"]][r["piece"]] = r["n"]
        weights = {lang: np.append((t + _PSEUDO) / (t.sum() + _PSEUDO * len(t)), 0.0) for lang, t in totals.items()}
    # A piece that no language uses has nearly the same weight in all of them: leave it out.
    used = np.flatnonzero(sum(totals.values()) > 1e-6)
    if not len(used):
        return LanguageModel([], [], np.zeros((1, 0)), np.zeros(0))
    table = np.vstack([np.stack([weights[lang][used] for lang in sizes], 1), np.zeros((1, len(sizes)))])
    prior = np.log(np.array(list(sizes.values())) / sum(sizes.values()))
    return LanguageModel(list(sizes), [pieces[k] for k in used], table, prior)


def _predict(batches: Iterator[pa.RecordBatch], model: LanguageModel):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]
    )
    table, n_langs = PieceTable(model.pieces), len(model.langs)
    places: dict[str, int] = {}
    known = np.zeros((1 << 16, n_langs))

    def learn(words: list[str]) -> None:
        nonlocal known
        cut = [stretches(w) for w in words]
        found = log_likelihoods([s for c in cut for s in c], table, model.weights)
        sums = np.add.reduceat(found, np.concatenate([[0], np.cumsum([len(c) for c in cut])[:-1]]), axis=0)
        while len(places) + len(words) > len(known):
            known = np.concatenate([known, np.zeros_like(known)])
        known[len(places) : len(places) + len(words)] = sums
        for w in words:
            places[w] = len(places)

    for batch in batches:
        langs, scores = [], []
        if len(places) > _WORDS_HELD:
            places.clear()
        texts = [(t or "").lower().split() if letter else None
                 for t, letter in zip(batch.column("text").to_pylist(), batch.column("letter").to_pylist())]
        new = dict.fromkeys(w for words in texts if words for w in set(words) if w not in places)
        if new and n_langs:
            learn(list(new))
        for words in texts:
            if not words or not n_langs:
                langs.append(UNDECIDED)
                scores.append(0.0)
                continue
            total = known[np.fromiter(map(places.__getitem__, words), np.int64, len(words))].sum(axis=0) + model.prior
            best = int(np.argmax(total))
            langs.append(model.langs[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        columns = batch.column("doc_id"), batch.column("held_out"), langs, scores
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, schema)], schema=schema)


def identify(docs: DataFrame, model: LanguageModel, held: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    ``score`` is the probability of the predicted language given the text, among those learned.
    A text that is null, empty or without a letter is ``und`` with score 0, as is every text
    of a model without languages. Equal probabilities go to the language that comes first by
    code point. Rows that repeat are judged each; other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"),
        F.col(text).cast("string").alias("text"), F.coalesce(F.col(text).rlike(_LETTER), F.lit(False)).alias("letter"),
    )
    return rows.mapInArrow(partial(_predict, model=model), "doc_id long, held_out boolean, lang_pred string, score double")


def predict_languages(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``identify`` with a model fitted on the documents whose crc32 of the id, modulo 4, is not 2."""
    return _learned(docs, vocabulary)[0]


def _learned(docs: DataFrame, vocabulary: str) -> tuple[DataFrame, LanguageModel]:
    prepare(docs.sparkSession)
    held = mod_of_id("doc_id", FOLDS) == HELD_OUT
    model = fit(docs.filter(~held), vocabulary)
    return identify(docs, model, held), model


def drop_undecided(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` without documents in no language; columns as they were.

    If no language was learned, documents with a letter stay. Rows that share an id, or have none, go
    only if none of them is in a language.
    """
    judged, model = _learned(docs, vocabulary)
    out = F.col("lang_pred") == UNDECIDED
    if not model.langs:
        judged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").rlike(_LETTER), F.lit(False)).alias("letter"))
        out = ~F.col("letter")
    return without_ids(docs, judged, out, "doc_id")
