import hashlib
import re
import time
from itertools import combinations

import pyarrow as pa
from pyspark.sql import functions as F

from taxoloom.llm import exact_dedup
from taxoloom.llm.common import cut_by_slice
from taxoloom.llm.exact_dedup import Trie, drop_exact, exact_owners
from taxoloom.llm.graph import components
from taxoloom.llm.near_dedup import drop_near, near_components, signature, shingles
from taxoloom.llm.substring_dedup import levels, remove_repeats, repeats_digest

import numpy as np


def words(t, lower=False):
    t = t or ""
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t) if lower else t)


def least_reachable(ids, links):
    to = {i: {i} for i in ids}
    for a, b in links:
        to[a].add(b)
        to[b].add(a)
    out = {}
    for i in sorted(ids):
        stack = [i]
        while stack:
            j = stack.pop()
            if j not in out:
                out[j] = i
                stack += to[j]
    return out


# exact copies


def test_trie_splits_edges_and_keeps_the_best_owner():
    trie = Trie()
    for text, owner in [(b"abcd", (4, 7)), (b"abce", (4, 2)), (b"ab", (3, 1)), (b"abcd", (4, 5)), (b"", (0, None)), (b"abcd", (5, 9))]:
        trie.insert(text, owner)
    found = sorted((n.owner, n.rows) for n in Trie.terminals(trie.root) if n.owner[1] is not None)
    assert found == [((3, 1), 1), ((4, 2), 1), ((5, 9), 3)]


def test_trie_closes_subtrees_of_sorted_strings():
    trie, closed = Trie(), []
    for text in [b"aa", b"aab", b"ab", b"b"]:
        trie.insert(text, (1, 1), 1, closed)
    assert sum(len(list(Trie.terminals(n))) for n in closed) == 3
    assert len(list(Trie.terminals(trie.root))) == 1


def test_owners(frame):
    rows = [(1, "a b"), (2, "ab"), (3, " a\tb "), (4, None), (5, ""), (6, "\n"), (7, "A b"), (8, "ab "), (9, "x" * 90000), (10, "x" * 90000)]
    rows += [(100 + k, "same  text") for k in range(400)] + [(None, "ab"), (11, "ab")]
    got = exact_owners(frame(rows, 6)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(words(t)), []).append((-len(t or ""), i is None, i))
    want = sorted(
        (str(i), min(g)[2], len(g), i == min(g)[2], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, _, i in g
    )
    assert sorted((str(r[0]), *r[1:]) for r in got) == want


def test_empty_table_and_columns_kept(frame):
    assert exact_owners(frame([])).count() == 0
    kept = drop_exact(frame([(1, "a"), (2, "a "), (3, "b")]))
    assert kept.columns == ["doc_id", "text", "bucket", "u", "kept"] and {r["doc_id"] for r in kept.collect()} == {2, 3}


def test_drops_lose_no_text_of_shared_or_missing_ids(frame):
    rows = [(1, "a"), (None, "a "), (None, "only here"), (None, None), (2, "b"), (2, "a"), (3, "b"), (4, "only here ")]
    docs = frame(rows).withColumn("gone", F.lit(1)).withColumn("_Gone", F.lit(2))
    kept = drop_exact(docs)
    assert kept.columns == docs.columns
    # Id 3 goes (2 owns its text), as does 1 (the longer "a " owns it); the others hold a text of their own.
    left = kept.collect()
    assert sorted((r["doc_id"] or 0) for r in left) == [0, 0, 0, 2, 2, 4]
    assert {(r["text"] or "").strip() for r in left} == {"a", "b", "only here", ""}
    near = drop_near(docs)
    assert near.columns == docs.columns and near.filter("doc_id IS NULL").count() == 3
    assert {r["doc_id"] for r in near.collect() if r["doc_id"]} >= {1, 2}


# near copies


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(200, 200 + k) for k in range(30)] + [(300, 300), (41, 40)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {k: v for k, v in least_reachable({x for p in links for x in p}, links).items() if k != v}
    assert got == want


def test_signature_estimates_similarity():
    a, b = np.arange(1, 2001, dtype=np.uint64), np.arange(401, 2401, dtype=np.uint64)
    same = (signature(a, 512) == signature(b, 512)).mean()
    assert abs(same - 1600 / 2400) < 0.08


def test_near_components_agree_with_all_pairs(frame, prose):
    base = prose(1, 160).split()
    rows = []
    for k in range(120):  # one group whose members differ in a growing number of words
        copy = list(base)
        for j in range(k % 9):
            copy[(k * 7 + j * 31) % 160] = f"w{k}x{j}"
        rows.append((k, " ".join(copy)))
    rows += [(200 + k, prose(50 + k, 40)) for k in range(60)] + [(300 + k, prose(50 + k, 40).upper()) for k in range(0, 60, 3)]
    rows += [(400, None), (401, ""), (402, "one two"), (403, "ONE two"), (404, "one"), (405, prose(9, 9000)), (406, prose(9, 9000) + " end")]
    for percent in (80, 85):
        sets = {}
        for i, t in rows:
            w = words(t, True)
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        want = least_reachable(sets, links)
        got = near_components(frame(rows, 5), percent=percent).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {
            i: (len(s), want[i], want[i] == i) for i, s in sets.items()
        }


def test_near_edge_tables(frame):
    assert near_components(frame([])).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    got = sorted(((r["doc_id"] or 0), r["component_id"], r["kept"]) for r in near_components(frame(rows)).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert drop_near(frame(rows)).columns == ["doc_id", "text", "bucket", "u", "kept"]
    assert len(shingles(np.zeros(0, np.uint64))) == 0


# repeated passages


def removed(rows, n):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        out[i] = len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)
    return out


def test_levels_double():
    assert levels(13) == [7, 13] and levels(50) == [7, 13, 25, 50] and levels(6) == [6]


def test_repeats_agree_with_brute_force(frame, prose):
    passage = prose(7, 60)
    rows = [(k, prose(k, 30) + " " + (passage if k % 3 == 0 else "") + "\t" + prose(k + 500, 25)) for k in range(80)]
    rows += [(100, None), (101, ""), (102, passage[:40]), (103, passage), (104, passage + " " + passage), (105, prose(3, 5000)), (99, prose(3, 5000))]
    for n in (13, 26, 6):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in remove_repeats(frame(rows, 7), window=n).collect()}
        assert got == removed(rows, n)


def test_repeats_edge_tables(frame, prose):
    assert repeats_digest(frame([])).count() == 0
    text = prose(1, 20)
    got = sorted(((r["doc_id"] or 0), r["n_removed"]) for r in repeats_digest(frame([(None, text), (5, text), (5, text)])).collect())
    assert got == [(0, 20), (5, 0), (5, 0)]


def test_short_texts_count_with_all_that_their_groups_hold(monkeypatch):
    """A task of very many short texts passes its groups on before they fill its memory."""
    monkeypatch.setattr(exact_dedup.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    monkeypatch.setattr(exact_dedup, "HELD_BYTES", 1 << 20)
    rows = [f"text number {k}" for k in range(8000)]
    batches = (
        pa.RecordBatch.from_arrays([pa.array(range(k, k + 500)), pa.array([20] * 500), pa.array(rows[k : k + 500])], names=["doc_id", "points", "text"])
        for k in range(0, 8000, 500)
    )
    sizes = [b.num_rows for b in exact_dedup._local_groups(batches) if b.column("bytes").null_count == 0]
    assert sum(sizes) == 8000 and max(sizes) * exact_dedup.GROUP_BYTES < 2 << 20


def test_slices_cost_what_the_keys_cost():
    """A small block among a million slices, and slices that together hold every key once, in order."""
    r = np.random.default_rng(1)
    for bits in (20, 33, 40, 64):
        keys = np.unique(r.integers(0, 1 << bits, 500, dtype=np.uint64, endpoint=False) if bits < 64 else r.integers(0, 2**64 - 1, 500, dtype=np.uint64))
        for n_slices in (1, 8, 1_000_000, 1 << 30):
            started = time.perf_counter()
            cut = cut_by_slice(keys, bits, n_slices)
            assert time.perf_counter() - started < 0.05 and len(cut) <= len(keys)
            assert [i for a, b in cut.values() for i in range(a, b)] == list(range(len(keys)))
            assert list(cut) == sorted(cut) and 0 <= min(cut) and max(cut) < n_slices
            # Any part of the keys falls into the same slices.
            some = cut_by_slice(keys[::7], bits, n_slices)
            of = {int(k): s for s, (a, b) in cut.items() for k in keys[a:b]}
            assert all(of[int(k)] == s for s, (a, b) in some.items() for k in keys[::7][a:b])
    assert cut_by_slice(np.zeros(0, np.uint64), 64, 1000) == {}
