import random

import numpy as np
import pytest

from taxoloom.llm.byte_repeats import RunIndex, byte_repeats_digest, remove_byte_repeats, suffix_order


def brute(rows, window):
    spots = {}
    last = 1 << 62
    for doc_id, text in rows:
        raw = (text or "").encode()
        key = last if doc_id is None else doc_id
        for i in range(len(raw) - window + 1):
            s = raw[i : i + window]
            spots[s] = min(spots.get(s, (last + 1, 0)), (key, i))
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        key = last if doc_id is None else doc_id
        gone = [False] * len(raw)
        for i in range(len(raw) - window + 1):
            if spots[raw[i : i + window]] < (key, i):
                gone[i : i + window] = [True] * window
        spans = []
        for i, g in enumerate(gone):
            if g and spans[-1:] == [i]:
                spans[-1] = i + 1
            elif g:
                spans += [i, i + 1]
        out.append((doc_id, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=repr)


def ours(frame, rows, **options):
    found = remove_byte_repeats(frame(rows), **options).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["spans"], bytes(r["kept"])) for r in found), key=repr)


def texts(seed, n, letters):
    r = random.Random(seed)
    pool = ["".join(r.choice(letters) for _ in range(r.randrange(5, 60))) for _ in range(8)]
    return ["".join(r.choice(pool) if r.random() < 0.5 else r.choice(letters) for _ in range(r.randrange(14))) for _ in range(n)]


@pytest.mark.parametrize("letters, hot, block", [("abcdefgh é", 50_000, 1 << 20), ("abcdefgh é", 3, 400), ("ab", 50_000, 700), ("ab", 2, 1 << 20)])
def test_brute_force(frame, letters, hot, block):
    rows = list(enumerate(texts(len(letters) + hot, 70, letters)))
    rows += [(500, None), (501, ""), (None, rows[3][1]), (None, rows[5][1]), (7, rows[8][1]), (9, rows[9][1]), (-4, rows[20][1])]
    rows += [(600, "a" * 400), (601, "ab" * 150), (602, "a" * 90), (603, "x\x00y\x00" * 30)]
    assert ours(frame, rows, window=20, seed=8, hot=hot, block_bytes=block, index_bytes=900) == brute(rows, 20)


def test_production_lengths(frame, prose):
    passage = prose(1, 60)
    rows = [(k, prose(k + 10, 80) + (passage if k % 3 == 0 else "") + prose(k + 500, 30)) for k in range(60)]
    rows += [(k + 100, rows[k][1]) for k in range(0, 40, 2)] + [(300, prose(3, 400) * 40), (301, "=" * 5000)]
    assert ours(frame, rows) == brute(rows, 100)
    assert ours(frame, rows, hot=10, block_bytes=9000, index_bytes=5000) == brute(rows, 100)


def test_digest_has_all_documents(frame):
    found = {r["doc_id"]: r for r in byte_repeats_digest(frame([(1, "a" * 250), (2, None), (3, "a" * 100)])).collect()}
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"]) for k, r in found.items()} == {1: (250, 249, 1), 2: (0, 0, 0), 3: (100, 100, 1)}
    assert byte_repeats_digest(frame([])).collect() == []


def test_index_is_a_suffix_order_with_true_matches():
    r = random.Random(4)
    for letters in ("ab", "abcdefgh"):
        pool = ["".join(r.choice(letters) for _ in range(r.randrange(1, 40))).encode() for _ in range(30)]
        index = RunIndex(sorted({p + q for p in pool[:12] for q in pool[12:20]}))
        text = index.text.tolist()
        order = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffix_order(index.text).tolist() == order == index.order.tolist()
        expected = [0] * len(text)
        for x, y in zip(order, order[1:]):
            while x + expected[y] < len(text) and y + expected[y] < len(text) and text[x + expected[y]] == text[y + expected[y]]:
                expected[y] += 1
        assert index.matching().tolist() == expected
        assert len(index.heads) < len(text) / 2
        assert (np.repeat(index.letters, np.diff(np.append(index.heads, len(text))))[1:] == [text[i - 1] if i else -1 for i in order][1:]).all()
