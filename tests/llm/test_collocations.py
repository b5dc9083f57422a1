import random
import re
from collections import Counter

import pytest

from taxoloom.llm.collocations import collocations


def brute(rows, least=10, most=3, top=2000, percent=50):
    count, total = {}, Counter()
    for _, text, lang in rows:
        c = count.setdefault(lang or "und", Counter())
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for n in range(1, most + 1):
                for i in range(len(words) - n + 1):
                    c[tuple(words[i : i + n])] += 1
    out = []
    for lang, c in count.items():
        cands = [p for p, a in c.items() if len(p) > 1 and a >= least]
        around = Counter()
        for p in cands:
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    around[p[i : i + m]] = max(around[p[i : i + m]], c[p])
        rank = []
        for p in cands:
            a = c[p]
            if p in around and 100 * around[p] >= percent * a:
                continue
            s, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rank.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for k, (s, a, p, l, r) in enumerate(sorted(rank)[:top], 1):
            out.append((lang, k, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def made(seed, n, vocab, words=60):
    r = random.Random(seed)
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", " - "]
    return [
        (k, "".join(r.choice(vocab) + r.choice(ends) for _ in range(r.randrange(words))), r.choice(["en", "de", None, "und", "x\ty"]))
        for k in range(n)
    ]


@pytest.fixture
def table(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, lang string, f int, phrase string").repartition(3)

    return make


VOCAB = ["the", "The", "of", "new", "york", "a\x01", "a", "straße", "日本", "z" * 50]


@pytest.mark.parametrize("options", [{}, {"group_suffixes": 40, "block_bytes": 500}, {"group_suffixes": 7, "block_bytes": 1 << 20}])
def test_brute_force(table, options):
    rows = made(1, 120, VOCAB) + [(900, None, "en"), (901, "", None), (5, "new york " * 40, "en"), (5, "new york " * 40, "en")]
    found = collocations(table(rows), **options).collect()
    assert sorted(tuple(r) for r in found) == brute(rows)


def test_longer_phrases_and_ties(table):
    rows = made(2, 150, ["a", "b", "c"], 30)
    for top in (5, 2000):
        found = collocations(table(rows), most_words=4, least=4, top=top, group_suffixes=50).collect()
        assert sorted(tuple(r) for r in found) == brute(rows, 4, 4, top)


def test_one_long_text_and_hot_phrase(table):
    rows = [(0, "in the end " * 20000 + "x y. " * 12, "en")] + [(k, "in the end", "en") for k in range(50)]
    found = collocations(table(rows), group_suffixes=1000, block_bytes=4000).collect()
    assert sorted(tuple(r) for r in found) == brute(rows)


def test_empty(table):
    assert collocations(table([])).collect() == []
    assert collocations(table([(1, None, None), (2, "", "en"), (3, "one two three", "en")])).collect() == []


def test_large_alphabets_sort_by_columns():
    import numpy as np

    from taxoloom.llm.collocations import _suffixes

    codes, begins = np.array([1, 2, 3, 0, 1, 2, 3, 1]), np.array([1, 0, 0, 0, 0, 0, 0, 1], bool)
    small, big = _suffixes(codes, begins, 3, 3), _suffixes(codes, begins, 1 << 40, 3)
    assert (small[0] == big[0]).all() and (small[1] == big[1]).all()
