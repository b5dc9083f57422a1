import math
import re
import zlib
from collections import Counter

from taxoloom.llm.lm_score import count_class, score_texts


def expected(rows):
    token = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else zlib.crc32(b"") % 7 == 2
    learn = [token(t) for i, t in rows if not held(i)]
    c = Counter(w for t in learn for w in t)
    pairs = Counter(p for t in learn for p in zip(["START", *t], t))
    contexts = Counter(p[0] for t in learn for p in zip(["START", *t], t))
    n, v = sum(c.values()), len(c)
    followers, new = Counter(), Counter()
    for h, k in contexts.items():
        followers[int(count_class(k - 1))] += k if k > 1 else 0
    for (h, _), k in pairs.items():
        if k == 1 and contexts[h] > 1:
            new[int(count_class(contexts[h] - 1))] += 1
    rate, g = 0.5, {}
    for k in range(1, 80):
        rate = g[k] = (new[k] + 1) / (followers[k] + 2) if followers[k] else rate
    g0 = (sum(k == 1 for k in c.values()) + 1) / (n + 2)
    out = {}
    for i, t in rows:
        tokens = token(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens)
        total, h = 0.0, "START"
        for w in tokens:
            p = (1 - g0) * c[w] / n if c[w] else g0
            if contexts[h]:
                lam = g[int(count_class(contexts[h]))]
                p = (1 - lam) * pairs[h, w] / contexts[h] + lam * p
            total += math.log10(p)
            h = w
        out[i] = held(i), len(tokens), sum(c[w] > 0 for w in tokens), n, base, total
    return out


def test_scores_agree_with_a_plain_model(frame, prose):
    rows = [(i, prose(i % 40, 5 + i % 60)) for i in range(90)] + [(90, None), (91, ""), (92, "The THE É é\tthe"), (93, prose(3, 4000))]
    got = {r["doc_id"]: r for r in score_texts(frame(rows, 5)).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    for i, (held, n, known, train, base, score) in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)


def test_arcs_of_a_state_and_its_failure_arc_add_up_to_one():
    from taxoloom.llm.lm_score import BackoffAutomaton, _Texts
    from taxoloom.llm.common import Block

    import numpy as np

    texts = _Texts(Block([1, 2], np.array([0, 4, 6]), np.array([0, 1, 0, 2, 1, 0]), [b"a", b"b", b"c"], [False, False]))
    pairs, words = texts.pairs(), texts.word_counts()
    words[texts.start] = 2
    model = {"tokens": 8, "distinct": 4, "new": 0.1, "unseen": np.linspace(0.9, 0.1, 80)}
    automaton = BackoffAutomaton(words, pairs, pairs[3], texts.end, model)
    known = [k for k in range(len(words)) if k != texts.start]
    for state in (k for k in range(len(words)) if k != texts.end):
        total = 10 ** automaton.fail[state] * model["new"]  # the class of unknown words
        for w in known:
            arc = automaton.arcs.get(state * automaton.size + w)
            total += 10**arc if arc is not None else 10 ** (automaton.fail[state] + automaton.root[w])
        assert math.isclose(total, 1.0)


def test_edge_tables(frame, spark):
    assert score_texts(frame([])).count() == 0
    rows = [(None, "a b"), (None, None), (5, "a b"), (5, "a b")]
    got = score_texts(frame(rows, 2)).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 3, 3, 3] and all(r["score"] <= 0 for r in got)


def test_beats_the_base_on_held_out_texts(spark, tables):
    got = score_texts(spark.read.parquet(f"{tables}/documents.parquet")).filter("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
