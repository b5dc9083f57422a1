import hashlib
import random
from collections import Counter

import pytest

from taxoloom.llm.token_align import BYTE_BPE, PIECE_BPE, Alignment, TwoTokenizers, align_tokens


@pytest.fixture(scope="module")
def two():
    return TwoTokenizers(open(BYTE_BPE, "rb").read(), open(PIECE_BPE, "rb").read())


def links_of(two, text):
    """Groups of one whole text, encoded in one piece."""
    whole = " " + text
    a = two.first.encode(whole, add_special_tokens=False).ids
    b = two.second.encode(text)
    raw = whole.encode()
    if not text or b"".join(two.bytes_a[i] for i in a) != raw or b"".join(two.bytes_b[i] for i in b) != raw:
        return [], [], []
    ends = []
    for ids, spell in ((a, two.bytes_a), (b, two.bytes_b)):
        at, here = 0, {}
        for k, i in enumerate(ids):
            at += len(spell[i])
            here[at] = k
        ends.append(here)
    groups, x, y = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0][end] + 1, ends[1][end] + 1
        groups.append((a[x:p], b[y:q]))
        x, y = p, q
    return a, b, groups


def brute(two, rows):
    encoded = [(i, *links_of(two, t or "")) for i, t in rows]
    count = Counter((g[0][-1], g[1][-1]) for *_, groups in encoded for g in groups)
    top = {}
    for (a, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for i, a, b, groups in encoded:
        pairs = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            i, len(a), len(b), len(groups), len(pairs), sum(count[p] == top[p[1]] for p in pairs), sum(count[p] for p in pairs),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=repr), count


ODD = [
    None, "", " ", "  ", "a", " a ", "a  b", "a\n b", "a \n b", "a\n  b  \t c", "x  y", "x  y", "  z 　 z", "é à ü ",
    "<s> </s> <unk> <|endoftext|> <0x41>", "日本語 の 文章", "▁ under ▁bar", "it's we'll 've  's", "12 345  6789", "🙂 🙃x", "ﬁ ligature",
    "tab\there", "\x1c a", "a\x1f b", "end ", "\u0085 q", "…  dots . . .", "a" * 300, "\r\n\r\n x",
]


def test_matches_whole_text_encoding(spark, frame, two):
    r = random.Random(5)
    marks = [" ", "  ", "\n", " \n", " ", ".", ", ", "'s", "é", "　", "\t", "<s>"]
    made = ["".join(r.choice(["the", "Straße", "x", "12", "ing", "日本"]) + r.choice(marks) for _ in range(r.randrange(60))) for _ in range(60)]
    rows = list(enumerate(ODD + made)) + [(3, "again a"), (None, "no id"), (7, "the the the")]
    expected, _ = brute(two, rows)
    for size in (8 << 20, 200):
        found = [tuple(x) for x in align_tokens(frame(rows), block_bytes=size).collect()]
        assert sorted(found, key=repr) == expected


def test_pairs_are_popcounts(spark, frame, two):
    rows = [(k, "the cat and the dog and the " + "bird " * (k % 9)) for k in range(300)]
    _, count = brute(two, rows)
    per_doc = Counter(p for _, t in rows for p in {(x[-1], y[-1]) for x, y in links_of(two, t)[2]})
    found = {(r["a"], r["b"]): (r["n_docs"], r["n_links"]) for r in Alignment(frame(rows), block_bytes=900).pairs().collect()}
    assert found == {p: (per_doc[p], n) for p, n in count.items()}


def test_registered_query_on_the_table(spark, tables, two):
    from taxoloom.llm.queries import QUERIES

    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    expected, _ = brute(two, [(r["doc_id"], r["text"]) for r in docs])
    assert sorted((tuple(x) for x in QUERIES["op13_token_align"](spark, tables).collect()), key=repr) == expected


def test_empty_table_and_only_unusable_texts(spark, frame):
    assert align_tokens(frame([])).collect() == []
    found = align_tokens(frame([(1, None), (2, "")])).collect()
    assert sorted(tuple(x) for x in found) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
