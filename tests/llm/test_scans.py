import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from taxoloom.llm.decontaminate import contamination, contamination_digest, drop_contaminated, without_hits
from taxoloom.llm.html_text import extract_text, main_text
from taxoloom.llm.language_id import PieceTable, draw, drop_undecided, fit, identify, log_likelihoods, predict_languages
from taxoloom.llm.license_scan import TEMPLATES, scan_licenses
from taxoloom.llm.source_mix import mix_sources, mixed
from taxoloom.llm.sql import ORACLE
from taxoloom.llm.url_filter import DAMPING, judge_urls

import numpy as np


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_contamination_agrees_with_brute_force(frame, spark, prose):
    items = [(k, prose(900 + k, 20 + k)) for k in range(12)] + [(50, prose(950, 6)), (51, None), (52, ""), (53, prose(902, 22)), (None, "odd item")]
    rows = [(k, prose(k, 200) + " " + (items[k % 12][1] if k % 2 else prose(950, 6) if k % 5 == 0 else "")) for k in range(60)]
    rows += [(100, None), (101, ""), (102, items[3][1].upper().replace(" ", "--")), (103, prose(1, 9000) + " " + items[0][1]), (104, "an odd item")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in rows:
        w, hit, names = alnum(t), set(), set()
        for name, text in items:
            iw = alnum(text)
            n = min(13, len(iw))
            wins = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    names.add("" if name is None else str(name))
        want[i] = len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)
    for words in (500_000, 60):  # one automaton, and several shards
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in contamination(frame(rows, 4), table, shard_words=words).collect()}
        assert got == want
    digest = {r["doc_id"]: r["items_sha256"] for r in contamination_digest(frame(rows), table).collect()}
    assert digest == {i: hashlib.sha256(",".join(x[2]).encode()).hexdigest() for i, x in want.items()}
    assert {r["doc_id"] for r in drop_contaminated(frame(rows), table).collect()} == {i for i, x in want.items() if not x[3]}
    cut = {r["doc_id"]: r["text"] for r in without_hits(frame(rows), table).collect()}
    assert cut.keys() == {i for i, x in want.items() if x[1] and not x[3]}
    assert all(len(alnum(t)) == want[i][0] - want[i][1] for i, t in cut.items())


def test_contamination_edge_tables(frame, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(frame([]), none).count() == 0
    got = contamination(frame([(None, "a b"), (1, "a b"), (1, "a b")]), none).collect()
    assert len(got) == 3 and not any(r["contaminated"] for r in got)


def test_forward_pass_sums_all_segmentations():
    pieces = ["▁a", "b", "ab", "▁ab", "a", "▁"]
    p = np.array([[0.1], [0.2], [0.3], [0.05], [0.15], [0.2], [0.0]])
    got = log_likelihoods(["▁ab", "▁zb"], PieceTable(pieces), p)
    weight = dict(zip(pieces, p[:, 0]))
    assert np.isclose(got[0, 0], np.log(weight["▁ab"] + weight["▁a"] * weight["b"] + weight["▁"] * weight["ab"] + weight["▁"] * weight["a"] * weight["b"]))
    assert np.isclose(got[1, 0], np.log(weight["▁"] * 1e-7 * weight["b"]))


def test_languages_on_held_out_documents(spark, tables, frame):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 !? \n"), (None, None)], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    got = predict_languages(docs).collect()
    assert len(got) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 4 == 2) for r in got)
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in got if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if lang[r["doc_id"]] is None)
    assert drop_undecided(docs).count() == docs.count() - 4
    unlabelled = frame([(1, "some words")]).withColumn("lang", F.lit(None).cast("string"))
    assert [r["lang_pred"] for r in predict_languages(unlabelled).collect()] == ["und"]
    assert predict_languages(docs.filter("false")).count() == 0


def test_main_text():
    p = "<p>" + "Plain words of the article go on for a while. " * 4 + "</p>"
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav>
    <div class="cookie-banner">We use cookies.</div><div id=content><h1>Head &amp; tail</h1>{p}<p>One<br>two &lt;b&gt;<p>Three <b>bold<p>{p}</div>
    <div class="comments"><p>Nice read, thanks for sharing it with all of us here today.</p></div><aside>Side</aside>
    <form><input name=q> Search</form><footer>Foot</footer><script>var x = "</p>";</script></body></html>"""
    text = main_text(page)
    para = ("Plain words of the article go on for a while. " * 4).strip()
    assert text == "\n\n".join(["Head & tail", para, "One two <b>", "Three bold", para])
    assert main_text(None) == main_text("") == main_text("<p></p><!-- x -->") == ""
    assert main_text("just text & more") == "just text & more"
    assert main_text("<div>" * 3000 + "deep words" + "</div>" * 3000) == "deep words"


def test_broken_declarations_and_deep_pages():
    assert main_text("a<![x[ y ]]>b<p>text</p>") == "ab\n\ntext" and main_text("<![ 1]>x") == "x"
    assert main_text("<!DOCTYPE html [<!ELEMENT x (y)> <!ENTITY z 'w'>]><p>hello</p>") == "hello"
    for page in ("<!", "<!--", "<!x", "<![CDATA[ x", "<!doctype", "<p>a<!-- b", "</", "<a href=", "&#xffffffff; &bogus; x"):
        main_text(page)
    started = time.time()
    for tags in ("<div>", "<b>", "<p><b>", "<li>", "<table><td>", "</b><b>", "<nav></p>"):
        main_text(tags * 50_000 + "text")
    assert time.time() - started < 60


def test_extracts_every_page(spark, tables):
    pages = spark.read.parquet(f"{tables}/pages.parquet")
    rows = pages.unionByName(spark.createDataFrame([(None, None, None), (-1, "u", "")], pages.schema))
    got = extract_text(rows).collect()
    assert len(got) == rows.count() and all(r["n_chars"] == len(r["text"]) for r in got)
    html = {r["page_id"]: r["html"] for r in rows.collect()}
    assert all(r["text"] for r in got if "<article>" in (html[r["page_id"]] or ""))
    assert extract_text(pages.filter("false")).count() == 0


def test_license_notices(frame, prose):
    apache = TEMPLATES["Apache-2.0 header"].split()
    edited = " ".join(w for k, w in enumerate(apache) if k % 17 != 5)
    rows = [(1, f"x y {TEMPLATES['MIT']} {prose(1, 50)} {TEMPLATES['MIT'].upper()}"), (2, f"{prose(2, 30)} {edited} tail"),
            (3, "Released under a License."), (4, None), (5, ""), (6, prose(3, 9000) + " " + TEMPLATES["GPL-3.0"]), (None, TEMPLATES["MIT"]), (None, TEMPLATES["MIT"])]
    got = [(r["doc_id"], r["license"], round(r["coverage"], 2), r["first_word"], r["end_word"]) for r in scan_licenses(frame(rows)).collect()]
    assert sorted(g for g in got if g[0] == 1) == [(1, "MIT", 1.0, 2, 7), (1, "MIT", 1.0, 57, 62)]
    two = [g for g in got if g[0] == 2]
    assert len(two) == 1 and two[0][1] == "Apache-2.0 header" and two[0][2] >= 0.9 and two[0][3] == 30
    assert [g[1:] for g in got if g[0] == 6] == [("GPL-3.0", 1.0, 9000, 9012)]
    assert sum(g[0] is None for g in got) == 2 and not any(g[0] in (3, 4, 5) for g in got)
    assert scan_licenses(frame([])).count() == scan_licenses(frame(rows), {}).count() == 0


def test_mix_meets_its_targets(spark, prose):
    sizes = {"a": 4000, "b": 900, "c": 9000, "d": 50, None: 2000}
    rows, i = [], 0
    for source, total in sizes.items():
        for _ in range(total // 10):
            rows.append((i, prose(i, 10), source, "x"))
            i += 1
    rows += [(i, None, "a", "x"), (i + 1, "", "e", "x"), (None, "a b", "a", "x"), (0, rows[0][1], "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string").repartition(5)
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    taken, target, size = Counter(), {}, {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        key = r["source_size"]
        taken[key] += r["taken"]
        target[key], size[key] = r["target"], key
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 and all(target[k] <= 2 * k for k in target)
    assert all(abs(taken[k] - target[k]) <= 20 for k in target) and sum(taken.values()) <= 1.5 * total
    again = mix_sources(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mix_sources(docs.filter("false")).count() == 0
    assert mix_sources(docs.filter("text IS NULL OR text = ''")).agg(F.sum("taken")).first()[0] == 0
    assert mixed(docs.filter("doc_id > 0")).columns == [*docs.columns, "copies"]
    clash = docs.withColumn("copies", F.lit("x")).withColumn("taken_id", F.lit(1))
    mix = mixed(clash)
    assert mix.columns == [*docs.columns, "taken_id", "copies"]
    # Rows that share id 0 do not multiply; the row without an id may be taken too.
    want = {r["doc_id"] for r in got if r["taken"] > 0}
    rows_of = Counter(r["doc_id"] for r in clash.collect() if r["doc_id"] in want)
    assert Counter(r["doc_id"] for r in mix.collect()) == rows_of


def test_url_rules_and_propagation(spark):
    def link(*hosts):
        return "".join(f'<a class=x href="http://{h}/p">t</a>' for h in hosts)

    rows = [
        (1, "http://Sub.Example.NET/en/x?y", link("good.example.com")), (2, "http://bad.net/", ""), (3, "http://net", None),
        (4, "http://x.org/fr/", ""), (5, "http://x.example.com/de/1#a", ""), (6, "http://linker.example.com/z", link("bad.net", "x.example.com")),
        (7, "http://good.example.com/a", link("other.example.com")), (8, None, None), (9, "no scheme/net/", "<a href=/x>y</a>"),
        (10, "http://far.example.com/", link("linker.example.com")), (11, "http://alone.example.com", ""), (11, "http://alone.example.com", ""),
        (12, "http://xnet/", ""), (None, "http://a.net/?://b", ""), (13, "http://other.example.com/", None),
    ]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, rank int, host string").repartition(4)
    got = judge_urls(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert by[1] == ("sub.example.net", "/en/x", "example.net/en/", "allow")
    assert by[2] == ("bad.net", "/", "net/", "block") and by[3] == ("net", "", None, "allow")
    assert by[4][2:] == ("org/fr/", "allow") and by[5] == ("x.example.com", "/de/1", "example.com/de/", "block")
    assert by[6][2:] == (None, "block") and by[10][2:] == (None, "block")
    assert by[7][2:] == by[13][2:] == by[11][2:] == (None, "allow")
    assert by[8] == by[9] == ("", "", None, "allow") and by[12][2] is None and by[None][:3] == ("a.net", "/", "net/")
    assert judge_urls(pages.filter("false")).count() == 0


def stages_by_sql(docs, benchmark):
    """What the pipeline should keep, ``doc_id: copies``: every stage by SQL over what the one before kept."""
    con = duckdb.connect()
    con.register("all_documents", docs)
    con.register("benchmark", benchmark)
    con.execute("CREATE TABLE documents AS SELECT * FROM all_documents")
    letters = {i for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall() if any(c.isalpha() for c in t or "")}
    kept = [len(letters)]

    def keep(ids):
        con.register("wanted", pa.table({"id": pa.array(sorted(ids), pa.int64())}))
        con.execute("CREATE OR REPLACE TABLE documents AS SELECT * FROM documents WHERE doc_id IN (SELECT id FROM wanted)")
        kept.append(len(ids))

    keep(letters)
    keep({r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLE['op10_exact_dedup']}) WHERE kept").fetchall()})
    near = ORACLE["op4_near_dedup"].replace("85 *", "80 *")
    assert near != ORACLE["op4_near_dedup"]
    keep({r[0] for r in con.execute(f"SELECT doc_id FROM ({near}) WHERE kept").fetchall()})
    keep({r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLE['op7_decontaminate']}) WHERE NOT contaminated").fetchall()})
    mix = con.execute(f"SELECT doc_id, taken // size FROM ({ORACLE['op8_source_mix']}) WHERE taken > 0").fetchall()
    return dict(mix), kept


def test_pipeline_equals_sql_stage_by_stage(spark, tables):
    got = corpus_pipeline.run(spark, tables)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert got.columns == [*docs.columns, "copies"]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "source mixing"]
    expected, kept = stages_by_sql(docs.toArrow(), spark.read.parquet(f"{tables}/benchmark.parquet").toArrow())
    assert {r["doc_id"]: r["copies"] for r in got.collect()} == expected
    # Every stage but the first finds something to drop here.
    assert kept[1] > kept[2] > kept[4] and len(expected) > 50


def test_pipeline_on_odd_tables(spark, prose, tmp_path):
    """Null and empty texts, repeated ids, and columns whose names clash with those of the stages."""
    schema = "doc_id long, text string, lang string, source string, copies string, taken int, kept string, component_id int"
    texts = [prose(k, 60) for k in range(30)]
    rows = [(k, t, "en", "a" if k % 3 else None) for k, t in enumerate(texts)]
    rows += [(100, None, "en", "a"), (101, "", None, "a"), (102, "12 34", "en", "b"), (103, texts[3] + " ", "en", "b"), (104, texts[4] + " one", "en", "b")]
    spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    items = spark.createDataFrame([(1, " ".join(texts[5].split()[:40])), (2, None), (3, "")], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "taken", "kept", "component_id", "copies"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    expected, _ = stages_by_sql(docs.select("doc_id", "text", "lang", "source").toArrow(), items.toArrow())
    assert {r["doc_id"]: r["copies"] for r in got.collect()} == expected
    assert 5 not in expected and not {100, 101, 102} & expected.keys()

    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    items.write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_main_text_leaves_out_what_main_wraps_beside_the_article():
    p = "<p>" + "Plain words of the article go on for a while. " * 4 + "</p>"
    teasers = "<ul class=latest>" + "".join(f"<li><a href=/{k}>Short teaser {k}</a></li>" for k in range(8)) + "</ul>"
    para = ("Plain words of the article go on for a while. " * 4).strip()
    assert main_text(f"<body><main><div>{p * 3}</div>{teasers}</main></body>") == "\n\n".join([para] * 3)


def test_main_text_joins_all_subtrees_that_reach_the_threshold():
    def p(c):
        return f"<p>{c * 200}</p>"

    split = f"<div>{p('a') * 3}</div><div>{p('b') * 3}</div>"
    whole = ["a" * 200] * 3 + ["b" * 200] * 3
    assert main_text(f"<body>{split}</body>") == "\n\n".join(whole)
    page = f"<body><h1>Head</h1><div class=date>Today</div>{split}<h2>More</h2><h2>Next</h2><div><div>{p('c')}</div></div><h2>End</h2></body>"
    assert main_text(page) == "\n\n".join(["Head", *whole, "Next", "c" * 200])
    # Text without an element of its own, and a subtree below one that does not reach the threshold.
    thin = "<div>" + "<i></i>" * 400 + f"<div>{p('d')}</div></div>"
    assert main_text(f"<body>{'e' * 300}<div>{p('a') * 3}</div>{thin}</body>") == "\n\n".join(["e" * 300, *whole[:3], "d" * 200])


def test_copies_do_not_decide_what_languages_are_learned_from(spark, frame, prose):
    other = ["der", "die", "und", "ist", "nicht", "ein", "ich", "sie", "mit", "auf", "für", "werden"]
    rows = [(k, prose(k % 10, 40, other), "de") for k in range(6000)] + [(9000 + k, prose(100 + k, 40), "en") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = identify(docs, fit(docs, documents=20), F.lit(False)).collect()
    assert {(r["doc_id"] < 9000, r["lang_pred"]) for r in got} == {(True, "de"), (False, "en")}
    drawn = Counter(r["lang"] for r in draw(docs, 20)[0].collect())
    assert drawn["de"] == 10 and 5 <= drawn["en"] <= 40
    # Copies of a text that is drawn do not come along, and labelled rows without words teach nothing.
    assert draw(docs.filter("doc_id % 10 = 0 AND doc_id < 9000"), 1)[0].count() == 1
    blank = frame([(1, " "), (2, "some words"), (3, None)]).withColumn("lang", F.when(F.col("doc_id") != 2, "en"))
    assert [(r["lang_pred"], r["score"]) for r in predict_languages(blank).collect()] == [("und", 0.0)] * 3


def test_url_verdicts_do_not_depend_on_the_number_of_seeds(spark):
    chain = [(k, f"http://h{k}.example.com/", f'<a href="http://{"s0.net" if k == 1 else f"h{k - 1}.example.com"}/">t</a>') for k in range(1, 7)]
    linked = spark.createDataFrame(chain, "page_id long, url string, html string")
    for seeds in (10, 30_000):
        alone = spark.range(seeds).select((F.col("id") + 100).alias("page_id"), F.format_string("http://s%d.net/", "id").alias("url"), F.lit("").alias("html"))
        got = judge_urls(linked.unionByName(alone)).filter("page_id < 100").collect()
        assert len(got) == 6 and all(r["verdict"] == "block" for r in got)


def brute_ranks(edges, weights, back):
    """Personalised PageRank by plain iteration."""
    out = {}
    for (src, dst), w in edges.items():
        src, dst = (dst, src) if back else (src, dst)
        out.setdefault(src, {})[dst] = w
    rank = dict(weights)
    for _ in range(300):
        after = {h: (1 - DAMPING) * w for h, w in weights.items()}
        for src, arcs in out.items():
            for dst, w in arcs.items():
                after[dst] = after.get(dst, 0.0) + DAMPING * rank.get(src, 0.0) * w / sum(arcs.values())
        rank = after
    return rank


def test_verdicts_equal_brute_force_page_rank(spark):
    r = random.Random(3)
    hosts = [f"h{k}.example.com" for k in range(14)] + ["a.net", "b.net", "c.org", "d.org"]
    pages, edges, held = [], {}, {}
    for k in range(70):
        host = r.choice(hosts)
        path = r.choice(["/en/", "/de/", "/fr/", "/x"])
        to = set(r.sample(hosts, r.choice([0, 0, 1, 2]))) - {host}
        pages.append((k, f"http://{host}{path}", "".join(f'<a href="//{h}/">x</a>' for h in sorted(to)), host, path))
        for h in to:
            edges[host, h] = edges.get((host, h), 0) + 1

    def rule(host, path):
        if host.endswith(".net"):
            return "block"
        if host.endswith(".org") and path == "/fr/":
            return "allow"
        return "block" if path == "/de/" and host.endswith("example.com") else None

    for _, _, _, host, path in pages:
        held.setdefault(host, []).append(rule(host, path))
    good = {h: v.count("allow") / len(v) for h, v in held.items() if "allow" in v}
    bad = {h: v.count("block") / len(v) for h, v in held.items() if "block" in v}
    up, down = brute_ranks(edges, good, False), brute_ranks(edges, bad, True)
    expected = {}
    for k, _, _, host, path in pages:
        plain = (1 - DAMPING) * (1 - good.get(host, 0) - bad.get(host, 0)) if host in good or host in bad else 0.0
        all_, distrust = up.get(host, 0) + down.get(host, 0) + plain, down.get(host, 0)
        assert not all_ or abs(distrust / all_ - 0.5) > 1e-3
        expected[k] = rule(host, path) or ("block" if distrust > 0 and distrust >= all_ / 2 else "allow")
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    found = {x["page_id"]: x["verdict"] for x in judge_urls(df).collect()}
    assert found == expected and len({v for k, v in found.items() if not rule(*pages[k][3:])}) == 2
    # Seeds of either kind that nothing links to change no verdict.
    for name in ("http://t{}.org/fr/", "http://t{}.net/"):
        more = spark.createDataFrame([(1000 + k, name.format(k), "") for k in range(40)], df.schema)
        assert {x["page_id"]: x["verdict"] for x in judge_urls(df.unionByName(more)).collect() if x["page_id"] < 1000} == expected


def test_a_path_rule_is_not_the_verdict_of_a_host(spark):
    rows = [(k, f"http://some.example.com/{'de' if k < 3 else 'x'}/{k}", "") for k in range(9)]
    rows += [(20 + k, f"http://most.example.com/{'de' if k < 5 else 'x'}/{k}", "") for k in range(9)]
    # Seeded both ways, half and half: a tie blocks.
    rows += [(40, "http://e.example.net/en/", ""), (41, "http://e.example.net/", ""), (42, "http://e.example.net", "")]
    rows += [(50, "http://f.example.net/en/", ""), (51, "http://f.example.net/", ""), (52, "http://f.example.net/q", ""), (53, "http://f.example.net", "")]
    got = {r["page_id"]: r["verdict"] for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == ("block" if k < 3 else "allow") for k in range(9)) and all(got[20 + k] == "block" for k in range(9))
    assert got[42] == "allow" and got[53] == "block"


def test_license_notices_that_adjoin_or_miss_words(frame):
    mit, nc, gpl, apache = (TEMPLATES[k] for k in ("MIT", "CC-BY-NC-4.0", "GPL-3.0", "Apache-2.0 header"))
    rows = [(1, " ".join([mit] * 40)), (2, f"a: {mit} b and c: {mit} d: {nc} {nc} e: {mit}"), (3, "It is Released under MIT License here"),
            (4, f"{gpl} {gpl} x {gpl}"), (5, f"{apache} {apache}"), (6, f"Released the MIT License. {mit}"), (7, "released")]
    got = {}
    for r in scan_licenses(frame(rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["first_word"], r["license"], r["matched"]))
    assert sorted(got[1]) == [(5 * k, "MIT", 5) for k in range(40)]
    assert [x[1] for x in sorted(got[2])] == ["MIT", "MIT", "CC-BY-NC-4.0", "CC-BY-NC-4.0", "MIT"]
    assert got[3] == [(2, "MIT", 4)] and sorted(got[6]) == [(0, "MIT", 4), (4, "MIT", 5)] and 7 not in got
    assert [x[1] for x in got[4]] == ["GPL-3.0"] * 3 and [x[1] for x in got[5]] == ["Apache-2.0 header"] * 2


def test_documents_stay_when_no_language_was_learned(frame):
    docs = frame([(1, "some words"), (2, "123 !"), (3, None), (4, "more")]).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r["doc_id"] for r in drop_undecided(docs).collect()) == [1, 4]
