"""Each operator against a brute-force version, and on the cases its docstring defines."""

import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from millrace.llm import decontamination, html_extract, language_id, licenses, line_dedup, ngram_join, packing, pretoken, quality_rules, sharding, token_counts

#: Nulls, empties, white space, repeats of rows and ids, and a long text.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "One word."), (4, "One word."), (4, "another text of the same id"), (None, "a row without an id, of several words"), (5, "x" * 200_000), (6, "word " * 30_000), (7, "日本語 テキスト ½ é"), (8, "line one of this text\n" * 40)]
CLASH = [("id", "int"), ("t", "string"), ("h", "long"), ("fp", "long"), ("cls", "long"), ("n", "int"), ("token", "string"), ("hits", "int"), ("bucket", "int"), ("size", "int"), ("k0", "int")]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    return docs.withColumns({c: F.lit(1).cast(t) for c, t in CLASH} | {"source": F.when(F.col("doc_id") != 2, "s"), "lang": F.when(F.col("doc_id") == 4, "en")})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def corpus(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# 1 -----------------------------------------------------------------------------------------


def test_html_structure():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no";</script></head><body class="has-sidebar"><header>Site</header>
      <div class="menu"><a href=x>m</a></div><div id="content"><h1>T&eacute; &amp x</h1><p>a&nbsp; b <b>c</b><br>d<p>e<div class="comments"><p>bad</div><aside>x</aside>
      <form>f<input></form></div><div class="sidebar">s</div><footer>f</footer>"""
    assert html_extract.extract(page) == "Té & x\na b c d\ne"
    article = '<main><article class="post"><header><h1>T</h1></header><p>x <span class="ad">buy</span> 1 < 2</article><section id="comments"><article class="comment"><p>bad</article></section></main>'
    assert html_extract.extract(article) == "T\nx 1 < 2"
    for broken in ("<", "<p", "<p class='x", "&#", "<!--", "</p></div>", "<script>x", "plain"):
        assert isinstance(html_extract.extract(broken), str)


def test_html_survives_stray_quotes_and_depth():
    page = """<body><div><p class="a"">Hello <b title=it's>world</b></p><p><img alt="5" tall">of <i a='b'c">text</i> = ok</p></div>"""
    assert html_extract.extract(page) == "Hello world\nof text = ok"
    assert html_extract.extract("<div>" * 20_000 + "<p>deep" + "</div>" * 20_000) == "deep"
    deep = [f"<html><body>{'<div>' * n}<p>text {n}</p>{'</div>' * n}" for n in (2_990, 3_000, 3_000, 3_005)]
    known = html_extract.template(html_extract.induce([*deep, deep[1] + " "]))
    assert len(known) > 2_990 and html_extract.placed(known, html_extract.parse(deep[0])) is not None


def test_names_count_as_marks_only_beside_layout_words():
    kept = "<article><section class=discussion><p>a</p></section><p class=notice-period>b</p><p id=adoption>c</p><ul><li><a href=x>source</a></li></ul></article>"
    assert html_extract.extract(kept) == "a\nb\nc\nsource"
    gone = "<article><p>a</p><div class='comments-area'><p>x</p></div><div class=cookieNotice>x</div><div id=ad-slot>x</div><div class='site-footer wide'>x</div></article>"
    assert html_extract.extract(gone) == "a"
    assert html_extract.extract("<body><div><p>one two three</p><p>four five</p><ul><li><a href=x>source</a></li></ul></div><ul><li><a href=y>menu</a></li></ul>") == "one two three\nfour five\nsource"


def test_html_wrapper_is_induced_from_aligned_pages(spark):
    pages = [f"<html><body><div><p>{w} one two</p><p>Follow us today</p></div></body>" for w in "abcdef"]
    rows = [(k, f"http://h.example/{k}", p) for k, p in enumerate(pages)] + [(9, None, pages[0]), (10, "http://h.example/x", None), (9, None, pages[0]), (None, "http://x.example", "")]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()
    by = defaultdict(list)
    for r in got:
        by[r["page_id"]].append(r["text"])
    assert by[0] == ["a one two"] and by[9] == ["a one two\nFollow us today"] * 2 and by[10] == [""] and by[None] == [""]
    copies = [(k, "http://h.example/", pages[0].replace("today", "today" if k else "now")) for k in range(9)]
    got = html_extract.extract_pages(spark.createDataFrame(copies, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"a one two\nFollow us today", "a one two\nFollow us now"}  # copies do not make a template
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_find_the_content_of_pages_without_names(spark):
    r = random.Random(7)
    say = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for k in range(60):
        body = [say(r.randrange(5, 30)) for _ in range(r.randrange(1, 9))]
        menu = "".join(f"<li><a href=/{i}>{say(1)}</a></li>" for i in range(5))
        notes = [say(12) for _ in range(4)] if k % 2 else [say(14)]  # as long as a short article, and never the same
        html = f"<body><div><ul>{menu}</ul></div><div><div><h1>{say(4)}</h1>{''.join(f'<p>{b}</p>' for b in body)}<p>Share this</p></div></div><div>{''.join(f'<p>{n}</p>' for n in notes[: k % 3])}</div><div>{say(3)}</div>"
        rows.append((k, f"https://{'hot' if k % 3 else 'cold'}.example/{k}", html))
        want[k] = "\n".join([html_extract.parse(html)[1][5].text, *body])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {x["page_id"]: x["text"] for x in html_extract.extract_pages(pages, marks=False).collect()}
    assert got == want
    assert sum(html_extract.extract(h) == want[k] for k, _, h in rows) < 20  # alone a page does not tell


def test_long_comments_do_not_draw_the_content_to_them(spark):
    r = random.Random(2)
    say = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(n))
    bodies = [[say(9), say(9)] for _ in range(8)]
    rows = [(k, f"http://h.example/{k}", f"<body><div><h1>{say(3)}</h1>{''.join(f'<p>{x}' for x in b)}</div><div class=comments><div><p>{say(40)}<p>{say(50)}</div></div><div>{say(2)}</div>") for k, b in enumerate(bodies)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {x["page_id"]: x["text"].split("\n")[1:] for x in got} == dict(enumerate(bodies))


def brute_matching(a, b):
    if a.tag != b.tag:
        return 0
    w = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            w[i + 1][j + 1] = max(w[i][j + 1], w[i + 1][j], w[i][j] + brute_matching(x, y))
    return w[-1][-1] + 1


def test_tree_matching_equals_the_plain_recursion(monkeypatch):
    r = random.Random(3)

    def grow(depth):
        node = html_extract.Node(r.choice("ab"), None)
        node.kids = [grow(depth - 1) for _ in range(r.randrange(5))] if depth else []
        return node

    def every(node):
        return [node, *[x for k in node.kids for x in every(k)]]

    for cells in (html_extract.CELLS, 4):
        monkeypatch.setattr(html_extract, "CELLS", cells)
        for _ in range(300):
            a, b = grow(3), grow(3)
            a.tag = b.tag = "#"
            for t in (a, b):
                for x in every(t):
                    for k in x.kids:
                        k.parent = x
                html_extract.shaped(every(t))
            matching = html_extract.Matching()
            pairs = list(matching.pairs(a, b))
            assert matching.score(a, b) == brute_matching(a, b) == len(pairs)
            to = {id(x): y for x, y in pairs}
            assert len({id(y) for y in to.values()}) == len(to)
            assert all(x.tag == y.tag and (x is a or to[id(x.parent)] is y.parent) for x, y in pairs)
            order = [id(y) for y in every(b)]
            for x in every(a):
                at = [order.index(id(to[id(k)])) for k in x.kids if id(k) in to]
                assert at == sorted(at)


# 2 -----------------------------------------------------------------------------------------


def sentences(r, alphabet, n):
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randrange(2, 8))) for _ in range(n))


def test_language_network_learns(spark, odd, empty):
    r = random.Random(1)
    kinds = {"aa": "abcdeé ", "bb": "mnopqü "}
    rows = [(k, sentences(r, kinds[l], r.randrange(3, 120)), l) for k in range(160) for l in [("aa", "bb")[k % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", language_id.held_out())
    net = language_id.train(docs.filter("NOT held_out"), per_label=50)
    got = language_id.predict(docs, net, keep=("lang", "held_out")).filter("held_out").collect()
    assert got and np.mean([x["lang"] == x["lang_pred"] for x in got]) > 0.9
    out = language_id.predict(odd, net).collect()
    assert len(out) == len(ODD) and all(0 <= x["score"] <= 1 for x in out)
    assert Counter(x["lang_pred"] for x in out if x["doc_id"] in (1, 2, 3)) == {"und": 3}
    assert language_id.train(odd.withColumn("lang", F.lit(None).cast("string"))) is None
    assert language_id.predict(empty, net).count() == 0


def test_folded_tables_equal_the_network():
    net = language_id.ByteNet(["a", "b"])
    x = np.random.default_rng(0).integers(0, 255, (5, language_id.WINDOW)).astype(np.uint8)
    loss, _ = net.step(x, np.array([0, 1, 0, 1, 0]))
    direct = -net.log_probs(x)[np.arange(5), [0, 1, 0, 1, 0]].mean()
    assert abs(loss - direct) < 1e-4


def test_gradients_equal_finite_differences():
    net = language_id.ByteNet(["a", "b", "c"])
    g = np.random.default_rng(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = g.integers(0, 255, (4, 40)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, grad = net.step(x, y)
    for k, v in net.p.items():
        flat, own = v.reshape(-1), np.asarray(grad[k], float).reshape(-1)
        for i in np.argsort(-abs(own))[:5]:
            was = flat[i]
            ends = []
            for d in (1e-5, -1e-5):
                flat[i] = was + d
                ends.append(net.step(x, y)[0])
            flat[i] = was
            assert abs((ends[0] - ends[1]) / 2e-5 - own[i]) < 1e-4 + 1e-2 * abs(own[i]), k


# 3 -----------------------------------------------------------------------------------------


def shingle_sets(texts):
    out = {}
    for k, t in texts.items():
        w = words(ascii_lower(t))
        out[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def groups(sets):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def edited(r, n=350):
    vocabulary = [f"w{i}" for i in range(40)]
    base = [[r.choice(vocabulary) for _ in range(r.randrange(3, 60))] for _ in range(25)]
    texts = {}
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            p = r.randrange(len(w))
            w[p : p + 1] = r.choice([["new"], [r.choice(vocabulary)], [w[p], r.choice(vocabulary)]])
        texts[i] = " ".join(w + (base[0][:30] if r.random() < 0.3 else []))
    return texts


def test_ngram_join_equals_brute_force(spark):
    texts = edited(random.Random(4)) | {900: None, 901: "", 902: " \n", 903: "A b", 904: "a B", 905: "a"}
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.group(corpus(spark, texts)).collect()}
    assert got == groups(shingle_sets(texts))


def test_ngram_join_counts_runs_over_batches_alike(spark):
    rows = spark.createDataFrame([(t, c, 9) for t in range(5) for c in range(t + 1)] * 2, "token long, cls long, n long")
    none = spark.createDataFrame([], "token long, often long")
    full = {(x["token"], x["cls"]): x["df"] for x in ngram_join._counted(rows, none, 2).collect()}
    assert full == {(t, c): t + 1 for t in range(1, 5) for c in range(t + 1)}
    capped = {(x["token"], x["cls"]): x["df"] for x in ngram_join._counted(rows, none, 2, most=2).collect()}
    assert capped == {k: 2 for k in full}


@pytest.mark.parametrize("batch", [3, 10_000])
def test_ngram_join_deals_frequent_shingles_by_class_with_the_same_result(spark, batch, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = spark.createDataFrame([(t, c, 9) for t in range(5) for c in range(40)] * 2 + [(9, 1, 9)], "token long, cls long, n long")
        hot = spark.createDataFrame([(1, 64), (3, 128)], "token long, often long")
        dealt = ngram_join._dealt(rows, hot, 8).withColumn("task", F.spark_partition_id()).groupBy("token").agg(F.countDistinct("task").alias("n"))
        tasks = {x["token"]: x["n"] for x in dealt.collect()}
        assert tasks[0] == tasks[2] == tasks[4] == 1 and tasks[1] > 4 and tasks[3] > 4
        counted = [(x["token"], x["cls"], x["df"]) for x in ngram_join._counted(rows, hot, 2).collect()]
        assert sorted(counted) == [(t, c, {1: 64, 3: 128}.get(t, 40)) for t in range(5) for c in range(40)]
        shared = {x["cls"]: x["c"] for x in ngram_join._shared(rows.select("token", "cls"), hot, 2).collect()}
        assert shared == {c: 5 for c in range(40)}

        texts = edited(random.Random(5), 150)
        every = ngram_join.frequent
        monkeypatch.setattr(ngram_join, "frequent", lambda docs, size: every(docs, size, 2, 3))
        assert every(corpus(spark, texts).select(F.col("text").alias("t")), 5, 2, 3).count() > 20
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.group(corpus(spark, texts)).collect()}
        assert got == groups(shingle_sets(texts))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ngram_join_odd_rows(spark, odd, empty):
    got = ngram_join.group(odd).collect()
    assert len(got) == len(ODD)
    assert {x["component_id"] for x in got if x["doc_id"] is None} == {None}
    assert all(x["component_id"] == x["doc_id"] for x in got if x["doc_id"] in (1, 2, 3, 5, 7))
    assert ngram_join.group(empty).count() == 0
    kept = ngram_join.keep_first(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 4").count() == 2 and kept.filter("doc_id IS NULL").count() == 1


def test_keep_first_judges_rows_that_share_an_id_by_their_text(spark):
    near = "one text of a good many words that another row repeats with no change at all"
    rows = [(1, near), (2, near), (2, "what this row of the same id says stands nowhere else in the table")]
    kept = ngram_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(x) for x in kept} == {rows[0], rows[2]}


# 4 -----------------------------------------------------------------------------------------


def brute_notices(text, threshold=0.8):
    """(line, license, dice) of a text: every window of every template, the best taken in turn."""
    words = [(i, w) for i, line in enumerate((text or "").split("\n")) for w in re.sub(licenses.BREAK, " ", line.lower()).split()]
    grams = [f"{a[1]} {b[1]}" for a, b in zip(words, words[1:])]
    found = []
    for k, (name, body) in enumerate(licenses.TEMPLATES + licenses.HEADERS):
        own = licenses.bigrams(body)
        bag, has = Counter(own), {w for g in own for w in g.split(" ")}
        must, never = has & set(re.split("[^a-z0-9]+", name.lower())), set(licenses.KINDS) - has
        hit = [g in bag for g in grams]
        starts = [p for p, g in enumerate(grams) if hit[p] and (g == own[0] or p == 0 or not hit[p - 1])]
        ends = [p for p, g in enumerate(grams) if hit[p] and (g == own[-1] or p + 1 == len(grams) or not hit[p + 1])]
        for s in starts:
            for e in ends:
                if s <= e < s + 2 * len(own):
                    common = sum((Counter(grams[s : e + 1]) & bag).values())
                    dice, ws = 2 * common / (e - s + 1 + len(own)), {w for _, w in words[s : e + 2]}
                    if dice >= threshold and must <= ws and not never & ws:
                        found.append((-common, -dice, k, s, e, words[s][0], name))
    kept = []
    for x in sorted(found):
        if not any(x[3] <= o[4] and o[3] <= x[4] for o in kept):
            kept.append(x)
    return sorted((x[5], x[6], round(-x[1], 9)) for x in kept)


def noticed(row):
    return sorted((n["line"], n["license"], round(n["dice"], 9)) for n in row["notices"])


def test_license_scan_equals_brute_force(spark, odd, empty):
    every = [b for _, b in licenses.TEMPLATES + licenses.HEADERS]
    rnd = random.Random(4)
    texts = {
        1: "\n".join(every),
        2: "\n".join(b.replace("License", "Licence", 1) for b in every),
        3: "\n".join(["Nothing here", "", "License", "RELEASED under the   mit-license!"]),
        4: " ".join(every),
        5: "\n\n".join(textwrap.fill(b, 40) for b in every),
    }
    for k in range(6, 40):  # notices with words lost, doubled, swapped for those of others
        out = []
        for b in rnd.sample(every, 5):
            for w in b.split():
                r = rnd.random()
                out += [] if r < 0.04 else [w, w] if r < 0.06 else [rnd.choice(rnd.choice(every).split())] if r < 0.1 else [w]
                out += ["\n"] if rnd.random() < 0.05 else []
        texts[k] = " ".join(out)
    got = {x["doc_id"]: noticed(x) for x in licenses.scan(corpus(spark, texts)).collect()}
    assert got == {k: brute_notices(t) for k, t in texts.items()}
    assert len(got[1]) >= len(licenses.TEMPLATES) - 2 and got[3] == [(3, "MIT", 1.0)] and sum(map(len, got.values())) > 100
    out = licenses.scan(odd).collect()
    assert len(out) == len(ODD) and all(x["notices"] == [] for x in out)
    assert licenses.scan(empty).count() == 0


def test_license_words_that_tell_licenses_apart_decide(spark):
    texts = {
        1: "under the MIT License",
        2: "This code is available under the MIT License, see the file.",
        3: "This code is available under\nthe MIT\nLicense, see the file.",
        4: "Licensed under CC BY-SA 3.0.",
        5: "Licensed under CC BY-SA 4.0.",
        6: "This work is licensed under the GNU Lesser General Public License, version 2.",
        7: "This work is licensed under the GNU General Public License, version 4.",
        8: "This work is licensed under the GNU General Public License, version 2.",
    }
    got = {x["doc_id"]: [n["license"] for n in x["notices"]] for x in licenses.scan(corpus(spark, texts)).collect()}
    assert got == {1: ["MIT"], 2: ["MIT"], 3: ["MIT"], 4: [], 5: ["CC-BY-SA-4.0"], 6: [], 7: [], 8: ["GPL-2.0"]}


def test_license_scan_of_very_long_texts(spark):
    mit = textwrap.fill([b for name, b in licenses.HEADERS if name == "MIT"][1], 75)
    texts = {1: "\n\nint x;\n".join([mit] * 300), 2: "the terms of the software under the license " * 5_000 + "\n" + mit}
    got = {x["doc_id"]: [n["license"] for n in x["notices"]] for x in licenses.scan(corpus(spark, texts)).collect()}
    assert got == {1: ["MIT"] * 300, 2: ["MIT"]}


def test_license_windows_cross_lines_and_stand_inside_longer_ones(spark):
    mit = [b for name, b in licenses.HEADERS if name == "MIT"][1]
    gpl = [b for name, b in licenses.TEMPLATES if name == "GPL-3.0"][1]
    around = "Some words of a text come before it, quite a few of them.", "And others follow it in the same place."
    texts = {
        1: "Copyright 2020 Foo. Licensed under the MIT License.",
        2: mit,
        3: "Copyright 2020\n\n" + textwrap.fill(mit, 75),
        4: "x\n" + textwrap.fill(gpl, 70, initial_indent="# ", subsequent_indent="# ") + "\ny",
        5: f"{around[0]} {gpl.replace('any later version', 'a later one')} {around[1]}",
        6: f"{around[0]} Licensed under the Apache\nLicense, Version 2.0. {around[1]} Released under the BSD\n3-Clause License.",
        7: "A text licensed under CC BY-SA 3.0, software of the public, under the terms of a license as published.",
        8: f"{around[0]} {gpl.replace('you can redistribute it and/or modify it', 'modify it')} {around[1]}",
    }
    got = {x["doc_id"]: x["notices"] for x in licenses.scan(corpus(spark, texts)).collect()}
    named = {k: [(n["line"], n["license"]) for n in v] for k, v in got.items()}
    assert named == {1: [(0, "MIT")], 2: [(0, "MIT")], 3: [(2, "MIT")], 4: [(1, "GPL-3.0")], 5: [(0, "GPL-3.0")], 6: [(0, "Apache-2.0"), (1, "BSD-3-Clause")], 7: [], 8: [(0, "GPL-3.0")]}
    for k, t in texts.items():
        assert sorted((n["line"], n["license"], round(n["dice"], 9)) for n in got[k]) == brute_notices(t)


def test_license_anchors_are_in_every_window_that_matches():
    some = set(licenses.anchors())
    for _, body in licenses.TEMPLATES + licenses.HEADERS:
        grams = licenses.bigrams(body)
        without = sum(1 for g in grams if not some & set(g.split(" ")))
        assert without < licenses.bounds(len(grams), 0.8)[1]


# 5 -----------------------------------------------------------------------------------------


def brute_counts(t):
    w = words(t)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_statistics_equal_brute_force(spark, odd, empty):
    r = random.Random(6)
    texts = {k: "".join(r.choice(["a ", "b ", "\n", "a b c d e f g h ", "#", "é", "X | ", "\x85"]) for _ in range(r.randrange(60))) for k in range(150)}
    got = quality_rules.statistics(corpus(spark, texts)).collect()
    assert all((x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == brute_counts(texts[x["doc_id"]]) for x in got)
    out = quality_rules.statistics(odd).collect()
    assert len(out) == len(ODD) and quality_rules.statistics(empty).count() == 0
    assert all(x["base_failed"] for x in out if x["doc_id"] in (1, 2, 3, 4))


def test_quality_rules_are_learned_and_emitted(spark, odd):
    r = random.Random(8)
    rows = [(k, " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) + ("#" if k % 4 == 0 else "") for _ in range(60)), int(k % 4 > 0)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    rules = quality_rules.train(docs, docs.select("doc_id", "quality"))
    assert len(rules) == 1
    judged = quality_rules.apply(quality_rules.statistics(docs), rules).collect()
    assert all(x["kept"] == (x["doc_id"] % 4 > 0) for x in judged)
    assert quality_rules.train(docs, docs.select("doc_id", F.lit(None).cast("int").alias("quality"))) == []
    assert all(x["kept"] is not None for x in quality_rules.apply(quality_rules.statistics(odd), rules).collect())


# 6 -----------------------------------------------------------------------------------------


def plain(t):
    return words(re.sub(r"[!-/:-@\[-`{-~]", " ", ascii_lower(t)))


def brute_hits(text, items):
    w, out = plain(text), set()
    for i, t in items.items():
        b = plain(t)
        bag = Counter(tuple(b[k : k + 5]) for k in range(len(b) - 4))
        for s in range(len(w) - len(b) + 1):
            c = Counter(tuple(w[k : k + 5]) for k in range(s, s + len(b) - 4))
            if bag and 100 * sum((c & bag).values()) >= 75 * sum((c | bag).values()):
                out.add(i)
    return out


def test_decontamination_equals_brute_force(spark, odd, empty):
    r = random.Random(2)
    vocabulary = [f"v{i}" for i in range(60)]
    items = {k: " ".join(r.choice(vocabulary) for _ in range(r.randrange(12, 40))) for k in range(20)} | {30: "too short an", 31: None}
    texts = {}
    for k in range(120):
        w = items[r.randrange(20)].split()
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            p = r.randrange(len(w))
            w[p : p + 1] = r.choice([[], ["zz"], [w[p], "qq"]])
        w = [r.choice(vocabulary) for _ in range(30)] + w + [r.choice(vocabulary) for _ in range(20)]
        texts[k] = (" ".join(w).upper(), ",\n".join(w))[k % 2]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = {k: brute_hits(t, {i: x for i, x in items.items() if x}) for k, t in texts.items()}
    for block in (1 << 20, 300):
        got = {x["doc_id"]: {h["item"] for h in x["hits"]} for x in decontamination.scan(corpus(spark, texts), bench, block_bytes=block).collect()}
        assert got == want and any(want.values())
    out = decontamination.scan(odd, bench, keep=("text", "hits", "k0"))
    assert out.count() == len(ODD) and decontamination.scan(empty, bench).count() == 0
    assert all(x["hits"] == [] for x in decontamination.scan(odd, bench.limit(0)).collect())


def test_decontamination_of_documents_shorter_than_the_item(spark):
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(60)]
    items = {k: " ".join(r.choice(vocabulary) for _ in range(r.randrange(12, 60))) for k in range(20)}
    texts = {}
    for k in range(160):
        w = items[r.randrange(20)].split()
        cut = r.randrange(len(w) // 2)
        texts[k] = " ".join(w[cut // 2 : len(w) - (cut - cut // 2)])
    want = {}
    for k, t in texts.items():
        w, want[k] = plain(t), set()
        for i, x in items.items():
            b = plain(x)
            bag = Counter(tuple(b[j : j + 5]) for j in range(len(b) - 4))
            for s in range(max(1, len(w) - len(b) + 1)):
                c = Counter(tuple(w[j : j + 5]) for j in range(s, min(len(w), s + len(b)) - 4))
                if 100 * sum((c & bag).values()) >= 75 * sum((c | bag).values()):
                    want[k].add(i)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = decontamination.scan(corpus(spark, texts), bench).collect()
    assert {x["doc_id"]: {h["item"] for h in x["hits"]} for x in found} == want
    short = [x for x in found if x["hits"] and len(plain(texts[x["doc_id"]])) < len(plain(items[x["hits"][0]["item"]]))]
    assert len(short) > 20 and all(x["hits"][0]["n_words"] == len(plain(texts[x["doc_id"]])) for x in short)


def test_hamming_blocks_find_all_within_the_radius():
    g = np.random.default_rng(1)
    stored = g.integers(0, 1 << 63, 50, dtype=np.uint64)
    query = stored[g.integers(0, 50, 300)].copy()
    for k in range(300):
        for b in g.choice(64, g.integers(0, 26), replace=False):
            query[k] ^= np.uint64(1) << np.uint64(b)
    got = set(zip(*decontamination.HammingIndex(stored, 20).near(query), strict=True))
    assert got == {(q, s) for q in range(300) for s in range(50) if int(query[q] ^ stored[s]).bit_count() <= 20}


def test_radius_holds_the_pairs_that_the_exact_check_accepts():
    g = np.random.default_rng(2)
    fresh = lambda n: g.integers(1, 1 << 63, n, dtype=np.uint64)
    for w in (12, 16, 20, 30, 40, 60, 120):
        held = []
        for _ in range(6000):
            a = fresh(w)
            b = a.tolist()
            for _ in range(int(g.integers(1, w // 12 + 2))):
                p, kind = int(g.integers(w)), g.integers(3)
                b[p : p + 1] = [[int(fresh(1)[0])], [], [b[p] if p < len(b) else 1, int(fresh(1)[0])]][kind]
            b = np.concatenate([np.array(b, np.uint64), fresh(w)])[:w]
            if 100 * decontamination.similarity(decontamination.windows(a, 5), decontamination.windows(b, 5)) >= 75:
                x, y = (decontamination.simhash(z, w)[0] for z in (a, b))
                held.append(int(x ^ y).bit_count() <= decontamination.radius_of(w))
        assert len(held) > 200 and np.mean(held) >= 0.99, (w, np.mean(held))


def test_hamming_blocks_leave_out_most_pairs():
    g = np.random.default_rng(3)
    stored, query = (g.integers(0, 1 << 63, n, dtype=np.uint64) for n in (300, 300))
    share = [len(decontamination.HammingIndex(stored, decontamination.radius_of(w)).meet(query)[0]) / 90_000 for w in (12, 30, 60)]
    assert share[0] < 0.6 and share[1] < 0.5 and share[2] < 0.3


# 7 -----------------------------------------------------------------------------------------


def test_line_dedup_equals_brute_force(spark, odd, empty):
    r = random.Random(3)
    base = ["Read more", "read  more!", "- - -", "一二三四五六七八九十一二三四五六七八九十一二三四五六七", "a bb ccc d é", "A  bb\tccc d é ", "the quick brown fox jumps", "x y z w v u", "aa aa aa aa aaa", "one two three four"]

    def edit(s):
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            p = r.randrange(len(s))
            s = r.choice([s[:p] + s[p + 1 :], s[:p] + r.choice("ab é") + s[p:], s[:p] + r.choice("abé") + s[p + 1 :]]) or "q"
        return s

    texts = {i: "\n".join(edit(r.choice(base)) for _ in range(r.randrange(6))) for i in range(150)} | {500: None, 501: "", 502: "\n\n"}
    want, seen = {}, []
    for d in sorted(texts):
        want[d] = []
        for k, raw in enumerate((texts[d] or "").split("\n")):
            line = line_dedup.normal(raw)
            if re.search("[0-9a-z]|[^\x00-\x7f]", line):
                near = len(line.split(" ")) >= 5 or len(line) >= 25
                if any(s == line or near and n and line_dedup.within_one(line, s) for s, n in seen):
                    want[d].append(k)
                seen.append((line, near))
    assert {x["doc_id"]: x["dropped"] for x in line_dedup.report(corpus(spark, texts)).collect()} == want
    out = {(x["doc_id"], x["n_lines"]): x["n_dropped"] for x in line_dedup.report(odd).collect()}
    assert out[8, 41] == 39 and out[6, 1] == 0 and line_dedup.report(empty).count() == 0
    cleaned = line_dedup.clean(odd)
    assert cleaned.columns == odd.columns and cleaned.filter("doc_id = 8").first()["text"] == "line one of this text\n"
    assert cleaned.count() == len(ODD)


def test_cleaning_keeps_the_unique_short_lines_of_a_document(spark):
    note = "Released under the MIT License."
    texts = {1: f"a first document of some words\n{note}", 2: f"red\nblue\n{note}\ngreen", 3: f"日本語の文章がここにある\n{note}", 4: f"{note}\n---\n"}
    got = {x["doc_id"]: x["text"] for x in line_dedup.clean(corpus(spark, texts)).collect()}
    assert got == {1: texts[1], 2: "red\nblue\ngreen", 3: "日本語の文章がここにある"}


def test_cleaning_drops_repeats_of_short_lines_and_of_scripts_without_spaces(spark):
    long = "これは空白のない長い一行の文章であり、同じものが二つの文書に現れるので後のものは消える"
    texts = {1: f"Read more\n{long}\nChapter 1\n}}\nfirst", 2: f"read  more\n{long}\nChapter 2\n}}\nsecond", 3: f"{long[:-1]}\nthird\nthird"}
    got = {x["doc_id"]: x["text"] for x in line_dedup.clean(corpus(spark, texts)).collect()}
    assert got == {1: texts[1], 2: "Chapter 2\n}\nsecond", 3: "third"}


def test_within_one():
    pairs = {("abc", "abc"): True, ("abc", "abd"): True, ("abc", "ab"): True, ("abc", "xabc"): True, ("abc", "bca"): False, ("ab", "ba"): False, ("", "a"): True, ("a", "bcd"): False}
    assert all(line_dedup.within_one(*k) == v == line_dedup.within_one(*reversed(k)) for k, v in pairs.items())


# 8 -----------------------------------------------------------------------------------------


def best_fit(sizes, limit):
    free, used = [], 0
    for s in sorted(sizes, reverse=True):
        fits = [k for k in range(len(free)) if free[k] >= s]
        if fits:
            k = min(fits, key=lambda k: free[k])
            free[k] -= s
        else:
            free.append(limit - s)
            used += 1
    return used, sorted(free)


def test_packing_plan_is_best_fit_decreasing():
    r = random.Random(9)
    for limit in (10, 37, 100):
        for _ in range(60):
            sizes = [r.randrange(1, limit + 1) for _ in range(r.randrange(0, 80))]
            bins = defaultdict(dict)
            for length, lo, hi, first, per, offset in packing.plan(dict(Counter(sizes)), limit):
                for j in range(hi - lo):
                    bins[first + j // per][offset + j % per * length] = length
            for b in bins.values():
                at = 0
                for offset in sorted(b):
                    assert offset == at
                    at += b[offset]
                assert at <= limit
            assert (len(bins), sorted(limit - sum(b.values()) for b in bins.values())) == best_fit(sizes, limit)
            assert sum(len(b) for b in bins.values()) == len(sizes)


def test_packing_documents(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    got = packing.pack_documents(odd, path, 64).collect()
    want = Counter()
    for d, t in ODD:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for p, b in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[b : b + 64], "<u4")
            want[d, p, b, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == want
    bins = defaultdict(list)
    for x in got:
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
    for b in bins.values():
        b.sort()
        assert all(o == sum(n for _, n in b[:k]) for k, (o, _) in enumerate(b)) and sum(n for _, n in b) <= 64
    assert packing.pack_documents(empty, path).count() == 0


# 9 -----------------------------------------------------------------------------------------


def test_sharding(spark, odd, empty):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 50).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    for per in (100_000, 90):
        got = sharding.shard(rows, 16, per_bucket=per).join(rows, "doc_id").collect()
        by = defaultdict(list)
        for x in got:
            by[x["shard"]].append(x)
        assert len(got) == 2000 and {len(b) for b in by.values()} == {125}
        total = Counter(x["source"] for x in got)
        for b in by.values():
            assert sorted(x["slot"] for x in b) == list(range(125))
            assert all(abs(n - total[s] / 16) <= 2 for s, n in Counter(x["source"] for x in b).items())
    out = sharding.shard(odd, 4).collect()
    assert sorted(Counter(x["shard"] for x in out).values()) == [2, 3, 3, 3]
    assert {x["size"] for x in out if x["doc_id"] in (1, 2)} == {1} and all(x["text_crc32"] == 0 for x in out if x["doc_id"] == 1)
    assert sharding.shard(empty).count() == 0


# 10 ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pretokens_give_the_ids_of_the_library(name):
    r = random.Random(1)
    bits = list("abstredlvm  \n\t'''.,!|0123ABSé çÀÿß") + ["'s", "'re", "'ll", "  ", "\n\n", " \n", "\n ", " '", "'ve ", "×", "÷", "SS", "日", "́"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(3000)] + ["", "a<|endoftext|>b", "\x1cab\x00c", " ", "don't'll 'sure !'s"]
    splitter = pretoken.Splitter(public_tokenizers.path(name))
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    data, starts, ends, plain_ = splitter.spans(np.frombuffer(b"".join(raw), np.uint8), offsets)
    at = np.searchsorted(starts, offsets)
    for k, e in enumerate(splitter.tok.encode_batch(texts, add_special_tokens=False)):
        parts = [bytes(data[starts[j] : ends[j]]) for j in range(at[k], at[k + 1])] if plain_[k] else splitter.parts(texts[k])
        assert [i for p in parts for i in ([p] if isinstance(p, int) else splitter.ids(p))] == e.ids, texts[k]


def test_token_counts(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    want = Counter((d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in [*ODD, (50, "a <|endoftext|> b")])
    docs = odd.unionByName(odd.limit(1).withColumns({"doc_id": F.lit(50).cast("long"), "text": F.lit("a <|endoftext|> b")}))
    for head in (131_072, 0, 3):
        assert Counter(tuple(x) for x in token_counts.count_tokens(docs, path, head=head).collect()) == want
    assert token_counts.count_tokens(empty, path).count() == 0
