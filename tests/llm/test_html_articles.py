"""What wrappers keep of articles, what they cost, and their statistics against plain Python."""

import json
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import html_extract as hx


def say(r, n):
    return " ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(n))


def pages_of(spark, htmls, host="h.example"):
    rows = [(k, f"https://{host}/{k}", h) for k, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def texts(df, **options):
    return {r["page_id"]: r["text"].split("\n") for r in hx.extract_pages(df, **options).collect()}


def test_constant_headings_sentences_and_source_links_are_the_articles(spark):
    r = random.Random(1)
    htmls, want = [], {}
    for k in range(12):
        title, parts, steps, links = say(r, 3), [say(r, 4) for _ in range(3)], [say(r, 12) for _ in range(2)], [say(r, 2) for _ in range(2)]
        body = [f"<h1>{title}</h1><h2>Ingredients</h2><ul>{''.join(f'<li>{p}</li>' for p in parts)}</ul><p>Serves four people.</p><h2>Method</h2>{''.join(f'<p>{s}</p>' for s in steps)}<h2>Sources</h2>{''.join(f'<p><a href=/{i}>{x}</a></p>' for i, x in enumerate(links))}"]
        htmls.append(f"<body><nav><a href=/>Home</a></nav><main><article>{body[0]}<p>Follow us</p></article></main><footer>All rights reserved</footer></body>")
        want[k] = [title, "Ingredients", *parts, "Serves four people.", "Method", *steps, "Sources", *links]
    df = pages_of(spark, htmls)
    assert hx.wrappers(df.select(F.lit("h").alias("host"), "html")).count() == 1
    assert texts(df) == want  # the constant end goes


def test_a_constant_heading_before_the_first_varying_text_stays(spark):
    r = random.Random(2)
    bodies = [[say(r, 9), say(r, 8)] for _ in range(6)]
    htmls = [f"<body><div>Site</div><div><p>Home / News</p><h2>Report</h2><p>{a}</p><p>Site</p><p>Middle</p><p>{b}</p><p>Share</p><h3>More</h3><p><a href=/{k}>{say(r, 1)}</a></p></div></body>" for k, (a, b) in enumerate(bodies)]
    assert texts(pages_of(spark, htmls)) == {k: ["Report", a, "Middle", b] for k, (a, b) in enumerate(bodies)}  # "Site" also stands outside


def test_names_of_inline_elements_take_no_words_out():
    page = '<article><p>See <span class="legal">Article 5</span> of the <a class="related">Act</a> and <em class="notice">note</em> end.</p><p>x <span class="ad">buy</span> <b hidden>not seen</b> y</p><p class="notice">gone</p></article>'
    assert hx.extract(page) == "See Article 5 of the Act and note end.\nx y"


@pytest.mark.parametrize("marks", [True, False])
def test_renamed_pages_give_the_articles_of_the_named_ones(spark, marks):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    named = {r["page_id"]: r["text"] for r in hx.extract_pages(table).collect()}
    bare = F.regexp_replace(F.regexp_replace("html", r"<(/?)(?:article|main|nav|header|footer|aside|section)\b", "<$1div"), r"\s(?:class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    got = {r["page_id"]: r["text"] for r in hx.extract_pages(table.withColumn("html", bare), marks=marks).collect()}
    same = sum(got[k] == named[k] for k in named)
    assert same >= 0.9 * len(named), (same, len(named))


def varied(r, n):
    item = lambda: "<li>" + "".join(r.choice(["<p>x</p>", "<div><p>y</p></div>", "<h3>z</h3>", "<div><ul><li>a</li></ul></div>"]) for _ in range(r.randrange(2, 14))) + "</li>"
    return hx.parse(f"<body><ul>{''.join(item() for _ in range(n))}</ul></body>")


@pytest.mark.parametrize("many", [0, 3, 1 << 10])
def test_scores_of_many_pairs_at_once_are_the_same(monkeypatch, many):
    r = random.Random(many)
    monkeypatch.setattr(hx, "MANY", 1 << 40)
    trees = [varied(r, r.randrange(1, 9)) for _ in range(8)] + [hx.parse("<body><ul></ul></body>"), hx.parse("<p>x")]
    want = {(i, j): hx.Matching().score(a[0], b[0]) for i, a in enumerate(trees) for j, b in enumerate(trees)}
    monkeypatch.setattr(hx, "MANY", many)
    for (i, j), n in want.items():
        a, b = trees[i][0], trees[j][0]
        pairs = list(hx.Matching().pairs(a, b))
        assert hx.Matching().score(a, b) == n == len(pairs)
        place = {id(y): k for k, y in enumerate(trees[j][2])}
        assert all(x.tag == y.tag for x, y in pairs) and len({place[id(y)] for _, y in pairs}) == n


def test_lists_of_varied_items_and_deep_pages_end_in_time():
    r = random.Random(5)
    a, b = varied(r, 1500), varied(r, 1500)
    began = time.perf_counter()
    n = hx.Matching().score(a[0], b[0])
    assert time.perf_counter() - began < 15 and n > 1500  # a second or two on a free core
    page = "<body>" + "".join(f"<div>text {k}" for k in range(20_000)) + "</div>" * 20_000
    began = time.perf_counter()
    known = hx.template(hx.induce([page, page + " ", page + "  "]))
    assert len(hx.placed(known, hx.parse(page))) == 20_000
    assert hx.extract(page).endswith("\ntext 19999")
    assert time.perf_counter() - began < 20
    began = time.perf_counter()
    assert isinstance(hx.extract("<body>" + "<div><dt>x" * 20_000), str)
    assert time.perf_counter() - began < 20


def test_statistics_of_a_host_equal_plain_python(spark):
    r = random.Random(7)
    htmls = []
    for k in range(20):
        body = "".join(f"<p>{say(r, r.randrange(3, 20))}</p>" for _ in range(r.randrange(1, 5)))
        htmls.append(f"<body><div><p>{'Top' if k % 4 else 'Other'}</p><ul>{''.join(f'<li><a href=/{say(r, 1)}>{say(r, 1)}</a></li>' for _ in range(3))}</ul></div><div><h1>{say(r, 2)}</h1>{body}<p>End</p></div></body>")
    htmls += htmls[:3]  # copies count once
    rows = spark.createDataFrame([("h", h) for h in htmls], "host string, html string").repartition(4)
    known = hx.templates(rows).first()["template"]
    told = json.loads(hx.wrappers(rows).first()["wrapper"])
    held, slots, mass, seen = defaultdict(set), defaultdict(set), Counter(), {}
    found = []
    for h in htmls:
        tree = hx.parse(h)
        own = tuple(t for _, t in sorted(((len(b.text), b.text) for b in tree[1]), reverse=True)[:2])
        for b, at, above in hx.placed(hx.template(known), tree):
            held[above, hx._text_hash(b)].add(own)
            slots[at].add(own)
            found.append((at, above, hx._text_hash(b), len(b.text), b.linked >= 0.9 * len(b.text)))
        seen[own] = 1
    enough = lambda n: n >= max(hx.LEAST, -(-len(seen) * 3 // 5))
    constant = {k for k, pages in held.items() if enough(len(pages))}
    only = defaultdict(lambda: True)
    for at, above, h, chars, linked in found:
        if (above, h) not in constant:
            mass[at] += 0 if linked else chars
            only[at] &= linked
    links = sorted(at for at in only if only[at] and enough(len(slots[at])))
    want = hx.learn(known, len(seen), mass, links, sorted(map(list, constant)))
    assert told == json.loads(want)
    assert re.match(r"0 #\n1 body", known)
