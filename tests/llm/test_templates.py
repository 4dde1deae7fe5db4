"""Template deduction: classes against gathered vectors, main text against pages whose article is known."""

import os
import pickle
import re
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from disclore.llm import queries, templates  # noqa: E402

WORDS = "amber birch cedar delta ember fjord grove heath inlet jetty kelp lagoon marsh north ocean pine quartz reef slate tide".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n)).capitalize() + "."


def layouts(rng, k):
    """(html, main text) of page ``k`` in each of five layouts."""
    title, paragraphs = prose(rng, 4), [prose(rng, int(rng.integers(8, 60))) for _ in range(int(rng.integers(2, 7)))]
    text = " ".join([title, *paragraphs])
    links = "".join(f'<li><a href="/{k}/{w}">{prose(rng, 3)}</a></li>' for w in rng.choice(WORDS, 5))
    side, remark = prose(rng, 12), prose(rng, 15)
    yield f"<html><head><title>{title}</title><script>var t='</p><article>';</script></head><body><header><h2>The Paper</h2></header><nav><ul>{links}</ul></nav><main><article><header><h1>{title}</h1></header>{''.join(f'<p>{p}' for p in paragraphs)}</article></main><section id=comments><article><p>{remark}</p></article></section><footer>&copy; {side}</footer></body></html>", text
    yield f'<body class="post with-sidebar"><div id="top-menu"><ul>{links}</ul></div><div class="wrap sidebar"><div class="post" id="p{k}"><h1>{title}</h1>{"".join(f"<p>{p}</p>" for p in paragraphs)}<div class="share">Tell {side}</div></div></div><div class="cookieNotice">We use {remark}</div><form><label>Name {side}</label><textarea>{remark}</textarea></form></body>', text
    yield f'<table><tr><td width=20>{links}</td><td><h1>{title}</h1>{"".join(f"<p>{p}</p>" for p in paragraphs)}</td></tr></table>', text
    yield f'<div class=x1><div class=x2><a href=/>Home</a> <a href=/n>{prose(rng, 2)}</a></div><div class=x3><h1>{title}</h1><p>{"</p><p>".join(paragraphs)}</p><p>Printed with the kind permission of the publisher, all rights are with the authors.</p></div><div class=x4>{side.split()[0]}</div></div>', text
    yield f"<!doctype html><article><h1>{title}</h1><p><b>{paragraphs[0]}<br>{'<p>'.join(paragraphs[1:])}</article><aside>{side}</aside><div hidden>{remark}</div><p style='display: none'>{remark}</p><noscript>{side}</noscript><button>{side}</button><div role=alert>{side}</div>", text


@pytest.fixture(scope="module")
def site():
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for k in range(12):
        for n, (html, text) in enumerate(layouts(rng, k)):
            i = k * 10 + n
            rows.append((i, f"https://www{n}.example.org:80/{k}", html))
            want[i] = text
    return rows, want


def test_main_text_of_known_articles(spark, site):
    rows, want = site
    got = {r["page_id"]: r for r in templates.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    wrong = {i: (r["text"], want[i]) for i, r in got.items() if r["text"] != want[i]}
    assert not wrong
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_templates_by_host_and_salt_give_the_same(spark, site, monkeypatch):
    rows, want = site
    monkeypatch.setattr(templates, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(templates, "ENTRIES", 40)
    got = templates.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


def test_classes_equal_gathered_vectors(spark, site):
    """Sums of hashes tell tokens apart exactly as vectors of counts over the host's pages do."""
    rows, _ = site
    rows = [*rows, (900, "http://www0.example.org/again", rows[0][2]), (901, "http://www0.example.org/again", rows[0][2])]
    pages = spark.createDataFrame([(u, h) for _, u, h in rows], "url string, html string").select(templates.host_of(F.col("url")).alias("host"), "html").repartition(3)
    counts = defaultdict(lambda: defaultdict(Counter))
    for k, (_, u, h) in enumerate(rows):
        for e in templates.events(h):
            counts[re.match("https?://([^:/]*)", u)[1]][templates.token_of(e)][k] += 1
    got = defaultdict(dict)
    for r in templates.vectors(pages).collect():
        got[r["host"]][r["token"]] = (r["f0"], r["f1"], r["f2"], r["f3"])
        assert (r["pages"], r["total"]) == (len(c := counts[r["host"]][r["token"]]), sum(c.values())) or r["is_text"]
    for host, tokens in counts.items():
        exact = defaultdict(set)
        for t, c in tokens.items():
            exact[tuple(sorted(c.items()))].add(t)
        tags = {t for t in tokens if not t >> 62 & 1}
        told = defaultdict(set)
        for t, f in got[host].items():
            told[f].add(t)
        keep = lambda groups: {frozenset(g) for g in groups if g & tags}
        assert keep(told.values()) == keep(exact.values())


def test_classes_out_of_order_or_crossing_are_left():
    def template(*orders):
        place = {t: (c, k) for c, tokens in enumerate(orders) for k, t in enumerate(tokens)}
        return templates.Template(place, [len(o) for o in orders], set(), {})

    def page(text):
        nodes = {c: templates._node(None, c, "") for c in "abxy"}
        return [(templates.OPEN, nodes[c.lower()]) if c.islower() else (templates.CLOSE, nodes[c.lower()]) for c in text]

    t = {c: templates.token_of(page(c)[0]) for c in "aAbBxXyY"}
    outer, inner = (t["a"], t["A"]), (t["x"], t["y"], t["X"])
    for text, bad in [("axyXxyXA", set()), ("axyXA", set()), ("ayxXA", {1}), ("axyAX", {1}), ("axyA", {1}), ("Aa", {0})]:
        assert template(outer, inner).walk(page(text))[1] == bad, text
    assert template(outer, inner).walk(page("axyXA"))[2] == {0: (-1, 0), 1: (0, 0)}


def test_a_constant_notice_is_template_text_only_with_enough_pages(spark):
    rng = np.random.default_rng(9)
    notice = "Printed with the kind permission of the publisher, all rights are with the authors."
    make = lambda n: [(i, "http://a.example/", f"<article><p>{notice}</p><p>{prose(rng, 30)}</p><p>{prose(rng, 5 + i)}</p></article>") for i in range(n)]
    for n, there in ((templates.MIN_TEXT_PAGES - 1, True), (templates.MIN_TEXT_PAGES, False)):
        rows = templates.main_text(spark.createDataFrame(make(n), "page_id long, url string, html string")).collect()
        assert all((notice in r["text"]) == there for r in rows)


def test_edges(spark):
    copy = "<article><p>the very same article in two places of one host</p></article>"
    rows = [(1, "http://h.example/1", None), (2, None, "<p>no address</p>"), (None, "nonsense", "plain &amp; simple"), (3, "http://h.example/2", ""), (4, "http://c.example/1", copy), (4, "http://c.example/1", copy), (5, "http://c.example/2", copy)]
    rows += [(6, "http://long.example/", "<div>" * 20000 + "deep" + "</div>" * 20000), (7, "http://long.example/", "<article><p>" + "word " * 200_000), (8, "http://x.example/", "<a <a <a " * 20000), (9, "http://x.example/", "a < b &lt; c <!-- x -> y"), (10, "http://y.example/", "<p>a<b>b</b>c<br>d&nbsp; e</p><script>x")]
    rows += [(11, "http://y.example/1", "<ul><li>x<li>y</ul>"), (12, "http://z.example/", "퟿ 中 <p>😀</p>")]
    frame = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = templates.main_text(frame).collect()
    assert len(got) == len(rows) and templates.main_text(frame).columns == ["page_id", "url", "text", "n_chars"]
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == text[3] == "" and text[2] == "no address" and text[None] == "plain & simple"
    assert text[4] == text[5] == "the very same article in two places of one host" and sum(r["page_id"] == 4 for r in got) == 2
    assert text[6] == "deep" and text[7] == ("word " * 200_000).strip() and text[8] == "" and text[9] == "a < b < c"
    assert text[10] == "abc d e" and text[11] == "x y" and text[12] == "퟿ 中 😀"
    assert templates.main_text(frame.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_query_on_whole_pages(spark):
    def article(html):
        inner = re.search("(?s)<article>(.*?)</article>", html)[1]
        return " ".join(unescape(re.sub("<[^>]*>", "", re.sub("</?(?:p|h1|br)>", " ", inner))).split())

    want = {r["page_id"]: article(r["html"]) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert {r["page_id"]: r["text"] for r in queries.op12_templates(spark, "/root/testdata/sf0.001").collect()} == want


def test_templates_are_small(spark, site):
    rows, _ = site
    pages = spark.createDataFrame([(u, h) for _, u, h in rows], "url string, html string").select(templates.host_of(F.col("url")).alias("host"), "html")
    made = {r["host"]: pickle.loads(r["template"]) for r in templates.templates(pages).collect()}
    assert len(made) == 5 and all(len(t.place) < 60 and t.keep for t in made.values())
