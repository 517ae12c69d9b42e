"""Reading tags as HTML does, in linear time; articles that pages share; the deduction against plain Python on a whole table."""

import time
from collections import Counter, defaultdict

import pytest

from locusframe.llm import html_text, registry

PAGES = "page_id long, url string, html string"


def block_texts(page):
    return [t for _, t in html_text.blocks(page)]


def texts(spark, pages, url="http://h.example/{}"):
    rows = [(i, url.format(i), page) for i, page in enumerate(pages)]
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}


def test_tags():
    for page, want in [
        ("<p data-x=it's>Hello world</p><p>It's fine</p><p>Third</p>", ["Hello world", "It's fine", "Third"]),
        ('<p title="oops>First para</p>', ["First para"]),
        ('<p title="a>b" class=\'c>d\'>text</p>', ["text"]),
        ("<p a = \"x\" b= 'y' c =z d>text", ["text"]),
        ("<p =x>text</p><p x=>more</p>", ["text", "more"]),
        ('<p a="1"b="2>3">text', ["text"]),
        ("a < b and 3 <4 <p>x", ["a < b and 3 <4", "x"]),
        ("<p>x</p><p title=unfinished", ["x"]),
        ("<p>x<!-- no", ["x"]),
        ("<p>x<!-->y<!--->z<!-- a --!>w", ["xyzw"]),
        ("<p>x</3 no>y<?php no>z<!doctype no>w", ["xyzw"]),
        ("<p>x<script>a</scripty></script >y", ["xy"]),
        ("<p>x<script>a</script", ["x"]),
        ("<img alt='>' />text<br/>more", ["text more"]),
    ]:
        assert block_texts(page) == want, page


@pytest.mark.parametrize("piece", ['<p title="x>', "<p a='b>", "<a ", "<p ", "<!", "<!-", "</script", "<script", "</", "<p a=", "<p a=\"'", "<div>", "<div><p>", "</div>", "<p     ", "<x\"", "&#", "<svg", "<li><ul>"])
def test_a_megabyte_of_broken_tags_takes_no_second(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.time()
    html_text.blocks(page, Counter())
    assert time.time() - began < 3  # about a third of it on an idle machine


def test_deep_elements_belong_to_the_last_one_kept():
    n = html_text.DEPTH + 100
    found = html_text.blocks("<div>" * n + "<p>in</p>" + "</div>" * n + "<p>out</p>")
    assert [t for _, t in found] == ["in", "out"] and found[0][0].count("/") == html_text.DEPTH and found[1][0] == "/p"


def test_an_article_that_pages_share_is_kept(spark):
    page = '<body><article><p>The whole article of some length, twice on the host.</p></article><div class="box"><p>related {0}</p></div></body>'
    want = "The whole article of some length, twice on the host."
    for n in (2, 3, 12):
        assert texts(spark, [page.format(i) for i in range(n)]) == dict.fromkeys(range(n), want)
    short = '<body><article><p>Short.</p></article><div class="box"><p>related {0} with much more text</p></div></body>'
    assert texts(spark, [short.format(i) for i in range(3)]) == dict.fromkeys(range(3), "Short.")


def test_main_text_around_articles_is_kept(spark):
    page = "<body><nav>n</nav><main><h1>T{0}</h1><article><p>a{0}</p></article><p>between {0}</p><article><p>b{0}</p></article></main><div>open {0}</div></body>"
    assert texts(spark, [page.format(i) for i in range(3)]) == {i: f"T{i}\na{i}\nbetween {i}\nb{i}" for i in range(3)}


def deduced(rows):
    """page_id, text: the deduction of slots and roles over whole lists of pages."""
    pages, by_host = {}, defaultdict(dict)
    for page_id, url, html in rows:
        opened = Counter()
        own = [{"path": p, "region": html_text.region(p), "home": html_text.home(p), "text": t} for p, t in html_text.blocks(html or "", opened)]
        host, identity = html_text.host_of(url), tuple((b["home"], b["text"]) for b in html_text.compared(own))
        pages[page_id] = host, identity, own
        seen = by_host[host].setdefault(identity, (Counter(), defaultdict(list)))
        for path, n in opened.items():
            seen[0][path] = max(seen[0][path], n)
        seen[1]["blocks"].append(own)
    content = {}
    for host, of in by_host.items():
        paths = {p for counts, _ in of.values() for p in counts}
        slots = set()
        for p in paths:
            times = [counts[p] for counts, _ in of.values() if counts[p]]
            if set(times) == {1} and len(times) >= 2 and len(times) * html_text.SHARE >= len(of) and p.rsplit("/", 1)[1].split(".")[0] in html_text.SLOT_TAGS:
                slots.add(p + "/")
        slot_of = lambda home, slots=slots: max((s for s in slots if home.startswith(s)), key=len, default=None)
        held, inside = defaultdict(dict), Counter()
        for identity, (_, lists) in of.items():
            for own in lists["blocks"]:
                for b in own:
                    if b["region"] != "noise" and (slot := slot_of(b["home"])):
                        held[slot].setdefault(identity, Counter())[b["home"], b["text"]] += 1
                        inside[slot] |= b["region"] in ("article", "main")
        for slot in slots:
            kinds = {frozenset((k, v / sum(c.values())) for k, v in c.items()) for c in held[slot].values()}
            n = len(held[slot])
            content[host, slot] = not (n >= (html_text.FEW if inside[slot] else 2) and (len(kinds) == 1 or len(kinds) * html_text.SHARE <= n)), slot_of
    out = {}
    for page_id, (host, _, own) in pages.items():
        slots = {s: v[0] for (h, s), v in content.items() if h == host}
        named = [b for b in own if b["region"] != "noise"]
        varying = [b for b in named if slots.get(max((s for s in slots if b["home"].startswith(s)), key=len, default=None), True)]
        source = varying or named
        kinds = {b["region"] for b in source}
        best = {"article", "main"} if "article" in kinds else {"main", "named"} if kinds & {"main", "named"} else {"open"}
        out[page_id] = "\n".join(b["text"] for b in source if b["region"] in best)
    return out


def test_query_against_plain_deduction_on_the_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    got = {r.page_id: (r.text, r.n_chars) for r in registry.queries()["op9_main_text"](spark, sf_dir).collect()}
    assert got == {k: (t, len(t)) for k, t in deduced(rows).items()}


def test_deduction_without_articles_on_a_whole_table(spark, sf_dir, monkeypatch):
    """The pages of the table with plain divs for articles and names removed, so that classes decide; joined where slots are too many to be sent."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", "url", r"regexp_replace(regexp_replace(html, '(</?)(article|nav|footer)', '$1div'), 'class=\"ad\"', '') AS html")
    want = deduced([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == want
    monkeypatch.setattr(html_text, "MOST_SLOTS", 0)
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == want
