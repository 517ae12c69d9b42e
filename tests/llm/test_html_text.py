import re
from html.parser import HTMLParser

from locusframe.llm import html_text

PAGES = "page_id long, url string, html string, text string"


class Article(HTMLParser):
    """The text of the article element by another parser: blocks end where h1 or p begin or end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.on, self.blocks, self.now = False, [], ""

    def flush(self):
        text = re.sub(r"\s+", " ", self.now).strip()
        self.blocks += [text] if text else []
        self.now = ""

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        if tag == "br":
            self.now += " "
        if tag in ("p", "h1", "article"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.flush()
        if tag == "article":
            self.on = False

    def handle_data(self, data):
        if self.on:
            self.now += data


def brute(html):
    p = Article()
    p.feed(html or "")
    p.close()
    p.flush()
    return "\n".join(p.blocks)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    rows = html_text.extract(pages).collect()
    assert len(rows) == len(html)
    for r in rows:
        assert r.text == brute(html[r.page_id]) and r.n_chars == len(r.text)


LAYOUT = """<html><head><title>t</title></head><body><div class="top">Site name here</div><div id=menu><a href=1>One</a> <a href=2>Two</a></div>
<div class="content"><h2>Head {n}</h2><p>Body&nbsp;text {n} &amp; more <i>words</i>
follow {n}.<p>Second &lt;part&gt; {n}<script>var a = "</p>";</script></div><div class="legal">All rights are reserved by someone</div></body></html>"""


def test_templates_without_semantic_elements(spark):
    rows = [(i, f"http://h.example/{i}", LAYOUT.format(n=i * 7919), "x") for i in range(8)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(8):
        n = i * 7919
        assert got[i] == f"Head {n}\nBody text {n} & more words follow {n}.\nSecond <part> {n}"


def test_noise_in_articles_and_awkward_rows(spark):
    page = """<body><header>Site</header><main><article><header><h1>T</h1></header><p>One<aside>side</aside><p>Two<!-- <p>no</p> --><div class="ad-box">Buy</div>
    <form>Mail <input></form><section class="comments"><p>First!</p></section><ul><li>a<li>b</ul><table><tr><td>x<td>y</table></article></main><footer>f</footer>"""
    rows = [(1, "http://a/", page, "x"), (2, None, None, None), (3, "odd", "", "x"), (4, "http://b/", "just text", "x"), (4, "http://b/", "just text", "x"), (5, "http://c/", "<p>" + "w " * 300_000, "x")]
    out = html_text.extract(spark.createDataFrame(rows, PAGES)).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == 6 and got[1] == "T\nOne\nTwo\na\nb\nx\ny"
    assert got[2] == "" and got[3] == "" and got[4] == "just text" and len(got[5]) == 599_999
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_equal_occurrence_vectors_share_a_class(spark):
    rows = [(i, "http://h.example/", f"<body><nav><ul>{'<li>x</li>' * (i + 1)}</ul></nav><article><p>t{i}</p></article></body>", "x") for i in range(4)]
    classes = {r.path: r for r in html_text.equivalence_classes(html_text.tokenised(spark.createDataFrame(rows, PAGES))).collect()}
    li, p = classes["/body/nav/ul/li"], classes["/body/article/p"]
    assert li.fingerprint != p.fingerprint and p.in_root and p.n == 4 and li.n == 10
