from locusframe.llm import html_text

PAGES = "page_id long, url string, html string"


def texts(spark, pages, url="http://h.example/{}"):
    rows = [(i, url and url.format(i), page) for i, page in enumerate(pages)]
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}


def test_classes_decide_over_names(spark):
    page = '<body><div class="w"><div class="top">Site</div><article class="teaser"><p>Read our book</p></article><div class="text"><h2>Head {0}</h2><p>Body {0}</p><p>Always</p></div></div></body>'
    got = texts(spark, [page.format(i * 31) for i in range(5)])
    assert got == {i: f"Head {i * 31}\nBody {i * 31}\nAlways" for i in range(5)}


def test_root_class_is_once_in_every_page_and_others_nest(spark):
    rows = [(i, "http://h.example/", f'<body><div class="a">{"<section>x</section>" * (i + 1)}</div>{"<div class=b><p>t</p></div>" if i % 2 else ""}<p>u{i}</p></body>') for i in range(4)]
    classes = html_text.equivalence_classes(html_text.tokenised(spark.createDataFrame(rows, PAGES)))
    assert {r.path for r in classes.where("in_root").collect()} == {"/body", "/body/div.a", "/body/p"}
    slots = {r.slot: r for r in html_text.template(classes).collect()}
    assert set(slots) == {"/body/", "/body/div.a/", "/body/div.b/"} and not slots["/body/div.b/"].in_root
    assert slots["/body/"].fingerprint == slots["/body/div.a/"].fingerprint != slots["/body/div.b/"].fingerprint


def test_copies_are_no_evidence(spark):
    page = '<body><nav>{1}</nav><div class="text"><h2>Head {0}</h2><p>Body {0}</p></div></body>'
    for url in ("http://h.example/{}", None):
        assert texts(spark, [page.format(7, i) for i in range(3)], url) == {i: "Head 7\nBody 7" for i in range(3)}
        got = texts(spark, [page.format(7 if i < 4 else i * 31, 0) for i in range(6)], url)
        assert got == {i: f"Head {n}\nBody {n}" for i in range(6) for n in [7 if i < 4 else i * 31]}


def test_lines_repeated_in_a_page_or_between_pages_stay_in_a_varying_slot(spark):
    page = '<body><div class="top">Site</div><div class="text"><p>la la</p><p>verse {0}</p><p>la la</p><p>la la</p></div></body>'
    assert texts(spark, [page.format(i) for i in range(4)]) == {i: f"la la\nverse {i}\nla la\nla la" for i in range(4)}


def test_two_pages_are_judged_like_three(spark):
    page = '<body><div class="top">Site</div><div class="text"><p>verse {0}</p></div></body>'
    for n in (2, 3):
        assert texts(spark, [page.format(i // 2) for i in range(2 * n)]) == {i: f"verse {i // 2}" for i in range(2 * n)}


def test_constant_slots_after_slots_of_any_length_are_template(spark):
    page = '<body><div class="text">{0}</div><div class="legal"><p>All rights</p><p>reserved</p></div></body>'
    assert texts(spark, [page.format(f"<p>v{i}</p>" * (i + 1)) for i in range(4)]) == {i: "\n".join([f"v{i}"] * (i + 1)) for i in range(4)}


def test_many_copies_take_no_text_from_another_page(spark):
    page = '<body><nav>{1}</nav><div class="text"><p>Body {0}</p></div>{2}</body>'
    pages = [page.format(7, i, "") for i in range(20)] + [page.format(8, 0, '<div class="extra">More</div>')]
    assert texts(spark, pages) == {i: "Body 7" for i in range(20)} | {20: "Body 8\nMore"}


def test_text_under_body_and_in_siblings_is_whole(spark):
    flat = "<body><h1>T{0}</h1><p>a{0}</p><p>b{0}</p><ul><li>c{0}</li></ul></body>"
    assert texts(spark, [flat.format(i) for i in range(4)]) == {i: f"T{i}\na{i}\nb{i}\nc{i}" for i in range(4)}
    several = '<body><div class="head"><h1>T{0}</h1></div><div class="legal">All rights</div><div class="one">{1}</div><div class="two"><p>b{0}</p></div></body>'
    pages = [several.format(i, f"<p>a{i}</p>" * (i + 1)) for i in range(4)]
    assert texts(spark, pages) == {i: "\n".join([f"T{i}", *[f"a{i}"] * (i + 1), f"b{i}"]) for i in range(4)}


def test_names_of_one_page_make_no_token(spark):
    page = '<body><div class="top">Site</div><article id="post-{0}" class="post-{0} entry" ><p>a{0}</p></article><div id="e{0:08x}f"><p>b</p></div></body>'
    pages = [page.format(1000 + i * 77) for i in range(40)]
    assert texts(spark, pages) == {i: f"a{1000 + i * 77}" for i in range(40)}
    rows = [(i, "http://h.example/", page) for i, page in enumerate(pages)]
    classes = html_text.equivalence_classes(html_text.tokenised(spark.createDataFrame(rows, PAGES)))
    assert classes.where("in_root").count() == classes.count() == 6  # body, div.top, article and its p, div.# and its p
    words = [(i, "http://h.example/", f'<body><article id="{chr(97 + i % 26) * (2 + i // 26)}"><p>t{i}</p></article></body>') for i in range(60)]
    tokens = html_text.tokenised(spark.createDataFrame(words, PAGES))
    assert [r.slot for r in html_text.template(html_text.equivalence_classes(tokens)).collect()] == ["/body/"]
    assert {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(words, PAGES)).collect()} == {i: f"t{i}" for i in range(60)}


def test_tokens_are_told_apart_by_their_gap_in_the_root(spark):
    page = '<body><div><p>Shop</p><p>Cart</p></div><h1>Head {0}</h1><div><p>Body {0}</p><p>More {0}</p></div><hr><section><div>Old {0}</div></section></body>'
    assert texts(spark, [page.format(i) for i in range(5)]) == {i: f"Head {i}\nBody {i}\nMore {i}\nOld {i}" for i in range(5)}
    assert html_text.roles(["/b", "/b/d", "/b/h", "/b/d"], [{"/b", "/b/h"}])[1::2] != ["/b/d"] * 2


def test_roles_of_the_root_divide_its_gaps_anew_and_swapped_tokens_leave_it(spark):
    rows = [(i, "http://h.example/", f"<body><div>a</div><h1>h</h1><div>b</div>{'<h2>x</h2><h3>y</h3>' if i % 2 else '<h3>y</h3><h2>x</h2>'}<p>t{i}</p><h4>z</h4></body>") for i in range(4)]
    tokens = html_text.tokenised(spark.createDataFrame(rows, PAGES))
    classes, rounds = html_text.differentiated(tokens, 4)
    found = rounds.first().rounds
    assert not {"/body/h2", "/body/h3"} & set(found[0]) and {"/body", "/body/h1", "/body/p", "/body/h4"} <= set(found[0])
    assert len([r for r in found[-1] if r.startswith("/body/div")]) == 2 and classes.where("in_root and path like '/body/div%'").count() == 2
