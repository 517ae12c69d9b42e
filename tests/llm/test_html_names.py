from locusframe.llm import html_text


def test_hyphenated_names_inside_articles():
    noise = lambda inner: html_text.is_noise(f"/html/body/article/{inner}")
    assert not any(map(noise, ("p.share-price", "div.ad-hoc", "section.notice-period", "p.login-rules")))
    assert all(map(noise, ("div.related-posts", "div.ad-slot", "aside", "div.share", "ul.comment-list", "div.social-share-buttons", "div.newsletter_box")))
    assert html_text.is_noise("/html/body/div.share-price") and not html_text.is_noise("/html/body/main/div.share-price")


def test_long_pages_are_whole(spark):
    page = "<html><body><article>" + "".join(f"<p>line {i} of it</p>" for i in range(100_000)) + "</article></body></html>"
    rows = html_text.extract(spark.createDataFrame([(1, "http://a.example/x", page)], "page_id long, url string, html string")).collect()
    assert rows[0].text == "\n".join(f"line {i} of it" for i in range(100_000)) and rows[0].n_chars == len(rows[0].text)
