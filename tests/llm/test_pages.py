"""Ordinary markup must not cost a page its article."""

import pytest

TEXT = "Words of the article that stand on the page, enough of them to be its text."
MARKUP = ['<article title="the hidden valley"><p>{}</p></article>', '<section data-topic="our hidden gems"><p>{}</p></section>', "<head><title>x</title><p>{}",
          "<html><head><meta charset=utf-8><title>x</title><link rel=a href=b></head><body><p>{}</body></html>", "<p title=it's>{}</p><div class='ad'>Buy</div>",
          '<p class="a"">{}</p>', "<div title='class=ad'><p>{}</p></div>", '<div data-x="a > b"><p>{}</p></div>', '<div hidden><p>Not here</p></div><p>{}</p>',
          '<div style="color: red; display : none"><p>Not here</p></div><p>{}</p>', '<div aria-hidden=true><p>Not here</p></div><p>{}</p>']


@pytest.mark.parametrize("page", MARKUP)
def test_the_article_stays(page):
    from chatloom.llm.html import blocks_of, main_text

    assert main_text(blocks_of(page.format(TEXT)), None) == TEXT


def test_formulas_are_part_of_a_sentence():
    from chatloom.llm.html import blocks_of, main_text

    page = "<p>Let <math><mi>x</mi><annotation encoding='t'>\\x</annotation></math> be the number of pages.</p>"
    assert main_text(blocks_of(page), None) == "Let x be the number of pages."


def test_a_voted_container_with_one_short_line_is_not_the_article():
    from chatloom.llm.html import blocks_of, main_text

    page = f"<body><div class=qa><p>Tell others</p></div><div class=zb><p>{TEXT}</p><p>{TEXT} Again.</p></div></body>"
    assert main_text(blocks_of(page), "/body/div.qa").endswith(f"{TEXT}\n{TEXT} Again.")


def test_the_host_decides_between_containers_without_telling_names(spark):
    """On one page the longer container is not the article; the other pages of the host tell which one is."""
    from chatloom.llm.html import blocks_of, extract, main_text

    def page(i, more):
        return f"<body><div class=qa><p>{TEXT} Page {i}.</p></div><div class=zb>{more}</div></body>"

    rows = [(i, "http://h.example/x", page(i, "<p><a href=/a>One page</a> <a href=/b>Another page</a></p>")) for i in range(8)] + [(8, "http://h.example/x", page(8, f"<p>{TEXT} A remark.</p>" * 3))]
    assert "A remark" in main_text(blocks_of(rows[-1][2]), None)
    got = {r["row"]["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{TEXT} Page {i}." for i in range(9)}


def test_a_tag_that_breaks_off_is_read_in_linear_time():
    from chatloom.llm.html import blocks_of

    assert blocks_of("<p>" + TEXT + "</p><script " + 'a="b" ' * 20000) == blocks_of(f"<p>{TEXT}</p>")
