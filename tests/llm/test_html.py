"""Main text of pages."""

from __future__ import annotations

import re

import pytest

from archivolt.llm import html, queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy now</div>
<article><header><h1>Head &amp; line</h1></header><p>One   <b>two</b>
three &lt;four&gt;.<p>Short.</p><ul><li>item one<li>item two</ul><aside>See also</aside><form>Mail: <input></form><table><tr><td>cell a<td>cell b</table></article>
<section id="comments"><p>A reader says hello and much more than the article does, again and again and again.</p></section>
<footer>&copy; us</footer>"""


def test_article_without_the_rest():
    assert html.main_text(PAGE) == "Head & line\nOne two three <four>.\nShort.\nitem one\nitem two\ncell a\ncell b"


def test_pages_without_an_article_element():
    body = "".join(f"<p>Paragraph {i} with a good many words in it, as articles have.</p>" for i in range(5))
    page = f"<body><div class='menu'><a>Home</a><a>News</a></div><div class='content'>{body}</div><div id='sidebar'><a>x</a></div></body>"
    assert html.main_text(page).split("\n") == [f"Paragraph {i} with a good many words in it, as articles have." for i in range(5)]


@pytest.mark.parametrize("tag", ["div", "section", "article", "td"])
def test_pages_split_over_sibling_elements(tag):
    long = lambda k: [f"Paragraph {i} of part {k} with a good many words in it, as articles have." for i in range(4)]
    short = lambda k: [f"row {k} {i}" for i in range(4)]
    parts = [[*short(k), *long(k), *short(k)] for k in range(3)]  # short lines on both sides keep a cluster within its part
    body = "".join(f"<{tag}>{''.join(f'<p>{line}</p>' for line in part)}</{tag}>" for part in parts)
    body = f"<table><tr>{body}</tr></table>" if tag == "td" else body
    page = f"<body><nav><a>Home</a></nav><div class='content'>{body}</div><footer>us</footer></body>"
    assert html.main_text(page).split("\n") == [line for part in parts for line in part]


TEXT = [f"Paragraph {i} with a good many words in it, as articles have." for i in range(6)]
BODY = "".join(f"<p>{line}</p>" for line in TEXT)


@pytest.mark.parametrize("name", ["content has-sidebar", "elementor-widget-text", "page-with-comments widget", "comments-off", "no-comments", "main search"])
def test_a_word_in_the_class_of_a_wrapper_keeps_the_article(name):
    if name == "comments-off":
        page = f"<body class='{name}'>{BODY}</body>"
    else:
        page = f"<body><div class='menu'><a>Home</a></div><div class='{name}'><h1>Head</h1>{BODY}</div><div class='site-footer'>us</div></body>"
    assert html.main_text(page).split("\n")[-6:] == TEXT


def test_every_block_in_a_widget_of_its_own():
    parts = "".join(f"<div class='elementor-element elementor-widget elementor-widget-text-editor'><p>{line}</p></div>" for line in TEXT)
    page = f"<body><div class='cookie-banner'>We use cookies.</div>{parts}<div class='post-comments'><p>A reader says more than all of the article. {' '.join(TEXT * 3)}</p></div><div class='related-posts'>Next</div></body>"
    assert html.main_text(page).split("\n") == TEXT


LINK_LIST = "<ul>" + "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(8)) + "</ul>"


@pytest.mark.parametrize("menu", [LINK_LIST, LINK_LIST.replace("ul>", "div>").replace("li>", "div>")])
@pytest.mark.parametrize("foot", ["<div>Privacy Terms Contact</div>", "<p>Privacy</p><p>Terms</p><p>Contact</p>", "<ul><li>Privacy<li>Terms</ul>", "<table><tr><td>About<td>Jobs</table>"])
@pytest.mark.parametrize("wrap", ["{}", "<div>{}</div>"])
def test_menus_and_footers_of_plain_markup_go(menu, foot, wrap):
    """No element or name tells them: the clusters do."""
    page = f"<body>{menu}{wrap.format('<h1>Head</h1>' + BODY)}{foot}</body>"
    assert html.main_text(page).split("\n") == ["Head", *TEXT]


def test_clusters_decide(monkeypatch):
    page = f"<body>{LINK_LIST}<h1>Head</h1>{BODY}<div>Privacy Terms Contact</div></body>"
    with_clusters = html.main_text(page)
    monkeypatch.setattr(html, "content_lines", lambda page: [0] * len(page.lines))
    assert "Link 3" in html.main_text(page) and "Link 3" not in with_clusters


def test_lists_of_links_between_paragraphs_and_sentences_at_the_end():
    half = "".join(f"<p>{line}</p>" for line in TEXT[:3]), "".join(f"<p>{line}</p>" for line in TEXT[3:])
    assert html.main_text(f"<body>{half[0]}{LINK_LIST}{half[1]}<p>That is all.</p></body>").split("\n") == [*TEXT, "That is all."]
    assert "Link 3" in html.main_text(f"<article>{half[0]}{LINK_LIST}{half[1]}</article>")  # an article's own list of links is its text


def test_the_best_cluster_of_two_articles():
    short = "<div><span>a</span> <span>few</span> <i>words</i> <b>x</b></div>" * 12
    assert html.main_text(f"<body><article>{short}</article><article>{BODY * 3}</article></body>").split("\n") == TEXT * 3


@pytest.mark.parametrize("part", ["<section id='social'>{}</section>", "<div class='login-guide'>{}</div>", "<div class='search'>{}</div>"])
@pytest.mark.parametrize("around", ["article", "main"])
def test_a_part_of_an_article_keeps_its_text_whatever_its_name(part, around):
    assert html.main_text(f"<{around}>{BODY}{part.format(BODY)}</{around}>").split("\n") == TEXT * 2
    assert html.main_text(f"<{around}>{BODY}{part.format('<a>Share</a>')}</{around}>").split("\n") == TEXT


@pytest.mark.parametrize("open_end", ["<!-- " + "a comment that never ends " * 5000, "<a href='" + "y" * 500, "<p class", "</di", "<!DOCTYPE x"])
def test_markup_left_open_at_the_end_is_no_text(open_end):
    assert html.main_text(BODY + open_end).split("\n") == TEXT
    assert html.main_text(BODY + "<p>a < b and c <3").split("\n")[-1] == "a < b and c <3"


def test_self_closing_foreign_elements():
    assert html.main_text("<article><p>Hello <svg/> world <svg><path d='x'/><title>no</title></svg>again <math/>x</p></article>") == "Hello world again x"
    assert html.main_text("<article><p>Hello <b/> world</p><div/><p>again</p></article>") == "Hello world\nagain"


def test_deep_nesting_takes_memory_by_the_element():
    import tracemalloc

    page = "<div>x" * 100_000
    tracemalloc.start()
    assert html.main_text(page).count("\n") == 99_999
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert html.main_text("<article><p>" + "<span>x " * 50_000 + "</span>" * 50_000).count("x") == 50_000
    assert html.main_text("<ul>" + "<li><b>x" * 20_000) != ""


def test_empty_null_broken_and_long():
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x</script>") == ""
    assert html.main_text("plain text only") == "plain text only"
    assert html.main_text("<article><p>open <b>never closed") == "open never closed"
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    assert html.main_text(long).count("\n") == 19_999


def test_query_against_the_known_form_of_its_pages(spark):
    """The pages have one article each: its block texts by patterns alone."""
    import html as std

    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in queries.op4_html_extraction(spark, sf).collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        inner = re.search(r"<article>(.*)</article>", page, re.DOTALL).group(1)
        blocks = (" ".join(std.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", inner)))
        want = "\n".join(b for b in blocks if b)
        assert (got[i]["text"], got[i]["n_chars"]) == (want, len(want))


def test_frames_with_nulls_repeats_and_extra_columns(spark):
    frame = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, PAGE, None)], "page_id long, html string, text string")
    got = html.extract(frame, into="main").collect()
    assert [r["main"][:4] for r in got] == ["", "", "Head"] and got[0]["text"] == "x"
    assert html.extract(frame.limit(0)).count() == 0
