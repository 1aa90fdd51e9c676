import time

import pytest

from gleaner.llm import extract

LONG = "This is the story, told at length: it has clauses, commas and full stops. It goes on for a while, as articles do."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy now, cheap.</div>
<article><h1>Head &amp; line</h1><p><b>{LONG}<br><p>Short.</p><blockquote>Quoted &eacute;, at   once.</blockquote></article>
<section id="comments"><p>{LONG}</p></section><form>Your mail <input value="x"></form><footer>&copy; us</footer></body></html>"""


def test_article():
    assert extract.main_text(PAGE) == f"Head & line\n{LONG}\nShort.\nQuoted é, at once."


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        ("<p>", ""),
        ("just text &lt;b&gt;", "just text <b>"),
        (f"<body><header>Site</header><div class='sidebar'><p>{LONG}</p></div><div class='content'><p>{LONG}</p><div>Inner.</div></div></body>", f"{LONG}\nInner."),
        (f"<main><header><h1>Head</h1></header><p>{LONG}</p><aside>{LONG}</aside></main>", f"Head\n{LONG}"),
        (f"<div><p>{LONG}<p>{LONG}</div><div><a href=x>a</a><a href=y>b</a></div>", f"{LONG}\n{LONG}"),
        (f'<article><p hidden>no</p><p style="display:none">no</p><p title="a>b">{LONG}</p></article>', LONG),
        (f"<article><p>a<i>b</i>c\n\t d</p><p>{LONG}</p><article class='comment'>{LONG}</article></article>", f"abc d\n{LONG}"),
        ("<script>unclosed", ""),
        ("<nav>only</nav>", ""),
        (f"<article><p>{LONG}</p></nav></div></article>", LONG),
    ],
)
def test_cases(page, want):
    assert extract.main_text(page) == want


def test_long_pages():
    assert extract.main_text("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>").count("\n") == 2999
    assert extract.main_text("<div>" * 2000 + LONG) == LONG
    extract.main_text("<" * 20_000)


@pytest.mark.parametrize(
    "part", ["<a ", '<a b="', "<a b='>' ", "<div>x", "</b>", "<b><p>x", "<!", "<!--", "<p class='side'>x", "<li>", "<div><p>x</div></i>", "<script>", '<a ">" ', "<a \"'>'", "&amp", "<td><b>"]
)
def test_time_grows_with_the_page(part):
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        extract.main_text(part * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 1.0


def test_open_head_and_frames():
    article = f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p>"
    want = f"Head\n{LONG}\n{LONG}"
    assert extract.main_text(f"<html><head><title>T</title><meta x=y><body><div>{article}</div>") == want
    assert extract.main_text(f"<head><style>x</style><div>{article}</div>") == want
    assert extract.main_text(f'<div class="content with-sidebar"><div>{article}</div><div class="sidebar"><p>{LONG[:40]}</p></div></div>') == want
    assert extract.main_text(f'<form action="x"><div class="page has-banner">{article}<input name=a></div></form>') == want
    assert extract.main_text(f'<div class="layout-sidebar"><article>{article}</article></div><section class="promo"><p>{LONG} {LONG} {LONG}</p></section>') == want
    assert extract.main_text(f'<article>{article}</article><div id="comments">{article * 20}</div>') == want


def test_ratios_do_without_class_names():
    links = "<ul>" + "<li><a href=x>Some link</a></li>" * 30 + "</ul>"
    pages = [
        f"<div class='a'>{links}</div><div class='b'><h2>Head</h2>" + f"<p>{LONG}</p>" * n + f"</div><div class='c'><p>Contact us</p>{links}</div><div class='d'>© us</div>" for n in (2, 5, 30)
    ]
    for n, page in zip((2, 5, 30), pages, strict=True):
        assert extract.main_text(page, hints=False) == "\n".join(["Head", *[LONG] * n])


def test_rows(spark):
    rows = [(1, "u", PAGE, 9), (2, None, None, 9), (None, "u", "", 9), (1, "u", PAGE, 9)]
    got = extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, len(extract.main_text(PAGE))), (1, len(extract.main_text(PAGE))), (2, 0)]
    assert extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
