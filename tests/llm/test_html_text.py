import html
import random
import time

import pytest

from evigraph.llm.html_text import extract, main_text

PROSE = ["The first paragraph says a thing, at some length, so that it counts.", "Another paragraph, shorter, follows &amp; ends.", "A third one: caf&eacute; &#8212; with entities, commas, and more."]
WANT = ["The first paragraph says a thing, at some length, so that it counts.", "Another paragraph, shorter, follows & ends.", "A third one: café — with entities, commas, and more."]
P = "".join(f"<p>{x}</p>" for x in PROSE)
NOISE = '<nav><ul><li><a href="/">Home</a></li></ul></nav>', '<div class="cookie-notice"><p>We use cookies, many of them, for many reasons, all good.</p></div>', '<aside><p>Read this too, it is great, really.</p></aside>', '<footer>&copy; us, 2024, all rights</footer>', '<form><label>Name</label><input name="a"></form>', '<section id="comments"><p>I disagree, strongly, with this, and that.</p></section>', "<script>var x='</p>';</script>", "<style>p{}</style>", "<!-- <p>gone, gone, gone</p> -->"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body>{NOISE[0]}<article>{P}</article>{NOISE[3]}</body></html>",
        f"<body>{''.join(NOISE)}<div id=content>{P}</div>{NOISE[5]}</body>",
        f"<body><header><h1>Site, of things</h1></header><main>{NOISE[1]}{P}{NOISE[5]}</main></body>",
        f"<table><tr><td>{NOISE[0]}<td>{P}</table>",
        f"<div class=wrapper><div class='sidebar'><p>Old news, more news, all news.</p></div><div class='post-body'>{P}</div></div>",
        f"<p>{PROSE[0]}<p>{PROSE[1]}<p>{PROSE[2]}",
        f"<div hidden><p>Not seen, never, at all, by any one.</p></div><div>{P.replace('</p>', '')}</div>",
        f"<article><p><b>{PROSE[0]}<br><p>{PROSE[1]}</b></p><div><p>{PROSE[2]}</p></div></article>",
        f"<BODY><DIV CLASS=Main>{P.replace('p>', 'P>')}</DIV><div class=ad>Buy, buy, buy now, and pay later, gladly.</div>",
    ],
)
def test_the_article_alone(page):
    assert main_text(page).split("\n") == WANT


def test_white_space_and_odd_markup():
    assert main_text("<article><h1> A\n  title </h1><p>one<br>two &lt;b&gt; 1 < 2</p><ul><li>x<li>y</ul></article>") == "A title\none two <b> 1 < 2\nx\ny"
    for odd in (None, "", "<", "<p", "</p>", "<!--", "<script>", "&", "<a b='", "<div>" * 3000, "text only"):
        main_text(odd)
    assert main_text("text only") == "text only"


def test_random_markup_does_not_crash():
    r = random.Random(1)
    bits = ["<p>", "</p>", "<div class='ad x'>", "</div>", "<a href=x>", "</a>", "<b>", "</b>", "<li>", "<table>", "<td>", "</table>", "text, more", "&amp;", "<br/>", "<script>", "</script>", "<", ">", "'", '"', "<!--", "-->"]
    for _ in range(500):
        main_text("".join(r.choice(bits) for _ in range(60)))


def test_operator(spark):
    df = spark.createDataFrame([(1, "u", f"<article>{P}</article>", "t"), (2, None, None, "t"), (2, None, "", "t")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract(df).collect())
    want = "\n".join(WANT)
    assert got == [(1, want, len(want)), (2, "", 0), (2, "", 0)]


def test_a_form_around_the_page():
    """As some frameworks write every page; a form within it that asks for little still goes."""
    page = f'<body><form id="aspnetForm" action="x">{NOISE[0]}<div>{P}</div><form><label>Your name</label><select><option>a</option></select></form></form></body>'
    assert main_text(page).split("\n") == WANT


def test_time_is_linear():
    def took(page):
        t = time.perf_counter()
        main_text(page)
        return time.perf_counter() - t

    for make in (lambda n: "<div>" * n + "word, " * 50, lambda n: '<a href="x ' * n + ">text", lambda n: "<div><b>" + "<i>" * n + "</b></b>" * n + "<p>" * n, lambda n: "<p><div>" + "<x-foo>" * n + "<p></p>" * n):
        assert took(make(40_000)) < 40 * took(make(4_000)) + 0.5


def test_very_long_pages_and_empty_tables(spark):
    long = f"<article>{P * 20_000}</article>"
    assert main_text(long).split("\n") == WANT * 20_000
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract(none).collect() == []


def test_every_block_of_gold_pages_once():
    """Brute force: what was put into the article of a random page is what comes out, in order."""
    r = random.Random(4)
    for _ in range(200):
        said = [" ".join(r.choice(["alpha", "beta,", "gamma", "delta,", "x < y", "tea & milk"]) for _ in range(r.randint(12, 60))) + "." for _ in range(r.randint(3, 12))]
        tag = lambda t: r.choice(["<p>{}</p>", "<p>{}", "<div><p>{}</p></div>", "<blockquote><p>{}</p></blockquote>", "<p><em>{}</em></p>"]).format(html.escape(t))
        body = "".join(tag(t) for t in said)
        page = "<html><head><title>t</title></head><body>" + "".join(r.sample(NOISE, 4)) + r.choice(["<article>{}</article>", "<main><div>{}</div></main>", "<article class=x><section>{}</section></article>"]).format(body) + "".join(r.sample(NOISE, 4)) + "</body></html>"
        assert main_text(page).split("\n") == said
