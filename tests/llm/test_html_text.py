import itertools
import time

import numpy as np
import pytest

from vecstead.llm import html_text

PAGE = """<!doctype html><html><head><title>No title &amp; all</title><style>p { color: red }</style></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav>
<div class="cookie-banner">We use cookies on this site, please accept them all now.</div>
<article><h1>A &lt;plain&gt; title</h1><p>First   <b>bold</b>&nbsp;words of\n the article run on for a while.</p>
<script>var x = "<p>not this</p>";</script>
<div class="advert">Buy many things here today</div>
<p>Second block<br>after a break, with more words to read. Then it goes on for some time, so that what follows the advert is worth more than the advert costs the run.</p></article>
<section id="comments"><p>A reader wrote this comment about the article.</p></section>
<footer>Copyright of somebody, all rights reserved</footer></body></html>"""
WANT = "A <plain> title\n\nFirst bold words of the article run on for a while.\n\nSecond block after a break, with more words to read. Then it goes on for some time, so that what follows the advert is worth more than the advert costs the run."


def test_main_text():
    assert html_text.main_text(PAGE) == WANT


def test_best_run_equals_brute_force():
    rng = np.random.default_rng(1)
    for n in range(1, 12):
        for _ in range(40):
            scores = rng.integers(-4, 5, n).tolist()
            lo, hi = html_text.best_run(scores)
            best = max([0] + [sum(scores[a:b]) for a, b in itertools.combinations(range(n + 1), 2)])
            assert sum(scores[lo:hi]) == best


def test_query_and_edges(spark, tmp_path):
    rows = [(1, "u1", PAGE), (2, "u2", None), (3, "u3", ""), (4, None, "<p"), (5, "u5", "<p>" * 3000 + "deep words " * 2000), (6, "u6", "<nav>only a menu</nav>"), (1, "u1", PAGE)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.query(spark, str(tmp_path)).collect()), key=str)
    assert [x[0] for x in got] == [1, 1, 2, 3, 4, 5, 6]
    assert got[0] == got[1] == (1, "u1", WANT, len(WANT))
    assert all(x[2] == "" and x[3] == 0 for x in got if x[0] in (2, 3, 4, 6))
    assert got[5][2] == " ".join(["deep words"] * 2000)


def test_empty_table_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, PAGE, 3)], "page_id long, html string, text int")
    assert html_text.extract_text(pages).first().text == WANT
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_article_text_survives_embedded_elements_and_slugs():
    words = "some words of the article that run on for quite a while here"
    page = lambda body: f"<body><div><h1>Title</h1><p>First {words}</p>{body}</div><p>Last {words}</p></body>"
    whole = page(f"<p>Second {words}</p>")
    want = html_text.main_text(whole)
    assert want.count(words) == 3
    for odd in ("<svg class='i'/>", "<math/>", "<svg><title>no</title><path d='M0'/></svg>", "<select><option>no<option>no</select>"):
        assert html_text.main_text(page(f"{odd}<p>Second {words}</p>")) == want
    for odd in ("button", "select", "object", "canvas"):
        assert html_text.main_text(page(f"<p>Second {words}<{odd}>no</p>")) == want
    for start, end in (("<h2 id='related-work'>", "</h2>"), ("<section id='search-methods'>", "</section>"), ("<div class='post category-social'>", "</div>"), ("<article class='post comments-open'>", "</article>")):
        assert html_text.main_text(page(f"{start}Second {words}{end}")) == want
    for start in ("<div class='related-links'>", "<section id='comments'>", "<div class='advert-3'>"):
        assert html_text.main_text(page(f"{start}Second {words}</div></section>")).count("Second") == 0


def test_names_that_look_like_boilerplate_lose_nothing():
    words = "some words of the article that run on for quite a while here"
    head, tail = f"<html><body><nav>menu</nav><article><h1>Title</h1><p>First {words}</p>", f"<p>Last {words}</p></article><footer>end</footer></body></html>"
    want = f"Title\n\nFirst {words}\n\nSecond {words}\n\nLast {words}"
    for start, end in (
        ("<section id='discussion'><p>", "</section>"), ("<section id='related-work'><p>", "</section>"), ("<div class='popular-science'>", "</div>"),
        ("<div class='x hidden md:block'>", "</div>"), ("<header><p>", "</p></header>"), ("<table><tr><td>", "</table>"), ("<blockquote>", "</blockquote>"),
    ):
        assert html_text.main_text(f"{head}{start}Second {words}{end}{tail}") == want
    plain = f"{head}<p>Second {words}</p>{tail}"
    assert html_text.main_text(plain.replace("<body>", "<body><form action='x'>").replace("</body>", "</form></body>")) == want
    for odd in ("<form><label>Name</label> subscribe</form>", "<div hidden>secret</div>", "<p style='display: none'>secret</p>", "<aside>more</aside>", "<div class='ad'>buy</div>"):
        assert html_text.main_text(plain.replace("<p>Last", f"{odd}<p>Last")) == want
    for odd in ("<div class='zzz'>We set cookies here</div>", "<div>Copyright of us</div>"):
        assert html_text.main_text(plain.replace("<article>", f"{odd}<article>").replace("</article>", f"</article>{odd}")) == want


def naive_run(page, weights):
    """The text of the best run over every pair of ends."""
    found = html_text.read_page(page, weights.left_out_by)
    scores = html_text.scores_of(found, weights)
    sums = [0.0, *itertools.accumulate(scores)]
    lo, hi = max(((a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), key=lambda x: (round(sums[x[1]] - sums[x[0]], 9), -x[0], x[1]), default=(0, 0))
    kept = [p.text for p, s in zip(found.pieces[lo:hi], scores[lo:hi]) if s > 0 and not p.skip]
    return "".join("".join(kept).split()) if hi and sums[hi] - sums[lo] > 0 else ""


def test_whole_pages_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    bits = ["<p>some words of text</p>", "<div>", "</div>", "<div class=ad>buy it</div>", "<ul><li><a href=x>go</a><li>item</ul>", "bare words", "<nav>menu</nav>", "<h2>head</h2>", "<b>bold ", "</b>", "<form>f</form>"]
    pages = ["".join(rng.choice(bits, 12)) for _ in range(60)]
    marked = [f"<div class=ad>buy it now</div><article>{x}</article>" for x in pages[:20]]
    weights = html_text.learn_weights(spark.createDataFrame([(x,) for x in marked], "html string"))
    for page in pages + marked:
        assert "".join(html_text.main_text(page, weights).split()) == naive_run(page, weights)


def test_time_is_linear_in_the_page():
    for odd in ("<b>x ", "<a title='x>y ", "<div><b>x </i>", "<li>a", "<p>\"'", '<a b="c" ', "<div class='a'>", "<svg>", "</b>"):
        began = time.process_time()
        html_text.main_text(odd * 100_000)
        assert time.process_time() - began < 30


def test_class_words_are_learned(spark):
    body = "<p>word " * 150
    page = f"<div class='x-promo-y'>{body}</div><article>{body}<div class='promo'>{body}</div></article>"
    weights = html_text.learn_weights(spark.createDataFrame([(page,)] * 3, "html string"))
    assert weights.left_out_by("x-promo-y", "div") and not weights.left_out_by("promo", "div")
    assert html_text.Weights().left_out_by("promo", "div") and not html_text.Weights().left_out_by("x-promo-y", "div")


NAV = "<nav><a href=/>Home</a></nav><div class='menu'><ul>" + "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(8)) + "</ul></div>"
FOOT = "<footer>Copyright 2024</footer><div class='links'><a href=1>a</a> <a href=2>b</a></div>"
BARE = {
    "pairs": ("".join(f"<div><span>Q{i}</span></div><div>A{i}</div>" for i in range(12)), [x for i in range(12) for x in (f"Q{i}", f"A{i}")]),
    "table": ("<table>" + "".join(f"<tr><td>{i}</td><td>{i * i}</td></tr>" for i in range(20)) + "</table>", [x for i in range(20) for x in (str(i), str(i * i))]),
    "list": ("<h1>Things</h1><ul>" + "".join(f"<li>thing {i}</li>" for i in range(10)) + "</ul>", ["Things", *(f"thing {i}" for i in range(10))]),
    "headings": ("".join(f"<h2>Head {i}</h2><p>Some words of a paragraph, number {i}.</p>" for i in range(4)), [x for i in range(4) for x in (f"Head {i}", f"Some words of a paragraph, number {i}.")]),
    "formula": ("<p>The area is <math><mi>x</mi><mo>=</mo><mn>3</mn></math> exactly.</p>", ["The area is x=3 exactly."]),
}


@pytest.fixture(scope="module")
def learned(spark):
    article = "<article><h1>Title</h1><p>" + "plain words of the text " * 30 + "</p></article>"
    page = f"<html><body>{NAV}{article}<div>Related <a href=3>more</a></div>{FOOT}</body></html>"
    return html_text.learn_weights(spark.createDataFrame([(page,)] * 30, "html string"))


@pytest.mark.parametrize("name", BARE)
def test_pages_without_an_article(learned, name):
    body, blocks = BARE[name]
    for weights in (html_text.Weights(), learned):
        assert html_text.main_text(body, weights) == "\n\n".join(blocks)
    framed = f"<html><body>{NAV}<div>{body}</div>{FOOT}</body></html>"
    assert html_text.main_text(framed, learned) == "\n\n".join(blocks)


def test_the_scan_decides_where_nothing_is_marked(learned, monkeypatch):
    body = f"<html><body>{NAV}<div>{BARE['headings'][0]}</div>{FOOT}</body></html>"
    found = html_text.main_text(body, learned)
    monkeypatch.setattr(html_text, "best_run", lambda scores: (0, len(scores)))
    assert len(html_text.main_text(body, learned)) > len(found)
