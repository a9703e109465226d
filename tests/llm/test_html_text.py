import html
import os
import random
import re
import time

import pyarrow.parquet as pq
import pytest

from millrace.llm import html_text
from millrace.llm.html_text import main_text, trained

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">menu one</a><li><a href="/b">menu two</a></ul></nav><!-- no --><div class="cookie-notice">We use cookies, many of them indeed.</div>
<div class="ad">buy things</div><article><h1>Head&shy;line &lt;1&gt;</h1><p><b>Bold lead<br><p>First&nbsp;  para
 with <a href="x>y">a link</a>in<b>line</b>.</p><div class="advert">Sponsored words here</div><p>Last.</p>
<section class="comments"><p>Nice article says a reader at length and more</p></section></article>
<aside class="sidebar"><p>Other stories you may like</p></aside><form><label>Your name</label></form><footer>&copy; someone</footer></body></html>"""


def test_page():
    assert main_text(PAGE, trained()) == "Head\xadline <1> Bold lead First para with a linkinline. Last."


def test_cut_and_odd_pages():
    w = trained()
    assert main_text(PAGE[: PAGE.index("Last.") + 5], w) == "Head\xadline <1> Bold lead First para with a linkinline. Last."
    assert [main_text(x, w) for x in (None, "", "<", "<!-- x", "<script>a", "<nav>a b</nav>", "&nbsp;")] == [""] * 7
    assert main_text("<div class='post-content'><p>one & two < three</p></div>", w) == "one & two < three"
    assert main_text("<main><p>" + "word " * 50000 + "</main>", w) == " ".join(["word"] * 50000)
    assert main_text("<article>" + "<div>" * 3000 + "deep" + "</article>", w).endswith("deep")


def test_region_is_the_best_of_all():
    """The scan against all contiguous regions, on random sequences of runs and tags."""
    rng = random.Random(3)
    w = trained()
    openers = ["<p>", "<div class=ad>", "<article>", "<nav>", "<b>", "<li>", "<div class=content>", "</article>", "</div>", "</nav>", "</p>"]
    for _ in range(300):
        page = "".join(rng.choice(openers) if rng.random() < 0.5 else "w " * rng.randint(1, 9) for _ in range(14))
        scores, texts = [], []
        for kind, value, context in html_text.sequence(page, w.root, w.descend):
            scores.append(w.tag if kind == "tag" else w.score(len(value.split()), context))
            texts.append(len(value.split()) if kind == "text" and w.of(context) > 0 else 0)
        spans = [(sum(scores[a:b]), -a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        best = max((s for s in spans if s[0] > 0), default=(0, 0, 0), key=lambda s: round(s[0], 9))
        got = html_text.best_region(page, w, w.descend)[0].count("w")
        ties = {sum(texts[-a:b]) for s, a, b in spans if abs(s - best[0]) < 1e-9 and best[0] > 0} or {0}
        assert got in ties


def test_labelled_accuracy():
    w = trained()
    right = total = 0
    for page in html_text.labelled_pages(200, seed=9):
        for found, words, label in page:
            weight = w.bias + sum(w.feature.get(f, 0.0) * v for f, v in found.items())
            right += words * ((weight > 0) == label)
            total += words
    assert right > 0.93 * total


TEXT = "These are the words of a page that nobody has cut. " * 4
FOUND = " ".join(TEXT.split())


@pytest.mark.parametrize(
    "page",
    [
        f'<form id="form1"><div class="content"><p>{TEXT}</p></div></form>',
        f'<form id="aspnetForm"><div><ul class="menu"><li><a>Home</a></li></ul></div><div class="post"><p>{TEXT}</div></form>',
        f'<div class="fixed-header"><div class="content"><p>{TEXT}</p></div></div>',
        f'<body class="has-sidebar"><main><p>{TEXT}</p></main><aside>Other words</aside></body>',
        f'<article><p class="more">{TEXT}</p></article>',
        f"<body><ul><li><a>menu one</a></li><li><a>menu two</a></li></ul><div><p>{TEXT}</p></div></body>",
        f'<article><p>{TEXT}</p><section class="comments"><p>A reader says so</p></section></article>',
        f'<article data-x="<p>not text</p>" title=\'a > b\'><p>{TEXT}</article>',
    ],
)
def test_wrappers_dont_hide_content(page):
    assert main_text(page, trained()) == FOUND


MARKED = [f"<html><body><nav><a>menu</a></nav><article><h1>Title</h1><p>{TEXT}</p></article><footer>Someone</footer></body></html>"] * 50


@pytest.mark.parametrize("marked", [[], MARKED])
def test_forms_are_no_text_and_names_mislead(marked):
    w = trained(marked)
    for form in ("<form><p>Subscribe now</p></form>", "<form class='box'><label>Your name</label><input><p>We write once a week and never more.</p></form>", "<div class='newsletter-signup'><form><p>Subscribe now</p></form></div>", "<div class='x'><form action=z><div>Comment here</div></form></div>"):
        assert main_text(f"<article><p>{TEXT}</p>{form}<p>Tail.</p></article>", w) == f"{FOUND} Tail."
        assert main_text(f"<body><div><p>{TEXT}</p>{form}<p>{TEXT}</p></div></body>", w) == f"{FOUND} {FOUND}"
    assert main_text(f'<div class="newsletter"><h1>Issue 5</h1><p>{TEXT}</p></div>', w) == f"Issue 5 {FOUND}"
    assert main_text(f'<div id="cookie-recipe"><h1>Cookies</h1><p>{TEXT}</p></div>', w) == f"Cookies {FOUND}"
    assert main_text(f'<body class="search"><div class="main-menu"><a>Menu</a></div><div><p>{TEXT}</p></div></body>', w) == FOUND
    assert main_text(f'<body><form id="f"><div class="sidebar-left"><a>Menu</a></div><div><p>{TEXT}</p></div></form></body>', w) == FOUND
    links = "".join(f"<li><a>Another story of the week {k}</a></li>" for k in range(30))
    assert main_text(f'<body><div class="content"><p>{TEXT}</p></div><ul class="related">{links}</ul><div class="content"><p>{TEXT}</p></div></body>', w) == f"{FOUND} {FOUND}"
    # Comments are many, the article is short.
    comments = "".join(f"<div class='comment'><p>{TEXT}</p></div>" for _ in range(9))
    assert main_text(f"<article><p>{TEXT}</p></article><section class='comments'>{comments}</section>", w) == FOUND


def test_word_shares():
    shares = html_text.word_shares("<div>a b<p>c</p><script>x y z</script></div><nav>d</nav>")
    assert shares == [0.75, 0.25, 0.25]
    assert html_text.word_shares("") == [] and html_text.word_shares("<p></p>") == [0.0]


@pytest.mark.parametrize(
    "page",
    ["<a" * 200_000, '<a href="' * 50_000, '<a b=">" ' * 50_000, "<div>" * 100_000 + "x", "<b>" * 50_000 + "<li></li>" * 50_000, "<" * 300_000, "<!--" * 100_000, "<script>" * 100_000, "</p>" * 100_000, "<p>" + "</b>" * 100_000],
)
def test_hostile_pages_take_linear_time(page):
    w = html_text.Weights({}, 1.0, -0.02)
    began = time.perf_counter()
    main_text(page, w)
    assert time.perf_counter() - began < 8  # under a second each on an idle machine; quadratic reading takes minutes


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no sample tables")
def test_pages_against_their_article_elements():
    """Pages that aren't in the sample, held against what an independent reading of <article> gives."""
    pages = [x for x in pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist() if x]
    w, seen = trained(pages[:100]), 0
    for page in pages[100:]:
        if own := re.search(r"<article>(.*?)(</article>|$)", page, re.S):
            body = re.sub(r"</?(b|a|i|em|span|strong)\b[^>]*>", "", re.sub(r"<script.*?</script>", "", own[1], flags=re.S))
            assert main_text(page, w) == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", body)).split())
            seen += 1
    assert seen > 1000


def test_query(spark):
    rows = [(1, "u", PAGE), (2, None, None), (2, None, None), (None, "v", "<article>é 👍</article>")]
    out = html_text.op10_html_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.n_chars, r.page_id) for r in out if r.page_id != None) [:2] == [(0, 2), (0, 2)]  # noqa: E711
    assert [r.text for r in out if r.page_id is None] == ["é 👍"]
    assert html_text.op10_html_text(spark, spark.createDataFrame([], "page_id long, url string, html string, text int")).count() == 0
    clash = spark.createDataFrame([(1, "u", "<article>words</article>", 5, "z")], "page_id long, url string, html string, text int, n_chars string")
    assert [tuple(r) for r in html_text.op10_html_text(spark, clash).collect()] == [(1, "u", "words", 5)]
