import itertools
import random
import time

import pytest

from roaskit.llm import html_extract as m
from roaskit.llm.common import table
from tests.llm.conftest import SMALL

W = m.DEFAULT_WEIGHTS
MENU = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News about things</a></li></ul></nav>"
BODY = "The first paragraph has a good number of words so that it stands out. " * 3


def test_article_without_what_surrounds_it():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><h2>Site</h2></header>{MENU}
      <div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Other stories</p></div>
      <article class="post"><header><h1>A &amp; B</h1></header><p>One  two<br>three&nbsp;four <b>bold</b>.</p>
      <script>var x = "</p><p>no</p>";</script><!-- <p>no</p> --><div class=ad>Buy now</div>
      <form><input name=q><label>Search</label></form><p>{BODY}<p>Last &lt;one&gt;, caf&eacute; &#233;.</p>
      <section class="comments"><h3>Comments</h3><div><p>Nice article, I liked every word of it very much.</p></div></section>
      </article><aside>Aside</aside><footer>&copy; Site</footer></body></html>"""
    assert m.main_text(page, W) == "\n\n".join(["A & B", "One two three four bold.", BODY.strip(), "Last <one>, café é."])


def test_page_without_article_element():
    page = f"<body>{MENU}<div class=main-column><h1>Head</h1><p>{BODY}</p><p>{BODY}</p></div><div id=footer>About us | Contact</div></body>"
    assert m.main_text(page, W) == "\n\n".join(["Head", BODY.strip(), BODY.strip()])


@pytest.mark.parametrize("aside", ["<p class=notice>Hi there", "<ul><li class=ad>Buy now<li class=ad>And this</ul>", "<dl><dt class=promo>Offer<dd class=promo>Ten off</dl>",
                                   "<table><tr><td class=ad>Buy<td class=ad>now</table>", "<div><div class=sidebar><p>Other</div></div>"])
def test_asides_whose_end_tag_is_left_out(aside):
    body = f"<h1>Head</h1><p>{BODY}</p><p>{BODY}</p>"
    wanted = "\n\n".join(["Head", BODY.strip(), BODY.strip()])
    assert m.main_text(f"<body>{aside}<article>{body}</article></body>", W) == wanted
    assert m.main_text(f"<body><article>{body}{aside.replace('notice', 'ad')}</article><footer>x</footer></body>", W) == wanted


def test_names_inside_the_article():
    inside = ["<p class='share-price'>The price of a share rose.</p>", "<section id='related-work'><h2>Related work</h2><p>Others did it too, as we know well.</p></section>"]
    around = ["<div class='share-buttons'><p>Share this</p></div>", "<div id='related-posts'><p>More posts to read here</p></div>", "<p class='ad-12'>Buy</p>",
              "<div class='promo-special'><a href=a>One offer</a><a href=b>Another offer</a></div>"]
    page = f"<article><p>{BODY}</p>{inside[0]}{''.join(around)}{inside[1]}<p>{BODY}</p></article>"
    assert m.main_text(page, W) == "\n\n".join([BODY.strip(), "The price of a share rose.", "Related work", "Others did it too, as we know well.", BODY.strip()])


def test_pages_with_several_articles():
    one, two = f"<article><h2>One</h2><p>{BODY}</p></article>", f"<article><h2>Two</h2><p>{BODY}</p><p>{BODY}</p></article>"
    teaser = "<article class=card><a href=x>Read more of this</a></article>"
    comment = f"<article class='comment even'><p>{BODY}</p></article>"
    page = f"<body>{MENU}{teaser}{one}{two}{comment}{teaser}<footer>x</footer></body>"
    assert m.main_text(page, W) == "\n\n".join(["One", BODY.strip(), "Two", BODY.strip(), BODY.strip()])


@pytest.mark.parametrize("page", ["", "   ", "<p></p>", MENU, "<", "<!-- open", "<script>x", "<a href='>", "</div></div>"])
def test_pages_without_text(page):
    assert m.main_text(page, W) in ("", "<", "<a href='>")


def test_scan_finds_the_best_run():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.choice([-3, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(rng.randrange(1, 12))]
        best = max(sum(s[a:b]) for a, b in itertools.combinations(range(len(s) + 1), 2))
        run = m.best_run(s)
        assert run is None if best <= 0 else abs(sum(s[slice(*run)]) - best) < 1e-9


def test_operator_and_weights(spark):
    pages = table(spark, SMALL, "pages")
    weights = m.fitted_weights(pages, most=60)
    assert weights["word:text"] > 0 and all(v < 0 for k, v in weights.items() if k.startswith("tag"))
    rows = m.extracted(pages, weights).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) for r in rows)
    html = {r.page_id: r.html for r in pages.collect()}
    assert sum("<article" in html[r.page_id] and not r.text for r in rows) == 0


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a b c d e f</p>", None), (1, None, None, "x"), (2, "u", "<p>" + "w " * 200_000, "y")],
                                  "page_id long, url string, html string, text string")
    rows = m.extracted(pages, m.fitted_weights(pages)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in rows) == [(0, 11), (1, 0), (1, 0), (2, 399_999)]
    assert m.extracted(pages.limit(0), W).count() == 0


def test_unclosed_tags_take_linear_time():
    for bad in ("<a ", "<a 'x\" ", "<" + "a" * 3, "<!x ", "<script ", "</p "):
        page = "<article><p>" + "Words of the article stand here. " * 20 + "</p></article>" + bad * (1_000_000 // len(bad))
        start = time.time()
        items = m.items_of(page)
        assert time.time() - start < 10, bad
        assert sum(x.words for x in items if x.main) == 120
    start = time.time()
    m.items_of("<" + "a" * 1_000_000)
    assert time.time() - start < 10
