import html
import re

import pytest

from ledgerloom.llm import pages

from .helpers import small


def test_small_table_against_the_article_element(spark):
    table = small(spark, "pages")
    want = {}
    for r in table.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want[r["page_id"]] = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", body))).split())
    got = {r["page_id"]: r for r in pages.extract(table).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain & simple", "plain & simple"),
        ("<p>a&nbsp;b &lt;c&gt; &eacute;&#33;</p>", "a b <c> é!"),
        ("<article><h1>T</h1><p>One <b>t</b>wo<br>three</article>", "T One two three"),
        ("<nav>menu</nav><header>Site</header><main><h1>Head</h1><p>Body text here.</p><ul><li>x<li>y</ul></main><footer>f</footer>", "Head Body text here. x y"),
        ("<div class='content'><p>Real words of the article.</p><div class='ad-box'>Buy now</div><p>More.</p></div><div id='sidebar'>s</div>", "Real words of the article. More."),
        ("<article><p>Text of the page.</p><section class='comments'><p>First!</p></section><form>Mail <input></form></article>", "Text of the page."),
        ("<article><p>a long enough paragraph</p><script>var t='</p>';</script><style>p{}</style><!-- note --></article><div class='cookie-notice'>ok?</div>", "a long enough paragraph"),
        ("<article><p>cut off <a hre", "cut off"),
        ("<article><p>one<p>two<div>three</div>four</article>", "one two three four"),
        ("<nav>only a menu</nav>", ""),
    ],
)
def test_cases(page, text):
    assert pages.main_text(page) == text


def test_short_blocks_stay_and_boilerplate_goes():
    body = "".join(f"<p>{'word ' * n}end.</p>" for n in (40, 1, 60, 2, 30))
    side = "".join(f"<li><a href='#'>link {i}</a></li>" for i in range(30))
    got = pages.main_text(f"<body><div class='menu'><ul>{side}</ul></div><div class='main'><h2>Title</h2>{body}</div><div class='related'>{side}</div></body>")
    assert got.startswith("Title word") and got.count("end.") == 5 and "link" not in got


def sentence(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n)) + "."


def test_several_articles_stay():
    a, b, c = sentence("a", 60), sentence("b", 40), sentence("c", 5)
    menu = "".join(f"<li><a href='#'>link {i}</a></li>" for i in range(12))
    page = f"<body><ul>{menu}</ul><article><h2>One</h2><p>{a}</p></article><article><h2>Two</h2><p>{b}</p><p>{c}</p></article><p><a href='#'>back</a></p></body>"
    assert pages.main_text(page) == f"One {a} Two {b} {c}"
    assert pages.main_text(page.replace("article>", "main>")) == f"One {a} Two {b} {c}"


def test_lead_and_end_beside_the_body_stay():
    lead, end, paragraphs = sentence("lead", 30), sentence("end", 30), [sentence(f"p{i}w", 80) for i in range(6)]
    menu = "".join(f"<li><a href='#'>link {i}</a></li>" for i in range(12))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    page = f"<body><div><ul>{menu}</ul></div><div><p>{lead}</p></div><div>{body}</div><div><p>{end}</p></div></body>"
    assert pages.main_text(page) == " ".join([lead, *paragraphs, end])


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (2, None, "<p>" + "word " * 200_000 + "</p>", "x"), (None, "v", "<p>a</p>", "x")]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 1, 999_999]
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_smoothing_keeps_constants():
    import numpy as np

    assert np.allclose(pages.smooth(np.full(9, 3.0)), 3.0)
