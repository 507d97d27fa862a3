"""Main text of planted pages."""

import math
import random

import numpy as np
import pytest

from crestline.llm import htmltext

ARTICLE = "<h1>A &amp; B</h1><p>First   para\nwith <b>bold</b> text &#233; and more words in it.<p>Short.<ul><li>item one<li>item two</ul><table><tr><td>a<td>b</table><blockquote>Quoted words stand here.</blockquote>"
WANT = "A & B\nFirst para with bold text é and more words in it.\nShort.\nitem one\nitem two\na\nb\nQuoted words stand here."
AROUND = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home page of the site</a></ul></nav><header><h2>Site name</h2></header><div class="cookie-notice"><p>We use cookies on this site to make it better for you and for us all.</p></div>%s<aside><p>Related things that are long enough to look like an article to a ratio.</p></aside><div id="comments"><p>A reader wrote a very long comment that goes on and on, much longer than the article.</p></div><form><p>Sign up</p><button>Go</button></form><footer><p>All rights reserved by somebody, somewhere, at some time.</p></footer></body></html>'


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", '<div class="post-body">%s</div>', '<div><div id="content"><script>var t="</p>";</script>%s<!-- x --></div></div>', "<section>%s<div class=ad>Buy this now, it is very good and very cheap.</div></section>"])
def test_article_in_its_page(wrap):
    assert htmltext.extract(AROUND % (wrap % ARTICLE)) == WANT


@pytest.mark.parametrize(("html", "want"), [("", ""), ("no tags at all", "no tags at all"), ("<p>a<p>b", "a\nb"), ("<article><p>cut off in the mid", "cut off in the mid"), ("<script>x</script>", ""), ("<p>a &lt;b&gt; c</p>", "a <b> c"), ("<article>" + "<div>" * 3000 + "deep", "deep")])
def test_odd_pages(html, want):
    assert htmltext.extract(html) == want


def test_table(spark):
    long = "word " * 50000
    rows = [(1, "u", f"<article><p>{long}</p></article>", 0), (2, None, None, 1), (None, "v", "<p>x</p>", 2), (1, "u", f"<article><p>{long}</p></article>", 0)]
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()}
    assert got == {(1, "u"): (long.strip(), len(long) - 1), (2, None): ("", 0), (None, "v"): ("x", 1)}
    assert htmltext.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("page", ["<div>%s</div>", '<div><div class="x">%s</div></div>', "<table><tr><td>%s</td></tr></table>"])
@pytest.mark.parametrize("long", ["<p>%s</p>", "<div class=lead><p>%s</p></div>", "<div class=lead><p>%s</p><p>Its caption.</p></div>", "<ul><li>%s<li>an item</ul>", "<div>%s</div>", "<blockquote><p>%s</p></blockquote>"])
def test_one_long_paragraph_among_short_ones(page, long):
    article = "<h1>The heading</h1><p>Short one.</p>" + long % ("words of the long one " * 200) + "<p>Short two.</p><p>A third paragraph that is a bit longer.</p>"
    got = htmltext.extract(AROUND % (page % article)).split("\n")
    assert got[:2] == ["The heading", "Short one."] and got[-2:] == ["Short two.", "A third paragraph that is a bit longer."]
    assert "words of the long one " * 199 in "\n".join(got)


def test_an_article_keeps_its_list_of_links():
    sources = "<ul>" + "".join(f'<li><a href="/{i}">Source number {i}</a>' for i in range(4)) + "</ul>"
    for wrap in ("<article>%s</article>", "<main>%s</main>"):
        assert htmltext.extract(AROUND % (wrap % (ARTICLE + sources))) == WANT + "".join(f"\nSource number {i}" for i in range(4))
    assert htmltext.extract(AROUND % (f"<div>{ARTICLE}{sources}</div>")) == WANT
    menu = "<ul>" + "".join(f'<li><a href="/{i}">Go {i}</a>' for i in range(8)) + "</ul>"
    assert htmltext.extract(f"<body>{menu}<p>{'words of the page ' * 40}</p><p>Some more.</p></body>") == ("words of the page " * 40).strip() + "\nSome more."


def test_smoothing_and_threshold_equal_plain_sums():
    r = random.Random(2)
    for n in (1, 2, 3, 7, 40):
        blocks = [("x" * r.choice([1, 5, 30, 400]), r.randint(0, 9), 0, 0) for _ in range(n)]
        ratios = [len(t) / max(1, tags) for t, tags, _, _ in blocks]
        plain = []
        for i in range(n):
            near = [(math.exp(-0.5 * ((j - i) / htmltext.SIGMA) ** 2), ratios[j]) for j in range(n) if abs(j - i) <= 2 * htmltext.SIGMA]
            plain.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
        mean = sum(plain) / n
        spread = math.sqrt(sum((x - mean) ** 2 for x in plain) / n)
        assert htmltext.smooth(np.array(ratios)) == pytest.approx(plain)
        assert [bool(x) for x in htmltext.content_lines(blocks)] == [x >= min(spread, max(plain)) - 1e-9 for x in plain]


def planted_page(r):
    """A page without article or main element or telling names, and the text of its article."""
    word = lambda: "".join(r.choices("etaoinshr", k=r.randint(2, 8)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    links = lambda n: "".join(f'<li><a href="/{word()}">{words(1, 2)}</a></li>' for _ in range(n))
    parts, want = [], []
    for _ in range(r.randint(6, 20)):
        kind, text = r.choice("ppppphlqt"), words(15, 90)
        if kind == "p":
            parts.append(f"<p>{text}</p>")
            want.append(text)
        elif kind == "h":
            text = words(2, 6)
            parts.append(f"<h2>{text}</h2>")
            want.append(text)
        elif kind == "l":
            items = [words(4, 20) for _ in range(r.randint(1, 4))]
            parts.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            want += items
        elif kind == "q":
            parts.append(f"<blockquote><p>{text}</p></blockquote>")
            want.append(text)
        else:
            cells = [words(3, 9) for _ in range(4)]
            parts.append("<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in zip(cells[::2], cells[1::2])) + "</table>")
            want += cells
    parts.append(f"<p>{'long ' * 60}</p>")
    want.append(("long " * 60).strip())
    body = r.choice(["<div>%s</div>", "<div><div class=x1>%s</div></div>", "<section>%s</section>"]) % "".join(parts)
    around = [f"<div><ul>{links(r.randint(2, 7))}</ul></div>", body, f"<div><ul>{links(r.randint(2, 7))}</ul></div>"]
    return f"<html><body>{''.join(around)}</body></html>", "\n".join(want)


@pytest.mark.parametrize("seed", range(60))
def test_the_cluster_finds_articles_that_nothing_names(seed):
    html, want = planted_page(random.Random(seed))
    assert htmltext.extract(html) == want


def test_links_between_content_stay_without_an_article_element():
    words = "some words that make up a paragraph of the article and more of them " * 3
    links = "".join(f'<p><a href="/{i}">Link number {i}</a></p>' for i in range(4))
    got = htmltext.extract(f"<body><div><p>{words}</p>{links}<p>{words}</p></div></body>").split("\n")
    assert len(got) == 6
