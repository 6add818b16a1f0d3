"""Main text of pages: given ones, hand-made ones, awkward ones."""

import html
import re

import pytest

from doorflux.llm import dom, extraction
from doorflux.llm.common import table
from doorflux.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model():
    pages = [dom.read(x) for x in extraction.made_pages()]
    return extraction.fit([(p, extraction.labelled_states(p)) for p in pages])


def test_articles_of_the_given_pages(spark, sf_dir):
    rows = {r.page_id: r for r in QUERIES["op6_html_extraction"](spark, sf_dir).collect()}
    for page in table(spark, sf_dir, "pages").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", page.html, re.DOTALL)[1]
        text = " ".join(html.unescape(re.sub(r"<[^>]*(>|$)", " ", article)).split())
        r = rows.pop(page.page_id)
        assert (r.url, r.text, r.n_chars) == (page.url, text, len(text))
    assert not rows


PROSE = "The committee met on Tuesday and agreed on the plan. It will be carried out in May."
PAGES = {
    "main": f"<body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><main><h1>Title here</h1><p>{PROSE}</p><p>Short.</p></main><footer>&copy; 2020</footer>",
    "class": f"<div id=wrapper><div class='site-header'>Name</div><div class='post-content'><h1>Title here</h1><p>{PROSE}<p>Short.</div><div class='sidebar'><h3>More</h3><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div></div>",
    "comments": f"<article><h1>Title here</h1><p>{PROSE}</p><p>Short.</p><section class='comments'><h3>2 comments</h3><div class=comment><p>I do not agree with this at all. It was May.</p></div></section></article>",
    "notices": f"<div class='cookie-notice'>We use cookies. By going on you agree.</div><article><h1>Title here</h1><div class=ad>Buy one, get one free.</div><p>{PROSE}</p><form action=s><label>Mail</label><input><button>Go</button></form><p>Short.</p></article><aside>Other news of the day.</aside>",
    "hidden": f"<article><script>if (a < b) document.write('<p>no</p>')</script><style>p > a {{}}</style><h1>Title here</h1><p>{PROSE}</p><p>Short.</p><!-- <p>no</p> --></article>",
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(model, name):
    assert extraction.main_texts([PAGES[name]], model) == [f"Title here {PROSE} Short."]


def test_held_out_made_pages(model):
    right = total = 0
    for source in extraction.made_pages(150, seed=99):
        page = dom.read(source)
        states = extraction.labelled_states(page)
        chances = extraction.marginals([page], model)[:, extraction.CONTENT]
        for node, _ in page.blocks:
            total += 1
            right += (chances[node] > 0.5) == (states[node] == extraction.CONTENT)
    assert right / total > 0.95


def test_marginals_by_enumeration(model):
    import itertools

    import numpy as np

    page = dom.read("<div class=x><p>One two three.</p><ul><li>a</li></ul></div>")
    phi = [sum((model.seen.get(x, np.zeros(3)) for x in seen), np.zeros(3)) for seen in extraction.observations(page)]
    total = np.zeros((len(phi), 3))
    for states in itertools.product(range(3), repeat=len(phi)):
        log = model.root[states[0]] + sum(phi[k][s] for k, s in enumerate(states))
        log += sum(model.steps[states[page.parents[k]], s] for k, s in enumerate(states) if k)
        for k, s in enumerate(states):
            total[k, s] += np.exp(log)
    assert extraction.marginals([page], model) == pytest.approx(total / total.sum(axis=1, keepdims=True))


@pytest.mark.parametrize(("source", "blocks"), [
    ("", []), ("plain &amp; simple", ["plain & simple"]), ("a<br>b<b>c</b>d", ["a bcd"]), ("<p>one<p>two", ["one", "two"]),
    ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("<p>a</b></i></div>b", ["ab"]), ("<div>a<p>b</div>c", ["a", "b", "c"]),
    ("<p>cut <b", ["cut"]), ("<p>a &lt b &am", ["a < b &am"]), ("<title>t</title><p x='>'>y</p>", ["y"]), ("x < y > z", ["x < y > z"]),
    ("<p>a<!-- b", ["a"]), ("<SCRIPT>x</p></SCRIPT >y", ["y"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("\x00\ud800", ["\x00\ud800"]),
])
def test_reading(source, blocks):
    assert [text for _, text in dom.read(source).blocks] == blocks


@pytest.mark.parametrize(("source", "texts"), [
    ("<p>a <svg/> b</p>", ["a b"]),
    ("<article><math display='block' /><p>text</p></article>", ["text"]),
    ("<p>a <svg class=x/>no</svg> b</p>", ["a b"]),
    ("<head><title>t</title><meta charset=utf-8><p>one<p>two", ["one", "two"]),
    ("<head><style>p {}</style> bare text <b>too</b>", ["bare text too"]),
    ("<head><template><p>no</p></template></head><p>yes", ["yes"]),
])
def test_no_text_is_lost(source, texts):
    assert [text for _, text in dom.read(source).blocks] == texts


def test_awkward_pages(spark, model):
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<p>x"), (2, "u", deep), (3, "u", f"<article><p>{'long text. ' * 30000}</p></article>"), (3, "u", "<article><p>a</p></article>")]
    pages = spark.createDataFrame([(*r, "clash", 7) for r in rows], schema)
    found = extraction.extract(pages, extraction.train(pages)).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    assert [r.text for r in found if r.page_id == 1] == ["", ""]
    assert max(r.n_chars for r in found) == 11 * 30000 - 1
    assert extraction.extract(pages.where("false"), extraction.train(pages.where("false"))).count() == 0
