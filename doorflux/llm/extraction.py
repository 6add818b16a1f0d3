"""HTML extraction by a tree-structured graphical model.

Each block element of a page is a node with one of three states: it is main text, it
is something else, or it holds both. A node's observations (tag, words of its names,
length, links and full stops of its own text, links of its subtree) depend on its state, its state on its
parent's. Counts over labelled pages give both. Messages passed up from the leaves
and down from the root give each node's marginals exactly; blocks of nodes
that are main text with more than half the probability are kept.

Labelled pages are made from rules (names that page parts commonly have, each with its
label), and a bounded sample of at most about ``FIT_PAGES`` of the given pages that
label themselves: pages with exactly one ``article`` element.

* null and empty pages, and pages without main text, give an empty text
* unclosed, crossed and cut-off tags are read as browsers do, more or less
* repeated pages each get a row; an empty table gives an empty result
* whole pages are read; other columns are ignored
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorflux.llm import dom
from doorflux.llm.common import checkpointed, drawn, map_texts, row_keys

STATES = ("content", "other", "holder")
CONTENT, OTHER, HOLDER = range(3)
FIT_PAGES = 500
MADE_PAGES = 1500

# Names that parts of pages commonly have.
OTHER_PARTS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs",
    "header": "header masthead topbar banner branding site-header",
    "footer": "footer site-footer copyright legal colophon",
    "aside": "sidebar aside widget widgets related recommended recommendations trending popular",
    "notice": "notice cookie cookies consent gdpr alert announcement warning disclaimer popup modal overlay message",
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion banner-ad adsbygoogle",
    "form": "form search newsletter subscribe subscription login signup contact-form",
    "share": "share social sharing follow tags",
    "comments": "comments comment comment-list reader-comments discussion replies reply respond responses disqus feedback",
}
OTHER_TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}
CONTENT_NAMES = "content post entry article article-body story post-content entry-content main text body article-content main-content post-body"


def made_pages(n: int = MADE_PAGES, seed: int = 6) -> list[str]:
    """Labelled pages: parts with common names around a text, in many orders and nestings."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9)))
    sentence = lambda a=4, b=18: " ".join(word() for _ in range(rnd.randint(a, b))).capitalize() + rnd.choice(".....?!")
    prose = lambda: " ".join(sentence() for _ in range(rnd.choice((1, 1, 2, 3, 5, 8))))
    link = lambda: f'<a href="/{word()}">{" ".join(word() for _ in range(rnd.randint(1, 3)))}</a>'

    def named(names: str) -> str:
        name = rnd.choice(names.split())
        more = rnd.choice(("", "", " " + word(), "-" + word(), " " + rnd.choice(("box", "wrapper", "list", "block", "section", "area"))))
        return rnd.choice(("class", "class", "id")) + f'="{name}{more}"'

    def other(kind: str) -> str:
        tag = OTHER_TAGS.get(kind, "div") if rnd.random() < 0.6 else rnd.choice(("div", "div", "section", "aside"))
        names = "" if tag in ("nav", "header", "footer", "aside", "form") and rnd.random() < 0.5 else " " + named(OTHER_PARTS[kind])
        if kind in ("nav", "share"):
            inner = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(2, 8))) + "</ul>" if rnd.random() < 0.7 else " ".join(link() for _ in range(4))
        elif kind == "comments":
            inner = f"<h3>{sentence(1, 3)}</h3>" * (rnd.random() < 0.5) + "".join(rnd.choice((f'<div {named("comment reply comment-body")}><p>{prose()}</p></div>', f"<p>{prose()}</p>", f"<li><b>{word()}</b> {prose()}</li>")) for _ in range(rnd.randint(1, 6)))
        elif kind == "form":
            inner = f"<label>{word()}</label><input name='q'><p>{sentence(2, 8)}</p><button>{word()}</button>"
        elif kind == "aside":
            inner = f"<h4>{sentence(1, 3)}</h4>" + rnd.choice(("<ul>" + "".join(f"<li>{link()}</li>" for _ in range(5)) + "</ul>", f"<p>{sentence()}</p>", prose()))
        elif kind == "header":
            inner = rnd.choice((f"<h1>{sentence(1, 3)}</h1>", f"<div>{link()}</div>", sentence(1, 4), f"<p>{sentence(2, 6)}</p>"))
        else:
            inner = rnd.choice((sentence(3, 12), f"<p>{sentence()}</p>", f"<p>{prose()}</p>", f"{sentence(2, 5)} {link()}", f"&copy; {word()} {sentence(2, 5)}"))
        return f'<{tag}{names} data-label="other">{inner}</{tag}>'

    def text_part() -> str:
        kind = rnd.random()
        if kind < 0.72:
            return f"<p>{prose()}</p>"
        if kind < 0.8:
            return f"<h2>{sentence(1, 6)}</h2><p>{prose()}</p>"
        if kind < 0.85:
            return "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(rnd.randint(1, 5))) + "</ul>"
        if kind < 0.88:
            return f"<blockquote><p>{prose()}</p></blockquote>"
        if kind < 0.91:
            return f"<p>{sentence()} {link()} {sentence()}</p>"
        if kind < 0.93:
            return f"<table><tr><td>{word()}</td><td>{word()}</td></tr></table>"
        if kind < 0.95:
            return f"<figure><figcaption>{sentence()}</figcaption></figure>"
        if kind < 0.97:
            return f"<pre>{prose()}</pre>"
        return f"<div>{prose()}</div>"

    pages = []
    for _ in range(n):
        inner = [f"<h1>{sentence(2, 10)}</h1>"] * (rnd.random() < 0.8) + [text_part() for _ in range(rnd.randint(1, 14))]
        for kind in rnd.sample(list(OTHER_PARTS), rnd.choice((0, 0, 1, 2))):
            inner.insert(len(inner) if kind == "comments" else rnd.randint(1, len(inner)), other(kind))
        body = "".join(inner)
        style = rnd.random()
        if style < 0.4:
            main = f'<article data-label="content">{body}</article>'
        elif style < 0.6:
            main = f'<main data-label="content">{body}</main>'
        elif style < 0.9:
            main = f'<div {named(CONTENT_NAMES)} data-label="content">{body}</div>'
        else:
            main = "".join(x if "data-label" in x[:90] else x.replace(">", ' data-label="content">', 1) for x in inner)
        before = [other(k) for k in rnd.sample(("nav", "header", "notice", "ad", "form"), rnd.randint(0, 4))]
        after = [other(k) for k in rnd.sample(("comments", "aside", "share", "ad", "notice", "form", "footer"), rnd.randint(0, 5))]
        for _ in range(rnd.choice((0, 0, 1, 2))):
            names = f' class="{rnd.choice(("wrapper", "container", "page", "row", "layout", "site", "grid", word()))}"' if rnd.random() < 0.8 else ""
            tag = rnd.choice(("div", "div", "section"))
            cut = rnd.randint(0, len(before)), rnd.randint(0, len(after))
            main = f'<{tag}{names} data-label="holder">' + "".join(before[cut[0]:]) + main + "".join(after[:cut[1]]) + f"</{tag}>"
            before, after = before[:cut[0]], after[cut[1]:]
        pages.append(f'<html data-label="holder"><head><title>{sentence()}</title></head><body data-label="holder">{"".join(before)}{main}{"".join(after)}</body></html>')
    return pages


def labelled_states(page: dom.Page) -> list[int] | None:
    """States from ``data-label`` or, if there is none, from the page's only ``article``."""
    states = []
    if any(page.labels):
        for label, parent in zip(page.labels, page.parents, strict=True):
            states.append(STATES.index(label) if label else HOLDER if parent < 0 else states[parent])
        return states
    if page.tags.count("article") != 1:
        return None
    article = page.tags.index("article")
    above, node = set(), article
    while node >= 0:
        node = page.parents[node]
        above.add(node)
    for k, (tag, parent) in enumerate(zip(page.tags, page.parents, strict=True)):
        if k in above:
            states.append(HOLDER)
        elif k == article:
            states.append(CONTENT)
        elif states[parent] == CONTENT:
            states.append(OTHER if tag in ("nav", "aside", "footer", "form") else CONTENT)
        else:
            states.append(OTHER)
    return states


def observations(page: dom.Page) -> list[list[str]]:
    """What is seen of each node, as words."""
    chars, stops = [0] * len(page.tags), [0] * len(page.tags)
    for node, text in page.blocks:
        chars[node] += len(text)
        stops[node] += text.count(". ") + text.endswith((".", "!", "?"))
    below, linked = list(chars), list(page.linked)  # of the whole subtree
    for k in range(len(page.tags) - 1, 0, -1):
        below[page.parents[k]] += below[k]
        linked[page.parents[k]] += linked[k]
    out = []
    for k, tag in enumerate(page.tags):
        seen = [f"tag {tag}", f"length {min(6, chars[k].bit_length() * 2 // 3)}"]
        seen += [f"name {x}" for x in dict.fromkeys(page.names[k])] or ["name"]
        if below[k] > chars[k]:
            seen.append(f"within {min(3, 4 * linked[k] // below[k])}")
        if chars[k]:
            seen.append(f"links {min(3, 4 * page.linked[k] // max(1, chars[k]))}")
            seen.append(f"stops {min(3, stops[k])}")
        out.append(seen)
    return out


@dataclass(frozen=True)
class Model:
    """Log probabilities: of observations by state, of a state given the parent's, of the root's."""

    seen: dict[str, np.ndarray]
    steps: np.ndarray
    root: np.ndarray


def fit(pages: list[tuple[dom.Page, list[int]]]) -> Model:
    kinds: dict[str, dict[str, np.ndarray]] = {}
    steps, root = np.ones((3, 3)) * 0.2, np.ones(3) * 0.2
    for page, states in pages:
        root[states[0]] += 1
        for k, seen in enumerate(observations(page)):
            if k:
                steps[states[page.parents[k]], states[k]] += 1
            for x in seen:
                counts = kinds.setdefault(x.split(" ")[0], {}).setdefault(x, np.zeros(3))
                counts[states[k]] += 1
    out = {}
    for kind in kinds.values():
        # made-up names of a few pages say nothing
        kind = {x: counts for x, counts in kind.items() if counts.sum() >= 3}
        total = sum(kind.values(), np.zeros(3))
        for x, counts in kind.items():
            out[x] = np.log((counts + 0.1) / (total + 0.1 * len(kind)))
            out[x] -= out[x].mean()
    return Model(out, np.log(steps / steps.sum(axis=1, keepdims=True)), np.log(root / root.sum()))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(pages: list[dom.Page], model: Model) -> np.ndarray:
    """State probabilities of all nodes of all pages, by messages up and down the trees."""
    parents, depth, own = [], [], []
    nothing = np.zeros(3)
    for page in pages:
        base = len(parents)
        for parent in page.parents:
            parents.append(base + parent if parent >= 0 else -1)
            depth.append(depth[base + parent] + 1 if parent >= 0 else 0)
        own += [sum((model.seen.get(x, nothing) for x in seen), nothing) for seen in observations(page)]
    parent, level, up = np.array(parents), np.array(depth), np.array(own).reshape(-1, 3)
    order = np.argsort(level, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(level[order])) + 1)
    message = np.zeros_like(up)  # from a node to its parent
    for nodes in reversed(levels[1:]):
        message[nodes] = _log_sum(up[nodes][:, None, :] + model.steps[None], 2)
        np.add.at(up, parent[nodes], message[nodes])
    belief = up.copy()
    for nodes in levels:
        if parent[nodes[0]] < 0:
            belief[nodes] += model.root
        else:
            above = belief[parent[nodes]] - message[nodes]
            belief[nodes] += _log_sum(above[:, :, None] + model.steps[None], 1)
        belief[nodes] -= _log_sum(belief[nodes], 1)[:, None]
    return np.exp(belief)


def main_texts(sources: list[str], model: Model) -> list[str]:
    pages = [dom.read(s) for s in sources]
    chances = marginals(pages, model)[:, CONTENT] if pages else []
    out, base = [], 0
    for page in pages:
        out.append(" ".join(text for node, text in page.blocks if chances[base + node] > 0.5))
        base += len(page.tags)
    return out


def train(pages: DataFrame, fit_pages: int = FIT_PAGES) -> Model:
    """Fits the model on made pages and on a bounded sample of the given ones."""
    known = [dom.read(x) for x in made_pages()]
    rows = pages.where("html is not null").select("html", *row_keys("page_id", "url", "html"), F.lit(1).alias("_one"))
    chosen = drawn(rows, "_one", fit_pages)
    # at most fit_pages rows, however many there are, one at a time
    sampled = rows.join(F.broadcast(chosen), ["_one", "_h1", "_h2"]).dropDuplicates(["_h1", "_h2"])
    for row in checkpointed(sampled.select("html")).toLocalIterator():
        known.append(dom.read(row["html"]))
    return fit([(page, states) for page in known if (states := labelled_states(page))])


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page."""

    def run(sources: list[str]) -> dict[str, list]:
        texts = [x for k in range(0, len(sources), 100) for x in main_texts(sources[k:k + 100], model)]
        return {"text": texts, "n_chars": [len(x) for x in texts]}

    return map_texts(pages.select("page_id", "url", "html"), "html", "text string, n_chars bigint", run)
