"""Pages as trees of block elements with the text of each block, by a forgiving reader."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
SKIPPED = frozenset("head script style noscript template svg math iframe object audio video canvas map select textarea button datalist title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: They may be closed in themselves.
FOREIGN = frozenset({"svg", "math"})
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
CLOSES_P = BLOCKS - frozenset("body html caption dd dt legend li optgroup option tbody td tfoot th thead tr".split())
#: What an opening tag ends, up to the nearest element that holds such a list.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|([^\s=\"'/>]+)")
_BARE_VALUE = re.compile(r"=\s*[^\s\"'=>]+/$")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Page:
    """Elements in page order, parents before children; the first one stands for the page."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    #: Words of class, id, role and label; ``hidden`` if the element is.
    names: list[list[str]] = field(default_factory=lambda: [[]])
    labels: list[str | None] = field(default_factory=lambda: [None])
    #: Characters within links, of each element's own text.
    linked: list[int] = field(default_factory=lambda: [0])
    #: (element, text) in page order.
    blocks: list[tuple[int, str]] = field(default_factory=list)


def _attributes(text: str) -> tuple[list[str], str | None]:
    names, label = [], None
    if not text or text.isspace():
        return names, label
    for key, value, bare in _ATTRIBUTE.findall(text):
        key = (key or bare).lower()
        value = value.strip("\"'")
        if key in ("class", "id", "role", "aria-label", "itemprop"):
            names += [x.lower() for x in _NAME.findall(html.unescape(value))]
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            names.append("hidden")
        elif key == "data-label":
            label = value
    return names, label


def read(source: str) -> Page:
    """The page's block elements; inline elements add to the block that they stand in."""
    page = Page()
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements, inline ones with their block
    parts: list[str] = []
    links = skipped = 0

    def close_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                page.blocks.append((stack[-1][1], text))
            parts.clear()

    def pop() -> None:
        nonlocal links, skipped
        tag, _ = stack[-1]
        if tag in BLOCKS:
            close_block()
        links -= tag == "a"
        skipped -= tag in SKIPPED
        stack.pop()

    def end(tags: set[str], within: set[str]) -> None:
        depth = len(stack) - 1
        found = 0
        while depth > 0 and stack[depth][0] not in within:
            if stack[depth][0] in tags:
                found = depth
            depth -= 1
        while found and len(stack) > found:
            pop()

    at, n = 0, len(source)
    while at < n:
        m = _TAG.search(source, at)
        stop = m.start() if m else n
        if stack[-1][0] == "head" and not source[at:stop].isspace() and stop > at:
            pop()
        if stop > at and not skipped:
            parts.append(source[at:stop])
            if links:
                page.linked[stack[-1][1]] += stop - at
        if not m:
            break
        at = m.end()
        slash, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            depth = len(stack) - 1
            while depth > 0 and stack[depth][0] != tag:
                # an inline end tag reaches no further than its block
                depth = 0 if tag not in BLOCKS and tag not in SKIPPED and stack[depth][0] in BLOCKS else depth - 1
            while depth and len(stack) > depth:
                pop()
            continue
        if tag == "br":
            parts.append(" ")
        if tag == "body":
            end({"head"}, set())
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            pop()
        if tag in CLOSES_P:
            end({"p"}, {"td", "th", "li", "div", "article", "section", "blockquote", "body", "#page"})
        if tag in ENDS:
            end(*ENDS[tag])
        if tag in BLOCKS:
            close_block()
        if tag in VOID or tag in FOREIGN and rest.endswith("/") and not _BARE_VALUE.search(rest):
            continue
        own = stack[-1][1]
        if tag in BLOCKS:
            names, label = _attributes(rest)
            page.tags.append(tag)
            page.parents.append(own)
            page.names.append(names)
            page.labels.append(label)
            page.linked.append(0)
            own = len(page.tags) - 1
        stack.append((tag, own))
        links += tag == "a"
        skipped += tag in SKIPPED
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(source, at)
            at = close.start() if close else n
    while len(stack) > 1:
        pop()
    close_block()
    return page
