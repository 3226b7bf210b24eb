"""A page's elements and text runs, read as a browser reads unclosed and misplaced tags."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"                                     # comments
    r"|<(?:[!?]|/(?![A-Za-z]))[^>]*(?:>|\Z)"                            # declarations and the like
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)"
    r"(?P<attributes>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>"
    r"|</?[A-Za-z].*", re.S)                                           # a tag that the page breaks off in
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

#: Names and nesting rules of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADS | frozenset(
    "address article aside blockquote br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split())
_ENDS_P = BLOCKS - frozenset("br caption legend optgroup option tbody td tfoot th thead tr".split())
_SCOPE = ("button", "caption", "marquee", "object", "table", "td", "template", "th")
_TABLE = frozenset("caption tbody td tfoot th thead tr".split())
#: A start tag ends the elements in its first list, unless one of the second was opened since.
_ENDS = {
    "li": (("li",), ("dir", "menu", "ol", "ul", *_SCOPE)),
    "dd": (("dd", "dt"), ("dl", *_SCOPE)),
    "dt": (("dd", "dt"), ("dl", *_SCOPE)),
    "option": (("option",), ("select",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tr": (("caption", "td", "th", "tr"), ("table",)),
    "tbody": (("caption", "tbody", "td", "tfoot", "th", "thead", "tr"), ("table",)),
    "thead": (("caption", "tbody", "td", "tfoot", "th", "thead", "tr"), ("table",)),
    "tfoot": (("caption", "tbody", "td", "tfoot", "th", "thead", "tr"), ("table",)),
    "a": (("a",), ("article", "div", "li", "section", *_SCOPE)),
}


@dataclass
class Tree:
    """Elements in page order, the page itself first; a text run knows its element and whether it is a link's."""
    tags: list[str] = field(default_factory=lambda: ["body"])
    parents: list[int] = field(default_factory=lambda: [-1])
    attributes: list[str] = field(default_factory=lambda: [""])
    owners: list[int] = field(default_factory=lambda: [0])       # nearest block, itself included
    runs: list[tuple[int, str, bool]] = field(default_factory=list)


#: The run between blocks, of no element.
BREAK = (-1, " ", False)


@lru_cache(maxsize=None)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


def read(html: str) -> Tree:
    """The tree of a page; what a page breaks off in (a tag, a comment, a raw element) is not text."""
    tree, stack, opened, blocks, at, link = Tree(), [0], {}, [0], 0, False

    def last(names) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=0)

    def cut(depth: int) -> None:
        nonlocal link
        while len(stack) > depth:
            name = tree.tags[stack.pop()]
            opened[name].pop()
            link = link and name != "a"
            if name in BLOCKS:
                blocks.pop()
                tree.runs.append(BREAK)

    def say(text: str) -> None:
        if text:
            tree.runs.append((stack[-1], unescape(text), link))

    while at < len(html):
        found = _MARKUP.search(html, at)
        if not found:
            say(html[at:])
            break
        say(html[at:found.start()])
        at, name = found.end(), found["name"]
        if not name:
            continue
        name = name.lower()
        if name in ("html", "head", "body"):
            continue
        if found["end"]:
            if name == "a":
                link = False
            if name in HEADS:
                depth = last(HEADS)
            else:
                depth = last((name,))
            if name in _TABLE:
                barrier = last(("table",))
            elif name == "table":
                barrier = last(("template",))
            elif name in BLOCKS or name in _SCOPE:
                barrier = last([s for s in _SCOPE if s != name])
            else:
                barrier = max(blocks[-1], last(_SCOPE))
            if depth > barrier:
                cut(depth)
            elif name == "br":
                tree.runs.append(BREAK)
            continue
        if name in _ENDS_P and last(("p",)) > last(_SCOPE):
            cut(last(("p",)))
        if name in HEADS and tree.tags[stack[-1]] in HEADS:
            cut(len(stack) - 1)
        if name in _ENDS:
            ends, barriers = _ENDS[name]
            depths = [opened[n][-1] for n in ends if opened.get(n) and opened[n][-1] > last(barriers)]
            if depths:
                cut(min(depths))
        if name in BLOCKS:
            tree.runs.append(BREAK)
        if name in VOID:
            continue
        foreign = opened.get("svg") or opened.get("math")
        if foreign and found["attributes"].endswith("/"):
            continue
        if name in RAW and not foreign:
            closing = _closing(name).search(html, at)
            after = html.find(">", closing.end()) if closing else -1
            at = after + 1 if after >= 0 else len(html)
            continue
        if name == "a":
            link = "href" in found["attributes"].lower()
        node = len(tree.tags)
        tree.tags.append(name)
        tree.parents.append(stack[-1])
        tree.attributes.append(found["attributes"])
        tree.owners.append(node if name in BLOCKS else tree.owners[stack[-1]])
        opened.setdefault(name, []).append(len(stack))
        if name in BLOCKS:
            blocks.append(len(stack))
        stack.append(node)
    return tree


def attribute(attributes: str, *names: str) -> str:
    """Values of the named attributes, joined by a space."""
    found = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), unescape("".join(values)))
    return " ".join(found[n] for n in names if n in found)
