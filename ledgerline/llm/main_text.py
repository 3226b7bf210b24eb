"""Main text of pages: paragraphs pass points to the elements around them, the best one is kept."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerline.llm.page_tree import BLOCKS, HEADS, Tree, attribute, read
from ledgerline.llm.words import slices

PARAGRAPH_CHARS = 25         # shorter paragraphs have their share of the first point
LENGTH_CHARS, LENGTH_POINTS = 100, 3.0
SHARES = (1.0, 0.5, 1 / 6, 1 / 9, 1 / 12)    # of a paragraph's points, from the nearest element on
NAMED_POINTS = 25.0
SIBLING_SHARE = 0.2          # of the best element's points
LINK_DENSITY = 0.25          # most of a sibling that is kept
LIST_LINKS, LIST_DENSITY = 3, 0.8            # a block of so many links is a menu

_NEVER = frozenset(
    "audio button canvas datalist iframe noembed noframes noscript object script select style svg template textarea "
    "title video".split())
_ASIDE = frozenset("aside dialog footer menu nav".split())
_DOUBTED = frozenset("fieldset form header input label".split())
_CONTAINERS = frozenset("article body center details div main section table tbody td th tr".split())
_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Names of classes and ids of what is not the article.
_JUNK = re.compile("|".join((
    r"(?:global|main|mob|mobile|page|primary|secondary|side|site|sub|top|bottom|foot)?(?:nav|navbar|navigation|menu|menubar)s?",
    r"breadcrumbs?|pagination|pager|paging|toolbar|skiplinks?",
    r"(?:blog|global|page|site|top)?(?:header|footer|masthead|colophon)s?|topbar|copyright|legal",
    r"(?:left|right)?(?:sidebar|sidenav|aside|rail)s?|widgets?",
    r"cookies?|cookie(?:bar|banner|box|consent|notice)|consent|gdpr|privacy|notices?|notifications?|alerts?|banners?",
    r"pop(?:up|over)s?|modals?|overlays?|lightbox|toasts?|disclaimers?|paywall|newsletters?|subscribe|subscription",
    r"signup|signin|login|register|registration",
    r"ads?|adv|ads(?:box|ense|lot|ys)|adsbygoogle|ad(?:area|banner|block|box|container|slot|space|unit|wrap|wrapper|zone)s?",
    r"advert\w*|sponsor(?:ed|s)?|promos?|promot(?:ed|ion|ions)|commercials?|outbrain|taboola|dfp",
    r"forms?|search(?:bar|box|form)?|poll|quiz|survey",
    r"related|recommended|recommendations?|shar(?:e|es|ing)|sharebar|social|follow",
    r"(?:reader|user)?comments?|comment(?:s?(?:area|box|form|list|section|thread))|responses?|respond|repl(?:y|ies)|discussions?|disqus|talkback",
)))
_REMARK = re.compile(r"(?:reader|user)?comments?|comment(?:s?(?:area|box|form|list|section|thread))|repl(?:y|ies)|disqus")
_WANTED = re.compile(r"articles?|articlebody|blog|body|content|entry|hentry|main|post|posts|story|text")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_COMMAS = re.compile("[,،、，]")


class Scored:
    """A page's tree with what counts for each element; an element's own and all below it."""

    def __init__(self, tree: Tree):
        self.tree, n = tree, len(tree.tags)
        self.words = [[w.lower() for w in _WORD.findall(attribute(a, "class", "id"))] if a else [] for a in tree.attributes]
        self.roles = [attribute(a, "role", "itemprop").split() if a else [] for a in tree.attributes]
        self.gone = [False] * n
        self.article = [False] * n           # is or holds an outer article, a main element or a first heading
        self.first = [False] * n             # is or holds a main element or a first heading
        self.heads = [False] * n             # is or holds a heading
        self._drop_first()
        self._count()
        self._drop_doubted()
        self._count()

    def is_article(self, node: int) -> bool:
        named = self.tree.tags[node] in ("article", "main") or "main" in self.roles[node] or "articleBody" in self.roles[node]
        return named and not any(map(_REMARK.fullmatch, self.words[node]))

    def density(self, node: int) -> float:
        return self.linked[node] / self.chars[node] if self.chars[node] else 0.0

    def _drop_first(self) -> None:
        tags, parents = self.tree.tags, self.tree.parents
        for node in range(1, len(tags)):
            self.gone[node] = self.gone[parents[node]] or tags[node] in _NEVER or tags[node] in _ASIDE

    def _count(self) -> None:
        """Characters, links and paragraph points of what is not gone yet, own and below."""
        tags, parents, owners = self.tree.tags, self.tree.parents, self.tree.owners
        n = len(tags)
        self.chars, self.linked, self.links = [0] * n, [0] * n, [0] * n
        self.below, commas = [0.0] * n, [0] * n
        for node, text, link in self.tree.runs:
            if node >= 0 and not self.gone[node]:
                size = len("".join(text.split()))
                self.chars[owners[node]] += size
                self.linked[owners[node]] += size if link else 0
                commas[owners[node]] += len(_COMMAS.findall(text))
        self.own = [0.0] * n
        for node in range(n):
            if self.chars[node] and tags[node] not in HEADS:
                self.own[node] = (min(1.0, self.chars[node] / PARAGRAPH_CHARS) + commas[node]
                                  + min(LENGTH_POINTS, self.chars[node] / LENGTH_CHARS)) * (1 - self.density(node))
                self.below[node] = self.own[node]
        self.inside = [False] * n            # in an article or a main element
        self.nested = [False] * n            # in an article
        for node in range(n):
            if node:
                above = parents[node]
                here = self.is_article(above)
                self.inside[node] = self.inside[above] or here
                self.nested[node] = self.nested[above] or here and tags[above] == "article"
            self.links[node] = int(tags[node] == "a" and not self.gone[node])
            self.first[node] = not self.gone[node] and tags[node] in ("h1", "main")
            self.article[node] = self.first[node] or (
                not self.gone[node] and self.is_article(node) and not self.nested[node])
            self.heads[node] = tags[node] in HEADS
        for node in range(n - 1, 0, -1):
            above = parents[node]
            for counts in (self.chars, self.linked, self.links, self.below):
                counts[above] += counts[node]
            self.article[above] |= self.article[node]
            self.heads[above] |= self.heads[node]
            self.first[above] |= self.first[node]

    def _drop_doubted(self) -> None:
        """Drop what its tag, role or names speak against, unless it holds the article and most points."""
        tags, parents = self.tree.tags, self.tree.parents
        for node in range(1, len(tags)):
            if self.gone[node] or self.gone[parents[node]]:
                self.gone[node] = True
                continue
            words = self.words[node]
            holds = self.first[node] if any(map(_REMARK.fullmatch, words)) else self.article[node]
            if holds and 2 * self.below[node] >= self.below[0] and tags[node] != "header":
                continue
            head = tags[node] == "header" or "header" in words
            if head and (self.inside[node] or any(map(_WANTED.fullmatch, words))) and self.heads[node]:
                continue
            listed = tags[node] in BLOCKS and tags[node] not in HEADS and tags[node] != "p"
            self.gone[node] = (
                tags[node] in _DOUBTED or any(r in _ROLES for r in self.roles[node]) or any(map(_JUNK.fullmatch, words))
                or (tags[node] == "article" and self.nested[node])
                or (listed and self.links[node] >= LIST_LINKS and self.density(node) >= LIST_DENSITY))

    def scores(self) -> dict[int, float]:
        """Points of the elements that paragraphs pass them to, less the share of links."""
        tags, owners, parents = self.tree.tags, self.tree.owners, self.tree.parents
        found: dict[int, float] = {}
        for node, points in enumerate(self.own):
            if not points or self.gone[node]:
                continue
            at = node if tags[node] in _CONTAINERS else owners[parents[node]]
            for share in SHARES:
                found[at] = found.get(at, 0.0) + share * points
                if not at:
                    break
                at = owners[parents[at]]
        for node in found:
            if self.is_article(node) or any(map(_WANTED.fullmatch, self.words[node])):
                found[node] += NAMED_POINTS
            found[node] *= 1 - self.density(node)
        return found

    def roots(self) -> list[int]:
        """The best element, or the article around it, and what stands beside it and is like it."""
        tags, parents, owners = self.tree.tags, self.tree.parents, self.tree.owners
        found = self.scores()
        if found:
            best = min(found, key=lambda node: (-found[node], node))
        else:
            best = next((n for n in range(len(tags)) if not self.gone[n] and self.is_article(n)), 0)
        around, node = None, best
        while node:                           # the outermost article, else the outermost other
            if self.is_article(node) and (tags[node] == "article" or around is None or tags[around] != "article"):
                around = node
            node = parents[node]
        kept = [best if around is None else around]
        children: dict[int, list[int]] = {}
        for node in range(1, len(tags)):
            children.setdefault(parents[node], []).append(node)
        at, enough = kept[0], SIBLING_SHARE * self.below[kept[0]]
        while at:
            for node in children[parents[at]]:
                if node == at or self.gone[node] or not self.chars[node]:
                    continue
                if around is not None:
                    like = self.is_article(node) and self.below[node] >= enough and self.density(node) < LINK_DENSITY
                elif tags[node] == "h1":
                    like = True
                elif tags[node] in HEADS or tags[node] == "p":
                    like = parents[at] == parents[kept[0]] and self.density(node) < LINK_DENSITY
                else:
                    like = owners[node] == node and self.below[node] >= enough and self.density(node) < LINK_DENSITY
                if like:
                    kept.append(node)
            at = parents[at]
        return kept


def main_text(html: str | None) -> str:
    """The main text of one page, its blocks joined by one space; empty if there is none."""
    tree = read(html or "")
    page = Scored(tree)
    kept = [False] * len(tree.tags)
    for node in page.roots():
        kept[node] = True
    for node in range(1, len(kept)):
        kept[node] = (kept[node] or kept[tree.parents[node]]) and not page.gone[node]
    return " ".join("".join(text for node, text, _ in tree.runs if node < 0 or kept[node]).split())


def main_texts(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` without ``html``, and ``into``: the article of each page, from the whole of it.

    Each page is read and scored by itself, in its partition, a few at a time; nothing is
    shuffled. Paragraphs score for length and commas, less their share of links, and pass
    that on to the elements around them; the best element counts, or the article or main element
    that it is in, with siblings that have a fifth of its points and few links. Menus, headers,
    footers, sidebars, notices, adverts, forms, scripts and reader comments are known by their
    tags, roles, names, or by being lists of links, and go, unless they hold most of the
    page's points and its first heading or article. References are decoded; white space, also
    between blocks, becomes one space.

    A null or empty page, and one without text, has an empty text. Repeated rows and null ids
    are rows like others; other columns are kept as they are, but for one named ``into``, which
    is replaced; an empty table gives no rows.
    """
    others = [c for c in pages.columns if c not in (html, into)]
    # what the rows carry has names of its own: theirs may be any
    rows = pages.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)), F.col(html).cast("string").alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "html"):
                found = pa.array([main_text(page) for page in piece.column(len(others)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], found], names=[*piece.schema.names[:-1], "text"])

    kind = StructType([StructField(f"c{i}", pages.schema[c].dataType) for i, c in enumerate(others)]).add("text", StringType())
    out = rows.mapInArrow(extract, kind)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(others)), F.col("text").alias(into))
