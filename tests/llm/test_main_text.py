"""Pages with a known article, broken markup, and the scoring against a version that walks subtrees anew."""

import random
import re
from html import escape, unescape

import pytest

from ledgerline.llm import main_text as M
from ledgerline.llm.main_text import Scored, main_text, main_texts
from ledgerline.llm.page_tree import HEADS, read

A = "It was, as they said, a long day in the valley, and nobody, not even the old ones, knew why the river rose."
B = "The water came up to the second step, then stopped. Many left, some stayed, and a few, it is said, sang."
C = "By the evening it was over, and the boats lay in the streets, quiet, as if they had always been there."
LONG = "<p>I think this is wrong, all of it, and I said so before, many times, in this very place.</p>" * 9
MENU = '<ul>' + ''.join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(6)) + '</ul>'
BODY = f"<h1>The river</h1><p>{A}</p><p>{B}</p><p>{C}</p>"
TEXT = f"The river {A} {B} {C}"


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title><style>p{{}}</style></head><body><nav>{MENU}</nav><article>{BODY}</article><footer>f</footer></body></html>",
    f"<header><h2>Site name</h2>{MENU}</header><main>{BODY}</main><aside><p>{B}</p></aside><footer><p>{C}</p></footer>",
    f'<div id="wrapper"><div class="site-header"><p>{C}</p></div><div id="content">{BODY}</div><div class="sidebar">{LONG}</div></div>',
    f'<div id="page" class="with-sidebar"><div class="post">{BODY}</div><div id="comments">{LONG}{LONG}</div></div>',
    f'<article>{BODY}<section class="comments"><h2>Comments</h2><article>{LONG}</article></section></article>',
    f'<article>{BODY}</article><section id="disqus_thread">{LONG}{LONG}</section>',
    f'<div class="cookie-notice"><p>{A}</p></div><div>{BODY}</div>',
    f'<div role="dialog"><p>We use cookies, and you, dear reader, must agree.</p></div><article><div class="ad-slot">{LONG}</div>{BODY}</article>',
    f'<article><header><h1>The river</h1></header><p>{A}</p><div class="advertisement"><p>Buy, buy, buy!</p></div><p>{B}</p><p>{C}</p><footer>By me</footer></article>',
    f'<article><h1>The river</h1><div><p>{A}</p></div><div><p>{B}</p></div><div><p>{C}</p></div></article><div><p>x</p></div>',
    f'<form id="aspnetForm"><div class="topnav">{MENU}</div><article>{BODY}</article><input value="x"></form>',
    f'<table><tr><td class="leftmenu">{MENU}</td><td>{BODY}</td></tr></table>',
    f'<body><h1>The river</h1>{A}<br><br>{B}<br>{C}<script>var a = "<p>no</p>";</script><!-- <p>no</p> --></body>',
    f'<article>{BODY}<ul class="share"><li>Share</li></ul><div>{MENU}</div></article>',
    f'<article>{BODY}<form><p>Your name, your mail, your words.</p><textarea>{A}</textarea><button>Send</button></form></article>',
    f'<div class="newsletter"><p>{A}</p></div><div itemprop="articleBody">{BODY}</div><div class="related"><p>{A}</p></div>',
    f'<div><div><h1>The river</h1><div><p>{A}</p><p>{B}</p><p>{C}</p></div></div></div>',
    f'<main><article><h1>The river</h1><p>{A}</p></article><article><p>{B}</p></article><article><p>{C}</p></article></main>',
    f'<main><div class="lead">{MENU}</div><article>{BODY}</article><div><p>Elsewhere, much the same was said, and more.</p></div></main>',
    f'<noscript><p>{A}</p></noscript><main><article>{BODY}</article><article class="teaser"><p>Next, <a href="/x">more</a></p></article></main>',
])
def test_article_alone(page):
    assert main_text(page) == TEXT


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), (" \n ", ""), ("<p>", ""), ("just text", "just text"), ("a < b &amp; c &lt; d", "a < b & c < d"),
    ("<article>Er.</article>", "Er."), ("<article><h1>Only a title</h1></article><nav>x</nav>", "Only a title"),
    ("<article><p>One<p>two <b>bo<i>ld</b>er</i><p>three", "One two bolder three"),
    ("<article><p><b>Open<br><p>next</p></article>tail", "Open next"),
    ("<article>a<!-- x --> b<!-->c<!--->d<!-- never closed <p>e</p>", "a bcd"),
    ("<article>a<script>if (a < b) '</p>'</SCRIPT >b<style>p{}</style>c<script>never closed", "abc"),
    ("<article><p>&eacute;&#233;&#xe9;&amp;lt;&nbsp;&copy&notin; &bogus; &am</p></article>", "ééé&lt; ©∉ &bogus; &am"),
    ("<article><p title='a > b' data-x=\"</p>\">x</p><p class=a/b>y</p ></article>", "x y"),
    ("<article><p>kept</p><p title=\"never closed>lost</p></article>", "kept"),
    ("<article><p>kept</p><foot", "kept"), ("<article>1 <2 3<4</article>", "1 <2 3<4"),
    ("<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul><dl><dt>e<dd>f<dt>g</dl></article>", "a b c d e f g"),
    ("<article><table><tr><td>a<td>b<tr><th>c</table>d</article>", "a b c d"),
    ("<article><div>a</span></p>b</section>c</div>d</article>", "abc d"),
    ("<article><p>x y  z\r\n\tw</p></article>", "x y z w"),
    ("<article><svg><title>t</title><path/></svg><math><mi>x</mi></math></article>", "x"),
    ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"), ("<?xml version='1'?><!DOCTYPE html><article>a</></ b>c</article>", "ac"),
])
def test_markup_as_browsers_read_it(page, text):
    assert main_text(page) == text


def test_traps_take_linear_time():
    many = 60_000
    for page in ("<div>" * many + "x", "<header>" * many + "x", "<b>" * many + "<p>" * many + "x", "<a x=\"" * many,
                 "<!--" * many, "</i>" * many + "x", "<p><table>" + "<b>" * many + "<p></p>" * 100, "<script>" * many,
                 "<ul><li>" * many + "x", "&amp;" * many, "<p>" + "w, " * 400_000):
        assert len(main_text(page)) <= len(page)


# -- scoring anew ----------------------------------------------------------------------------

TAGS = ["div", "div", "section", "article", "main", "p", "p", "p", "ul", "span", "h1", "h2", "nav", "aside", "footer", "header", "form", "table"]
NAMES = ["", "", "", "", "content", "ad-slot", "sidebar", "comments", "post entry", "related", "x", "articleHeader", "site-header", "menu"]


def made(pick, depth=0):
    """A random well-formed piece of a page."""
    tag = pick.choice(TAGS if depth < 4 else ["p"])
    name = pick.choice(NAMES)
    words = " ".join(pick.choice(["w", "long, word", "&amp;", "é,", "etc."]) for _ in range(pick.choice([0, 2, 9, 60])))
    if tag in ("p", "h1", "h2", "span"):
        inner = words
    elif tag == "ul":
        inner = "".join(f"<li><a href='/'>{w}</a></li>" if pick.random() < 0.7 else f"<li>{w}, {w}</li>" for w in ["one", "two", "three", "four"][:pick.randrange(5)])
    elif tag == "table":
        inner = f"<tr><td>{made(pick, depth + 1)}</td><td>{words}</td></tr>"
    else:
        inner = (words if pick.random() < 0.2 else "") + "".join(made(pick, depth + 1) for _ in range(pick.randrange(4)))
    if pick.random() < 0.1:
        inner = f"<a href='/'>{escape(words)}</a>" + inner
    return f"<{tag} class='{name}'>{inner}</{tag}>"


class Node:
    def __init__(self, tag, name, above):
        self.tag, self.names, self.above, self.parts, self.gone = tag, re.findall(r"[A-Z]?[a-z]+", name), above, [], False
        self.names = [n.lower() for n in self.names]

    def below(self):
        yield self
        for part in self.parts:
            if isinstance(part, Node):
                yield from part.below()

    def up(self):
        return [self, *self.above.up()] if self.above else [self]

    block = property(lambda self: self.tag not in ("a", "span"))


def parsed(page):
    root = at = Node("body", "", None)
    for end, tag, attributes, text in re.findall(r"<(/?)(\w+)([^>]*)>|([^<]+)", page):
        if text:
            at.parts.append(unescape(text))
        elif end:
            at = at.above
        else:
            node = Node(tag, (re.findall("class='(.*)'", attributes) or [""])[0], at)
            at.parts.append(node)
            at = node
    return root


def texts(node, own=False):
    """(text, in a link) of what is not gone below; ``own``: not in blocks below."""
    for part in node.parts:
        if isinstance(part, str):
            yield part, any(n.tag == "a" for n in node.up())
        elif not part.gone and not (own and part.block):
            yield from texts(part, own)


def size(node, own=False, links=False):
    return sum(len("".join(t.split())) for t, link in texts(node, own) if link or not links)


def density(node, own=False):
    return size(node, own, True) / size(node, own) if size(node, own) else 0.0


def own_points(node):
    n = size(node, True)
    if not n or not node.block or node.tag in HEADS or node.gone:
        return 0.0
    commas = sum(t.count(",") for t, _ in texts(node, True))
    return (min(1.0, n / 25) + commas + min(3.0, n / 100)) * (1 - density(node, True))


def points(node):
    return sum(own_points(n) for n in node.below() if not any(u.gone for u in n.up()))


def article(node):
    return node.tag in ("article", "main") and not any(M._REMARK.fullmatch(n) for n in node.names)


def brute_text(page):
    root = parsed(page)
    every = list(root.below())
    for node in every:
        node.gone = any(u.tag in M._ASIDE for u in node.up())
    first = {n: any(b.tag in ("h1", "main") and not b.gone for b in n.below()) for n in every}
    nested = {n: any(u.tag == "article" and article(u) for u in n.up()[1:]) for n in every}
    outer = {n for n in every if article(n) and not n.gone and not nested[n]}
    holds = {n: first[n] or not any(M._REMARK.fullmatch(w) for w in n.names) and any(b in outer for b in n.below()) for n in every}
    heads = {n: any(b.tag in HEADS for b in n.below()) for n in every}
    total, worth = points(root), {n: points(n) for n in every}
    links = {n: sum(b.tag == "a" and not b.gone for b in n.below()) for n in every}
    dense = {n: density(n) for n in every}
    for node in every[1:]:
        inside = any(article(u) for u in node.up()[1:])
        if node.above.gone or node.gone:
            node.gone = True
        elif holds[node] and 2 * worth[node] >= total and node.tag != "header":
            pass
        elif (node.tag == "header" or "header" in node.names) and heads[node] and (
                inside or any(M._WANTED.fullmatch(n) for n in node.names)):
            pass
        else:
            node.gone = (
                node.tag in ("form", "header") or any(M._JUNK.fullmatch(n) for n in node.names)
                or node.tag == "article" and nested[node]
                or node.block and node.tag not in HEADS and node.tag != "p" and links[node] >= 3 and dense[node] >= 0.8)
    found = {}
    for node in every:
        if own_points(node):
            chain = [u for u in node.up() if u.block]
            chain = chain if node.tag in M._CONTAINERS else chain[1:]
            for share, above in zip(M.SHARES, chain):
                found[above] = found.get(above, 0.0) + share * own_points(node)
    for node in found:
        named = article(node) or any(M._WANTED.fullmatch(n) for n in node.names)
        found[node] = (found[node] + 25 * named) * (1 - density(node))
    best = max(found, key=found.get) if found else next((n for n in every if article(n) and not n.gone), root)
    around = [u for u in best.up() if article(u)]
    around = [u for u in around if u.tag == "article"] or around
    best = around[-1] if around else best
    kept, at = {best}, best
    while at.above:
        for node in (p for p in at.above.parts if isinstance(p, Node) and p is not at and not p.gone and size(p)):
            like = points(node) >= 0.2 * points(best) and density(node) < 0.25
            if around:
                like = like and article(node)
            elif node.tag == "h1":
                like = True
            elif node.tag in HEADS or node.tag == "p":
                like = at is best and density(node) < 0.25
            else:
                like = like and node.block
            if like:
                kept.add(node)
        at = at.above

    def said(node, on):
        on = (on or node in kept) and not node.gone
        edge = " " if node.block else ""
        return edge + "".join((p if on else "") if isinstance(p, str) else said(p, on) for p in node.parts) + edge

    return " ".join(said(root, False).split())


def test_scoring_against_subtrees_walked_anew():
    pick = random.Random(4)
    different = 0
    for _ in range(400):
        page = "".join(made(pick) for _ in range(pick.randrange(1, 5)))
        if re.search(r"<p[^>]*>[^<]*<(?!a|/)", page):
            continue
        found, want = main_text(page), brute_text(page)
        assert found == want, page
        different += 0 < len(found) < len(" ".join(unescape(re.sub("<[^>]*>", " ", page)).split()))
    assert different > 150


def test_points_fall_with_links_and_rise_with_commas():
    def points_of(inner):
        page = Scored(read(f"<div>{inner}</div>"))
        return page.scores().get(1, 0.0)

    assert points_of(f"<p>{A}</p>") > points_of(f"<p>{A.replace(',', '')}</p>") > points_of("<p>short</p>") > 0
    assert points_of(f"<p><a href=''>{A}</a></p>") == 0


# -- tables -----------------------------------------------------------------------------------

def test_tables(spark, folder):
    kind = "page_id long, url string, html string, c0 string, text string, c1 struct<a:int>"
    page = f"<nav>{MENU}</nav><article>{BODY}</article>"
    rows = [(1, "u", page, "keep", "old", (5,)), (1, "u", page, "keep", "old", (5,)), (None, None, None, None, None, None),
            (2, "v", "", "", "", (None,)), (3, "w", "<article>" + f"<p>{A}</p>" * 20_000 + "</article>", "", "", None)]
    found = main_texts(spark.createDataFrame(rows, kind).repartition(3))
    assert found.columns == ["page_id", "url", "c0", "c1", "text"]
    got = sorted(map(tuple, found.collect()), key=repr)
    want = [(1, "u", "keep", (5,), TEXT)] * 2 + [(None, None, None, None, ""), (2, "v", "", (None,), ""), (3, "w", "", None, " ".join([A] * 20_000))]
    assert got == sorted(want, key=repr)
    assert main_texts(spark.createDataFrame([], kind)).count() == 0
    assert "html" not in main_texts(spark.createDataFrame([(1, "<p>a")], "i int, html string"), into="html").columns[:1]


def test_pages_of_the_folder(spark, folder):
    """The pages' articles hold nothing but headings, paragraphs, bold text and breaks."""
    for r in main_texts(spark.read.parquet(f"{folder}/pages.parquet"), into="found").join(
            spark.read.parquet(f"{folder}/pages.parquet"), "page_id").collect():
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        assert r["found"] == " ".join(unescape(re.sub("</?(p|h1|br)>", " ", re.sub("</?b>", "", inner))).split())
