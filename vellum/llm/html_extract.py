"""HTML extraction by gradient-boosted trees over DOM nodes.

A page is parsed to block elements and text blocks.  Each node has features:
its kind, tokens of its attributes and of those above it, depth, density of
text and links in its subtree, and how it stands among its siblings.  Boosted
trees give the probability that a node holds a part of the main text, and
a dynamic program over the tree picks the likeliest labelling in which nothing
below a dropped node is kept, and a node that is kept has all above it kept.

No page of the corpus says what its main text is, so the trees are trained on
pages that ``make_page`` builds from random layouts (``TRAINING`` of them, with
a fixed seed), whose parts are known; half of those layouts have no telling
tags or class names.

A null or an empty page has no text and no characters.  Pages are independent
of each other, so equal pages have equal texts, and repeated, null and great ids
are kept; nodes may be as deep as a page makes them.  An empty table gives an
empty one; further columns are ignored, whatever they are called.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import boosting
from vellum.llm.common import small_batches, texts

#: Pages that the trees are trained on, and the seed of their layouts.
TRAINING, SEED = 400, 6

# A quoted value counts only behind an equals sign, if it is closed before the next "<" or in front of a blank or the tag's end; a tag that another one cuts short ends there.
# No part is tried twice, so a page of any signs is read in a time in proportion to its length.
_QUOTED = r"""=\s*+(?:"[^"<]*+"|'[^'<]*+'|"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>]))"""
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<!(?!--)[^>]*+>?|<\?[^>]*+>?|</[a-zA-Z][^<>]*+>?|<[a-zA-Z](?:[^<>="']|{_QUOTED}|[="'])*+>?""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*")

#: Elements without content, elements whose content isn't markup, elements that never hold text of an article, and elements in a line of text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title svg xmp object".split())
_NEVER = frozenset("head script style noscript template iframe textarea title svg select option button canvas audio video object datalist dialog".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that may stand in a head; any other one ends it, as text does.
_IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Start tags that end an open element of the same group, up to one of its holders.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}

_KINDS = ("article", "main", "p", "h", "nav", "header", "footer", "aside", "form", "list", "li", "div", "section", "table", "quote", "figure", "text")
_KIND_OF = {"h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "ul": "list", "ol": "list", "dl": "list", "menu": "nav", "blockquote": "quote", "pre": "quote", "tr": "table", "td": "table", "th": "table", "tbody": "table", "figcaption": "figure", "fieldset": "form", "dt": "li", "dd": "li", "#": "text"}
#: Tokens of class names and ids, by what they tell.
_TOKENS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs tabs toc pagination pager",
    "edge": "footer foot copyright legal header masthead topbar banner logo",
    "side": "sidebar side aside widget rail related recommended more popular trending tags",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion commercial",
    "notice": "cookie cookies consent gdpr notice alert popup modal subscribe newsletter signup paywall disclaimer",
    "talk": "comment comments reply replies respond disqus discussion reviews feedback",
    "share": "share social follow like buttons author byline meta date search form login",
    "text": "article content post entry main body story text prose page",
}
_GROUPS = tuple(_TOKENS)
_GROUP_OF = {w: i for i, g in enumerate(_GROUPS) for w in _TOKENS[g].split()}


@dataclass
class Node:
    """An element, or a block of text (tag ``#``)."""

    tag: str
    groups: int = 0
    children: list = field(default_factory=list)
    text: str = ""
    link: int = 0
    keep: bool = False


def _own_end(page: str, at: int, name: str) -> re.Match | None:
    """The end tag that comes before another start tag of that name, as after ``<script src="x"/>`` in plain HTML."""
    m = re.compile(rf"<(/?){re.escape(name)}(?=[\s/>]|$)", re.I).search(page, at)
    return m if m and m.group(1) else None


def parse(page: str) -> Node:
    """The tree of block elements; text and inline elements between them become text blocks."""
    root = Node("#root")
    stack, run, links = [root], [], 0
    # names of all open elements, and how often each is open
    names, held = [root.tag], Counter()
    open_link = 0

    def flush() -> None:
        nonlocal run, links
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                stack[-1].children.append(Node("#", text=text, link=min(links, len(text))))
            run, links = [], 0

    def close(to: int) -> None:
        flush()
        held.subtract(names[to:])
        del stack[to:], names[to:]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None or m.start() > at:
            piece = page[at : m.start() if m else n]
            if names[-1] == "head" and piece.strip():
                close(len(names) - 1)
            run.append(piece)
            if open_link:
                links += len(piece)
        if m is None:
            break
        at, token = m.end(), m.group()
        if token[1] in "!?":
            continue
        name = _NAME.match(token).group(1).lower()
        if token[1] == "/":
            if name == "a":
                open_link = 0
            if name in _INLINE:
                continue
            for i in range(len(names) - 1, 0, -1) if held[name] else ():
                if names[i] == name:
                    close(i)
                    break
            continue
        if names[-1] == "head" and name not in _IN_HEAD:
            close(len(names) - 1)
        if name in _INLINE:
            if name == "br":
                run.append(" ")
            elif name == "a":
                open_link = 1
            continue
        flush()
        if name in _VOID:
            continue
        if name in _RAW:
            if token.endswith("/>") and (name == "svg" or _own_end(page, at, name) is None):
                continue
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|$)|</{re.escape(name)}\s[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if len(names) > 1:
            if names[-1] == "p" or (names[-1][0] == "h" and names[-1][1:].isdigit() and name[0] == "h" and name[1:].isdigit()):
                close(len(names) - 1)
            elif name in _ENDS:
                own, holders = _ENDS[name]
                for i in range(len(names) - 1, 0, -1) if any(held[o] for o in own) else ():
                    if names[i] in holders:
                        break
                    if names[i] in own:
                        close(i)
                        break
        groups = 0
        if "=" in token:
            for value in _ATTRIBUTES.findall(token):
                for w in _WORD.findall(value):
                    g = _GROUP_OF.get(w.lower())
                    if g is not None:
                        groups |= 1 << g
        node = Node(name, groups)
        stack[-1].children.append(node)
        # in HTML, a slash at its end doesn't close an element
        stack.append(node)
        names.append(name)
        held[name] += 1
    flush()
    return root


N_FEATURES = len(_KINDS) + 2 * len(_GROUPS) + 6 + 21
_KIND_AT = {k: i for i, k in enumerate(_KINDS)}
_ABOVE = {"nav": 0, "header": 1, "footer": 2, "aside": 3, "form": 4, "article": 5, "main": 5}


def _level(tag: str) -> int:
    """6 for a title of the first rank down to 1, 0 for other elements."""
    return 7 - int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" else 0


def vectors(root: Node) -> tuple[list[Node], list[int], np.ndarray]:
    """All nodes below the root in page order, the place of each one's parent (-1: the root), and their features."""
    nodes: list[Node] = []
    parents: list[int] = []
    facts: list[list] = []  # depth, groups above, kinds above, place among siblings, number of siblings

    stack = [(c, -1, 1, 0, 0, i, len(root.children)) for i, c in reversed(list(enumerate(root.children)))]
    while stack:
        node, parent, depth, above, kinds, place, n = stack.pop()
        me = len(nodes)
        nodes.append(node)
        parents.append(parent)
        facts.append([depth, above, kinds, place, n])
        if node.tag in _ABOVE:
            kinds |= 1 << _ABOVE[node.tag]
        if node.tag not in _NEVER:
            k = len(node.children)
            stack += [(c, me, depth + 1, above | node.groups, kinds, i, k) for i, c in reversed(list(enumerate(node.children)))]
    count = len(nodes)
    # subtree: characters, characters of links, elements, text blocks, paragraphs, stops, longest block
    sums = np.zeros((count, 7))
    for i in range(count - 1, -1, -1):
        node, row = nodes[i], sums[i]
        if node.tag == "#":
            size = len(node.text)
            row += (size, node.link, 0, 1, 0, node.text.count(".") + node.text.count(","), 0)
            row[6] = size
        else:
            row[2] += 1
            row[4] += node.tag == "p"
        if parents[i] >= 0:
            up = sums[parents[i]]
            up[:6] += row[:6]
            up[6] = max(up[6], row[6])
    x = np.zeros((count, N_FEATURES), np.float32)
    total = max(1.0, sum(sums[i, 0] for i in range(count) if parents[i] < 0))
    blocks = max(1.0, sum(sums[i, 3] for i in range(count) if parents[i] < 0))
    seen = 0.0
    of_parent: dict[int, list[int]] = {}
    for i, p in enumerate(parents):
        of_parent.setdefault(p, []).append(i)
    for p, kids in of_parent.items():
        chars = sums[kids, 0]
        whole, most, same = chars.sum() + 1, chars.max() + 1, {}
        for i in kids:
            same[nodes[i].tag] = same.get(nodes[i].tag, 0) + 1
        for at, i in enumerate(kids):
            x[i, -4:] = chars[at] / whole, chars[at] / most, same[nodes[i].tag] / len(kids), np.log1p(max(chars[at - 1] if at else 0, chars[at + 1] if at + 1 < len(kids) else 0))
    base = len(_KINDS)
    for i, node in enumerate(nodes):
        kind = _KIND_AT.get(_KIND_OF.get(node.tag, node.tag))
        if kind is not None:
            x[i, kind] = 1
        depth, above, kinds, place, n = facts[i]
        if node.groups or above:
            for g in range(len(_GROUPS)):
                x[i, base + g] = node.groups >> g & 1
                x[i, base + len(_GROUPS) + g] = above >> g & 1
        if kinds:
            for g in range(6):
                x[i, base + 2 * len(_GROUPS) + g] = kinds >> g & 1
        chars, linked, elements, texts_, paragraphs, stops, longest = sums[i]
        x[i, base + 2 * len(_GROUPS) + 6 : -4] = (
            depth, place, n, place / n, np.log1p(chars), linked / (chars + 1), np.log1p(elements), np.log1p(texts_), np.log1p(paragraphs), chars / (elements + 1) / 100,
            100 * stops / (chars + 20), np.log1p(longest), chars / total, seen / blocks, np.log1p(chars / (texts_ + 1)), node.tag in _NEVER, _level(nodes[parents[i]].tag if node.tag == "#" and parents[i] >= 0 else node.tag),
        )
        seen += node.tag == "#"
    return nodes, parents, x


def decode(nodes: list[Node], parents: list[int], p: np.ndarray) -> list[bool]:
    """The likeliest labels in which whatever stands below a dropped node is dropped.

    A block of text weighs by its own probability, an element likewise, so a
    strong element can overrule its weak blocks and the other way round.
    """
    n = len(nodes)
    keep, drop = np.log(np.clip(p, 1e-6, 1 - 1e-6)), np.log(np.clip(1 - p, 1e-6, 1 - 1e-6))
    best, none = keep.copy(), drop.copy()
    for i in range(n):
        if nodes[i].tag in _NEVER:
            best[i], none[i] = -1e9, 0.0
    for i in range(n - 1, -1, -1):
        if parents[i] >= 0:
            best[parents[i]] += max(best[i], none[i])
            none[parents[i]] += none[i]
    out = [False] * n
    for i in range(n):
        out[i] = (parents[i] < 0 or out[parents[i]]) and bool(best[i] >= none[i])
    return out


def extract(pages: list[str], model: boosting.Boosted) -> list[str]:
    """The main text of every page; all nodes of the pages go through the trees together."""
    parsed = [vectors(parse(p)) for p in pages]
    sizes = np.cumsum([0] + [len(n) for n, _, _ in parsed])
    if not sizes[-1]:
        return [""] * len(pages)
    p = model.probability(np.concatenate([x for _, _, x in parsed]))
    out = []
    for (nodes, parents, _), a, b in zip(parsed, sizes, sizes[1:], strict=False):
        kept = decode(nodes, parents, p[a:b])
        out.append("\n".join(n.text for n, k in zip(nodes, kept, strict=True) if k and n.tag == "#"))
    return out


def make_page(rng: random.Random) -> str:
    """A page of a random layout.  Parts of its main text carry the mark ``\\x01``."""
    plain = rng.random() < 0.5  # no telling tags or names

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiouéä") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        out = " ".join(words(2, 14).capitalize() + rng.choice(".,.!!") for _ in range(rng.randint(a, b)))
        return out.upper() if rng.random() < 0.05 else out

    def mark(x: str) -> str:
        return "\x01" + x

    def box(tag: str, names: str, inside: str) -> str:
        name = rng.choice(names.split())
        if plain or rng.random() < 0.3:
            return f"<div>{inside}</div>" if plain and rng.random() < 0.7 else f"<{tag}>{inside}</{tag}>"
        attr = rng.choice([f' class="{name}"', f' id="{name}"', f' class="x{rng.randint(1, 9)} {name}-box"', ""])
        return f"<{rng.choice([tag, 'div']) if attr else tag}{attr}>{inside}</{tag}>" if not attr else f"<div{attr}>{inside}</div>" if rng.random() < 0.5 else f"<{tag}{attr}>{inside}</{tag}>"

    def links(a: int, b: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(rng.randint(a, b))) + "</ul>"

    def paragraph(text: str) -> str:
        style = rng.random()
        if style < 0.05:
            return f'<p><a href="/{rng.randint(1, 99)}">{text}</a></p>'
        if style < 0.15:
            return f"<p><b>{text}<br>"
        if style < 0.3:
            return f"<p>{text}"
        if style < 0.4:
            return f'<p>{text} <a href="#">{words(1, 3)}</a> {words(1, 5)}</p>'
        return f"<p>{text}</p>"

    def body() -> str:
        parts = [f"<h1>{mark(words(1, 12))}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14, 25])):
            r = rng.random()
            if r < 0.08:
                parts.append(f"<h2>{mark(words(1, 6))}</h2>")
            elif r < 0.13:
                parts.append("<ul>" + "".join(f"<li>{mark(sentences(1, 1))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif r < 0.17:
                parts.append(f"<blockquote>{paragraph(mark(sentences(1, 3)))}</blockquote>")
            elif r < 0.2:
                parts.append("<table>" + "".join(f"<tr><td>{mark(words(1, 3))}</td><td>{mark(words(1, 3))}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif r < 0.23:
                parts.append(box("aside", "ad advert related promo sponsored", f"<p>{sentences(1, 2)}</p>"))
            elif r < 0.31:
                parts.append(paragraph(mark(words(1, 5) + rng.choice([".", "", "!"]))))
            elif r < 0.34:
                parts.append(f'<p>{mark(words(1, 2))} <a href="/{rng.randint(1, 99)}">{words(1, 3)}</a></p>')
            else:
                parts.append(paragraph(mark(sentences(1, rng.choice([1, 2, 4, 10])))))
        return "".join(parts)

    article = body()
    bare = rng.random()
    if bare < 0.2:  # no wrapper: the text stands among the page's other parts
        pass
    elif not plain and rng.random() < 0.8:
        article = f"<article>{article}</article>"
    else:
        article = f'<div class="{rng.choice("content post-body entry-content main story x1".split())}">{article}</div>' if not plain else f"<div>{article}</div>"
    if bare < 0.1:  # nothing but the text, or hardly a page
        return article if bare < 0.03 else f"<html><body>{article}</body></html>" if bare < 0.07 else f"<html><head><title>{words(2, 5)}</title></head><body><div>{article}</div></body></html>"
    if rng.random() < 0.3 and bare >= 0.2:
        article = f"<main>{article}</main>" if not plain else f"<div>{article}</div>"
    head = [box("nav", "nav menu navbar navigation", links(3, 8))] if rng.random() < 0.9 else []
    if rng.random() < 0.4:
        name = words(1, 4) if rng.random() < 0.8 else f"<h1>{words(1, 3)}</h1>"
        head.append(box("header", "header masthead banner topbar", f"{name} <a href='/'>{words(1, 2)}</a>"))
    if rng.random() < 0.5:
        ad = f'<div class="{rng.choice("ad ads advert promo sponsored".split())}">{sentences(1, 2)}</div>'
        head.append(ad)
    if rng.random() < 0.3:
        head.append(box("div", "cookie-notice consent alert notice popup", f"<p>{sentences(1, 2)}</p><a href='#'>{words(1, 2)}</a>"))
    tail = []
    if rng.random() < 0.4:
        tail.append(box("aside", "sidebar widget related rail", f"<h3>{words(1, 3)}</h3>{links(2, 6)}"))
    if rng.random() < 0.35:
        tail.append(box("section", "comments comment-list replies discussion", f"<h3>{words(1, 2)}</h3>" + "".join(f"<div class='comment'><p>{words(1, 2)}</p><p>{sentences(1, 3)}</p></div>" for _ in range(rng.randint(1, 6)))))
    if rng.random() < 0.3:
        tail.append(f"<form><label>{words(1, 3)}</label><input><p>{words(3, 10)}</p></form>")
    if rng.random() < 0.2:
        tail.append(box("div", "newsletter subscribe signup share social", f"<p>{sentences(1, 1)}</p>"))
    foot = box("footer", "footer copyright legal", f"&copy; {words(1, 3)} &middot; {sentences(1, 2)}") if rng.random() < 0.9 else ""
    rng.shuffle(head)
    rng.shuffle(tail)
    inside = "".join(head) + article + "".join(tail)
    if rng.random() < 0.3:
        inside = f"<div>{inside}</div>"
    return f"<html><head><title>{words(2, 5)}</title></head><body>{inside}{foot}</body></html>"


@lru_cache(maxsize=1)
def trained(pages: int = TRAINING, seed: int = SEED) -> boosting.Boosted:
    """The trees, fitted to the nodes of made pages: a node counts as text if a marked block stands in it."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes, parents, _ = vectors(parse(make_page(rng)))
        good = np.zeros(len(nodes))
        for i in range(len(nodes) - 1, -1, -1):
            if nodes[i].tag == "#":
                good[i] = "\x01" in nodes[i].text
                nodes[i].text = nodes[i].text.replace("\x01", "")
            if good[i] and parents[i] >= 0:
                good[parents[i]] = 1
        root = Node("#root", children=[n for n, p in zip(nodes, parents, strict=True) if p < 0])
        xs.append(vectors(root)[2])
        ys.append(good)
    return boosting.fit(np.concatenate(xs), np.concatenate(ys))


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url``, ``text`` and ``n_chars`` (code points) for every page."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("text string, n_chars long")
    def rows(batch: pd.Series) -> pd.DataFrame:
        out = extract(list(texts(batch)), held.value)
        return pd.DataFrame({"text": out, "n_chars": [len(t) for t in out]})

    # ids stay in Spark: pandas would make floats of a batch's ids where one is null
    return df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), rows(F.col(html_col)).alias("_row")).select(F.col("_id").cast("long").alias(id_col), F.col("_url").alias(url_col), "_row.*")
