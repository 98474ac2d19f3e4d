"""HTML to a tree of blocks with features; tolerant of unclosed and misplaced tags."""

from __future__ import annotations

import math
import re
from html import unescape

# Element names by their part in a page, after the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template title svg annotation annotation-xml iframe object canvas audio video head select option textarea".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}
SCOPES = frozenset("ul ol dl table body article section main div nav aside footer header form blockquote".split())
TAGS = "article main section div p h1 h2 h3 ul ol li nav header footer aside form table blockquote pre figure #text".split()
#: Families of tokens in class, id and role (fixed values).
FAMILIES = [frozenset(x.split()) for x in (
    "article content post entry story main body text maincontent articlebody postbody prose",
    "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc tabs",
    "header masthead banner top topbar brand logo hero",
    "footer bottom copyright legal colophon imprint foot",
    "sidebar side widget aside rail secondary complementary",
    "ad ads advert advertisement adverts sponsor sponsored promo promotion banner adsense commercial",
    "cookie cookies consent notice alert gdpr newsletter subscribe privacy warning message popup modal overlay toast",
    "comment comments reply replies disqus discussion respond reader readers feedback",
    "share social sharing follow buttons tools",
    "related recommended recommendations more popular trending teaser",
    "form search login signup register contact input",
)]
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-label)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_BUTTON = re.compile("</button", re.I)
_PART = re.compile(r"[a-z]+")
_SPACE = " \t\n\r\f\v"


class Node:
    __slots__ = ("attributes", "chars", "children", "elements", "families", "headings", "inputs", "links", "own", "paragraphs", "parent", "punctuation", "start", "state", "tag")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.attributes, self.own = attributes, None
        self.chars = self.links = self.elements = self.paragraphs = self.punctuation = self.headings = self.inputs = 0
        self.start, self.state = 0, ""
        self.families = ()


def parse(html: str) -> Node:
    """The body's tree. Leaves ``#text`` hold a block's text: what stands between block tags."""
    root = node = Node("body", None)
    path = [root]  # the open blocks
    places: dict[str, list[int]] = {}  # of the open blocks in path, by tag
    scopes: list[int] = []
    pos, links = 0, 0
    held: list[str] = []  # of the block at hand
    linked = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                leaf = Node("#text", node)
                leaf.own, leaf.links = text, min(linked, len(text))
                node.children.append(leaf)
            held.clear()
        linked = 0

    def innermost(tags) -> int:
        """Place of the innermost open block with one of the tags, 0 if there is none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(place: int) -> Node:
        """Close the blocks from that place on; the one that stays open."""
        while len(path) > place:
            x = path.pop()
            places[x.tag].pop()
            if x.tag in SCOPES:
                scopes.pop()
        return path[-1]

    size = len(html)
    while pos < size:
        found = _TOKEN.search(html, pos)
        end = found.start() if found else size
        if end > pos:
            held.append(html[pos:end])
            if links:
                linked += end - pos
        if not found:
            break
        pos = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        closing = bool(found[1])
        if tag in HIDDEN and tag != "head":
            if not closing and not found[3].endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, pos)
                pos = stop.end() if stop else (size if tag in ("script", "style", "textarea", "title") else pos)
                if tag in ("select", "textarea"):
                    node.inputs += 1
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                held.append(" ")
            continue
        if tag in ("html", "body", "head"):
            if tag == "body" and not closing and found[3]:
                root.attributes = found[3]
            continue
        if tag in ("input", "button", "label"):
            node.inputs += 1
            if tag == "button" and not closing:
                stop = _BUTTON.search(html, pos)
                pos = stop.start() if stop else pos
            continue
        flush()
        links = 0
        if tag in VOID:
            continue
        if closing:
            place = innermost((tag,))
            bound = innermost(("article", "main")) if tag in ("p", "div", "li", "ul") else 0
            if place > bound:
                node = close(place)
            continue
        if tag in CLOSES_P and node.tag == "p":
            node = close(len(path) - 1)
        if tag in SAME:
            place = innermost(SAME[tag])
            if place > (scopes[-1] if scopes else 0):
                node = close(place)
        if found[3].endswith("/"):
            continue
        child = Node(tag, node, found[3])
        node.children.append(child)
        places.setdefault(tag, []).append(len(path))
        if tag in SCOPES:
            scopes.append(len(path))
        path.append(child)
        node = child
    flush()
    return root


def walk(root: Node) -> list[Node]:
    """Nodes in page order, parents first."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(reversed(x.children))
    return out


def measure(nodes: list[Node]) -> None:
    at = 0
    for x in nodes:
        x.start = at
        if x.own is not None:
            x.chars = len(x.own)
            at += x.chars
            x.punctuation = sum(map(x.own.count, ".,;:?!"))
        words = set()
        for name, *values in _ATTRIBUTE.findall(x.attributes) if x.attributes else ():
            words.update(_PART.findall((name + " " if name.lower() == "hidden" else "") + "".join(values).lower()))
        x.families = tuple(bool(words & f) for f in FAMILIES) if words else NONE
    for x in reversed(nodes):
        p = x.parent
        if p is not None:
            p.chars += x.chars
            p.links += x.links
            p.punctuation += x.punctuation
            p.elements += x.elements + 1
            p.paragraphs += x.paragraphs + (x.tag == "p")
            p.headings += x.headings + (x.tag[0] == "h" and x.tag[1:].isdigit())
            p.inputs += x.inputs + (x.tag == "form")


NONE = (False,) * len(FAMILIES)
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
ABOVE = ("article", "main", "nav", "footer", "aside", "header", "form")
N_FEATURES = len(TAGS) + 2 * len(FAMILIES) + len(ABOVE) + 22
#: Whether a family or element speaks against an article: all but the first family, all but the first two elements.
_AGAINST, _AGAINST_TAGS = slice(1, None), frozenset(ABOVE[2:])


def features(nodes: list[Node]) -> list[list[float]]:
    """A row of N_FEATURES numbers per node; call ``measure`` first.

    Depth counts the ancestors that have text in two children or more: wrappers around wrappers, however
    many, are no deeper than one.
    """
    log = math.log1p
    total = max(1, nodes[0].chars)
    above: dict[int, tuple] = {id(nodes[0]): (0, NONE, (False,) * len(ABOVE))}
    rows = []
    for x in nodes:
        depth, families, tags = above[id(x)]
        kids = x.children
        if kids:
            below = (depth + (sum(k.chars > 0 for k in kids) > 1), tuple(a or b for a, b in zip(families, x.families, strict=True)) if any(x.families) else families, tuple(a or x.tag == t for a, t in zip(tags, ABOVE, strict=True)) if x.tag in ABOVE else tags)
            n = len(kids)
            for i, k in enumerate(kids):
                above[id(k)] = below
                k.state = (i, n, kids[i - 1].chars if i else 0, kids[i + 1].chars if i + 1 < n else 0)
        i, n, before, after = x.state or (0, 1, 0, 0)
        one_hot = [0.0] * len(TAGS)
        if x.tag in _TAG_AT:
            one_hot[_TAG_AT[x.tag]] = 1.0
        chars = max(1, x.chars)
        parent = x.parent.chars if x.parent is not None else x.chars
        marked = any(families[_AGAINST]) or any(tags[2:])
        marks = (float(marked or any(x.families[_AGAINST]) or x.tag in _AGAINST_TAGS), float(marked))
        rows.append([*marks, *one_hot, *x.families, *families, *tags, depth, log(x.chars), x.chars / total, x.links / chars, log(x.elements), log(x.chars / (x.elements + 1)), log(x.paragraphs), x.punctuation / chars, n, i / n, i, log(before), log(after), x.chars / max(1, parent), log(x.inputs), log(x.headings), x.start / total, (x.start + x.chars) / total, log(total), float(x.chars == 0)])
    return rows
