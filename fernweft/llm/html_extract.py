"""Main text of web pages by scoring the element tree.

Paragraphs pass points for their length and commas to their ancestors, less
the further up; a container's points are discounted by the share of its text
that is in links. The container with most points is kept with those of its
siblings that belong to the article, and its blocks are the text.

Tags and class words that mark menus, comments and the like never decide
alone: what is marked so goes only if the rest of the page holds an article by
its points. Tags and class words that mark an article make its points whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from html import unescape
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

_tag = re.compile(
    r"""<!--.*?(?:-->|\Z) | <!\[CDATA\[.*?(?:\]\]>|\Z) | <[!?][^>]*(?:>|\Z)
      | <(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""",
    re.VERBOSE | re.DOTALL,
)
_attr = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_split = re.compile(r"[^a-z0-9]+")
_notice = re.compile(r"(?:©|\(c\) *\d{4}|copyright (?:©|\(c\)|\d{4}))", re.IGNORECASE)

# Groups of HTML elements.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "map", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
    "var", "wbr",
}
#: Elements without text of the page.
DROPPED = {
    "script", "style", "noscript", "template", "button", "select", "option", "textarea", "input", "iframe", "object", "embed", "svg", "canvas",
    "audio", "video", "map", "noembed", "noframes", "title", "datalist", "head",
}
#: Elements whose tag marks something other than the article.
ASIDE = {"nav", "footer", "aside", "form", "dialog", "menu"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = {"p", "pre", "blockquote", "li", "dd", "dt", "td", "th", "figcaption", *HEADINGS}
#: Elements that hold others and may be menus.
CONTAINERS = {"ul", "ol", "dl", "div", "section", "table", "center"}
#: Characters of a notice of rights at most.
MOST_NOTICE = 200
#: An opening tag of the key closes an open element of the values.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
#: Elements beyond which an implied end does not reach.
SCOPE = {"ul", "ol", "dl", "table", "body", "html", "article", "main", "section", "div", "td", "th", "blockquote", "nav", "footer", "aside"}
#: Words in a class or id that mark something other than the article.
UNLIKELY = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "banner", "sponsor", "sponsored", "promo", "promotion", "nav",
    "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "masthead", "cookie", "cookies", "consent",
    "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "comment", "comments", "commentlist", "disqus", "replies", "reply",
    "respond", "share", "sharing", "social", "related", "recommended", "recommendations", "newsletter", "subscribe", "subscription", "signup",
    "login", "search", "pagination", "pager", "toolbar", "topbar", "widget", "skip", "hidden", "copyright", "announcement", "toast", "lightbox",
    "outbrain", "taboola", "adsense", "adslot", "adunit", "adcontainer", "subnav", "sidenav", "mainmenu", "feedback", "poll",
}
#: Strings that do so within longer words as well.
UNLIKELY_PARTS = ("sidebar", "comment", "cookie", "advert", "newsletter", "breadcrumb", "sponsor", "navbar", "footer", "popup", "disqus", "subscri")
#: Of these, what may carry more than a short article beside it.
BULKY = {"nav", "footer", "aside", "menu", "navigation", "sidebar", "comment", "comments", "commentlist", "disqus", "replies", "reply", "respond", "related", "recommended", "recommendations"}
#: Words that say where or how something is laid out, and not what it is.
LAYOUT = set(
    "area bar block bottom box button buttons col column container content div elem global group header inner item items js layout left line "
    "link links list main module outer page panel primary region right row secondary section site slot text title top unit user wrap wrapper".split()
)
#: Words beside a mark that tell a state of the page: "no-sidebar" is none.
STATES = {"no", "not", "has", "have", "with", "without", "open", "closed", "enabled", "disabled", "on", "off"}
#: Words that mark the article.
OF_ARTICLE = {"post", "article", "entry", "content", "story", "title", "heading", "page"}
#: Those of them that mark its body, not its title or the page.
ARTICLE_BODY = {"post", "article", "entry", "story"}
UNLIKELY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
#: Elements that may stand in a head; any other, or text, ends it.
IN_HEAD = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
#: How far up a paragraph's points go, and their shares.
SHARES = (1.0, 1 / 2, 1 / 6, 1 / 9, 1 / 12)


@dataclass(frozen=True)
class Scoring:
    """Points of a paragraph: ``base``, one for each comma, and one for each
    ``chars_per_point`` characters up to ``most_for_length``. Siblings of the
    best container stay with ``sibling_share`` of its points or as paragraphs;
    ``most_links`` bounds the share of link text in what is kept. What is
    marked as none of the article stays where it has ``marked_share`` of the
    points that it and the unmarked page have; a plain mark, or one of a bulky
    kind, needs a sign of an article in it too, or a page that has no sign and
    no more than ``least_rest`` points without it."""

    base: float = 1.0
    chars_per_point: int = 100
    most_for_length: int = 3
    sibling_share: float = 0.2
    most_links: float = 0.5
    marked_share: float = 0.5
    least_rest: float = 1.0


class Element:
    """``against``: marked as none of the article; ``bulky``: by a mark that
    is plain or of a bulky kind; ``hidden``: not shown; ``likely``: marked as the
    article; ``inside``: an article or main element, or within one."""

    __slots__ = ("name", "parent", "children", "points", "dropped", "links", "chars", "marks", "against", "bulky", "hidden", "likely", "worth", "inside")

    def __init__(self, name: str, parent: Element | None, dropped: bool = False, marks: frozenset[str] = frozenset()):
        self.name, self.parent, self.dropped, self.marks = name, parent, dropped, marks
        self.children: list[Element | str] = []
        self.against = self.bulky = self.hidden = self.likely = False
        self.points, self.worth, self.links, self.chars = 0.0, 0.0, 0, 0
        self.inside = name in ("article", "main") or parent is not None and parent.inside


def mark_of(token: str) -> tuple[str, bool]:
    """The word by which a class or id marks something other than the article
    (empty: none), and whether it tells nothing else ("ad-box" does not,
    "share-price" does)."""
    words = [w for w in _split.split(token) if w]
    if STATES & set(words):
        return "", False
    found, whole = "", True
    for m in words:
        part = next((x for x in UNLIKELY_PARTS if x in m and not m.startswith("commentar")), "")
        if m in UNLIKELY or part:
            found = found or (m if m in UNLIKELY else part)
        elif m not in LAYOUT and not m.isdigit():
            whole = False
    return found, bool(found) and whole


def judge_marks(node: Element, attrs: dict[str, str]) -> None:
    """Set the marks that an element's tag, role, class and id give."""
    name, parent = node.name, node.parent
    if name in ("html", "body"):
        return
    # A page's header holds its banner; an article's header holds its title.
    if name in ASIDE or name == "header" and not parent.inside:
        node.against, node.bulky = True, name in BULKY or name == "header"
    style = attrs.get("style", "").replace(" ", "")
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        node.against = node.hidden = True
    if attrs.get("role") in UNLIKELY_ROLES:
        node.against = node.bulky = True
    if "header" in node.marks and not node.marks & OF_ARTICLE and not parent.inside:
        node.against = True
    of_article = name in ("article", "main") or attrs.get("role") in ("main", "article")
    for token in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        mark, whole = mark_of(token)
        if mark and (whole or name not in PARAGRAPHS):
            node.against = True
            node.bulky |= whole or mark in BULKY
        elif not mark and ARTICLE_BODY & set(_split.split(token)):
            of_article = True
        elif not mark and OF_ARTICLE & set(_split.split(token)):
            node.bulky = False
    # What is marked both ways goes by its points, as any other container.
    node.likely = of_article and not node.against
    if of_article and name not in PARAGRAPHS and not (name in ("article", "main") and node.bulky):
        node.bulky = False


def parse(html: str) -> Element:
    """The element tree, with ends implied as in HTML."""
    root = Element("#root", None)
    at, node, n = 0, root, len(html)
    # Open elements by name: a tag that closes none of them costs no search.
    opened: Counter[str] = Counter()

    def back_to(target: Element) -> Element:
        at = node
        while at is not target:
            opened[at.name] -= 1
            at = at.parent
        return target

    def put(text: str) -> None:
        nonlocal node
        if node.name == "head" and not text.isspace() and text:
            node = back_to(ended(node, {"head"}))
        if text and not node.dropped:
            node.children.append(unescape(text) if "&" in text else text)

    while at < n:
        start = html.find("<", at)
        if start < 0:
            put(html[at:])
            break
        m = _tag.match(html, start)
        if m is None:
            put(html[at : start + 1])
            at = start + 1
            continue
        put(html[at:start])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["close"]:
            if opened[name]:
                node = back_to(closed(node, name))
            continue
        if name not in INLINE and opened["p"]:
            node = back_to(ended(node, {"p"}))
        if any(opened[c] for c in CLOSES.get(name, ())):
            node = back_to(ended(node, CLOSES[name]))
        if opened["head"] and (name == "body" or node.name == "head" and name not in IN_HEAD):
            node = back_to(ended(node, {"head"}))
        child = Element(name, node, node.dropped or name in DROPPED)
        if not child.dropped:
            attrs = {}
            if m["attrs"] and not m["attrs"].isspace():
                attrs = {k.lower(): unescape(v.strip("\"'")).lower() for k, v in _attr.findall(m["attrs"])}
                child.marks = frozenset(_split.split(attrs.get("class", "") + " " + attrs.get("id", ""))) - {""}
            judge_marks(child, attrs)
            node.children.append(child)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(html, at)
            if name == "xmp" and not child.dropped:  # is shown as it stands
                child.children.append(html[at : end.start() if end else n])
            at = end.end() if end else n
        elif name not in VOID and not (name in INLINE and (m["attrs"] or "").endswith("/")):
            node = child
            opened[name] += 1
    return root


def ended(node: Element, names: set[str]) -> Element:
    """Where parsing goes on after an implied end of one of ``names``."""
    at = node
    while at.parent is not None:
        if at.name in names:
            return ended(at.parent, names)
        if at.name in SCOPE and at.name not in names:
            return node
        at = at.parent
    return node


def closed(node: Element, name: str) -> Element:
    """Where parsing goes on after an end tag; one without a start is void."""
    at = node
    while at.parent is not None:
        if at.name == name:
            return at.parent
        # An inline end tag does not close the block around it.
        if name in INLINE and at.name not in INLINE:
            return node
        at = at.parent
    return node


def walk(root: Element) -> list[Element]:
    """All elements, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Element)]
    return out


def weigh(nodes: list[Element], how: Scoring) -> None:
    """Points of each element's own text, blocks inside it left out."""
    for node in nodes:
        # Most elements that hold others have no text of their own.
        empty = node.name in INLINE or not any(c.name in INLINE if isinstance(c, Element) else not c.isspace() for c in node.children)
        node.worth = 0.0 if empty else paragraph_points(*inner(node), how)


def measure(nodes: list[Element]) -> None:
    """Characters of all elements, given parents first, and those in links."""
    for node in reversed(nodes):
        node.chars = node.links = 0
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c) - c.count(" ") if not c.isspace() else 0
            else:
                node.chars += c.chars
                node.links += c.chars if c.name == "a" else c.links


def paragraph_points(text: str, linked: int, how: Scoring) -> float:
    """Points of a paragraph, less by the share of its text in links."""
    if not text:
        return 0.0
    points = how.base + text.count(",") + min(len(text) // how.chars_per_point, how.most_for_length)
    return points * (1 - min(1.0, linked / max(1, len(text) - text.count(" "))))


def inner(node: Element) -> tuple[str, int]:
    """Text of an element but for blocks inside it, and its length in links."""
    if all(isinstance(c, str) for c in node.children):
        return " ".join("".join(node.children).split()), 0
    out, linked = [], 0
    stack: list[tuple[Element | str, bool]] = [(c, node.name == "a") for c in reversed(node.children)]
    while stack:
        c, link = stack.pop()
        if isinstance(c, str):
            out.append(c)
            linked += len(c) - c.count(" ") if link else 0
        elif c.name == "br":
            out.append(" ")
        elif c.name in INLINE:
            stack += [(x, link or c.name == "a") for x in reversed(c.children)]
    return " ".join("".join(out).split()), linked


def settle(root: Element, nodes: list[Element], how: Scoring) -> bool:
    """Drop the elements that are marked as none of the article, unless their
    points speak for them; those with most points are judged first, and bulky
    ones without a sign of an article last. Returns whether there were any.

    What a marked element carries leaves out marked ones within, which are
    judged after it. A sign of an article is a heading of the first rank, or
    an element marked as the article, that is not marked otherwise."""
    if not any(n.against for n in nodes):
        return False
    carried, most, within, signs, own_signs = {}, {}, {}, {}, {}
    for node in reversed(nodes):
        total, best, inside = node.worth, 0.0, []
        sign = own_sign = node.likely or node.name == "h1" and not node.against
        for c in node.children:
            if isinstance(c, Element):
                best, sign = max(best, most[c]), sign or signs[c]
                if c.against:
                    inside.append(c)
                else:
                    total, own_sign = total + carried[c], own_sign or own_signs[c]
                    more = within.pop(c)
                    if len(more) > len(inside):
                        inside, more = more, inside
                    inside += more
        carried[node], within[node], signs[node], own_signs[node] = total, inside, sign, own_sign
        most[node] = max(best, total if node.against else 0.0)
    rest, signed, order = carried[root], own_signs[root], count()

    def entry(n: Element) -> tuple[bool, float, int, Element]:
        return (n.bulky or n.hidden) and not signs[n], -most[n], next(order), n

    heap = [entry(n) for n in within[root]]
    heapify(heap)
    while heap:
        unsigned, top, _, node = heappop(heap)
        enough = top < 0 and -top >= how.marked_share * (rest - top)
        alone = not rest or rest <= how.least_rest and not signed and not node.hidden
        if enough and (alone or not unsigned):
            rest, signed = rest + carried[node], signed or own_signs[node]
            for n in within[node]:
                heappush(heap, entry(n))
        else:
            node.dropped = True
    changed: dict[Element, None] = {}
    for node in nodes:
        gone = [c for c in node.children if isinstance(c, Element) and c.dropped]
        if gone:
            node.children = [c for c in node.children if isinstance(c, str) or not c.dropped]
            at = node
            while at is not None and at.name in INLINE:
                at = at.parent
            if at is not None and any(c.name in INLINE for c in gone):
                changed[at] = None
    weigh(list(changed), how)
    return True


def score(nodes: list[Element], how: Scoring) -> None:
    """Give points to all elements, given parents first.

    A paragraph's points go to its parent whole and to a few more ancestors in
    shares. An element marked as the article has all points below it that no
    such element within has, and half of the others."""
    for node in nodes:
        node.points = 0.0
    own: dict[Element, float] = {}
    taken: dict[Element, float] = {}
    for node in reversed(nodes):
        own[node], taken[node] = node.worth, 0.0
        for c in node.children:
            if isinstance(c, Element):
                own[node] += 0.0 if c.likely else own[c]
                taken[node] += taken[c] + (own[c] if c.likely else 0.0)
        if not node.worth:
            continue
        at = node.parent if node.name in PARAGRAPHS else node
        for share in SHARES:
            if at is None:
                break
            at.points += node.worth * share
            at = at.parent
    for node in nodes:
        if node.likely:
            node.points = max(node.points, own[node] + taken[node] / 2)


def density(node: Element) -> float:
    return node.links / node.chars if node.chars else 0.0


def kept(root: Element, how: Scoring) -> list[Element]:
    """The container with most points, and those of its siblings that fit."""
    nodes = walk(root)
    weigh(nodes, how)
    if settle(root, nodes, how):
        nodes = walk(root)
    measure(nodes)
    score(nodes, how)
    containers = [n for n in nodes if n.name not in INLINE and n.name not in PARAGRAPHS - {"td", "blockquote"}]
    best = max(containers, key=lambda n: n.points * (1 - density(n)))
    if best.points <= 0:
        return [root]
    if not best.likely:
        prune(best, how)
        # What only wraps the best container has the same siblings to offer.
        while best.parent is not None and best.parent.name not in ("body", "html", "#root") and best.parent.chars == best.chars:
            best.parent.points = max(best.parent.points, best.points)
            best = best.parent
    parent = best.parent
    if parent is None or best.name == "body":
        return [best]
    bar = best.points * how.sibling_share
    # Beside an article that the page itself marks, only its title is its own.
    by_page, title = best.likely, any(n.name == "h1" for n in walk(best))
    paragraphs = (set() if title else HEADINGS) if by_page else PARAGRAPHS - {"li", "td", "th"}
    out = []
    for c in parent.children:
        if not isinstance(c, Element) or c is best:
            out += [c] if c is best else []
            continue
        if density(c) > how.most_links:
            continue
        titled = not title and any(n.name == "h1" for n in walk(c))
        alike = c.name == best.name and c.marks == best.marks and (bool(c.marks) or parent.name not in ("body", "#root"))
        enough = c.points >= bar and (c.name == best.name or not by_page) or alike and not (by_page and best.name == "article")
        if c.name in paragraphs and c.chars or titled or enough and c.points > 0:
            out.append(c)
    return out


def prune(best: Element, how: Scoring) -> None:
    """Take lists and containers of links, and notices of rights at the end, out
    of a container that the page itself does not mark as its article."""
    for node in walk(best):
        node.children = [c for c in node.children if isinstance(c, str) or c.name not in CONTAINERS or density(c) <= how.most_links]
    texts = [n for n in walk(best) if n is not best and n.name not in INLINE and n.chars and not any(isinstance(c, Element) and c.name not in INLINE for c in n.children)]
    while texts and len(text := inner(texts[-1])[0]) <= MOST_NOTICE and _notice.match(text):
        texts.pop().children = []


def blocks(nodes: list[Element]) -> Iterator[str]:
    """Texts of the blocks in page order, white space made single spaces."""
    run: list[str] = []

    def flush() -> Iterator[str]:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            yield text

    for top in nodes:
        stack: list[Element | str | None] = [top]
        while stack:
            c = stack.pop()
            if c is None:
                yield from flush()
            elif isinstance(c, str):
                run.append(c)
            elif c.name == "br":
                run.append(" ")
            elif c.name in INLINE:
                stack += reversed(c.children)
            else:
                yield from flush()
                stack.append(None)
                stack += reversed(c.children)
        yield from flush()


def extract(html: str | None, how: Scoring = Scoring()) -> str:
    """Main text of a page, its blocks joined by newlines. Null, empty and
    text-free pages give an empty text; plain text is one block."""
    if not html:
        return ""
    return "\n".join(blocks(kept(parse(html), how)))


def text_column(html: Column, how: Scoring = Scoring()) -> Column:
    """``extract`` as a string column; never null."""

    @F.arrow_udf("string")
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([extract(p.as_py(), how) for p in pages], pa.string())

    return extracted(html)


def extract_pages(pages: DataFrame, name: str = "text", html_col: str = "html", how: Scoring = Scoring()) -> DataFrame:
    """``pages`` with the main text of each in column ``name``.

    Pages are parsed one by one and whole, however long or deep, in time that
    grows with their length; repeated rows give equal texts. A null or empty
    page has an empty text. An empty table gives no rows. A column named
    ``name`` is replaced.
    """
    return pages.withColumn(name, text_column(F.col(html_col), how))
