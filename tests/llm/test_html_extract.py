"""Main text of pages made from known articles in several layouts."""

from __future__ import annotations

import html as escaping
import random
import re
import time

import pytest

from fernweft.llm import html_extract
from fernweft.llm.html_extract import (
    CONTAINERS, HEADINGS, INLINE, MOST_NOTICE, PARAGRAPHS, Element, Scoring, _notice, blocks, density, extract, extract_pages, inner, kept, measure, parse, score, walk, weigh,
)
from fernweft.llm.queries import op10

MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Menu entry, number {i}</a></li>" for i in range(12)) + "</ul>"
COMMENTS = "".join(f"<p>Great post, number {i}, thanks, really, a lot of good points here.</p>" for i in range(4))
LAYOUTS = {
    "semantic": "<header><h1>Site</h1>{menu}</header><nav>{menu}</nav><main><article>{body}</article></main><aside><p>Most read, today</p></aside><footer>&copy; x</footer>",
    "classes": "<div id='top-nav'>{menu}</div><div class='wrap'><div class='post-body'>{body}</div><div class='sidebar'>{menu}</div></div><div class='footer'>Legal, text</div>",
    "ids": "<div id=page><div id=cookie-notice>We use cookies, for all, of it</div><div id=content>{body}</div><section id=comments>{comments}</section></div>",
    "article with extras": "<body class='no-sidebar comments-open'><article><header>{head}</header><div class='ad'>Buy, buy, buy</div>{rest}<form><p>Sign up, now</p><input name=q></form>"
    "<div class=comments>{comments}</div><footer><p>By someone</p></footer></article></body>",
    "tables": "<table><tr><td class=menu>{menu}<td>{body}</table>",
    "links": "<div>{body}</div><div>{menu}</div>",
    "div header": "<div id='header'><h1>Site name, and slogan</h1></div><div class='story'><div class='story-header'>{head}</div>{rest}</div><div class='leftsidebar'><p>About us, and more</p></div>",
    "notices": "<p role='alert'>Notice, read this</p><article>{body}</article><p>Subscribe now, it is free, it is good</p><div class='usercomments'>{comments}</div>",
    "parts": "<div class='page'><div class='part'>{head}</div><div class='part'>{rest}</div></div><div class='topbar'><p>Log in, now</p></div>",
    "site title": "<div class='brand'><h1>The site</h1></div><h2>Slogan, here</h2><article>{body}</article>",
    "title outside": "<div class='top'>{head}</div><article>{rest}</article>",
    "teasers": "<div><article>{body}</article><article><p>More, here</p></article></div>",
}


def article(rng):
    blocks = [("h1", "A title & more")]
    for _ in range(rng.randrange(3, 9)):
        blocks.append((rng.choice(["p", "p", "p", "blockquote"]), " ".join(rng.choice(["word", "é<3", "a,", "b;", "long-ish", "&amp;"]) for _ in range(rng.randrange(4, 60)))))
    return blocks


def markup(blocks, rng):
    out = []
    for tag, text in blocks:
        inner = escaping.escape(text, quote=False).replace(" ", rng.choice([" ", "\n\t", "&#32;"]))
        inner = re.sub(r"\bword\b", rng.choice(["word", "<b>word</b>", "<a href='x'>word</a>"]), inner, count=1)
        out.append(f"<{tag.upper() if rng.random() < 0.2 else tag}>{inner}" + (f"</{tag}>" if tag != "p" or rng.random() < 0.7 else ""))
    return out


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("seed", range(5))
def test_articles_come_back_whole_and_alone(layout, seed):
    rng = random.Random(seed)
    blocks = article(rng)
    parts = markup(blocks, rng)
    page = LAYOUTS[layout].format(menu=MENU, comments=COMMENTS, body="".join(parts), head=parts[0], rest="".join(parts[1:]))
    page = f"<!DOCTYPE html><html><head><title>T</title><script>var a='</p><article>no</article>';</script><style>p{{x:1}}</style></head>{page}</html>"
    assert extract(page) == "\n".join(" ".join(t.split()) for _, t in blocks)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), (" \n ", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>one<p>two", "one\ntwo"), ("<article><p>a<br>b</p></article>", "a b"),
        ("<p>&nbsp;x&#x41;&eacute;&unknown;</p>", "xAé&unknown;"), ("<script>only()</script>", ""), ("<p>unclosed <b>bold<p>next", "unclosed bold\nnext"),
        ("<article><!-- <p>no</p> --><p>yes</p></article>", "yes"), ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        ("<article><ul><li>a<li>b<ul><li>c</ul></ul></article>", "a\nb\nc"), ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "yes"),
        ("<article><p title='a > b'>yes</p></article>", "yes"), ("</div></p>late", "late"), ("<article><p>cut off <", "cut off <"),
    ],
)
def test_odd_pages(page, text):
    assert extract(page) == text


MARKED = [
    "<div class='content no-sidebar'>{body}</div>", "<div class='post has-sidebar'>{body}</div>", "<div class='entry social-share'>{body}</div>",
    "<div id='page-with-comments'>{body}</div>", "<div class='widget' id='story'><div class='post nosidebar'>{body}</div></div>",
    "<div class='entry social-share'>{body}<div class='post related'><p>More, and more</p></div></div><div class='comments'>{comments}</div>",
    "<div class='content'>{body}<div class='post promo'><p>Buy, or not</p></div></div>",
]


@pytest.mark.parametrize("layout", MARKED)
@pytest.mark.parametrize("head", ["<head><title>T</title></head><body>", "<head><meta charset=utf-8><title>T</title><body>", "<head><title>T</title>\n<link href=x>", ""])
def test_marks_on_the_article_and_open_heads(layout, head):
    for seed in range(5):
        rng = random.Random(seed)
        blocks = article(rng)
        page = layout.format(body="".join(markup(blocks, rng)), comments=COMMENTS)
        assert extract(f"<html>{head}<nav>{MENU}</nav>{page}</html>") == "\n".join(" ".join(t.split()) for _, t in blocks)


def test_text_and_inline_elements_end_a_head():
    assert extract("<head><title>T</title>words <b>here</b>") == "words here"
    assert extract("<head><script>x</script><style>y</style><template><p>no</p></template><noscript>z</noscript>") == ""


CLASSES = [
    "content with-sidebar", "site has-sidebar", "entry-content no-comments", "post search", "layout-widget", "footer-sticky", "widget",
    "sidebar-layout", "ad-free", "search-results", "plain",
]


@pytest.mark.parametrize("css", CLASSES)
@pytest.mark.parametrize("tag", ["div", "section", "main", "article", "form"])
def test_no_class_word_empties_a_page(css, tag):
    for seed in range(4):
        blocks = article(random.Random(seed))
        body = "".join(markup(blocks, random.Random(seed)))
        page = f"<body><nav>{MENU}</nav><{tag} class='{css}'>{body}</{tag}><footer><p>All rights, reserved.</p></footer></body>"
        want = "\n".join(" ".join(t.split()) for _, t in blocks)
        assert extract(page) == want
        assert extract(f"<div class='footer-sticky'><article>{body}</article></div>") == want


MANY_COMMENTS = "".join(f"<p>Nice, very nice, number {i}, thanks, I like it a lot, and so on and on, really.</p>" for i in range(60))
REPLIES = [
    "<section class='comments'>{}</section>", "<ol class='comment-list'><li class='comment'>{}</li></ol>", "<div id=disqus_thread>{}</div>",
    "<div class='user-comments'><article class='comment-body'>{}</article></div>",
]


@pytest.mark.parametrize("replies", REPLIES)
@pytest.mark.parametrize("tag", ["article", "div class=post", "div class=content", "div", "main"])
@pytest.mark.parametrize("inside", [True, False])
def test_comments_that_outweigh_the_article_go(replies, tag, inside):
    blocks = article(random.Random(7))
    body, rest, end = "".join(markup(blocks, random.Random(7))), replies.format(MANY_COMMENTS), f"</{tag.split()[0]}>"
    page = f"<nav>{MENU}</nav><{tag}>{body}" + (rest + end if inside else end + rest)
    assert extract(page) == "\n".join(" ".join(t.split()) for _, t in blocks)


def test_a_marked_paragraph_of_the_article_stays():
    for tag in ("article", "div"):
        assert extract(f"<{tag}><h1>A</h1><p>One, two.</p><p class='share-price'>It fell, again.</p><p class='ad'>Buy.</p></{tag}>") == "A\nOne, two.\nIt fell, again."


def test_an_article_in_sections_stays_whole():
    parts = "".join(f"<section><h2>Part {i}</h2><p>Text of part {i}, and more.</p></section>" for i in range(6))
    for page in (f"<article><h1>T</h1>{parts}</article>", f"<main>{parts}</main>", f"<div class=post>{parts}</div>", f"<div class=wrap><h1>T</h1>{parts}</div>"):
        assert extract(f"<body><nav>{MENU}</nav>{page}</body>").count("Text of part") == 6


def plain_points(root, how):
    """Points of every element by walking down from it, one by one."""

    def below(node, level=0):
        yield node, level
        for c in node.children:
            if isinstance(c, Element):
                yield from below(c, level + 1)

    def without_likely(node):
        return node.worth + sum(without_likely(c) for c in node.children if isinstance(c, Element) and not c.likely)

    out = {}
    for node in walk(root):
        total = 0.0
        for n, level in below(node):
            if n.name in INLINE or not n.worth or n.name in PARAGRAPHS and not level:
                continue
            level -= n.name in PARAGRAPHS
            total += n.worth * {0: 1.0, 1: 1 / 2, 2: 1 / 6, 3: 1 / 9, 4: 1 / 12}.get(level, 0.0)
        if node.likely:
            inner = [n for n, level in below(node) if n.likely and level]
            total = max(total, without_likely(node) + sum(map(without_likely, inner)) / 2)
        out[node] = total
    return out


@pytest.mark.parametrize("layout", list(LAYOUTS))
def test_points_agree_with_a_plain_walk(layout):
    for seed in range(4):
        rng = random.Random(seed)
        parts = markup(article(rng), rng)
        page = LAYOUTS[layout].format(menu=MENU, comments=COMMENTS, body="".join(parts), head=parts[0], rest="".join(parts[1:]))
        root, how = parse(page), Scoring()
        nodes = walk(root)
        weigh(nodes, how)
        measure(nodes)
        score(nodes, how)
        for node, want in plain_points(root, how).items():
            assert node.points == pytest.approx(want), node.name


def elements(node):
    return [c for c in node.children if isinstance(c, Element)]


def plain_settle(root, how):
    """Marked elements judged one after the other, with all that is known of
    them found anew by walking. None where two compete for the next turn."""

    def below(n, through):
        found = [n]
        for c in elements(n):
            found += below(c, through) if through or not c.against else []
        return found

    def outermost(n):
        return [m for c in elements(n) for m in ([c] if c.against else outermost(c))]

    def carried(n):
        return sum(m.worth for m in below(n, False))

    def signed(n, through):
        return any(m.likely or m.name == "h1" and not m.against for m in below(n, through))

    def turn(n):
        return (n.bulky or n.hidden) and not signed(n, True), -max(carried(m) for m in below(n, True) if m.against)

    rest, sign, waiting, gone = carried(root), signed(root, False), outermost(root), []
    while waiting:
        waiting.sort(key=turn)
        node = waiting.pop(0)
        unsigned, top = turn(node)
        if top and any(turn(n) == (unsigned, top) for n in waiting):
            return None
        enough = top < 0 and -top >= how.marked_share * (rest - top)
        alone = not rest or rest <= how.least_rest and not sign and not node.hidden
        if enough and (alone or not unsigned):
            rest, sign = rest + carried(node), sign or signed(node, False)
            waiting += outermost(node)
        else:
            gone.append(node)
    for n in gone:
        n.parent.children.remove(n)
    return gone


def plain_kept(root, how):
    """What is kept, with shares of links and points found by walking down from
    each element; None where marked elements compete for a turn."""
    weigh(walk(root), how)
    if plain_settle(root, how) is None:
        return None
    weigh(walk(root), how)

    def chars(n, linked=False, inside=False):
        own = sum(len(c) - c.count(" ") for c in n.children if isinstance(c, str) and not c.isspace())
        return (own if inside or not linked else 0) + sum(chars(c, linked, inside or c.name == "a") for c in elements(n))

    size = {n: chars(n) for n in walk(root)}
    links = {n: chars(n, True) / size[n] if size[n] else 0.0 for n in size}
    points = plain_points(root, how)
    best = None
    for n in walk(root):
        if n.name in INLINE or n.name in PARAGRAPHS and n.name not in ("td", "blockquote"):
            continue
        # Sums in another order differ in the last digits.
        if best is None or points[n] * (1 - links[n]) > points[best] * (1 - links[best]) + 1e-9:
            best = n
    if points[best] < 1e-9:
        return [root]
    if not best.likely:
        for n in walk(best):
            n.children = [c for c in n.children if isinstance(c, str) or c.name not in CONTAINERS or links[c] <= how.most_links]
        while True:
            last = [n for n in walk(best) if n is not best and n.name not in INLINE and size[n] and n.children and all(isinstance(c, str) or c.name in INLINE for c in n.children)]
            if not last or len(inner(last[-1])[0]) > MOST_NOTICE or not _notice.match(inner(last[-1])[0]):
                break
            last[-1].children = []
        while best.parent and best.parent.name not in ("body", "html", "#root") and size[best.parent] == size[best]:
            points[best.parent] = max(points[best.parent], points[best])
            best = best.parent
    if best.parent is None or best.name == "body":
        return [best]
    holds_title = {n: any(m.name == "h1" for m in walk(n)) for n in [best, *elements(best.parent)]}

    def stays(c):
        if links[c] > how.most_links:
            return False
        if not holds_title[best] and holds_title[c]:
            return True
        if size[c] and c.name in HEADINGS and not (best.likely and holds_title[best]):
            return True
        if size[c] and c.name in ("p", "pre", "blockquote", "dd", "dt", "figcaption") and not best.likely:
            return True
        twin = c.name == best.name and c.marks == best.marks and (c.marks or best.parent.name not in ("body", "#root"))
        twin = twin and not (best.likely and best.name == "article")
        strong = points[c] >= how.sibling_share * points[best] - 1e-9 and (c.name == best.name or not best.likely)
        return points[c] > 1e-9 and bool(twin or strong)

    return [c for c in elements(best.parent) if c is best or stays(c)]


def made_page(rng, depth=0):
    """Nested elements with and without marks, and texts of many sizes."""
    if depth and rng.random() < 0.25 + depth / 8:
        text = ("comma, " * rng.randrange(30) + "word " * rng.randrange(60)).strip() or "short"
        if rng.random() < 0.15:
            text = rng.choice(["\u00a9 2020 Someone", "Copyright 2021 the owner"])
        if rng.random() < 0.3:
            text = f"{text} <a href=x>{'link ' * rng.randrange(1, 30)}</a>"
        if rng.random() < 0.2:
            text = f"{text} <span><em class={rng.choice(['ad', 'x', 'share'])}>{text[:40]}</em> tail</span>"
        tag = rng.choice(["p", "p", "p", "h1", "h2", "li", "blockquote", "div"])
        return f"<{tag}>{text}</{tag}>"
    tag = rng.choice(["div", "div", "div", "section", "ul", "article", "nav", "footer", "aside", "header", "form"] if depth else ["body"])
    mark = rng.choice(["", "", "", "", " class=ad", " class=comments", " class='sidebar wide'", " class=post", " class=entry-title", " id=menu", " hidden", " role=main", " class=part"])
    return f"<{tag}{mark}>{''.join(made_page(rng, depth + 1) for _ in range(rng.randrange(1, 6)))}</{tag}>"


@pytest.mark.parametrize("how", [Scoring(), Scoring(marked_share=0.2, least_rest=5.0, sibling_share=0.5)])
def test_what_is_kept_agrees_with_a_plain_form(how):
    compared = cut = 0
    for seed in range(400):
        page = made_page(random.Random(seed))
        wanted = plain_kept(parse(page), how)
        if wanted is not None:
            got, want = "\n".join(blocks(kept(parse(page), how))), "\n".join(blocks(wanted))
            assert got == want, page
            compared += 1
            cut += want != "\n".join(blocks([parse(page)]))
    assert compared > 300 and cut > 200


def unmarked(page):
    """A page without tags and classes that tell its parts."""
    return re.sub(r"<(/?)(?:nav|footer|header|aside|main|article|form)\b", r"<\1div", re.sub(r" (?:class|id|role)=('[^']*'|[^ >]*)", "", page))


def test_points_choose_the_text(monkeypatch):
    pages, wants = [], []
    for seed in range(20):
        rng = random.Random(seed)
        blocks = article(rng)
        pages.append(unmarked(f"<body><div><nav>{MENU}</nav></div><div><article>{''.join(markup(blocks, rng))}</article></div><div><aside><a href=x>More</a> of it</aside></div></body>"))
        wants.append("\n".join(" ".join(t.split()) for _, t in blocks))
    assert [extract(p) for p in pages] == wants

    def constant(nodes, how):
        for n in nodes:
            n.points = 1.0

    monkeypatch.setattr(html_extract, "score", constant)
    assert sum(extract(p) == w for p, w in zip(pages, wants)) < len(pages) / 2


def test_points_fall_with_links():
    page = parse("<div><p>Words, and more words.</p></div><div><p><a href=x>Words, and more words.</a></p></div>")
    nodes = walk(page)
    weigh(nodes, Scoring())
    measure(nodes)
    score(nodes, Scoring())
    one, two = [n for n in nodes if n.name == "div"]
    assert one.points == 2.0 and two.points == 0.0 and density(two) == 1.0


def test_deep_and_long_pages():
    assert extract("<b>" * 20_000 + "x" + "</i></div>" * 20_000) == "x"
    assert extract("<div>" * 20_000 + "<p>deep</p>") == "deep"
    began = time.perf_counter()
    extract("<div>text, here " * 20_000)
    assert time.perf_counter() - began < 2
    long = " ".join(["word"] * 200_000)
    assert extract(f"<nav>{MENU}</nav><article><p>{long}</p></article>") == long


def test_query_on_pages(spark, sf_dir):
    got = {r.page_id: r for r in op10.query(spark, sf_dir).collect()}
    for page in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        pieces = re.split(r"<[^>]+>", re.sub(r"</?b>", "", body))
        want = "\n".join(x for x in (" ".join(escaping.unescape(p).split()) for p in pieces) if x)
        assert got[page.page_id].text == want and got[page.page_id].n_chars == len(want)


def test_query_on_pages_without_article_tags(spark, sf_dir):
    for page in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        want = extract(page.html)
        for tag in ("div", "section", "div class='content with-sidebar'"):
            html = page.html.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag.split()[0]}>")
            assert want and extract(html) == want


def test_tables_with_nulls_repeats_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, None, "t"), (2, "<p>x", "t"), (2, "<p>x", "t")], "page_id bigint, html string, text string")
    assert [r.text for r in extract_pages(pages).orderBy("page_id").collect()] == ["", "x", "x"]
    assert extract_pages(pages.limit(0)).count() == 0


SENTENCES = "".join(f"<p>Sentence number {i}, with commas, and words enough for a paragraph of text.</p>" for i in range(5))


@pytest.mark.parametrize("frame", ["<body>{}</body>", "<body><div>{}</div></body>", "<body><div><div>{}</div></div></body>"])
def test_menus_and_notices_go_from_pages_without_marks(frame):
    menu = "<ul>" + "".join(f"<li><a href=x>Entry {i}</a></li>" for i in range(8)) + "</ul>"
    links = "<div><a href=a>Home</a> <a href=b>About us</a></div>"
    text = extract(frame.format(f"{menu}<h1>A title</h1>{SENTENCES}{links}<p>© 2024 Example. All rights reserved.</p>"))
    assert text.startswith("A title\nSentence number 0") and text.endswith("paragraph of text.")
    assert not any(x in text for x in ("Entry", "Home", "©"))


def test_lists_and_links_of_the_article_stay():
    page = f"<body><h1>A title</h1>{SENTENCES}<ul><li>One item, with <a href=x>a link</a> in it</li><li>Another</li></ul><p>See <a href=x>this</a>.</p></body>"
    assert extract(page).endswith("One item, with a link in it\nAnother\nSee this.")


def test_title_and_parts_around_nested_containers_stay():
    page = f"<div><h1>T</h1><div><div>{SENTENCES}</div></div><div><div><p>Last words.</p></div></div></div>"
    assert extract(page).startswith("T\nSentence") and extract(page).endswith("\nLast words.")


def test_text_shown_as_it_stands():
    assert extract("<body><p>before, it is</p><xmp>a <b>raw</b> text</xmp></body>") == "before, it is\na <b>raw</b> text"


def test_many_marked_spans_and_headers_take_little_time():
    began = time.perf_counter()
    page = "<body><p>" + '<span><span class="ad">x</span>text</span>' * 8000 + "</p></body>"
    assert extract(page) == "text" * 8000
    extract("<header>" * 8000 + "x")
    assert time.perf_counter() - began < 4
