"""Main text of web pages by boosted trees over DOM nodes.

Each block element of a page is a node with features of its subtree (text,
density, links, tags below), its attribute tokens, its depth and its siblings.
Boosted trees give the probability that a node is main text.  Decoding is
hierarchical: over all choices in which nothing below a dropped node is kept,
the one with the highest likelihood is taken, by one pass from the leaves up.

The trees are trained here on at most ``SAMPLE`` pages (the documented bound,
drawn by hash): on the pages themselves, where ``article`` or ``main`` marks the
text, and on pages put together anew from their parts, with other containers
and with the kinds of boilerplate that surround texts.  Extraction covers every
page and the whole html, row by row, with no shuffle.

Defined results: a null or empty page has an empty text.  White space (no-break
space included) inside a block becomes one space; ``br`` is white space; blocks
are joined by a blank line.  Broken markup is read leniently: a tag that is
never closed ends with its parent, and a quote counts only right after an
attribute's "=".  Text outside of all elements, and after ``</html>``, belongs to
the body (an implied one if there is none); a page without any block element,
such as plain text, is kept whole.  Repeated rows each get their text.
"""

from __future__ import annotations

import html as htmllib
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Forest, fit_trees
from .shared import col

SAMPLE = 200
SEED = 5

# Element names of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input link meta".split())
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video head title select textarea button datalist".split())
RAW = frozenset("script style textarea title noscript iframe".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "tr td th thead tbody", "tfoot": "tr td th tbody"}
FENCE = frozenset("ul ol dl table body html article section div main td th".split())
# Words in class, id and role that speak for or against main text.
FOR = frozenset("article main content post entry story body text page blog news prose paragraph".split())
AGAINST = frozenset(
    "ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs byline combx comment comments community consent contact cookie cookies copyright cta disclaimer disqus donate "
    "feedback footer footnav form gdpr header legal links login masthead menu menubar meta modal nav navbar navigation newsletter notice overlay pagination pager paywall popup privacy promo promoted "
    "recommended related reply replies respond reader responses search share sharing shop sidebar sidenav signup site sitemap skyscraper social sponsor sponsored subscribe tag tags teaser toc toolbar tools warning widget alert".split()
)
# An attribute is a name, and after "=" a quoted or bare value: a quote counts only there, one that never closes is part of a bare value.
_VALUE = r"\"[^\"]*+\"|'[^']*+'|[^\s>]*+"
_MARK = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\s++|/|=|[^\s/>=]++(?:\s*+=\s*+(?:{_VALUE}))?)*+)(?:>|\Z)|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STOPS = re.compile(r"[.,;!?]")
LABEL = "data-main-text"

N_FEATURES = 34


@dataclass
class Page:
    """Block elements in page order (place 0 stands for the page) and the text blocks of each."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    attrs: list[str] = field(default_factory=lambda: [""])
    links: list[int] = field(default_factory=lambda: [0])
    tags: list[int] = field(default_factory=lambda: [0])
    inputs: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str]] = field(default_factory=list)


def parse(html: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("#page", 0)]
    text: list[str] = []
    owner, hidden, link, at = 0, 0, 0, 0

    def end_block() -> None:
        if text:
            words = "".join(text)
            if "&" in words:
                words = htmllib.unescape(words)
            words = " ".join(words.split())
            if words:
                page.blocks.append((owner, words))
            text.clear()

    def pop() -> None:
        nonlocal owner, hidden, link
        name, _ = stack[-1]
        if name in INLINE:
            link -= name == "a"
        elif name in HIDDEN:
            hidden -= 1
        else:
            end_block()
        stack.pop()
        owner = stack[-1][1]

    search = _MARK.search
    while True:
        found = search(html, at)
        if found is None:
            break
        if not hidden and found.start() > at:
            piece = html[at : found.start()]
            text.append(piece)
            if link:
                page.links[owner] += len(piece)
        at = found.end()
        name = found.group(2)
        if not name:
            continue
        name = name.lower()
        if found.group(1):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    while len(stack) > depth:
                        pop()
                    break
                if name in INLINE and stack[depth][0] not in INLINE:
                    break
            continue
        page.tags[owner] += 1
        if name in VOID:
            if name == "br":
                text.append(" ")
            elif name == "input":
                page.inputs[owner] += 1
            elif name == "hr":
                end_block()
            continue
        if name in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    while len(stack) > depth:
                        pop()
                    break
                if stack[depth][0] in FENCE:
                    break
        elif name in SAME:
            ends = SAME[name].split()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in ends:
                    while len(stack) > depth:
                        pop()
                    break
                if stack[depth][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = close.end() if close else len(html)
            page.inputs[owner] += name == "textarea"
            continue
        if name in INLINE:
            link += name == "a"
            stack.append((name, owner))
        elif name in HIDDEN:
            hidden += 1
            stack.append((name, owner))
            page.inputs[owner] += name in ("select", "button")
        else:
            end_block()
            page.parent.append(owner)
            page.tag.append(name)
            page.attrs.append(found.group(3) or "")
            page.links.append(0)
            page.tags.append(0)
            page.inputs.append(0)
            owner = len(page.tag) - 1
            stack.append((name, owner))
    if not hidden and at < len(html):
        text.append(html[at:])
    end_block()
    if any(node == 0 for node, _ in page.blocks):  # text outside of all elements belongs to the body, an implied one if there is none
        if "body" not in page.tag:
            for values, value in ((page.parent, 0), (page.tag, "body"), (page.attrs, ""), (page.links, page.links[0]), (page.tags, page.tags[0]), (page.inputs, 0)):
                values.append(value)
        body = page.tag.index("body")
        page.blocks = [(node or body, words) for node, words in page.blocks]
    return page


_KINDS = [
    frozenset(("article",)), frozenset(("main",)), frozenset(("nav", "menu")), frozenset(("footer",)), frozenset(("header",)), frozenset(("aside",)), frozenset(("form", "fieldset")),
    frozenset(("ul", "ol", "dl")), frozenset(("li", "dt", "dd")), frozenset(("p", "pre", "blockquote")), frozenset(("h1",)), frozenset(("h2", "h3", "h4", "h5", "h6")),
    frozenset(("table", "tbody", "tr", "td", "th")), frozenset(("div", "section", "center")), frozenset(("body", "html", "#page")),
]


def features(page: Page) -> np.ndarray:
    """One row for each node of a page."""
    n = len(page.tag)
    parent = page.parent
    own, stops, paragraphs = [0] * n, [0] * n, [t == "p" for t in page.tag]
    for node, words in page.blocks:
        own[node] += len(words)
        stops[node] += len(_STOPS.findall(words))
    chars, links, tags, inputs, stop, ps = list(own), list(page.links), list(page.tags), list(page.inputs), list(stops), [int(p) for p in paragraphs]
    children, place, twins = [0] * n, [0] * n, [0] * n
    by_tag: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = parent[i]
        place[i] = children[p]
        children[p] += 1
        by_tag[p, page.tag[i]] = by_tag.get((p, page.tag[i]), 0) + 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        tags[p] += tags[i] + 1
        inputs[p] += inputs[i]
        stop[p] += stop[i]
        ps[p] += ps[i]
    depth, pro, con, above_pro, above_con, before = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    last: dict[int, int] = {}
    kinds = np.zeros((n, len(_KINDS)))
    for i in range(n):
        tag = page.tag[i]
        for k, names in enumerate(_KINDS):
            if tag in names:
                kinds[i, k] = 1
        if page.attrs[i]:
            for _, a, b, c in _ATTR.findall(page.attrs[i]):
                words = {w.lower() for w in _WORD.findall(a or b or c)}
                pro[i] += len(words & FOR)
                con[i] += len(words & AGAINST)
        if i:
            p = parent[i]
            depth[i] = depth[p] + 1
            above_pro[i] = above_pro[p] + pro[p] + (page.tag[p] in ("article", "main"))
            above_con[i] = above_con[p] + con[p] + (page.tag[p] in ("nav", "footer", "aside", "form", "header"))
            before[i] = chars[last[p]] if p in last else 0
            last[p] = i
            twins[i] = by_tag[p, tag]
    up = np.array([max(0, p) for p in parent])
    a = {k: np.array(v, float) for k, v in dict(own=own, chars=chars, links=links, tags=tags, inputs=inputs, stop=stop, ps=ps, children=children, place=place, twins=twins, depth=depth, pro=pro, con=con, ap=above_pro, ac=above_con, before=before).items()}
    siblings = np.maximum(1, a["children"][up])
    some = np.maximum(1, a["chars"])
    link_share = np.minimum(1, a["links"] / some)
    table = np.column_stack([
        a["depth"], np.log1p(a["chars"]), np.log1p(a["own"]), a["chars"] / max(1, chars[0]), link_share, np.log1p(a["chars"] / (1 + a["tags"])),
        np.log1p(a["children"]), a["place"] / siblings, np.log1p(siblings), a["twins"] / siblings, a["chars"] / np.maximum(1, a["chars"][up]), a["stop"] / some,
        np.log1p(a["ps"]), a["pro"], a["con"], a["ap"], a["ac"], np.log1p(a["before"]), np.log1p(a["inputs"]),
    ])
    return np.hstack([table, kinds])


def choose(parent: list[int], probability: np.ndarray) -> list[bool]:
    """Likeliest choice in which nothing below a dropped node is kept; the page itself is free."""
    p = np.clip(probability, 1e-4, 1 - 1e-4)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    n = len(parent)
    for i in range(n - 1, 0, -1):
        up = parent[i]
        yes[up] += max(yes[i], no[i])
        no[up] += no[i]
    keep = [True] * n
    for i in range(1, n):
        keep[i] = keep[parent[i]] and yes[i] > no[i]
    return keep


def main_texts(pages: list[str], forest: Forest) -> list[str]:
    parsed = [parse(x) for x in pages]
    rows = [features(p) for p in parsed]
    scores = forest.probability(np.vstack(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for page, row in zip(parsed, rows):
        keep = choose(page.parent, scores[at : at + len(row)])
        keep[0] = False
        if all(t in ("#page", "html", "body") for t in page.tag):  # no block to choose from: all of the page is its text
            keep = [True] * len(keep)
        at += len(row)
        out.append("\n\n".join(words for node, words in page.blocks if keep[node]))
    return out


def _labels(page: Page) -> np.ndarray | None:
    """1 for nodes whose text is mostly main text: marked ones, or those in article and main; None if a page marks none."""
    n = len(page.tag)
    marked = any(LABEL in a for a in page.attrs)
    main, total, inside = [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        away = page.tag[i] in ("nav", "aside", "footer", "form") or (marked and f'{LABEL}="0"' in page.attrs[i])
        mine = f'{LABEL}="1"' in page.attrs[i] if marked else page.tag[i] in ("article", "main")
        inside[i] = (inside[page.parent[i]] or mine) and not away
    if not any(inside):
        return None
    for node, words in page.blocks:
        total[node] += len(words)
        main[node] += len(words) * inside[node]
    for i in range(n - 1, 0, -1):
        total[page.parent[i]] += total[i]
        main[page.parent[i]] += main[i]
    return np.array([inside[i] if not total[i] else 2 * main[i] > total[i] for i in range(n)], float)


def _remade(rng: random.Random, text: list[str], words: list[str]) -> str:
    """A page of known parts: ``text`` in one of many containers, boilerplate of ``words`` around and inside."""
    esc = htmllib.escape
    some = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/x">{esc(some(1, 4))}</a>'
    one = lambda *names: rng.choice(names)

    def listing(k: int) -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(k)) + "</ul>" if rng.random() < 0.7 else "".join(one(f"<p>{link()}</p>", f"<div>{link()}</div>", link() + " | ") for _ in range(k))

    def prose(a: int, b: int) -> str:
        return "".join(f"<p>{esc(rng.choice(text))[: rng.randint(40, 900)]}</p>" for _ in range(rng.randint(a, b)))

    def named(names: str, tags: str = "div section") -> tuple[str, str]:
        tag, name = rng.choice(tags.split()), rng.choice(names.split())
        return tag, f'<{tag} {one("class", "class", "id")}="{name}{one("", "-box", "-inner", "_wrap")}" {LABEL}="0">'

    def boiler() -> str:
        kind = rng.randrange(11)
        if kind == 0:
            return f'<nav {LABEL}="0">{listing(rng.randint(2, 9))}</nav>'
        if kind == 1:
            return f'<footer {LABEL}="0">&copy; {esc(some(2, 6))} &middot; {esc(rng.choice(text))[: rng.randint(10, 200)]}{one("", listing(3))}</footer>'
        if kind == 2:
            return f'<aside {LABEL}="0">{one("<h3>" + esc(some(1, 3)) + "</h3>", "")}{one(listing(4), prose(1, 3))}</aside>'
        if kind == 3:
            return f'<header {LABEL}="0">{one("", "<h1>" + esc(some(1, 4)) + "</h1>", "<div>" + esc(some(2, 8)) + "</div>")}{one("", listing(3))}</header>'
        if kind == 4:
            return f'<form action="/s" {LABEL}="0"><p>{esc(some(2, 12))}</p><label>{esc(some(1, 3))}</label><input name="q"><button>{esc(some(1, 2))}</button></form>'
        if kind == 5:
            tag, head = named("comments comment-list reader-comments responses disqus replies")
            return head + one("<h2>" + esc(some(1, 3)) + "</h2>", "") + "".join(f'<div class="{one("comment", "reply", "c-item")}"><b>{esc(some(1, 2))}</b>{prose(1, 2)}</div>' for _ in range(rng.randint(1, 5))) + f"</{tag}>"
        names = ("ad ads advert banner sponsored promo", "cookie-notice notice consent alert gdpr", "menu navbar topnav breadcrumbs navigation", "sidebar widget related-links toc recommended", "share social newsletter subscribe login signup")
        tag, head = named(names[kind - 6])
        return head + one(esc(some(2, 20)), esc(rng.choice(text))[: rng.randint(20, 400)], prose(1, 2), listing(rng.randint(2, 6))) + f"</{tag}>"

    body = [f'<p>{one("", "<b>", "<i>")}{esc(t)}{one("", "<br>")}{one("</p>", "")}' if rng.random() < 0.85 else one(f"<div>{esc(t)}</div>", f"<blockquote>{esc(t)}</blockquote>", f"<ul><li>{esc(t)}</li></ul>", f"<h2>{esc(t)[:80]}</h2>") for t in text[: rng.randint(1, 12)]]
    if rng.random() < 0.25:
        body = [f"<h1>{esc(text[0])[:60]}</h1>"]
        body += [f"<p>{esc(text[0])[: rng.randint(20, 300)]}</p>"]
    elif rng.random() < 0.8:
        body.insert(0, f"<h1>{esc(text[0])[: rng.randint(10, 90)]}</h1>")
    for _ in range(rng.choice((0, 0, 0, 1, 2))):
        body.insert(rng.randint(1, len(body)), boiler())
    tag, name = rng.choice((("article", ""), ("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("div", "article-body"), ("section", "story"), ("div", "entry-content"), ("div", ""), ("td", "main")))
    attr = f' {one("class", "id")}="{name}"' if name else ""
    core = f'<{tag}{attr} {LABEL}="1">{"".join(body)}</{tag}>'
    core = f"<table><tr>{core}</tr></table>" if tag == "td" else core
    if rng.random() < 0.3:
        core = f'<div class="{one("page", "wrapper", "container", "layout")}">{boiler() if rng.random() < 0.4 else ""}{core}{boiler() if rng.random() < 0.4 else ""}</div>'
    top, end = [boiler() for _ in range(rng.randint(0, 3))], [boiler() for _ in range(rng.randint(0, 3))]
    return f"<html><head><title>{esc(some(2, 6))}</title></head><body>{''.join(top)}{core}{''.join(end)}</body></html>"


def train(pages: list[str], seed: int = SEED, variants: int = 4) -> Forest:
    """Trees from pages of known main text; pages without such a mark add nothing."""
    rng = random.Random(seed)
    rows, labels = [], []

    def learn(page: Page) -> None:
        y = _labels(page)
        if y is not None:
            rows.append(features(page)[1:])
            labels.append(y[1:])

    for html in pages:
        page = parse(html)
        learn(page)
        blocks = [w for _, w in page.blocks]
        long = [w for w in blocks if len(w) > 40] or blocks
        words = [w for b in blocks for w in b.split()[:200]]
        if long and words:
            for _ in range(variants):
                rng.shuffle(long)
                learn(parse(_remade(rng, long, words)))
    if not rows:  # nothing to learn from: everything is text
        return fit_trees(np.zeros((1, N_FEATURES)), np.ones(1), rounds=0)
    return fit_trees(np.vstack(rows), np.concatenate(labels))


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Forest:
    """Train on at most ``sample`` pages of no more than 200 000 characters, drawn by hash."""
    html = col(html_col)
    rows = pages.filter(F.length(html).between(1, 200_000)).select(html.alias("h"), F.xxhash64(html).alias("o"))
    least = rows.select("o").distinct().orderBy("o").limit(sample)  # only hashes are ordered; then their pages are fetched
    drawn = rows.join(F.broadcast(least), "o").groupBy("o").agg(F.min("h").alias("h"))
    return train([r["h"] for r in sorted(drawn.collect())])


def extract_text(pages: DataFrame, forest: Forest, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page; a column named ``out`` is replaced."""

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        found: list[str] = []
        for at in range(0, len(column), 200):
            found += main_texts([x or "" for x in column[at : at + 200].to_pylist()], forest)
        return pa.array(found, pa.string())

    return pages.withColumn(out, texts(col(html_col)))
