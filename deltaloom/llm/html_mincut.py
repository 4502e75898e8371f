"""Main-text extraction: blocks of a page labelled by a minimum cut.

A page is cut into text blocks at block-level tags. A classifier gives each block a
log-odds of being content; its absolute value becomes a terminal capacity, to the content
side if positive, else to the boilerplate side. The log-odds add up two parts:

* what the text looks like (length, links, sentence's end, heading, copyright sign), by a
  logistic regression fitted to blocks of a bounded sample of pages whose tags or names say
  plainly what they are; tags and names are no features of it;
* what the nearest ancestor says that says anything, by tag or by a name that as a whole
  speaks of boilerplate. Names of which only a part does, and names of content, count on top
  of what stands further out. An article in a wrapper is judged by the article.

Smoothness edges join neighbours in page order, heavier the deeper their common ancestor,
and successive blocks of one parent; they are weak across the border of an element that
speaks for or against content. Maximum flow then separates content from boilerplate at
least total cost. No part alone outweighs the other and the neighbours in every case.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

# Element names by what they do to the text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
DROPPED = frozenset("select option datalist svg math object canvas audio video button".split())
BOILER_TAGS = frozenset("nav footer aside menu dialog".split())
FORM_TAGS = frozenset("form fieldset legend".split())
CONTENT_TAGS = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role that speak against or for content.
BOILER_WORDS = frozenset("ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist reply replies respond discussion disqus share sharing social related recommended recommendations subscribe subscription newsletter signup login search popup modal overlay widget pagination pager copyright legal disclaimer skip toc tags meta byline complementary contentinfo".split())
CONTENT_WORDS = frozenset("article articlebody content post entry story body main text maincontent postcontent".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond discussion disqus".split())
# Words that say how something is laid out, and words of a state that isn't the element's own kind.
NEUTRAL_WORDS = frozenset("site page left right top bottom box list item items container wrapper wrap block area section inner outer group row col column primary secondary layout the".split())
WRAP_WORDS = frozenset("container wrapper wrap layout".split())
STATE_WORDS = frozenset("has no with without is open closed enabled disabled active inactive show hide hidden visible on off".split())
#: Log-odds that an element adds: by its tag, its name, or a part of its name.
MARKUP = {"content_tag": 2.0, "boiler_tag": -4.5, "form": -4.5, "page_header": -4.5, "name": -4.5, "comments": -4.5, "content_name": 1.0, "name_part": -1.5, "hidden": -9.0}
#: Kinds that count on top of what stands further out.
PARTIAL = frozenset(["content_name", "name_part"])
#: Kinds inside which an article isn't the page's own: teasers and comments.
SEALED = frozenset(["boiler_tag", "comments"])
#: Weights of the text's features where there is nothing to fit them on.
UNFITTED = (-1.2, 0.7, -3.5, 0.5, 0.6, -2.0)
#: The most that a text's features add or take.
TEXT_MOST = 3.0
NEAR, SIBLING, ACROSS = 0.8, 0.8, 0.25

_TAG = re.compile(r"<(?:!--(.*?)(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|/[^a-zA-Z][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>)", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}


def named(value: str) -> str | None:
    """What a class, id or role says: ``comments``, ``name``, ``name_part``, ``content_name``, or nothing."""
    best = None
    for token in value.split():
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", token)]
        core = [w for w in words if w not in NEUTRAL_WORDS]
        if not core or not STATE_WORDS.isdisjoint(words):
            continue
        first, last = core[0] in BOILER_WORDS, core[-1] in BOILER_WORDS
        if core[0] in COMMENT_WORDS or core[-1] in COMMENT_WORDS:
            return "comments"
        if BOILER_WORDS.issuperset(core):
            return "name"
        if last and WRAP_WORDS.isdisjoint(words) and "content" not in core:
            return "name"
        if first or last:
            best = "name_part"
        elif best is None and CONTENT_WORDS.issuperset(core):
            best = "content_name"
    return best


class Node:
    """An open element. ``says`` is the nearest element, itself included, that says what it is."""

    __slots__ = ("tag", "up", "depth", "kind", "says", "in_content", "contents", "dropped", "link")

    def __init__(self, tag: str, up: "Node | None", attributes: str):
        self.tag, self.up, self.kind, self.contents = tag, up, None, 0
        if up is None:
            self.depth, self.says, self.in_content, self.dropped, self.link = 0, None, False, False, False
            return
        self.depth, self.in_content = up.depth + 1, up.in_content or tag in CONTENT_TAGS
        self.dropped, self.link = up.dropped or tag in DROPPED, up.link or tag == "a"
        kind = "content_tag" if tag in CONTENT_TAGS else "boiler_tag" if tag in BOILER_TAGS else "form" if tag in FORM_TAGS else None
        if tag == "header" and not up.in_content:
            kind = "page_header"
        if attributes and tag not in ("html", "body", "a"):
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), (m[2] or "").strip("\"'")
                if name == "style":
                    if "display:none" in value.lower().replace(" ", ""):
                        kind = "hidden"
                elif name == "hidden" or name == "aria-hidden":
                    if name == "hidden" and value.lower() != "false" or value.lower() == "true":
                        kind = "hidden"
                elif kind != "hidden":
                    found = "content_tag" if name == "role" and value.lower() in CONTENT_TAGS else named(value)
                    if found in ("name", "comments") or found and kind is None or found == "content_tag" and kind not in ("name", "comments"):
                        kind = found
        self.kind = kind
        self.says = self if kind else up.says
        if kind == "content_tag":
            for e in self.outward():
                e.contents += 1

    def outward(self):
        """The elements that say something, from here outwards."""
        e = self.says
        while e is not None:
            yield e
            e = e.up.says


def blocks(page: str) -> list[tuple[str, Node, int]]:
    """(text, innermost block element, letters inside links) of every block, in page order."""
    out: list[tuple[str, Node, int]] = []
    root = Node("", None, "")
    stack, parts, linked = [root], [], 0
    holder = root

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, holder, min(linked, len(text))))
            parts.clear()
        linked = 0

    def say(raw: str):
        nonlocal linked, holder
        top = stack[-1]
        if top.dropped or not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        if not parts:
            holder = top
            while holder.tag in INLINE:
                holder = holder.up
        parts.append(text)
        if top.link:
            linked += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        following = page[lt + 1 : lt + 2]
        if not (following.isalpha() and following.isascii() or following in "/!?") or not following:
            say("<")
            at = lt + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            break  # the page ends inside a tag, which is no text
        at = m.end()
        closing, tag, attributes = m.groups()[-3:]
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag not in INLINE:
            flush()
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID or attributes.endswith("/") and tag in ("path", "rect", "circle", "use"):
            continue
        if tag in CLOSES_P or tag in ("li", "td", "th", "tr", "dd", "dt"):
            shut = {"p"} | ({tag} if tag in ("li", "td", "th", "tr", "dd", "dt") else set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in shut:
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        stack.append(Node(tag, stack[-1], attributes))
    flush()
    return out


def text_features(text: str, node: Node, linked: int) -> tuple[float, ...]:
    """Constant, length, share of links, sentence's end, heading, copyright sign."""
    return 1.0, math.log(1 + len(text) / 24), linked / len(text), float(text[-1] in ".!?…\""), float(node.tag in HEADINGS), float("©" in text[:40])


def void(found: list[tuple[str, Node, int]]) -> set[int]:
    """Elements (by id()) that hold most of a page and so can't be what they're said to be.

    A form round half of the text or more, and what is so named or tagged though it holds
    that much and every article or main element of the page.
    """
    mass: dict[int, int] = {}
    seen: dict[int, Node] = {}
    for text, node, _ in found:
        for e in node.outward():
            if e.kind in ("form", "name", "name_part", "comments", "boiler_tag"):
                mass[id(e)] = mass.get(id(e), 0) + len(text)
                seen[id(e)] = e
    if not mass:
        return set()
    total = sum(len(text) for text, _, _ in found)
    tops = {id(e) for _, node, _ in found for e in node.outward() if e.kind == "content_tag"}
    return {i for i, m in mass.items() if 2 * m >= total and (seen[i].kind == "form" or seen[i].contents and seen[i].contents >= len(tops))}


def markup(node: Node, skip: set[int] = frozenset()) -> float:
    """What tags and names round a block add to its log-odds."""
    round_it = [e.kind for e in node.outward() if id(e) not in skip]
    for kind in round_it:
        if kind in SEALED:
            return MARKUP[kind]
    z = 0.0
    for kind in round_it:
        z += MARKUP[kind]
        if kind not in PARTIAL:
            break
    return z


def log_odds(text: str, node: Node, linked: int, weights: tuple[float, ...] = UNFITTED, skip: set[int] = frozenset()) -> float:
    """The classifier's log-odds that a block is content."""
    z = sum(w * x for w, x in zip(weights, text_features(text, node, linked)))
    return min(max(z, -TEXT_MOST), TEXT_MOST) + markup(node, skip)


def fit_weights(pages: DataFrame, max_pages: int = 2000, max_bytes: int = 200_000) -> tuple[float, ...]:
    """Weights of the text's features, by logistic regression.

    Fitted on the ``max_pages`` pages first by a hash of their ids, of those with at most
    ``max_bytes`` bytes of html. Blocks inside an article or main element are content,
    those in what is named or tagged as boilerplate are not, by the nearest element that
    says so; others aren't used. The weights are UNFITTED where one of the two kinds is
    missing.
    """
    ids = pages.where(F.octet_length("html") <= max_bytes).select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)
    sample = pages.join(F.broadcast(ids), "page_id", "left_semi").where(F.octet_length("html") <= max_bytes).select("html")

    def run(batches):
        for b in pieces(batches):
            rows = []
            for page in b.column(0).to_pylist():
                for text, node, linked in blocks(page):
                    kind = node.says and node.says.kind
                    if kind in ("content_tag", "boiler_tag", "page_header", "name", "comments"):
                        rows.append((float(kind == "content_tag"), text_features(text, node, linked)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["y", "x"])

    got = sample.mapInArrow(run, "y double, x array<double>").toArrow()
    y = got["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return UNFITTED
    x = np.array(got["x"].to_pylist())
    share = y.mean()
    each = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))  # both kinds weigh the same
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * 1e-3 * len(y)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grown = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (each * (y - p)) - ridge @ w)
        w = w + grown
        if np.abs(grown).max() < 1e-6:
            break
    return tuple(float(v) for v in np.round(w, 6))


def smoothness(nodes: list[Node]) -> list[tuple[int, int, float]]:
    """Edges (i, j, capacity) between blocks that are near in the page or its tree."""
    edges = []
    last: dict[int, int] = {}
    for j, b in enumerate(nodes):
        if j:
            a, b2 = nodes[j - 1], b
            apart = 0
            while a is not b2:
                if a.depth >= b2.depth:
                    a = a.up
                else:
                    b2 = b2.up
                apart += 1
            edges.append((j - 1, j, NEAR / (1 + apart) * (1.0 if nodes[j - 1].says is b.says else ACROSS)))
        parent = id(b.up or b)
        i = last.get(parent, -1)
        if i >= 0 and nodes[i].says is b.says:
            edges.append((i, j, SIBLING))
        last[parent] = j
    return edges


def minimum_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the content side of a minimum cut.

    Dinic's maximum flow from the content terminal to the boilerplate terminal, in
    thousandths. Ties leave a node on the boilerplate side unless the source reaches it.
    """
    n = len(unary)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a, b, c, back):
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, z in enumerate(unary):
        c = round(abs(z) * 1000)
        if z > 0:
            edge(source, i, c, 0)
        else:
            edge(i, sink, c, 0)
    for i, j, c in edges:
        c = round(c * 1000)
        edge(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(cap[e] for e in path)
                cut = None
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                    if cut is None and not cap[e]:
                        cut = k
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if cap[e] and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(out[a][turn[a]])
                a = to[path[-1]]
            elif a == source:
                break
            else:
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1


def label(found: list[tuple[str, Node, int]], weights: tuple[float, ...] = UNFITTED) -> tuple[list[float], list[bool]]:
    """Each block's log-odds, and whether the minimum cut leaves it with the content."""
    skip = void(found)
    unary = [log_odds(*b, weights, skip) for b in found]
    if not unary or max(unary) <= 0:
        return unary, [False] * len(unary)
    if min(unary) > 0:
        return unary, [True] * len(unary)
    return unary, minimum_cut(unary, smoothness([b[1] for b in found]))


def main_text(page: str | None, weights: tuple[float, ...] = UNFITTED) -> str:
    """Content blocks joined by one space; empty for null, empty or text-less pages."""
    found = blocks(page) if page else []
    return " ".join([b[0] for b, k in zip(found, label(found, weights)[1]) if k])


def extract(pages: DataFrame, weights: tuple[float, ...] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page; null html counts as empty.

    The classifier is fitted on a sample of the pages unless ``weights`` are given.

    Repeated rows each give a row, null ids and urls stay null, other columns are ignored.
    """

    if weights is None:
        weights = fit_weights(pages)

    def run(batches):
        for b in pieces(batches):
            texts = [main_text(p, weights) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
