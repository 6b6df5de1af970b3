"""Main text of a web page by minimum-cut labelling of its blocks.

A page is read into blocks of text in page order. A linear classifier of each block (the cues of what it
stands in, its links, length and punctuation) gives log-odds, which become terminal capacities; neighbours
in the page and in the DOM are joined by smoothness capacities; the minimum cut between the terminals
leaves the content blocks on the source's side. Terminals are squashed to about what a block's edges add
up to, so neighbours can turn a block over. Weights are fixed parameters; nothing is learnt. Blocks whose
terminal outweighs all their edges are settled before the flow.

Defined cases: null or empty html gives an empty text; unclosed tags, comments and quotes end with the
page; character references are decoded; white space in a block becomes one space; blocks are joined by
a newline; repeated rows keep a row each; an empty table gives an empty result; extra columns are kept,
an earlier ``text`` column being replaced.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html import unescape
from math import exp, tanh

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKUP = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>", re.S
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Names of HTML elements (fixed values).
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea select title button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Where a search for an element to close stops.
WALLS = frozenset("ul ol dl table div section article aside nav body form main header footer".split())

#: Log-odds that what an element's own cues say adds to its blocks. They are priors: a block's text, and through
#: the cut its neighbours, can overrule any of them but STRONG ones.
GOOD, WEAK, FORM, STRONG = 2.0, -2.0, -3.0, -6.0
#: Beyond this an inner "article" no longer speaks for content.
LOST = -3.5
#: Terminals are squashed to this range, about what the edges of one block add up to.
RANGE = 3.0
_STRONG = frozenset(
    "nav navbar navigation menu submenu footer sidebar notice cookie cookies consent gdpr banner alert ad ads adv advert adverts advertisement advertising promo"
    " promotion sponsor sponsored comment comments commentlist disqus share sharing breadcrumb breadcrumbs pagination pager subscribe subscription newsletter"
    " signup login popup modal copyright hidden".split()
)
_WEAK = frozenset(
    "header masthead topbar foot aside respond reply replies social related recommend recommended recommendations overlay widget toolbar legal skip tags tagcloud"
    " feedback survey".split()
)
_GOOD = frozenset("article content main post entry story text body prose".split())
_BAD_TAGS = frozenset("nav footer aside menu dialog".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())


def _prior(tag: str, attrs: str, outer: float) -> float:
    """Log-odds of what an element's blocks stand in, given those of what the element itself stands in."""
    if tag in _BAD_TAGS:
        return STRONG
    inside, cue, good = outer > 0, 0.0, tag in ("article", "main")
    if tag == "header" and not inside:
        cue = WEAK
    elif tag in ("form", "fieldset"):
        cue = FORM
    if attrs and not attrs.isspace() and tag not in ("html", "body"):
        names: list[str] = []
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                words = [w.lower() for w in _NAMES.findall(value)]
                if not any(w in ("with", "has", "no", "without") for w in words):
                    names += words
            elif key == "role" and value.lower() in _BAD_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return STRONG
            elif key == "role" and value.lower() in ("main", "article"):
                good = True
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return STRONG
        if not _STRONG.isdisjoint(names):
            return STRONG
        weak = _WEAK.intersection(names)
        if weak and not (inside and weak <= {"header"}):
            cue = min(cue, WEAK)
        elif not _GOOD.isdisjoint(names):
            good = True
    if cue:
        return max(STRONG, outer + cue)
    return max(outer, GOOD) if good and outer > LOST else outer


class Block:
    __slots__ = ("text", "tag", "prior", "parent", "node", "linked")

    def __init__(self, text, tag, prior, parent, node, linked):
        self.text, self.tag, self.prior, self.parent, self.node, self.linked = text, tag, prior, parent, node, linked


def blocks_of(html: str) -> tuple[list[Block], list[int]]:
    """The blocks of a page that hold text, in page order, and the parent of each element (by number)."""
    out: list[Block] = []
    up = [0]
    stack: list[tuple[str, int, float]] = [("", 0, 0.0)]  # tag, number, prior
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, in_link, at, n = 0, False, 0, len(html)

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                tag, node, prior = stack[-1]
                holder = stack[-2][1] if tag in ("p", "li", "td", "th", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6") and len(stack) > 1 else node
                out.append(Block(text, tag, prior, holder, node, min(linked, len(text))))
            parts.clear()
        linked = 0

    def text(raw: str):
        nonlocal linked
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if in_link:
                linked += len(raw)

    def close(tag: str):
        """Leave the innermost open ``tag`` and all that is open in it."""
        if opened[tag]:
            while True:
                left = stack.pop()[0]
                opened[left] -= 1
                if left == tag:
                    break

    while True:
        m = _MARKUP.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attrs = tag.lower(), bool(m[1] or m[4]), (m[3] or m[6] or "")
        if tag == "br":
            parts.append(" ")
        elif tag in RAW:
            if not closing and not attrs.endswith("/"):
                end = re.compile(rf"</{tag}[\s>/]", re.I).search(html, at)
                if end is None:
                    at = n
                else:
                    gt = html.find(">", end.start())
                    at = n if gt < 0 else gt + 1
        elif tag == "a":
            in_link = not closing
        elif tag in BLOCKS or attrs and not closing and tag not in VOID and ("class" in attrs or "id=" in attrs or "hidden" in attrs or "role" in attrs or "style" in attrs):
            block = tag in BLOCKS
            if block:
                flush()
            if closing:
                close(tag)
                in_link = in_link and not block
                continue
            if block:
                if tag in CLOSES:
                    if any(opened[t] for t in CLOSES[tag]):
                        for k in range(len(stack) - 1, 0, -1):
                            if stack[k][0] in CLOSES[tag]:
                                close(stack[k][0])
                                break
                            if stack[k][0] in WALLS:
                                break
                elif stack[-1][0] == "p":
                    close("p")
            outer = stack[-1][2]
            prior = _prior(tag, attrs, outer)
            if not block and prior == outer or tag in VOID or attrs.endswith("/"):
                continue
            if not block:
                flush()
            stack.append((tag, len(up), prior))
            up.append(stack[-2][1])
            opened[tag] += 1
        elif closing and opened[tag]:  # an inline element that had a prior of its own
            flush()
            close(tag)
    flush()
    return out, up


def evidence(b: Block) -> float:
    """Log-odds that a block is content, squashed to RANGE."""
    size, words = len(b.text), b.text.count(" ") + 1
    e = b.prior
    links = b.linked / size
    e -= 4.0 * links if b.prior <= 0 else 1.5 * links
    e += min(words, 40) / 16 - 0.4
    if b.text[-1] in ".!?:;\"'”’…":
        e += 0.5
    if b.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre"):
        e += 0.75
    if "©" in b.text[:40]:
        e -= 4.0
    return RANGE * tanh(e / RANGE)


def smoothness(blocks: list[Block], up: list[int]) -> list[tuple[int, int, float]]:
    """Edges between page neighbours and between a container's blocks in turn.

    An edge is stronger the closer two blocks are in the DOM, and weaker the more the priors of what they
    stand in differ, so that a cut likes to run along the border of a menu or an advert. The way from one
    block to the next through the DOM is walked from both ends; all of them together pass each element twice.
    """
    edges, last = [], {}
    for j, b in enumerate(blocks):
        if j:
            a, steps, x, y = blocks[j - 1], 0, blocks[j - 1].node, b.node
            while x != y:  # numbers grow downwards, so the greater one is not an ancestor of the other
                if x > y:
                    x = up[x]
                else:
                    y = up[y]
                steps += 1
            near = 1.0 if a.parent == b.parent else 1.0 / (1 + steps)
            edges.append((j - 1, j, near * exp(-abs(a.prior - b.prior) / 2)))
        i = last.get(b.parent)
        if i is not None and i < j - 1:
            edges.append((i, j, 0.5 * exp(-abs(blocks[i].prior - b.prior) / 2)))
        last[b.parent] = j
    return edges


def minimum_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True where a node stays on the source's side of a minimum cut (of ties the largest such side).

    A positive score is the capacity from the source, a negative one that to the sink.
    """
    n = len(score)
    score = list(score)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # a terminal that outweighs all edges of its node settles it, and so adds to its neighbours' terminals
        i = todo.popleft()
        if side[i] is None and abs(score[i]) >= sum(near[i].values()):
            side[i] = score[i] >= 0
            for j, w in near[i].items():
                score[j] += w if side[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if left and (min(score[i] for i in left) >= 0 or max(score[i] for i in left) < 0):  # nothing to separate
        for i in left:
            side[i] = score[i] >= 0
    elif left:
        source, sink = n, n + 1
        cap: list[dict[int, float]] = [dict(d) for d in near] + [{}, {}]
        for i in left:
            if score[i] > 0:
                cap[source][i], cap[i][source] = score[i], 0.0
            elif score[i] < 0:
                cap[i][sink], cap[sink][i] = -score[i], 0.0
        _max_flow(cap, source, sink)
        reach, todo = {sink}, deque([sink])
        while todo:  # what can still reach the sink is cut off
            v = todo.popleft()
            for u in cap[v]:
                if u not in reach and cap[u].get(v, 0.0) > 1e-12:
                    reach.add(u)
                    todo.append(u)
        for i in left:
            side[i] = i not in reach
    return [bool(s) for s in side]


def _max_flow(cap: list[dict[int, float]], source: int, sink: int) -> None:
    """Dinic's algorithm; ``cap`` ends as the residual capacities."""
    while True:
        level, todo = {source: 0}, deque([source])
        while todo and sink not in level:
            u = todo.popleft()
            for v, c in cap[u].items():
                if c > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    todo.append(v)
        if sink not in level:
            return
        nexts = {u: iter(list(cap[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                push = min(cap[a][b] for a, b in zip(path, path[1:]))
                back = len(path)
                for k, (a, b) in enumerate(zip(path, path[1:])):
                    cap[a][b] -= push
                    cap[b][a] = cap[b].get(a, 0.0) + push
                    if cap[a][b] <= 1e-12 and k + 1 < back:
                        back = k + 1
                for a in path[back - 1 : -1]:
                    nexts[a] = iter(list(cap[a]))
                del path[back:]
                continue
            for v in nexts[u]:
                if cap[u][v] > 1e-12 and level.get(v, -1) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()


def main_text(html: str | None) -> str:
    """The content blocks of one page, joined by newlines."""
    if not html:
        return ""
    blocks, up = blocks_of(html)
    keep = minimum_cut([evidence(b) for b in blocks], smoothness(blocks, up))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without its html column, with ``text``; each page is labelled where it is read."""

    def texts(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in column], dtype=object)

    kept = [pages[c] for c in pages.columns if c not in (html, "text")]
    return pages.select(*kept, F.pandas_udf(texts, "string")(pages[html].cast("string")).alias("text"))


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
