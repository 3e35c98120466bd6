"""Main text of a page by minimum-cut labelling.

Blocks of text are the nodes of a graph. What a block's own features say for or
against content becomes its terminal capacities; blocks that follow each other,
or that share a container, are tied by smoothness edges that weaken with their
distance in the document tree. A maximum flow separates content from the rest.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import Batches, small_batches, text_of

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<bad>/?[a-zA-Z][^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their text is code or a form's own, not marked-up prose.
RAW = frozenset(("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"))
# These end an open paragraph, or an open element of their own kind.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
CLOSES_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
              "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section main aside nav header footer div body html form".split())


@dataclass(frozen=True)
class Costs:
    """Log-odds for content, and the strength of ties. Parameters of the labelling.

    What a container says is soft: a short or linked block inside an article is
    in doubt by itself, and its ties to the blocks around it decide.
    """

    base: float = -1.0
    word: float = 0.35  # per logarithm of the words
    sentence: float = 0.5  # ends as a sentence does
    linked: float = -3.0  # share of characters inside links
    inside: dict[str, float] = field(default_factory=lambda: dict(
        article=0.3, main=0.3, p=0.7, h1=0.7, h2=0.7, h3=0.7, h4=0.7, h5=0.7, h6=0.7, blockquote=0.7,
        pre=1.0, figcaption=0.7, li=1.0, dt=1.0, dd=1.0, td=1.0, th=1.0, caption=0.7,
        nav=-6.0, footer=-6.0, aside=-6.0, form=-6.0, menu=-6.0, dialog=-6.0, button=-6.0, select=-6.0,
        script=-99.0, style=-99.0, template=-99.0, noscript=-99.0, svg=-99.0, head=-99.0, title=-99.0, textarea=-99.0,
        iframe=-99.0, object=-99.0, canvas=-99.0, xmp=-99.0, noembed=-99.0, noframes=-99.0,
    ))
    page_header: float = -6.0  # a header that no article or main encloses
    named_content: float = 2.5
    named_other: float = -6.0
    neighbour: float = 1.2
    sibling: float = 0.8
    fade: float = 0.1  # of a neighbour's tie for each step by which they are farther apart than siblings


COSTS = Costs()
# Parts of class, id and role values that name content, or what is not.
CONTENT_NAMES = frozenset("article content entry main post story body text".split())
OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside nav navbar"
    " navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices notification alert popup modal"
    " overlay newsletter subscribe signup login search social share sharing related recommended recommendations teaser widget"
    " comment comments reply replies disqus discussion respond pagination pager toolbar copyright legal gdpr paywall".split()
)


def _name_cost(rest: str, costs: Costs) -> float:
    names = {p.lower() for m in _ATTRIBUTE.finditer(rest) for p in _NAME_PARTS.findall(html.unescape(m[2] or m[3] or m[4] or ""))}
    if names & OTHER_NAMES:
        return costs.named_other
    return costs.named_content if names & CONTENT_NAMES else 0.0


class _Node:
    """An open element: its place in the tree and what it and its ancestors say for content."""

    __slots__ = ("content", "cost", "depth", "parent", "tag")

    def __init__(self, tag: str, parent: _Node | None, cost: float, content: bool) -> None:
        self.tag, self.parent, self.cost, self.content = tag, parent, cost, content
        self.depth = parent.depth + 1 if parent else 0


def _child(parent: _Node, tag: str, rest: str, costs: Costs) -> _Node:
    own = costs.inside.get(tag, 0.0)
    if tag == "header" and not parent.content:
        own = costs.page_header
    if rest and tag not in ("html", "body"):
        own += _name_cost(rest, costs)
    return _Node(tag, parent, parent.cost + own, parent.content or tag in ("article", "main"))


def blocks(page: str, costs: Costs = COSTS) -> list[tuple[str, float, _Node]]:
    """(text, log-odds for content, container) of the page's blocks, in page order."""
    top = _Node("", None, costs.base, False)
    node, found, parts, linked, in_link, at = top, [], [], 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                score = node.cost + costs.word * math.log(text.count(" ") + 1) + costs.linked * min(1.0, linked / len(text))
                found.append((text, score + costs.sentence * (text[-1] in ".!?…"), node))
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        text = html.unescape(text)
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    while at < len(page):
        token = _TOKEN.search(page, at)
        if token is None:
            take(page[at:])
            break
        if token.start() > at:
            take(page[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if not page.endswith(">", 0, at):
            break  # the page ends inside a tag
        if token["close"]:
            if tag == "a":
                in_link = 0
            if tag in INLINE:
                continue
            flush()
            open_one = node
            while open_one is not top and open_one.tag != tag:
                open_one = open_one.parent
            if open_one is not top:
                node = open_one.parent
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 1
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        in_link = 0
        if tag in VOID:
            continue
        for closed in (("p",) if tag in CLOSES_P else ()) + CLOSES_OWN.get(tag, ()):
            open_one = node
            while open_one is not top and open_one.tag != closed and open_one.tag not in SCOPES:
                open_one = open_one.parent
            if open_one is not top and open_one.tag == closed:
                node = open_one.parent
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if tag not in ("script", "style"):
                node = _child(node, tag, "", costs)
                take(page[at:stop])
                flush()
                node = node.parent
            close = page.find(">", stop)
            at = close + 1 if end and close >= 0 else len(page)
            continue
        node = _child(node, tag, token["rest"], costs)
    flush()
    return found


def _distance(a: _Node, b: _Node) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def ties(found: list[tuple[str, float, _Node]], costs: Costs = COSTS) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block to the next one, and to the next of its container."""
    out, last = [], {}
    for i, (_, _, node) in enumerate(found):
        if i:
            out.append((i - 1, i, costs.neighbour * costs.fade ** max(0, _distance(found[i - 1][2], node) - 2)))
        holder = id(node.parent)
        if holder in last and last[holder] < i - 1:
            out.append((last[holder], i, costs.sibling))
        last[holder] = i
    return out


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source: capacity ``score`` from the source, ``-score`` to the sink.

    A node whose own capacity is at least that of all its ties keeps its side in
    some minimum cut; such nodes are settled first and their ties become their
    neighbours' capacities. A maximum flow over the others, by augmenting along
    shortest paths, finds the rest.
    """
    n = len(scores)
    score = list(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    free = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    ready = deque(i for i in range(n) if abs(score[i]) >= free[i])
    while ready:
        i = ready.popleft()
        if side[i] is not None:
            continue
        side[i] = score[i] > 0
        for j, w in near[i].items():
            if side[j] is None:
                score[j] += w if side[i] else -w
                free[j] -= w
                if abs(score[j]) >= free[j] - 1e-12:
                    ready.append(j)
    left = [i for i in range(n) if side[i] is None]
    if left:
        for i, s in zip(left, _cut_by_flow(left, score, near), strict=True):
            side[i] = s
    return side


def _cut_by_flow(nodes: list[int], score: list[float], near: list[dict[int, float]]) -> list[bool]:
    inside = set(nodes)
    rest = {i: {j: w for j, w in near[i].items() if j in inside} for i in nodes}
    spare = {i: score[i] for i in nodes}  # above 0: still to come from the source; below: still to go to the sink
    while True:
        origin: dict[int, int] = {i: -1 for i in nodes if spare[i] > 1e-12}
        queue, goal = deque(origin), -1
        while queue:
            i = queue.popleft()
            if spare[i] < -1e-12:
                goal = i
                break
            for j, w in rest[i].items():
                if w > 1e-12 and j not in origin:
                    origin[j] = i
                    queue.append(j)
        if goal < 0:
            return [i in origin for i in nodes]
        path = [goal]
        while origin[path[-1]] >= 0:
            path.append(origin[path[-1]])
        flow = min(-spare[goal], spare[path[-1]], *(rest[b][a] for a, b in zip(path, path[1:], strict=False)))
        spare[goal] += flow
        spare[path[-1]] -= flow
        for a, b in zip(path, path[1:], strict=False):
            rest[b][a] -= flow
            rest[a][b] += flow


def main_text(page: str, costs: Costs = COSTS) -> str:
    """The content blocks of one whole page, joined by line feeds."""
    found = blocks(page, costs)
    kept = minimum_cut([s for _, s, _ in found], ties(found, costs))
    return "\n".join(text for (text, _, _), k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame, costs: Costs = COSTS) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row; nothing is shuffled.

    A null or empty page, one without content, and an empty table give no text
    and no rows; long pages are read whole. White space inside a block becomes
    one space. A page cut off anywhere is read as
    far as it goes; a tag cut off is left out. Repeated rows give repeated results.
    """

    def work(batches: Batches) -> Batches:
        for batch in small_batches(batches):
            texts = [main_text(p, costs) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text_of("html"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
