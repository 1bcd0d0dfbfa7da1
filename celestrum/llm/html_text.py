"""Main text of web pages by minimum-cut labelling.

A page is a row of blocks, the stretches of text between block-level tags. A
logistic classifier of what a block's text looks like (length, links, ends of
sentences, kind of element, neighbours) gives it a log-odds of being content;
that is the capacity of its edge to the source (content) or the sink
(boilerplate). Smoothness edges join blocks that follow each other, more so
blocks of one parent, and, by proximity in the DOM, a block with the nearest
element around it that says what it holds: an article, a menu, a notice. Such
an element is a node of its own, bound to the source or the sink. The minimum cut,
found by maximum flow, is the labelling that pays least in classifier costs and
broken edges.

The classifier is fitted on a bounded sample of pages that have an article
element, which tells their content, from prior weights on; where there are none, the
prior weights hold.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celestrum.llm import shared

#: The classifier is fitted on at most so many pages, of at most so many characters each.
SAMPLE_PAGES = 400
SAMPLE_CHARS = 100_000

# Names of elements, and words in class, id and role.
#: Elements whose contents are no text of the page.
RAW = frozenset("script style template title textarea iframe object canvas audio video select svg button".split())
#: Of these, those within a line of text, and those that go on to the page's end if nothing closes them.
RAW_INLINE = frozenset("script template textarea select svg canvas object audio video button".split())
RAW_TO_END = frozenset("script style title textarea".split())
#: Blocks that may stand in a page's head; others end it.
IN_HEAD = frozenset("head html title meta link style".split())
#: Elements without contents.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block; all others, unknown ones too, are within a line.
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li link main menu meta nav ol optgroup option p pre search section style "
    "summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that an element of this name ends, and those that keep it from doing so.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Elements beyond which a block doesn't end an open paragraph.
SCOPE = frozenset("td th caption table button".split())
BOILERPLATE = frozenset("nav footer aside form fieldset dialog menu head".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "footer foot header masthead topbar sidebar aside rail widget toolbar cookie cookies consent gdpr notice alert popup modal overlay "
    "comment comments commentlist disqus reply replies respond share sharing social follow related recommended recommendations "
    "subscribe subscription newsletter signup login search pagination pager copyright legal disclaimer skip hidden complementary contentinfo".split()
)
GOOD_WORDS = frozenset("article content contents story post entry body main text prose maintext".split())
#: Words that don't change what those beside them say.
NEUTRAL_WORDS = frozenset(
    "box block bar list section wrapper wrap container area inner outer site page global top bottom left right primary secondary item unit slot link links "
    "icon icons panel module row col column group form button buttons sticky fixed small large big new old the and of side thread user users reader readers form policy posts articles stories news topics tags more items entries title".split()
)
#: Words that say nothing of an article's own head.
HEADER_WORDS = frozenset("header masthead".split())
#: Words that speak of the layout around an element, not of what it holds.
MODIFIERS = frozenset("has have with without no not is layout enabled disabled".split())

#: Weights of the classifier before it is fitted, in the order of `_features`.
PRIOR = (-0.2, 0.45, -4.0, 0.8, -0.4, 0.4, -0.3, 0.1, 0.1)
#: How firmly they hold: as if so many examples spoke for them.
FIRMNESS = 200.0
#: Classifier costs are at most so large.
MOST = 3.0
# Weights of the smoothness edges: blocks that follow each other, of one parent, and with elements that say what they hold.
FOLLOWS, SAME_PARENT, IN_CONTENT, IN_BOILERPLATE, OUTSIDE, HINT = 0.3, 0.5, 7.0, 9.0, 5.0, 1.5
#: Capacity of an element's own edge to the source or the sink.
BOUND = 1e6

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.DOTALL)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z]+")
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?(?:false|until-found))|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_SENTENCE = re.compile(r"[.!?。।؟](?:\s|$|[\"'»”)])")


class Element:
    """at and end: the blocks in it; bad: 2 if its names say that it is boilerplate, 1 if they hint at it, 3 if they say that it is a header."""

    __slots__ = ("at", "bad", "end", "good", "keys", "name", "parent")

    def __init__(self, name: str, parent: int, at: int, bad: int, good: bool, keys: tuple[int, int, int]) -> None:
        self.name, self.parent, self.at, self.end, self.bad, self.good, self.keys = name, parent, at, -1, bad, good, keys


class Block:
    """element: the innermost it stands in; name, parent: of the block-level one; linked: share of its text that is links."""

    __slots__ = ("element", "linked", "name", "parent", "text")

    def __init__(self, text: str, element: int, name: str, parent: int, linked: float) -> None:
        self.text, self.element, self.name, self.parent, self.linked = text, element, name, parent, linked


def _hints(attributes: str) -> tuple[int, bool]:
    """2 if a name in class, id or role is one of boilerplate, 1 if it has a word of it among others, 3 if of headers alone; and whether one speaks of content."""
    bad, good = 0, False
    for m in _NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = {w.lower() for w in _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name))}
            if not words.isdisjoint(MODIFIERS):
                continue
            if not words.isdisjoint(BAD_WORDS):
                known = words <= BAD_WORDS | NEUTRAL_WORDS | GOOD_WORDS
                bad = max(bad, (3 if words & BAD_WORDS <= HEADER_WORDS else 2) if known else 1, key=(0, 1, 3, 2).index)
            elif words and words <= GOOD_WORDS | NEUTRAL_WORDS and not words.isdisjoint(GOOD_WORDS):
                good = True
    if _HIDDEN.search(attributes):
        bad = 2
    return bad, good


def parse(page: str) -> tuple[list[Block], list[Element]]:
    """Blocks in page order, and elements, each after its parent; the first stands for the page."""
    blocks: list[Block] = []
    elements = [Element("", 0, 0, 0, False, (0, 0, 0))]
    stack = [0]
    open_: Counter = Counter()
    at, size = 0, len(page)
    pieces: list[str] = []
    linked = links = heads = articles = mains = 0

    def close_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                k = len(stack) - 1
                while k and elements[stack[k]].name not in BLOCK:
                    k -= 1
                blocks.append(Block(text, stack[-1], elements[stack[k]].name, elements[stack[k]].parent, min(1.0, linked / len(text))))
            pieces.clear()
        linked = 0

    def cut_stack(k: int) -> None:
        for e in stack[k:]:
            elements[e].end = len(blocks)
            a, b, c = elements[e].keys
            elements[e].keys = (heads - a, articles - b, mains - c)
            open_[elements[e].name] -= 1
        del stack[k:]

    def close_up(what: set | frozenset, until: set | frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            name = elements[stack[k]].name
            if name in until:
                return
            if name in what:
                cut_stack(k)
                return

    while at < size:
        m = _TAG.search(page, at)
        end = m.start() if m else size
        if end > at:
            piece = page[at:end]
            pieces.append(piece)
            if links:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name = name.lower()
        closing, attributes = (m[1] if m[2] else m[4]) == "/", (m[3] if m[2] else m[6]) or ""
        if name == "br":
            pieces.append(" ")
            continue
        if closing:
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCK:
                close_block()
            if open_[name]:  # else there is nothing to look for
                close_up({name}, frozenset())
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
                at = stop.end() if stop else size if name in RAW_TO_END else at
            if name not in RAW_INLINE:
                close_block()
            continue
        if name == "a":
            links += 1
        if name in BLOCK:
            close_block()
            links = 0 if name == "p" else links
            if open_["head"] and name not in IN_HEAD:
                close_up({"head"}, frozenset())
            if name in CLOSES:
                what, until = CLOSES[name]
                if any(open_[w] for w in what):
                    close_up(what, until)
            elif open_["p"]:  # any block ends an open paragraph
                close_up({"p"}, SCOPE)
        if name in VOID:
            continue
        heads += name == "h1"
        articles += name == "article"
        mains += name == "main"
        bad, good = _hints(attributes) if attributes and name not in ("body", "html") else (0, False)
        elements.append(Element(name, stack[-1], len(blocks), bad, good, (heads, articles, mains)))
        stack.append(len(elements) - 1)
        open_[name] += 1
    close_block()
    cut_stack(0)
    return blocks, elements


def marks(blocks: list[Block], elements: list[Element]) -> tuple[list[int], list[int], list[bool]]:
    """For each element: 1 if it or one around it is content, -1 if boilerplate, else 0; the number of that element; and whether it or one around it hints at boilerplate."""
    upto = [0]
    for b in blocks:
        upto.append(upto[-1] + len(b.text))
    whole = max(1, upto[-1])
    mark, by, hinted = [0], [0], [False]
    for k, e in enumerate(elements[1:], 1):
        share = (upto[e.end] - upto[e.at]) / whole
        heads, articles, mains = e.keys
        # What holds the page's heading or most of it isn't boilerplate, whatever it is called; a form around a whole page isn't one.
        holds = mains > 0 or share > 0.3 and heads > 0 or share > 0.5 and (articles > 0 or e.bad == 1)
        m, at, hint = mark[e.parent], by[e.parent], hinted[e.parent]
        if m >= 0:
            named = e.bad == 2 or m == 0 and (e.bad == 3 or e.name == "header")
            if e.name in BOILERPLATE and not (e.name in ("form", "fieldset") and (holds or share > 0.5)) or named and not holds:
                m, at = -1, k
            elif e.name in CONTENT:
                m, at = 1, k
        hint = hint or e.bad == 1 and not holds
        mark.append(m)
        by.append(at)
        hinted.append(hint)
    if not any(m > 0 and elements[k].end > elements[k].at for k, m in enumerate(mark)):
        # No article: elements that are called so, if they hold a good part of the page.
        for k, e in enumerate(elements[1:], 1):
            if mark[k] == 0 and mark[e.parent] > 0:
                mark[k], by[k] = mark[e.parent], by[e.parent]
            elif mark[k] == 0 and e.good and (upto[e.end] - upto[e.at]) > 0.3 * whole:
                mark[k], by[k] = 1, k
    return mark, by, hinted


def _features(blocks: list[Block]) -> np.ndarray:
    """Constant, length, share of links, whether a sentence ends, list item, heading, cell of a table, and the neighbours' lengths."""
    size = np.array([math.log1p(len(b.text) / 10) for b in blocks])
    return np.stack(
        [
            np.ones(len(blocks)),
            size,
            np.array([b.linked for b in blocks]),
            np.array([bool(_SENTENCE.search(b.text)) for b in blocks]),
            np.array([b.name == "li" for b in blocks]),
            np.array([b.name in HEADINGS for b in blocks]),
            np.array([b.name in ("td", "th") for b in blocks]),
            np.concatenate([[0.0], size[:-1]]),
            np.concatenate([size[1:], [0.0]]),
        ],
        axis=1,
    )


def fit(pages: list[str]) -> np.ndarray:
    """Weights of the classifier: logistic regression from PRIOR on, by Newton's method. Examples: blocks in articles, and those of the same pages that are not, both with the same weight in all."""
    prior = np.array(PRIOR)
    rows, labels = [], []
    for page in pages:
        blocks, elements = parse(page)
        mark, _, _ = marks(blocks, elements)
        if blocks and any(e.name in CONTENT and mark[k] > 0 for k, e in enumerate(elements)):
            rows.append(_features(blocks))
            labels.append(np.array([mark[b.element] > 0 for b in blocks]))
    if not rows:
        return prior
    x, y = np.concatenate(rows), np.concatenate(labels)
    if y.all() or not y.any():
        return prior
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum()) * len(y)
    w = prior.copy()
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + FIRMNESS * (w - prior)
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + FIRMNESS * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return w


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of the cheapest labelling: a node with label false pays max(cost, 0), with true max(-cost, 0), and each edge between different labels its weight."""
    n = len(costs)
    costs = list(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    # What is bound to the source or the sink is one with it; its edges become their neighbours' capacities.
    label: list[bool | None] = [c > 0 if abs(c) >= BOUND else None for c in costs]
    for k in range(n):
        if label[k] is not None:
            for j, w in near[k].items():
                if label[j] is None:
                    del near[j][k]
                    costs[j] += w if label[k] else -w
    left = [k for k in range(n) if label[k] is None]
    if left:
        source_side = _flow(left, costs, near)
        for k in left:
            label[k] = k in source_side
    return [bool(x) for x in label]


def _flow(nodes: list[int], costs: list[float], near: list[dict[int, float]]) -> set[int]:
    """What the source still reaches when the flow to the sink is greatest: flows along shortest paths, all of one length at a time, until there is none."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {k: dict(near[k]) for k in nodes}
    room[source], room[sink] = {}, {}
    for k in nodes:
        c = costs[k]
        room[source][k], room[k][source] = max(c, 0.0), 0.0
        room[k][sink], room[sink][k] = max(-c, 0.0), 0.0
    while True:
        level, todo = {source: 0}, deque([source])
        while todo:
            a = todo.popleft()
            for b, free in room[a].items():
                if free > 1e-9 and b not in level:
                    level[b] = level[a] + 1
                    todo.append(b)
        if sink not in level:
            return set(level) - {source}
        rest = {k: iter(list(room[k])) for k in level}
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                steps = list(zip(path, path[1:], strict=False))
                least = min(room[u][v] for u, v in steps)
                for u, v in steps:
                    room[u][v] -= least
                    room[v][u] += least
                # Back to before the first edge that is full now.
                del path[next(k for k, (u, v) in enumerate(steps) if room[u][v] <= 1e-9) + 1 :]
                continue
            for b in rest[a]:
                if room[a][b] > 1e-9 and level.get(b) == level[a] + 1:
                    path.append(b)
                    break
            else:
                level[a] = -1
                path.pop()


def labelled(page: str, weights: np.ndarray) -> tuple[list[Block], list[bool], np.ndarray]:
    """Blocks, whether each is content, and what the classifier alone says of it (log-odds)."""
    blocks, elements = parse(page)
    if not blocks:
        return [], [], np.zeros(0)
    mark, by, hinted = marks(blocks, elements)
    odds = np.clip(_features(blocks) @ weights, -MOST, MOST)
    n = len(blocks)
    costs, edges = odds.tolist(), []
    node: dict[int, int] = {}

    def element(k: int, content: bool) -> int:
        if k not in node:
            node[k] = len(costs)
            costs.append(BOUND if content else -BOUND)
        return node[k]

    article = any(mark[b.element] > 0 and elements[by[b.element]].name in CONTENT for b in blocks)
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        e = b.element
        if mark[e]:
            edges.append((k, element(by[e], mark[e] > 0), IN_CONTENT if mark[e] > 0 else IN_BOILERPLATE))
        elif article:
            edges.append((k, element(0, False), OUTSIDE))
        if hinted[e]:
            edges.append((k, element(-1, False), HINT))
        if k:
            edges.append((k - 1, k, FOLLOWS))
        if b.parent in last:
            edges.append((last[b.parent], k, SAME_PARENT))
        last[b.parent] = k
    return blocks, minimum_cut(costs, edges)[:n], odds


def main_text(page: str | None, weights: np.ndarray | None = None) -> str:
    """The content blocks, joined by line breaks; '' if there are none."""
    if not page:
        return ""
    blocks, keep, _ = labelled(page, np.array(PRIOR) if weights is None else weights)
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def learn(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights fitted on the sample_pages pages with the least hashes that have an article or main element and at most SAMPLE_CHARS characters."""
    whole = pages.select(F.col("html").cast("string").alias("html")).where((F.length("html") <= SAMPLE_CHARS) & F.lower("html").rlike("<(article|main)[\\s>]"))
    rows = shared.sample(whole, sample_pages, "html").collect()
    return fit([r["html"] for r in rows])


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """pages' columns without html, and text and n_chars (its code points). weights: from `learn`; learned from the pages themselves if None.

    Null or empty html: '' and 0. Broken markup is read as far as it goes; a
    page cut off inside a tag loses that tag alone. Repeated rows stay; columns
    named text or n_chars are replaced, others stay, whatever their names. No
    rows: none. A page takes about fifty times its size in a worker.
    """
    weights = learn(pages) if weights is None else weights
    pages = pages.drop("text", "n_chars")
    columns = [c for c in pages.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                own = batch.slice(at, 500)
                arrays = dict(zip(own.schema.names, own.columns, strict=True))
                texts = [main_text(p.as_py(), weights) for p in arrays.pop("html")]
                yield pa.RecordBatch.from_pydict({c: arrays[c] for c in columns} | {"text": pa.array(texts, type=pa.string()), "n_chars": pa.array([len(t) for t in texts], type=pa.int64())})

    fields = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in columns)
    return pages.select(*columns, F.col("html").cast("string").alias("html")).mapInArrow(run, f"{fields}text string, n_chars bigint")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages)
