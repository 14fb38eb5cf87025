"""Main text of web pages by a minimum cut between content and boilerplate.

A page is cut into text blocks. A linear classifier gives each block a cost of being
called content and a cost of being called boilerplate; these are the capacities to the
two terminals. Blocks that follow each other, and blocks under the same parent element,
are joined by smoothness edges. The cheapest labelling is a minimum cut, found by
blocking flows. Blocks whose own costs outweigh all their edges are settled first,
which changes no minimum cut, so the flow runs over the undecided blocks alone.

Null or empty html gives an empty text. Broken markup is read as far as it goes: an
unclosed element ends with its parent, an unclosed comment or script with the page.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from patchloom.llm.tools import portions

# A tag whose quoted values hold no "<"; others are ended by way of _TagEnds.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_MARKS = re.compile(r"[\"'>]")
RAW = frozenset("script style noscript template textarea select svg iframe math object canvas video audio".split())
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_HINT = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rt rp s samp small span "
    "strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An opening tag of the left ends an open element of the right.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dd", "dt", "p"}, "dd": {"dd", "dt", "p"}, "tr": {"tr", "td", "th", "p"},
        "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre "
    "section table ul".split())
# Elements an optional end tag cannot reach across.
BARRIER = frozenset("article aside body div footer header main nav section table ul ol dl td th form blockquote".split())

# Weights of the classifier: log-odds of content, summed over the block's open elements and the block itself.
CONTENT_TAGS = {"article": 6.0, "main": 4.0}
BOILERPLATE_TAGS = {"nav": -12.0, "footer": -12.0, "header": -12.0, "aside": -12.0, "form": -12.0, "button": -12.0, "menu": -12.0,
                    "head": -30.0, "title": -30.0, "dialog": -12.0, "fieldset": -12.0, "address": -4.0}
CONTENT_HINTS = {"article": 2.0, "content": 2.0, "main": 2.0, "entry": 2.0, "post": 1.0, "story": 2.0, "articlebody": 4.0}
BOILERPLATE_HINTS = dict.fromkeys(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay menu nav navigation navbar breadcrumb breadcrumbs sidebar side widget related "
    "recommended share social sharing comment comments reply replies disqus respond footer header masthead copyright newsletter "
    "subscribe subscription signup login search pagination pager skip toolbar tags metadata byline complementary contentinfo".split(),
    -12.0)
# Parts of a name that leave its meaning to the part before them, and parts that speak of a state.
GENERIC = frozenset(
    "list lists box section sections wrapper wrap block blocks area container bar widget menu links link inner outer left right top "
    "bottom item items form button buttons title text body content header footer panel module group holder row col icon image".split())
STATES = frozenset("no has with without is not".split())
PARTLY = -2.0
# Short blocks of this kind belong to no article.
_NOTICE = re.compile(r"©|\(c\) ?\d{4}|all rights reserved|\bcopyright\b", re.I)
NOTICE, NOTICE_WORDS = -4.0, 20
PARAGRAPH, HEADING, BARE = 1.6, 0.5, 0.0
PER_WORD, MOST_WORDS = 0.04, 50
LINKS = -4.0
BIAS = -0.5
SMOOTH_NEXT, SMOOTH_SIBLING = 0.6, 0.6


class Block:
    """A run of text without a block element inside."""

    __slots__ = ("text", "linked", "score", "parent", "tag")

    def __init__(self, text: str, linked: int, score: float, parent: int, tag: str):
        self.text, self.linked, self.score, self.parent, self.tag = text, linked, score, parent, tag


def _name_weight(token: str) -> float:
    """Weight of one class name or id. A listed word counts in full where it is the name, or stands
    before nothing but general parts (``comment-list``); elsewhere (``comments-open``) it counts little."""
    parts = [p.lower() for p in _WORD.findall(token)]
    if not parts or parts[0] in STATES:
        return 0.0
    bad = [k for k, p in enumerate(parts) if p in BOILERPLATE_HINTS]
    if bad:
        last = bad[-1]
        return BOILERPLATE_HINTS[parts[last]] if all(p in GENERIC for p in parts[last + 1 :]) else PARTLY
    return max((CONTENT_HINTS[p] for p in parts if p in CONTENT_HINTS), default=0.0)


def _hint_weight(kind: str, value: str) -> float:
    if kind == "aria-label":
        words = {w.lower() for w in _WORD.findall(value)}
        return min((BOILERPLATE_HINTS[w] for w in words if w in BOILERPLATE_HINTS), default=0.0)
    weights = [_name_weight(token) for token in value.strip("\"'").split()]
    worst = min(weights, default=0.0)
    # one name that says boilerplate outright decides; else the best and the weak ones add up
    return worst if worst < PARTLY else max(0.0, *weights, 0.0) + min(0.0, worst)


def _weight(name: str, attributes: str) -> float:
    weight = CONTENT_TAGS.get(name, 0.0) + BOILERPLATE_TAGS.get(name, 0.0)
    if attributes:
        if name not in ("html", "body"):
            weight += sum(_hint_weight(kind.lower(), value) for kind, value in _HINT.findall(attributes))
        if _HIDDEN.search(attributes):
            weight -= 12.0
    return weight


class _TagEnds:
    """Where a tag ends that opens at a place: the first ``>`` outside quotes, found for all places at
    once by one pass from the page's end."""

    def __init__(self, page: str):
        marks = [(m.start(), m.group()) for m in _MARKS.finditer(page)]
        self.places = [at for at, _ in marks]
        self.ends = [-1] * (len(marks) + 1)
        plain = double = single = -1
        for k in range(len(marks) - 1, -1, -1):
            at, mark = marks[k]
            if mark == ">":
                plain = at
            elif mark == '"':
                plain, double = double, plain
            else:
                plain, single = single, plain
            self.ends[k] = plain

    def __getitem__(self, at: int) -> int:
        return self.ends[bisect_left(self.places, at)]


def tags(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """``start, end, name, closing, attributes`` of every tag; comments, declarations and elements
    whose content is no text have no name. A tag with an open quote ends at the next ``>``."""
    ends, last, at = None, page.rfind(">"), page.find("<")
    while 0 <= at:
        start = at
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield start, end, None, False, ""
        elif at > last:
            return
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) + 1
            yield start, end, None, False, ""
        else:
            found = _TAG.match(page, at)
            if found:
                close, name, attributes, end = *found.groups(), found.end()
            else:
                opened = _NAME.match(page, at)
                if not opened:
                    at = page.find("<", at + 1)
                    continue
                ends = ends or _TagEnds(page)
                close, name = opened.groups()
                stop = ends[opened.end()]
                stop = page.find(">", opened.end()) if stop < 0 else stop
                attributes, end = page[opened.end() : stop], stop + 1
            name = name.lower()
            if name in RAW and not close:
                if not attributes.endswith("/"):
                    finish = _RAW_END[name].search(page, end)
                    end = finish.end() if finish else len(page)
                yield start, end, None, False, ""
            else:
                yield start, end, name, bool(close), attributes
        at = page.find("<", end)


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order."""
    out: list[Block] = []
    # open elements: name, weight summed from the root, number
    path: list[tuple[str, float, int]] = [("", BIAS, 0)]
    number, links, linked, at = 0, 0, 0, 0
    pending: list[str] = []

    def flush() -> None:
        nonlocal linked
        if pending:
            text = _SPACE.sub(" ", entities.unescape("".join(pending))).strip()
            pending.clear()
            if text:
                name, weight, _ = path[-1]
                parent = path[-2][2] if len(path) > 1 else 0
                out.append(Block(text, linked, weight, parent, name))
        linked = 0

    # how often a name is open, so that no path is searched in vain
    opened: dict[str, int] = {}

    def opening(name: str, weight: float) -> None:
        nonlocal number
        number += 1
        path.append((name, path[-1][1] + weight, number))
        opened[name] = opened.get(name, 0) + 1

    def closing(depth: int) -> None:
        for name, _, _ in path[depth:]:
            opened[name] -= 1
        del path[depth:]

    for start, end, name, close, attributes in tags(page):
        if start > at:
            pending.append(page[at:start])
            if links:
                linked += start - at
        at = end
        if name is None:
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if close else 1
            elif name == "br":
                pending.append(" ")
            if not close and attributes and name not in VOID and _weight(name, attributes) < PARTLY:
                # an inline element that is boilerplate by its own marks is a block of its own
                flush()
                opening(name, _weight(name, attributes))
            elif close and path[-1][0] == name:
                flush()
                closing(len(path) - 1)
            continue
        flush()
        if close:
            for depth in range(len(path) - 1 if opened.get(name) else 0, 0, -1):
                if path[depth][0] == name:
                    closing(depth)
                    break
                if path[depth][0] in BARRIER and name not in BARRIER:
                    break
            links = 0
            continue
        ended = ENDS.get(name, ()) if name not in CLOSES_P else ("p",)
        for depth in range(len(path) - 1 if any(opened.get(e) for e in ended) else 0, 0, -1):
            if path[depth][0] in ended:
                closing(depth)
            elif path[depth][0] in BARRIER:
                break
        if name == "body":
            closing(1)
        if name in VOID or attributes.endswith("/"):
            continue
        opening(name, _weight(name, attributes))
    if at < len(page):
        pending.append(page[at:])
    flush()
    return out


def score(block: Block) -> float:
    """Log-odds that a block is content."""
    words = block.text.count(" ") + 1
    tag = block.tag
    kind = PARAGRAPH if tag in ("p", "pre", "blockquote") else HEADING if tag[:1] == "h" and tag[1:].isdigit() else BARE
    share = min(1.0, block.linked / max(1, len(block.text)))
    notice = NOTICE if words <= NOTICE_WORDS and _NOTICE.search(block.text) else 0.0
    return block.score + kind + PER_WORD * min(words, MOST_WORDS) + LINKS * share + notice


def minimum_cut(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (true: content) of least cost: ``-gain`` for a content block of negative
    gain, ``gain`` for a boilerplate block of positive gain, and an edge's weight where its
    ends differ. Ties go to boilerplate."""
    n = len(gains)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    gains = list(gains)
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        a = queue.popleft()
        if label[a] is None and abs(gains[a]) > sum(near[a].values()):
            label[a] = gains[a] > 0
            for b, w in near[a].items():
                del near[b][a]
                gains[b] += w if label[a] else -w
                if label[b] is None:
                    queue.append(b)
            near[a] = {}
    open_ = [a for a in range(n) if label[a] is None]
    if open_:
        place = {a: k for k, a in enumerate(open_)}
        reached = _source_side([gains[a] for a in open_], [{place[b]: w for b, w in near[a].items()} for a in open_])
        for a, on in zip(open_, reached):
            label[a] = on
    return [bool(x) for x in label]


def _source_side(gains: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Which nodes a maximum flow leaves within reach of the source. The flow grows by blocking flows
    over the levels of a breadth-first search, so that each round saturates all shortest paths."""
    n = len(gains)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    arcs: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, there: float, back: float) -> None:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for a, gain in enumerate(gains):
        if gain > 0:
            arc(source, a, gain, 0.0)
        elif gain < 0:
            arc(a, sink, -gain, 0.0)
        for b, w in near[a].items():
            if a < b:
                arc(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue and level[sink] < 0:
            a = queue.popleft()
            for e in arcs[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        tried, path, a = [0] * (n + 2), [], source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                full = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[full] ^ 1]
                del path[full:]
                continue
            own = arcs[a]
            while tried[a] < len(own) and not (room[own[tried[a]]] > 1e-9 and level[to[own[tried[a]]]] == level[a] + 1):
                tried[a] += 1
            if tried[a] < len(own):
                path.append(own[tried[a]])
                a = to[path[-1]]
            elif a == source:
                break
            else:
                a = to[path.pop() ^ 1]
                tried[a] += 1


def main_text(page: str | None) -> str:
    """Content blocks joined by line feeds."""
    if not page:
        return ""
    found = blocks(page)
    edges, last = [], {}
    for k, block in enumerate(found):
        if k:
            edges.append((k - 1, k, SMOOTH_NEXT))
        if block.parent in last:
            edges.append((last[block.parent], k, SMOOTH_SIBLING))
        last[block.parent] = k
    kept = minimum_cut([score(b) for b in found], edges)
    return "\n".join(b.text for b, keep in zip(found, kept) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` (code points) for every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in portions(b, 2)):
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
            ], [id_col, url_col, "text", "n_chars"])

    kind = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    return pages.select(id_col, url_col, html_col).mapInArrow(
        run, f"`{id_col}` {kind[id_col]}, `{url_col}` {kind[url_col]}, text string, n_chars long")
