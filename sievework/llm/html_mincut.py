"""HTML extraction by minimum-cut labelling.

A page becomes a graph. Its nodes are the text blocks and those elements that hold several blocks or whose
name says what they are (regions). A logistic classifier gives each block the costs of calling it content or
boilerplate by how it reads; a region has such costs by its name. These costs are bounded and become the
capacities to the two terminals. Neighbours in page order are joined by smoothness edges, and so are a block
and the element that holds it, and an element and the one around it. The minimum cut separates content from
boilerplate: a region's name reaches its blocks only through the edges, and what reads unlike its region may
be cut off from it.

The classifier learns how content reads from blocks in a bounded sample of pages that stand in regions whose
name is plain. Names are no features of it.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: Pages that the classifier learns from, about.
SAMPLE = 400
#: Most that a block's reading may speak for content, and against it if no part of it is linked and if all is.
CONTENT, PLAIN, LINKED = 2.0, 1.0, 2.0
#: What a region's name costs for each block it holds: a plain name, and a class name that often stands around content.
NAMED, HINTED = 3.0, 1.5
#: Smoothness of neighbours, less by half for each level between them.
NEXT = 0.8
#: Edge of a block to its region (in one that its name speaks for, of its part that isn't linked), and to the innermost element that holds it and others.
HOLD, LOOSE = 3.0, 0.9
#: Edge of an element to the one around it: at a region's border, within it, where there is none, and in a region whose parts are never content.
BORDER, TIE, FREE, FIRM = 0.5, 4.0, 2.0, 1000.0

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template iframe textarea title canvas audio video xmp noembed noframes annotation annotation-xml".split())
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
_CLOSES = {"p": frozenset("p".split()), "li": frozenset("li".split()), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "tr": frozenset("tr td th".split()), "td": frozenset("td th".split()), "th": frozenset("td th".split()), "option": frozenset("option".split())}
_CLOSES_P = _BLOCK - {"button", "label", "option", "optgroup", "legend", "summary"}
_SCOPE = frozenset("article section div td th table ul ol dl body html nav aside main header footer form blockquote".split())
_OUT = frozenset("nav aside menu button select option label fieldset dialog head search header footer".split())
_IN = frozenset("article main".split())
_word = lambda words: re.compile(rf"(?:^|[\s_-])(?:{words})(?=$|[\s_\-0-9])", re.I)
_OUT_NAMES = _word(r"nav|navbar|navigation|menu|foot|footer|sidebar|ad|ads|adv|advert\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|comment|comments|disqus|reply|replies|respond|discussion|breadcrumb\w*|copyright|legal|pager|pagination|toolbar|tagcloud|skip")
_SOFT_NAMES = _word(r"head|header|masthead|side|rail|banner|widget|search|form|hidden")
_IN_NAMES = _word(r"article|articlebody|content|post|entry|story|maintext|body|text|main")
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog toolbar".split())
#: Regions: nothing in them is content; their name speaks against it; no name; for it by a class name; for it.
OUT, AGAINST, NONE, HINT, IN = -2, -1, 0, 1, 2
_ENDS = (".", "!", "?", "。", "”", '"', ":", "…")


class Element:
    __slots__ = ("name", "parent", "depth", "number", "link", "region", "border")

    def __init__(self, name: str, parent: Element | None, attrs: str, number: int):
        self.name, self.parent, self.number = name, parent, number
        self.depth = parent.depth + 1 if parent else 0
        self.link = name == "a" or bool(parent and parent.link)
        self.region, self.border = parent.region if parent else NONE, False
        if self.region != OUT:
            said = _said(name, attrs, self.region, parent.name if parent else "")
            if said != NONE:
                self.region, self.border = said, True


def _said(name: str, attrs: str, around: int, parent: str) -> int:
    """The region that an element says it begins, by its name and attributes; ``around``: the one it stands in."""
    out = name in _OUT and not (name == "header" and around > NONE) and not (name == "footer" and parent == "blockquote")
    against, for_, hint = name == "form", name in _IN, False
    for key, a, b, c in _ATTR.findall(attrs) if attrs else ():
        value, key = (a or b or c).strip().lower(), key.lower()
        if key in ("class", "id"):
            out |= bool(_OUT_NAMES.search(value))
            hint |= bool(_IN_NAMES.search(value))
            against |= bool(_SOFT_NAMES.search(value))
        elif key == "role":
            out |= value in _OUT_ROLES
            against |= value == "form"
            for_ |= value in ("main", "article")
        elif key == "itemprop":
            for_ |= value == "articlebody"
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            out = True
    if out:
        return OUT
    if for_:
        return IN
    if against:  # the header of a post is a part of it
        return NONE if around > NONE or hint else AGAINST
    return HINT if hint and around == NONE else NONE


class Block:
    __slots__ = ("text", "linked", "element", "tag")

    def __init__(self, text: str, linked: int, element: Element):
        self.text, self.linked, self.element = text, linked, element
        self.tag = element.name


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order. Scripts, styles, comments and the head's title give none."""
    root = Element("", None, "", 0)
    top, number = root, 0
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    owner = root

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, min(linked, len(text)), owner))
            parts, linked = [], 0

    def block_above(e: Element) -> Element:
        while e.parent and e.name not in _BLOCK:
            e = e.parent
        return e

    def text(a: int, b: int) -> None:
        nonlocal linked, owner
        if b > a:
            s = html.unescape(page[a:b]) if "&" in page[a:b] else page[a:b]
            if not parts:
                owner = block_above(top)
            parts.append(s)
            if top.link:
                linked += len(s.strip())

    def close(names: frozenset[str] | set[str], stop: frozenset[str]) -> None:
        """Closes the nearest open element of ``names``, unless one of ``stop`` is nearer."""
        nonlocal top
        e = top
        while e.parent:
            if e.name in names:
                top = e.parent
                return
            if e.name in stop:
                return
            e = e.parent

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name in _BLOCK:
                flush()
            elif name == "br":
                parts.append(" ")
            if name == "p" and not _open(top, "p"):
                continue
            close({name}, frozenset() if name in _SCOPE else _SCOPE)
            continue
        if name == "br":
            if parts:
                parts.append(" ")
            continue
        if name in _BLOCK:
            flush()
            if name in _CLOSES_P:
                close({"p"}, _SCOPE | {"button"})
            if name in _CLOSES:
                close(set(_CLOSES[name]), _SCOPE - _CLOSES[name] - ({"td", "th"} if name == "tr" else set()))
        if name in _VOID or m.group(3).endswith("/") and name not in _BLOCK and name not in _RAW:
            continue
        if name in _RAW:
            e = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = e.end() if e else end
            continue
        number += 1
        top = Element(name, top, m.group(3), number)
    flush()
    return out


def _open(e: Element | None, name: str) -> bool:
    while e:
        if e.name == name:
            return True
        e = e.parent
    return False


def reading(b: Block) -> list[float]:
    """How a block reads: features of its text alone."""
    n = len(b.text)
    words = b.text.count(" ") + 1
    return [
        1.0, min(math.log1p(n), 8) / 4, min(words, 60) / 30, b.linked / n, float(b.text.endswith(_ENDS)),
        min(b.text.count(",") + b.text.count(". "), 10) / 5, float("©" in b.text or "·" in b.text), float(b.text.count("|") > 1), sum(map(str.isdigit, b.text)) / n, float(words <= 3),
    ]


#: Used where no page tells content from boilerplate by its regions.
DEFAULT = np.array([-2.0, 1.2, 1.0, -5.0, 1.2, 0.6, -2.0, -1.0, -1.0, -0.8])


def costs(blocks: list[Block], weights: np.ndarray) -> list[float]:
    """Bounded log-odds of content of each block, by how it reads."""
    r = np.array([reading(b) for b in blocks])
    return np.clip(r @ weights, -PLAIN - (LINKED - PLAIN) * r[:, 3], CONTENT).tolist()


def graph(blocks: list[Block], odds: list[float]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Log-odds of the nodes, blocks first and then elements, and edges (i, j, weight).

    A region's name counts once for each block that an edge joins to it. Elements without a name that hold
    one block or element are left out.
    """
    n = len(blocks)
    parts: dict[int, int] = {}
    for b in blocks:
        e, new = b.element, True
        while new and e:
            new = e.number not in parts
            parts[e.number] = parts.get(e.number, 0) + 1
            e = e.parent
    members: list[Element] = []
    holder: dict[int, int] = {}  # place in members of the innermost node at or above an element, or -1

    def node_of(e: Element | None) -> int:
        passed, found = [], -1
        while e:
            if e.number in holder:
                found = holder[e.number]
                break
            passed.append(e.number)
            if e.border or parts[e.number] > 1:
                found = len(members)
                members.append(e)
                break
            e = e.parent
        for k in passed:
            holder[k] = found
        return found

    held = [node_of(b.element) for b in blocks]
    up, at = [], 0
    while at < len(members):  # which grow
        up.append(node_of(members[at].parent))
        at += 1
    region = [-1] * len(members)
    for k in sorted(range(len(members)), key=lambda k: members[k].depth):
        region[k] = k if members[k].border else region[up[k]] if up[k] >= 0 else -1

    edges = [(i - 1, i, NEXT * 0.5 ** min(12, _distance(blocks[i - 1].element, blocks[i].element))) for i in range(1, n)]
    counts = [0] * len(members)
    for i, (b, k) in enumerate(zip(blocks, held, strict=True)):
        if k < 0:
            continue
        r = region[k]
        if k != r or members[k].region > NONE:
            edges.append((i, n + k, LOOSE))
        if r >= 0 and (members[r].region != AGAINST or k == r):
            counts[r] += 1
            edges.append((i, n + r, HOLD * (1 - b.linked / len(b.text)) if members[r].region > NONE else HOLD))
    for k, e in enumerate(members):
        if up[k] >= 0:
            edges.append((n + k, n + up[k], BORDER if e.border else FIRM if e.region == OUT else FREE if e.region == NONE else TIE))
    rate = {OUT: -NAMED, AGAINST: -NAMED, NONE: 0.0, HINT: HINTED, IN: NAMED}
    return odds + [rate[e.region] * (1 + counts[k]) if e.border else 0.0 for k, e in enumerate(members)], edges


def _distance(a: Element, b: Element) -> int:
    """Levels from the farther element to the closest common ancestor, less one."""
    n = 0
    while a is not b:
        if a.depth >= b.depth and a.parent:
            a, n = a.parent, n + (a.depth >= b.depth)
        elif b.parent:
            b = b.parent
        else:
            break
    return max(0, n - 1)


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (true: content) that minimise the sum of -odds over content and of the weights of edges between unlike labels. Ties go to content."""
    n = len(odds)
    unary = list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(unary[i]) > sum(near[i].values()) + 1e-12:
            label[i] = unary[i] > 0
            for j, w in near[i].items():
                unary[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        content = _flow(rest, unary, near)
        for i in rest:
            label[i] = i in content
    return [bool(x) for x in label]


def _flow(rest: list[int], unary: list[float], near: list[dict[int, float]]) -> set[int]:
    """Dinic's maximum flow; the nodes that can't reach the sink afterwards are content."""
    n = len(rest)
    s, t = n, n + 1
    place = {i: k for k, i in enumerate(rest)}
    out: list[list[int]] = [[] for _ in range(n + 2)]  # edges by their number; e ^ 1 is the reverse of e
    to: list[int] = []
    cap: list[float] = []

    def add(u: int, v: int, c: float, back: float) -> None:
        out[u].append(len(to))
        out[v].append(len(to) + 1)
        to.extend((v, u))
        cap.extend((c, back))

    for k, i in enumerate(rest):
        if unary[i] >= 0:
            add(s, k, unary[i], 0.0)
        else:
            add(k, t, -unary[i], 0.0)
        for j, w in near[i].items():
            if j > i:
                add(k, place[j], w, w)
    eps = 1e-9
    while True:
        # levels from the sink: a path is found without dead ends but for saturated edges
        level = [-1] * (n + 2)
        level[t] = 0
        queue = [t]
        for v in queue:
            d = level[v] + 1
            for e in out[v]:
                u = to[e]
                if level[u] < 0 and cap[e ^ 1] > eps:
                    level[u] = d
                    queue.append(u)
        if level[s] < 0:
            return {i for k, i in enumerate(rest) if level[k] < 0}
        at = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                f = min(cap[e] for e in path)
                cut = -1
                for k, e in enumerate(path):
                    cap[e] -= f
                    cap[e ^ 1] += f
                    if cut < 0 and cap[e] <= eps:
                        cut = k
                u = to[path[cut] ^ 1]  # back to where the path is saturated
                del path[cut:]
                continue
            edges, k, d = out[u], at[u], level[u] - 1
            while k < len(edges) and not (cap[edges[k]] > eps and level[to[edges[k]]] == d):
                k += 1
            at[u] = k
            if k < len(edges):
                path.append(edges[k])
                u = to[edges[k]]
            elif path:
                level[u] = -1
                u = to[path.pop() ^ 1]
            else:
                break


def labels(blocks: list[Block], weights: np.ndarray = DEFAULT) -> list[bool]:
    """Whether each block is content."""
    if not blocks:
        return []
    return min_cut(*graph(blocks, costs(blocks, weights)))[: len(blocks)]


def extract(page: str, weights: np.ndarray = DEFAULT) -> str:
    """The main text of one page."""
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, k in zip(blocks, labels(blocks, weights), strict=True) if k)


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """Logistic weights of how content reads, from about ``sample`` pages chosen by a hash of their source."""
    n = pages.count()
    share = min(1 << 20, -(-sample * (1 << 20) // max(1, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for t in batch.column(0):
                for b in blocks_of(t.as_py() or ""):
                    if b.element.region in (OUT, IN):
                        rows.append([float(b.element.region == IN), *reading(b)])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], names=["x"])

    source = pages.select(F.col(html_col).cast("string").alias("html")).filter(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < share)
    got = source.mapInArrow(run, "x array<double>").orderBy(F.xxhash64("x")).limit(50 * sample).collect()
    if not got:
        return DEFAULT
    x = np.array([r.x for r in got])
    y, x = x[:, 0], x[:, 1:]
    if y.min() == y.max():
        return DEFAULT
    w = np.zeros(x.shape[1])
    for _ in range(15):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1.0 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 1.0 * w)
    return w


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``pages``: id_col, url_col, text, n_chars (code points).

    The article's blocks in page order, joined by two line feeds; inside a block white space is one space.
    A null or empty page, and one without content, gives an empty text. Broken markup is read as far as
    it goes: tags may be unclosed or cut off. Null and repeated ids and urls stay as they are; an empty
    table gives an empty result; other columns are not looked at. Nothing is cut off, however long.
    """
    weights = fit(pages, html_col, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [extract(t.as_py() or "", weights) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row_id", "row_url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("row_id"), F.col(url_col).alias("row_url"), F.col(html_col).cast("string").alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("row_id", "row_url")]
    return rows.mapInArrow(run, f"row_id {kinds[0]}, row_url {kinds[1]}, text string, n_chars long").select(F.col("row_id").alias(id_col), F.col("row_url").alias(url_col), "text", "n_chars")
