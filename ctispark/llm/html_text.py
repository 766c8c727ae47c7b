"""Main text of web pages by minimum cut.

A page is cut into blocks of text. A classifier gives each block the cost of
calling it content and of calling it boilerplate; these are the capacities
from the source and to the sink. Neighbours in page order, and neighbours
within one element, are tied by smoothness edges. The minimum cut, found by
maximum flow, separates content from boilerplate.
"""

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ctispark.llm.common import read

# Elements by what they do to text.
RAW = "script style title iframe"
#: What stands within these is no text; where they are not closed, the next block closes them.
SKIPPED = frozenset("noscript template svg select".split())
#: What one presses or fills in; a block of nothing else is a control.
CONTROLS = frozenset(("button", "label"))
BREAKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Roles of elements, by name and by names in their class, id and role.
CHROME = frozenset("nav footer aside form header menu dialog".split())
CHROME_WORDS = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup comment comments reply replies disqus share sharing social related recommended widget pagination pager toolbar login search complementary contentinfo".split())
#: Words that may stand beside these in one name; a name with any other word is no role.
BESIDE = frozenset("site page global main top bottom left right inner outer primary secondary first last area wrapper wrap container box bar list section block row col column panel group item items link links button buttons icons form thread posts policy slot unit small large mobile desktop sticky fixed header footer title".split())
BODY = frozenset(("article", "main"))
BODY_WORDS = frozenset("article post content story entry main".split())

#: Weights of the classifier, a logistic model of content: fit() on made pages (tests/llm/page_maker.py, the first 600) found them.
WEIGHTS = (3.71, 2.19, -13.15, -15.2, -13.44, -9.78, 3.14, 4.48, 4.43, 8.97)
#: Smoothness of neighbours in page order, and of neighbours within one element.
NEXT, SIBLING = 0.25, 0.75

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{RAW.replace(' ', '|')})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def roles(attrs: str) -> set[str]:
    """The roles in an element's class, id and role: names of which one word is a role and the others say nothing else."""
    found: set[str] = set()
    for value in ATTR.findall(attrs):
        for name in "".join(value).split():
            parts = [w.lower() for w in NAME.findall(name)]
            if all(w in CHROME_WORDS or w in BODY_WORDS or w in BESIDE or w.isdigit() for w in parts):
                found.update(parts)
    return found


class Block(NamedTuple):
    text: str
    tag: str
    #: Number of the element that directly holds the block's element.
    parent: int
    in_body: bool
    in_chrome: bool
    link_chars: int
    control_chars: int


def blocks(page: str) -> list[Block]:
    """The page's blocks of text, references decoded and white space single."""
    out: list[Block] = []
    # an open element: name, number, in body, in chrome
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
    number, parts, linked, in_link, pressed, in_control, skipping = 0, [], 0, 0, 0, 0, ""

    def flush() -> None:
        nonlocal parts, linked, pressed
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            name, own, body, chrome = stack[-1]
            parent = stack[-2][1] if name in PARAGRAPHS and len(stack) > 1 else own
            out.append(Block(text, name, parent, body, chrome, linked, pressed))
        parts, linked, pressed = [], 0, 0

    def add(text: str) -> None:
        nonlocal linked, pressed
        if skipping:
            return
        parts.append(text)
        if in_link:
            linked += len(text.strip())
        if in_control:
            pressed += len(text.strip())

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m["raw"]:
            parts.append(" ")
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag in SKIPPED:
            skipping = "" if m["end"] else tag
        elif tag == "a":
            in_link = 0 if m["end"] else 1
        elif tag in CONTROLS:
            in_control = 0 if m["end"] else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BREAKS:
            flush()
            in_link, in_control, skipping = 0, 0, ""
            if m["end"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            else:
                while stack[-1][0] in PARAGRAPHS and len(stack) > 1 or stack[-1][0] == tag == "li":
                    stack.pop()
                if tag in VOID:
                    continue
                _, _, body, chrome = stack[-1]
                named = roles(m["attrs"]) if m["attrs"] else set()
                number += 1
                # an article's own header holds its title
                told = (named & CHROME_WORDS) | ({tag} & CHROME)
                own = bool(told - {"header", "masthead"} if body or named & BODY_WORDS else told)
                stack.append((tag, number, body or tag in BODY or bool(named & BODY_WORDS) and not own, chrome or own))
    add(page[at:])
    flush()
    return out


def features(b: Block, marked: bool) -> tuple[float, ...]:
    """What the classifier sees: one, the block's place (marked: the page has blocks within an article), how much of it is links and controls, a sentence's end, length, a heading, the highest heading."""
    chars = max(1, len(b.text))
    return 1.0, b.in_body, marked and not b.in_body, b.in_chrome, min(1.0, b.link_chars / chars), min(1.0, b.control_chars / chars), b.text[-1] in ".!?…。！？:\"”»)", min(1.0, chars / 200), b.tag in HEADINGS, b.tag == "h1"


def scores(found: list[Block]) -> list[float]:
    """For each block of a page the log odds that it is content."""
    marked = any(b.in_body and not b.in_chrome for b in found)
    return [sum(w * x for w, x in zip(WEIGHTS, features(b, marked), strict=True)) for b in found]


def fit(pages: list[tuple[str, list[str]]], strength: float = 0.1, rounds: int = 50) -> list[float]:
    """Weights from pages (html, texts of their content blocks), by Newton's method with a penalty on their squares."""
    x, y = [], []
    for page, content in pages:
        found = blocks(page)
        marked = any(b.in_body and not b.in_chrome for b in found)
        x += [features(b, marked) for b in found]
        y += [b.text in set(content) for b in found]
    x, y = np.array(x, float), np.array(y, float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        w += np.linalg.solve((x.T * (p * (1 - p))) @ x + strength * np.eye(len(w)), x.T @ (y - p) - strength * w)
    return w.tolist()


def max_flow_side(source: list[float], sink: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut; ties are (node, node, capacity), both ways. Dinic's algorithm, iterative."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    near: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((forth, back))

    for i in range(n):
        both = min(source[i], sink[i])  # what flows straight through
        if source[i] > both:
            edge(s, i, source[i] - both, 0.0)
        if sink[i] > both:
            edge(i, t, sink[i] - both, 0.0)
    for a, b, c in ties:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in near[a]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        next_ = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if cap[e] <= 1e-12)
                a = to[path[cut] ^ 1]
                del path[cut:]
            while next_[a] < len(near[a]):
                e = near[a][next_[a]]
                if cap[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    break
                next_[a] += 1
            if next_[a] < len(near[a]):
                path.append(near[a][next_[a]])
                a = to[path[-1]]
            elif path:
                level[a] = -1
                a = to[path.pop() ^ 1]
            else:
                break


def label(found: list[Block]) -> list[bool]:
    odds = scores(found)
    # the cost of calling a block boilerplate is what it loses if it is content, and the other way round
    source = [math.log1p(math.exp(x)) for x in odds]
    sink = [math.log1p(math.exp(-x)) for x in odds]
    ties = [(i, i + 1, NEXT) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if b.parent in last:
            ties.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return max_flow_side(source, sink, ties)


def main_text(page: str) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, content in zip(found, label(found), strict=True) if content)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns keep, then text and n_chars, a row a page. Null and empty pages have an empty text; so have pages without content. Repeated rows are extracted each, pages of any length whole; ties of the cut are boilerplate. Other columns are not returned, whatever their names; an empty table gives an empty one."""
    import pyspark.sql.types as T

    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column(len(keep)).to_pylist()]
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, html).mapInArrow(run, schema)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
