"""Operator 2, HTML extraction by minimum-cut labelling.

A page becomes a sequence of text blocks.  A logistic classifier over tags, class
and id names, link share, length and punctuation gives each block its log-odds of
being content; these are the capacities to the two terminals.  Neighbouring
blocks are joined by an adjacency edge, and blocks with the same parent element
by a DOM edge, weaker the farther apart they are.  The minimum cut labels the
blocks, and the content blocks in page order are the text.

The classifier is fitted here, on the blocks of ``TRAINING_PAGES`` pages that
``generated`` writes with labels from a fixed seed (a bounded sample by its
parameter); names that mark boilerplate or content are features like the others,
so a paragraph under a doubtful name is decided with its neighbours.

The cut is exact and needs time in proportion to the blocks, but for groups of
undecided ones: a block whose capacity outweighs all its edges keeps its own
label, its edges become capacities of its neighbours, and so on; only groups that
are left undecided go through max-flow (Dinic's algorithm).

Edge cases: null or blank html gives ''; unclosed elements, comments, scripts
and cut-off pages are read to their end; text after a script or style goes on
whatever that holds; character references are decoded once; white space inside a
block becomes one blank; pages of any length are read whole; ties go to
boilerplate; repeated rows are extracted one by one; a null page_id or url is
passed on; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import deque
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from motley.llm import textbytes as tb
from motley.session import ship

ADJACENT, SIBLING = 0.8, 1.5
TRAINING_PAGES, RIDGE, SEED = 400, 0.02, 11

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label|style|hidden|type)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Elements whose content is no text of the page; those in _ENDLESS run to the end of the page if they are not closed.
_RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "title", "audio", "video", "xmp", "noembed", "noframes"}
_ENDLESS = {"script", "style", "textarea", "title", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "br"}
_ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_BAD_TAG = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "head", "input", "option", "legend"}
#: Names of boilerplate, and names that are found on it and on articles.
_SURE_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|footer\w*|sidebar\w*|aside|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|comments?|commentlist|repl(?:y|ies)|disqus|discussion|breadcrumbs?|pagination|pager|toolbar|search\w*|login|signup|subscribe\w*|subscription|newsletter|widget\w*|masthead|topbar|copyright|disclaimer|skip)(?:$|[\s_-])", re.I)
_WEAK_NAME = re.compile(r"(?:^|[\s_-])(?:side|share|sharing|social|related|recommend\w*|legal|tags?|taglist|meta|byline|hidden|toc)(?:$|[\s_-])", re.I)
_GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|body|story|text)(?:$|[\s_-])", re.I)
_BAD_ROLE = re.compile(r"navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu|status", re.I)
_HEADINGS = ("h1", "h2", "h3", "h4")
TAGGED, SURE, WEAK = 4, 2, 1


class Block:
    __slots__ = ("bad", "good", "header", "linked", "parent", "parts", "tag")

    def __init__(self, tag, parent, bad, good, header):
        self.tag, self.parent, self.bad, self.good, self.header = tag, parent, bad, good, header
        self.parts, self.linked = [], 0


def _marks(tag: str, rest: str) -> tuple[int, int, int]:
    """The marks of an element on what it holds: bits of boilerplate, whether of content, whether a header."""
    bad, good = TAGGED * (tag in _BAD_TAG), int(tag in ("article", "main"))
    for name, *values in _ATTRIBUTE.findall(rest) if rest.strip(" /\n\t") else ():
        value = values[0] or values[1] or values[2]
        name = name.lower()
        if name in ("class", "id", "aria-label"):
            value = re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", value)
            bad |= SURE * bool(_SURE_NAME.search(value)) | WEAK * bool(_WEAK_NAME.search(value))
            good |= int(bool(_GOOD_NAME.search(value)))
        elif name == "role":
            bad |= TAGGED * bool(_BAD_ROLE.search(value))
            good |= int(value.lower() in ("main", "article"))
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            bad |= TAGGED
    if tag in ("body", "html", "main", "article"):
        bad = 0
    elif good and bad & SURE and not bad & TAGGED:
        bad = bad & ~SURE | WEAK  # names of both kinds
    return bad, good, int(tag == "header")


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with the marks of the elements around them."""
    out: list[Block] = []
    # tag, number, bad, good, header, place of the nearest element that is not inline
    stack: list[tuple[str, int, int, int, int, int]] = [("", 0, 0, 0, 0, 0)]
    places: dict[str, list[int]] = {}  # of open elements by tag
    number, links, fresh, at = 0, 0, True, 0

    def last(tags) -> int:
        """The place of the innermost open element of these tags, 0 if there is none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(place: int) -> bool:
        """Closes the element at ``place`` and all inside it; whether a link was among them."""
        linked = False
        while len(stack) > place:
            tag = stack.pop()[0]
            places[tag].pop()
            linked |= tag == "a"
        return linked

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m["text"] if m["text"] is not None else m["cdata"]
        if text is not None:
            if text.strip():
                if fresh:
                    home = stack[-1][5]
                    around = stack[home - 1][5] if home else 0
                    out.append(Block(stack[home][0], stack[around][1], stack[-1][2], stack[-1][3], stack[-1][4]))
                    fresh = False
                if links:
                    out[-1].linked += len(text)
            if not fresh:
                out[-1].parts.append(text)
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag == "br" and not fresh:
            out[-1].parts.append(" ")
        elif tag not in _INLINE and tag not in _RAW:  # a raw element is left out of the block around it
            fresh = True
        if m["close"]:
            if tag == "a":
                links = max(0, links - 1)
            place = last((tag,))
            if place and (place >= stack[-1][5] or not (tag in _INLINE or tag == "p")):
                close(place)
            continue
        if tag in _RAW and not m["rest"].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if end or tag in _ENDLESS:
                at = end.end() if end else len(page)
            continue
        if tag in _VOID:
            continue
        if tag in _ENDS_P:
            place = last(("p",))
            if place and place >= stack[-1][5] and close(place):
                links = 0
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            place = last({"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,)))
            if place > last(("ul", "ol", "dl", "table", "menu", "div", "section", "article", "select") if tag == "tr" else ("ul", "ol", "dl", "table", "tr", "menu", "div", "section", "article", "select")):
                close(place)
        links += tag == "a"
        number += 1
        bad, good, header = _marks(tag, m["rest"])
        _, _, was_bad, was_good, was_header, home = stack[-1]
        inside = 0 if bad & (SURE | TAGGED) and tag not in ("article", "main") else was_good | good
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, number, was_bad | bad, inside, was_header | header, home if tag in _INLINE else len(stack)))
    return out


def clean(block: Block) -> str:
    return " ".join(unescape("".join(block.parts)).split())


FEATURES = ("bias", "words", "links", "all_links", "sentence", "prose_tag", "heading", "good", "sure_name", "weak_name", "bad_tag", "header", "header_text", "copyright")


def features(block: Block, text: str) -> list[float]:
    """What the classifier sees of a block, in the order of ``FEATURES``."""
    share = min(1.0, block.linked / max(1, sum(map(len, block.parts))))
    return [
        1.0, min(30, text.count(" ") + 1) / 10, share, float(share > 0.9), float(text[-1:] in ".!?:;…\"”"), float(block.tag in ("p", "blockquote", "pre")),
        float(block.tag in _HEADINGS), float(block.good), float(block.bad & SURE > 0), float(block.bad & WEAK > 0), float(block.bad & TAGGED > 0),
        float(block.header and not block.good), float(bool(block.header and block.good and block.tag not in _HEADINGS[:3])), float(text[:1] == "©" or text[:9].lower() == "copyright"),
    ]


def generated(count: int, seed: int) -> list[tuple[str, list[bool]]]:
    """Pages of many layouts with the label (content: True) of each of their blocks."""
    rng = random.Random(seed)
    some = lambda *options: rng.choice(options)
    phrase = lambda low, high: " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))
    pages = []
    for _ in range(count):
        labels: list[bool] = []

        def block(tag, text, content, attributes=""):
            labels.append(content)
            return f"<{tag}{attributes}>{text}</{tag}>"

        def named(names, chance):
            return f' {some("class", "id")}="{rng.choice(names)}"' if rng.random() < chance else ""

        def menu():
            tag = some("nav", "div", "ul", "header", "section")
            links = "".join(block("li", f'<a href="/{k}">{phrase(1, 3)}</a>', False) for k in range(rng.randint(2, 6)))
            return f"<{tag}{named(['menu', 'nav', 'navbar', 'breadcrumbs'], 0.5 if tag != 'nav' else 0.2)}>{links}</{tag}>"

        def aside():
            kind = rng.random()
            names = ["ad", "advert", "sidebar", "cookie-notice", "newsletter", "widget", "promo"] if kind < 0.6 else ["related", "share", "social", "tags", "meta"]
            tag = some("div", "div", "aside", "section")
            inner = block("p" if rng.random() < 0.4 else "div", phrase(2, 14) + some(".", "!", "", ""), False)
            return f"<{tag}{named(names, 0.97)}>{inner}</{tag}>"

        def comments():
            items = "".join(block("p", phrase(4, 25) + ".", False) for _ in range(rng.randint(1, 3)))
            return f"<{some('section', 'div')} {some('id', 'class')}=\"{some('comments', 'comment-list', 'discussion', 'replies')}\">{items}</div>"

        def footer():
            tag = some("footer", "footer", "div")
            return f"<{tag}{named(['footer', 'copyright', 'legal'], 0.9 if tag == 'div' else 0.2)}>" + block("p", some("&copy; ", "", "Copyright ") + phrase(2, 9) + some(".", ""), False) + f"</{tag}>"

        def article():
            tag = some("article", "article", "main", "div", "div", "section")
            weak = rng.random() < 0.25
            names = ["post meta", "content side", "story related", "entry tags", "text share"] if weak else ["content", "post", "article-body", "entry", "story", "x1", "wrap"]
            parts = [block("h1", phrase(2, 8), True)] if rng.random() < 0.9 else []
            for _ in range(rng.randint(2, 8)):
                kind = rng.random()
                if kind < 0.66:
                    parts.append(block(some("p", "p", "p", "div"), phrase(6, 60) + some(".", ".", "!", "?"), True))
                elif kind < 0.76:
                    parts.append(block("p", phrase(1, 4) + some(".", ""), True))
                elif kind < 0.84:
                    parts.append(block(some("h2", "h3"), phrase(1, 5), True))
                elif kind < 0.92:
                    parts.append("<ul>" + "".join(block("li", phrase(2, 9), True) for _ in range(rng.randint(1, 3))) + "</ul>")
                else:
                    parts.append(aside())
            return f"<{tag}{named(names, 0.7 if tag in ('div', 'section') else 0.3)}>{''.join(parts)}</{tag}>"

        pieces = [menu] * rng.randint(0, 2) + [aside] * rng.randint(0, 2) + [article] + [aside] * rng.randint(0, 2) + [comments] * rng.randint(0, 1) + [footer]
        pages.append(("<html><body>" + "".join(p() for p in pieces) + "</body></html>", labels))
    return pages


@lru_cache(maxsize=1)
def weights(count: int = TRAINING_PAGES, seed: int = SEED, ridge: float = RIDGE) -> tuple[float, ...]:
    """The classifier, by Newton's method on the generated pages; ``ridge`` for each block keeps certain features finite."""
    rows, target = [], []
    for page, labels in generated(count, seed):
        found = blocks(page)
        rows += [features(b, clean(b)) for b in found]
        target += labels
    x, y = np.array(rows), np.array(target, float)
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w)) * len(x) / 100
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def cut(values: list[float], parents: list[int]) -> list[bool]:
    """Labels (content: True) of a minimum cut, content only where every minimum cut has it."""
    n = len(values)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    latest: dict[int, int] = {}
    for k, parent in enumerate(parents):
        joined = [(k - 1, ADJACENT)] if k else []
        if parent in latest:
            joined.append((latest[parent], SIBLING / (k - latest[parent])))
        latest[parent] = k
        for j, weight in joined:
            near[k].append((j, weight))
            near[j].append((k, weight))
    value, free = list(values), [sum(w for _, w in edges) for edges in near]
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        k = todo.popleft()
        if label[k] is not None or abs(value[k]) < free[k] or value[k] == free[k]:
            continue
        label[k] = value[k] > 0
        for j, weight in near[k]:
            if label[j] is None:
                value[j] += weight if label[k] else -weight
                free[j] -= weight
                todo.append(j)
    for k in range(n):
        if label[k] is None:
            group, front = [k], [k]
            label[k] = False
            while front:
                for j, _ in near[front.pop()]:
                    if label[j] is None:
                        label[j] = False
                        group.append(j)
                        front.append(j)
            place = {j: i for i, j in enumerate(group)}
            edges = [(place[a], place[b], w) for a in group for b, w in near[a] if a < b and b in place]
            for j, keep in zip(group, max_flow([value[j] for j in group], edges)):
                label[j] = keep
    return label


def max_flow(values: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes the source still reaches after Dinic's algorithm; values above 0 are capacities from it, others to the sink."""
    n = len(values)
    source, sink = n, n + 1
    to: list[list[int]] = [[] for _ in range(n + 2)]
    ends: list[int] = []
    room: list[float] = []

    def edge(a: int, b: int, forth: float, back: float) -> None:
        for x, y, capacity in ((a, b, forth), (b, a, back)):
            to[x].append(len(ends))
            ends.append(y)
            room.append(capacity)

    for k, v in enumerate(values):
        edge(*((source, k) if v > 0 else (k, sink)), abs(v), 0.0)
    for a, b, weight in edges:
        edge(a, b, weight, weight)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in to[a]:
                if room[e] > 1e-12 and level[ends[e]] < 0:
                    level[ends[e]] = level[a] + 1
                    queue.append(ends[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        tried, path, a = [0] * (n + 2), [], source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                first = 0
                for i in range(len(path) - 1, -1, -1):
                    room[path[i]] -= flow
                    room[path[i] ^ 1] += flow
                    if room[path[i]] <= 1e-12:
                        first = i
                a = ends[path[first] ^ 1]
                del path[first:]
                continue
            while tried[a] < len(to[a]):
                e = to[a][tried[a]]
                if room[e] > 1e-12 and level[ends[e]] == level[a] + 1:
                    break
                tried[a] += 1
            if tried[a] < len(to[a]):
                path.append(to[a][tried[a]])
                a = ends[path[-1]]
            elif path:
                a = ends[path.pop() ^ 1]
                tried[a] += 1
            else:
                break


def labelled(page: str, w: tuple[float, ...]) -> list[tuple[str, float, bool]]:
    """The blocks of a page: text, log-odds, label."""
    found = [(b, t) for b in blocks(page) if (t := clean(b))]
    odds = [sum(a * x for a, x in zip(w, features(b, t))) for b, t in found]
    return [(t, v, keep) for (_, t), v, keep in zip(found, odds, cut(odds, [b.parent for b, _ in found]))]


def main_text(page: str | None, w: tuple[float, ...] | None = None) -> str:
    return "\n".join(t for t, _, keep in labelled(page or "", w or weights()) if keep)


def _kernel(w: tuple[float, ...]):
    def run(batches):
        for batch in batches:
            texts = [main_text(h, w) for h in tb.strings(batch.column("html")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    ship(pages.sparkSession)
    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html").mapInArrow(_kernel(weights()), "page_id long, url string, text string, n_chars long")
