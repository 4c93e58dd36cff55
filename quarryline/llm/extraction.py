"""Main text of HTML pages by a minimum cut.

A page becomes a list of text blocks, and one node for each of its articles and for what stands
outside them. Each gets two costs from a fixed linear classifier: that of being called content
and that of being called boilerplate; they are the capacities of its edges to the two terminals.
A block's costs come from its own words, links, tag and names; what an article says of its blocks
is said by the article's node, to which smoothness edges join them. An article within an article,
and a part of one that is named as readers' comments, has a node of its own. Only elements that are
never main text (nav, controls of forms and the like) are certain, and header, aside, dialog and form
only for what no article or main within them holds; a form around most of a page's text is its frame
and says nothing. Names of classes are costs among others. Blocks that follow each other, and blocks
with a common parent element, are joined by smoothness edges too. The minimum cut is the labelling
of least total cost. Of a page that would be left without text, the likeliest block is taken for
certain and the cut made anew.

Nodes whose terminal costs differ by more than all their smoothness edges can carry are settled
first (they keep that label in every minimum cut); max-flow runs over what is left.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that begin and end a block, that never show text, and that have no content (fixed values).
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("audio button canvas datalist head iframe map noframes noscript object option script select style svg template textarea title video".split())
RAW = frozenset("script style textarea title iframe noframes noscript xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of these ends where one of the given kind begins, within the nearest container.
CLOSED_BY = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}
CONTAINER = frozenset("ul ol dl table body article section div main".split())

BOILERPLATE_ELEMENTS = frozenset("nav footer menu label legend".split())
#: Boilerplate but for the articles they hold. What such an article says counts like that of one
#: with a boilerplate name around it, but for a form.
SOFT_ELEMENTS = frozenset("aside dialog header form".split())
#: What class, id and role values that name a part of a page are or end with (fixed values).
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus "
    "dropdown feedback footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promoted promotion "
    "related replies reply respond rss search share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets alert".split()
)
#: Those of them that name what readers wrote.
READER_WORDS = frozenset("comment comments commentlist disqus replies reply respond feedback".split())
#: Last parts of names that tell a shape only: the part before counts. Names with one of STATES
#: tell what a page has elsewhere (has-sidebar).
SHAPES = frozenset("area bar block box buttons container group inner item items links list panel section wrap wrapper".split())
STATES = frozenset("has have hide is no not show with without".split())
CONTENT_WORDS = frozenset("article body content entry main page post prose story text".split())

#: Classifier weights, in nats (fixed values).
BIAS, WORDS, LINKS, PARAGRAPH, HEADING, CONTENT_NAME, LIST_LINK, CERTAIN = -2.0, 0.55, 4.0, 0.8, 0.4, 1.2, 1.5, 1e3
#: Cost of a boilerplate name.
BOILERPLATE_NAME = 4.5
#: Log-odds that each of its blocks adds to an article's node, and to that of the outside.
ARTICLE, OUTSIDE = 3.0, -1.6
#: Smoothness of neighbours in page order, of neighbours with one parent element, and of a block
#: and the node of its article or of the outside.
ADJACENT, SIBLING, MEMBER = 0.4, 0.8, 3.0

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(>?)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DISPLAY_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Block:
    text: str
    linked: int  # characters of text in links
    parent: int  # number of the parent element
    tag: str
    article: int  # number of the article, or part of one, around it, or 0
    form: int  # number of the form around it, outside articles, or 0
    boilerplate: bool  # for certain
    named_boilerplate: bool
    around: bool  # what stands around its article has a boilerplate name
    named_content: bool


@dataclass(slots=True)
class Element:
    tag: str
    number: int
    hidden: bool = False
    boilerplate: bool = False
    soft: bool = False  # boilerplate, but for articles
    form: int = 0
    article: int = 0
    named_boilerplate: bool = False
    around: bool = False
    named_content: bool = False
    link: bool = False


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, decoded, with single spaces; none empty."""
    out: list[Block] = []
    stack = [Element("", 0)]
    number, at, n = 0, 0, len(page)
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                own = next(e for e in reversed(stack) if e.tag in BLOCK or not e.tag)
                out.append(Block(text, min(linked, len(text)), own.number, own.tag, own.article, own.form, stack[-1].boilerplate or stack[-1].soft, stack[-1].named_boilerplate, stack[-1].around, own.named_content))
            parts.clear()
            linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        top = stack[-1]
        if raw and not top.hidden:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if top.link:
                linked += len(text.strip())

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            say(page[at:])
            break
        found = _TAG.match(page, begin)
        if not found:
            if begin + 1 < n and (page[begin + 1].isalpha() or page[begin + 1] == "/"):
                say(page[at:begin])
                break  # a tag that the page's end cuts off
            if page[begin + 1 : begin + 2] == "/":
                say(page[at:begin])
                at = (page.find(">", begin) + 1) or n
                continue
            say(page[at : begin + 1])
            at = begin + 1
            continue
        say(page[at:begin])
        at = found.end()
        closing, tag, attributes, end = found[1], found[2], found[3], found[4]
        if tag is None:
            continue
        if not end:  # an odd quote ends with the tag; a tag without an end is cut off
            close = page.find(">", at)
            if close < 0:
                break
            at = close + 1
        tag = tag.lower()
        if closing:
            if tag in BLOCK:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in CONTAINER and tag not in BLOCK:
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if stack[-1].tag != "" and tag != "hr":
                _close_implied(stack, tag)
        if tag in VOID:
            continue
        top = stack[-1]
        number += 1
        element = Element(
            tag, number, top.hidden or tag in HIDDEN, top.boilerplate or tag in BOILERPLATE_ELEMENTS, top.soft, top.form, top.article,
            top.named_boilerplate, top.around, top.named_content, top.link or tag == "a",
        )
        if tag == "article" or (tag == "main" and not top.article):
            # an article stands for itself, whatever is said of what is around it
            element.article = number
            element.around = top.around or top.named_boilerplate or top.soft
            element.named_boilerplate = element.soft = False
            element.form = 0
        elif tag == "form" and not top.article and not top.soft:
            element.form = number
        elif tag in SOFT_ELEMENTS and not (tag == "header" and top.article):
            element.soft = True
        if attributes and tag not in ("html", "body"):
            found_attributes = attributes_of(attributes)
            if _unseen(found_attributes):
                element.hidden = True
            names = [n for a in ("class", "id", "role") for n in found_attributes.get(a, "").lower().split()]
            words = {w for n in names for w in _WORD.findall(n)}
            if tag in ("article", "main"):
                if top.article and any(_names_boilerplate(n, READER_WORDS) for n in names):
                    element.around = True
            elif any(map(_names_boilerplate, names)):
                element.named_boilerplate = True
                if top.article and any(_names_boilerplate(n, READER_WORDS) for n in names):
                    element.article, element.around = number, True
            elif words & CONTENT_WORDS and not words & BOILERPLATE_WORDS:
                element.named_content = True
        if not attributes.endswith("/") or tag in BLOCK or tag in RAW:
            stack.append(element)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            stack.pop()
            if not close:
                break
            at = (page.find(">", close.end()) + 1) or n
    flush()
    return out


def attributes_of(raw: str) -> dict[str, str]:
    """The attributes of a tag by name in lower case, decoded; of a repeated one the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        value = m[2] or m[3] or m[4] or ""
        out.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return out


def _unseen(attributes: dict[str, str]) -> bool:
    if attributes.get("hidden", "until-found").strip().lower() != "until-found":
        return True
    return attributes.get("aria-hidden", "").strip().lower() == "true" or bool(_DISPLAY_NONE.search(attributes.get("style", "")))


def _names_boilerplate(name: str, words: frozenset[str] = BOILERPLATE_WORDS) -> bool:
    parts = _WORD.findall(name)
    if STATES.intersection(parts):
        return False
    while len(parts) > 1 and parts[-1] in SHAPES:
        parts.pop()
    return bool(parts) and parts[-1] in words


def _close_implied(stack: list[Element], tag: str) -> None:
    """A block ends an open paragraph; list and table parts end their own kind."""
    for i in range(len(stack) - 1, 0, -1):
        own = stack[i].tag
        if own == "p":
            del stack[i:]
            return
        if own in CONTAINER:
            return
        if tag in CLOSED_BY.get(own, "").split():
            del stack[i:]
            return


def score(block: Block, plain: bool = False, frame: int = 0) -> float:
    """Log-odds of being content. plain: the page has an article with no boilerplate name
    around it, which makes those with such a name comments or teasers. frame: the form around
    most of the page's text."""
    if block.boilerplate:
        return -CERTAIN
    words = block.text.count(" ") + 1
    share = block.linked / max(len(block.text), 1)
    s = BIAS + WORDS * math.log1p(words) - LINKS * share
    if block.named_boilerplate or (block.around and plain) or (block.form and block.form != frame):
        s -= BOILERPLATE_NAME
    if block.tag == "p":
        s += PARAGRAPH
    elif block.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        s += HEADING
    elif block.tag == "li" and share > 0.8:
        s -= LIST_LINK
    if block.named_content:
        s += CONTENT_NAME
    return s


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    edges, last = [], {}
    for i, b in enumerate(blocks):
        weight = ADJACENT if i else 0.0
        j = last.get(b.parent)
        if j is not None and j == i - 1:
            weight += SIBLING
        elif j is not None:
            edges.append((j, i, SIBLING))
        if i:
            edges.append((i - 1, i, weight))
        last[b.parent] = i
    return edges


def network(blocks: list[Block]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Log-odds and smoothness edges of the blocks and, behind them, of a node for each article
    and one for the outside, on pages that have an article."""
    articles = [b for b in blocks if b.article and not b.boilerplate]
    plain = any(not b.around for b in articles)
    frame = _frame(blocks)
    scores, edges = [score(b, plain, frame) for b in blocks], smoothness(blocks)
    if not articles:
        return scores, edges
    sizes = Counter(b.article for b in blocks)
    around = {b.article for b in blocks if b.around and plain}
    place = {k: len(blocks) + i for i, k in enumerate(sizes)}
    scores += [n * (ARTICLE if k and k not in around else OUTSIDE) for k, n in sizes.items()]
    return scores, edges + [(i, place[b.article], MEMBER) for i, b in enumerate(blocks)]


def _frame(blocks: list[Block]) -> int:
    """The form that holds over half of the text outside menus and the like, or 0."""
    sizes: Counter[int] = Counter()
    for b in blocks:
        if not b.boilerplate and not b.named_boilerplate:
            sizes[b.form] += len(b.text) - b.linked
    form, size = max(sizes.items(), key=lambda x: (x[1], -x[0]), default=(0, 0))
    return form if 2 * size > sizes.total() else 0


def content_blocks(blocks: list[Block]) -> list[bool]:
    """Which blocks are content by the minimum cut; where none would be, the one of the best score
    that is no link, has no boilerplate name and isn't boilerplate for certain, and what goes with it."""
    scores, edges = network(blocks)
    keep = minimum_cut(scores, edges)[: len(blocks)]
    if any(keep):
        return keep
    able = [i for i, b in enumerate(blocks) if not b.boilerplate and not b.named_boilerplate and not b.around and 2 * b.linked < len(b.text)]
    if not able:
        return keep
    scores[max(able, key=lambda i: (scores[i], -i))] = CERTAIN
    return minimum_cut(scores, edges)[: len(blocks)]


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the blocks on the content side of a minimum cut; of several such cuts the one
    with the most blocks on the content side."""
    n = len(scores)
    label: list[bool | None] = [None] * n
    around: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        around[a].append((b, w))
        around[b].append((a, w))
    gain = list(scores)
    room = [sum(w for _, w in x) for x in around]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(gain[i]) > room[i]:
            label[i] = gain[i] > 0
            for j, w in around[i]:
                if label[j] is None:
                    gain[j] += w if label[i] else -w
                    room[j] -= w
                    todo.append(j)
    open_ = [i for i in range(n) if label[i] is None]
    if open_:
        place = {i: k for k, i in enumerate(open_)}
        inner = [(place[a], place[b], w) for a, b, w in edges if a in place and b in place]
        for i, side in zip(open_, _max_flow([gain[i] for i in open_], inner), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _max_flow(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Shortest augmenting paths from the content terminal to the boilerplate terminal."""
    n = len(gain)
    source, sink = n, n + 1
    to, room, out = [], [], [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        for x, y, c in ((a, b, forth), (b, a, back)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)

    for i, g in enumerate(gain):
        if g > 0:
            join(source, i, g, 0.0)
        elif g < 0:
            join(i, sink, -g, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        following = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:  # a blocking flow, without recursion
            if x == sink:
                pushed = min(room[e] for e in path)
                for e in path:
                    room[e] -= pushed
                    room[e ^ 1] += pushed
                k = next(k for k, e in enumerate(path) if room[e] <= least)
                x = to[path[k] ^ 1]
                del path[k:]
                continue
            while following[x] < len(out[x]):
                e = out[x][following[x]]
                if room[e] > least and level[to[e]] == level[x] + 1:
                    break
                following[x] += 1
            else:
                if x == source:
                    break
                level[x] = -1
                e = path.pop()
                x = to[e ^ 1]
                following[x] += 1
                continue
            path.append(e)
            x = to[e]
    # boilerplate: what can still reach the sink
    reach = [False] * (n + 2)
    reach[sink] = True
    queue = deque([sink])
    while queue:
        x = queue.popleft()
        for e in out[x]:
            if room[e ^ 1] > least and not reach[to[e]]:
                reach[to[e]] = True
                queue.append(to[e])
    return [not r for r in reach[:n]]


def main_text(page: str | None) -> str:
    """The content blocks of a page, one per line; '' for a null or empty page."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, k in zip(blocks, content_blocks(blocks), strict=True) if k)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [main_text(h) for h in part.column(part.num_columns - 1).to_pylist()]
            columns = [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], "text", "n_chars"])


def extract_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars per row of pages; nothing is shuffled.

    A null html is an empty page with an empty text. Tags and references that the page's end
    cuts off are dropped or left as they stand. Rows that repeat a page_id are pages each. Columns
    other than page_id, url and the html play no part.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", html_column).mapInArrow(_run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
