"""Text of web pages in one pass over their tags."""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarryline.functions.text import ENTITIES

#: Elements that show nothing, those whose end is a line end, and those around a page's text (fixed values).
HIDDEN = frozenset("script style noscript template svg head".split())
LINE_ENDS = frozenset("p div section article header footer li ul ol tr table h1 h2 h3 h4 h5 h6 pre blockquote figure main nav aside".split())
CHROME = frozenset("nav header footer aside".split())

_PART = re.compile(r"<!--.*?-->|<(?!>)(/?)([a-zA-Z][a-zA-Z0-9]*)?(?![a-zA-Z0-9])[^>]*>", re.DOTALL)
_REFERENCE = re.compile(r"&(?:#([xX]?)([0-9a-fA-F]+)|([A-Za-z][A-Za-z0-9]*));")
_BLANKS = re.compile(r"[ \t\f\v\r]+")


class Page:
    """A page as shown pieces: (characters of markup that it stands for, what it shows)."""

    def __init__(self, html: str):
        self.sizes: list[int] = []
        self.shown: list[str] = []
        #: Number of pieces before each begin and end of the elements that matter.
        self.begins: dict[str, list[int]] = {}
        self.ends: dict[str, list[int]] = {}
        tags = list(_PART.finditer(html))
        closings: dict[str, list[int]] = {}
        for k, m in enumerate(tags):
            if m[1]:
                closings.setdefault((m[2] or "").lower(), []).append(k)
        k, at = 0, 0
        while k < len(tags):
            m = tags[k]
            name, closing = (m[2] or "").lower(), bool(m[1])
            if m.start() > at:
                self._show(m.start() - at, html[at : m.start()])
            if name in HIDDEN and not closing:
                own = closings.get(name, [])
                last = bisect_left(own, k)
                if last < len(own):  # up to its end nothing shows; without an end it hides nothing
                    k = own[last]
                    name = ""
                self._show(1, " ")
            elif m[0].startswith("<!--"):
                self._show(1, " ")
            elif closing:
                self.ends.setdefault(name, []).append(len(self.shown))
                self._show(len(m[0]), "\n" if name in LINE_ENDS else " ")
            else:
                self._show(len(m[0]), "\n" if name == "br" else " ")
                self.begins.setdefault(name, []).append(len(self.shown))
            at = tags[k].end()
            k += 1
        if at < len(html):
            self._show(len(html) - at, html[at:])

    def _show(self, size: int, text: str) -> None:
        self.sizes.append(size)
        self.shown.append(text)

    def spans(self, name: str) -> list[tuple[int, int]]:
        """The pieces of each element of a name, from its begin to the next end."""
        out, after, ends = [], 0, self.ends.get(name, [])
        for begin in self.begins.get(name, []):
            k = bisect_left(ends, begin)
            if begin >= after and k < len(ends):
                out.append((begin, ends[k]))
                after = ends[k] + 1
        return out

    def chosen(self) -> list[str]:
        """What the first main shows, if anything; else the longest article that shows something, of
        equals the first; else all but navigation and the like."""
        full = lambda span: any(not x.isspace() for x in self.shown[slice(*span)])
        for span in self.spans("main")[:1]:
            if full(span):
                return self.shown[slice(*span)]
        articles = [s for s in self.spans("article") if full(s)]
        if articles:
            longest = max(articles, key=lambda s: (sum(self.sizes[slice(*s)]), -s[0]))
            return self.shown[slice(*longest)]
        out = list(self.shown)
        for name in CHROME:
            for begin, end in self.spans(name):
                out[begin : end + 1] = [" "] * (end + 1 - begin)
        return out


def _reference(m: re.Match) -> str:
    if m[3]:
        return ENTITIES.get(m[3].lower(), m[0])
    try:
        number = int(m[2], 16 if m[1] else 10)
    except ValueError:
        return m[0]
    if number > 0x10FFFF:
        return ""
    return "�" if 0xD800 <= number < 0xE000 else chr(number)


def page_text(html: str) -> str:
    """Text of a page: lines without spaces around them, at most one empty line between two."""
    text = _REFERENCE.sub(_reference, "".join(Page(html).chosen()))
    lines: list[str] = []
    for line in text.split("\n"):
        line = _BLANKS.sub(" ", line).strip(" ")
        if line or (lines and lines[-1]):
            lines.append(line)
    return "\n".join(lines).strip(" \t\n\r\f\v")


@F.arrow_udf(StringType())
def _page_texts(html: pa.Array) -> pa.Array:
    # one page at a time becomes a Python string, never the batch
    return pa.array((page_text(x.as_py()) if x.is_valid else None for x in html), pa.string(), size=len(html))


def html_text(html: str | Column) -> Column:
    """page_text() of a column; null stays null."""
    return _page_texts(F.col(html) if isinstance(html, str) else html)
