"""Code by the tokens of its language: what is a string or a comment, how brackets pair, where
definitions begin and end. One pass over a file each, so the work is linear in its text.

Strings and comments are told apart by one expression a language; everything else looks at code in
which they are blanked out, so a brace or the word `class` in a string of many lines misleads nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import pairwise

#: What the characters of a string become; no pattern of a definition or call meets it.
FILLER = "\x01"
BY_INDENT = ("python", "ruby")
#: Languages whose block comments nest.
_NESTING = ("rust", "kotlin")

_SLASHES, _BLOCK, _HASH = r"//[^\n]*", r"/\*", r"\#[^\n]*"
_LINE_DOUBLE, _LINE_SINGLE = r'"(?:[^"\\\n]++|\\.)*+"?', r"'(?:[^'\\\n]++|\\.)*+'?"
_LONG_DOUBLE, _LONG_SINGLE = r'"(?:[^"\\]++|\\.)*+"?', r"'(?:[^'\\]++|\\.)*+'?"
_TRIPLE_DOUBLE, _TRIPLE_SINGLE = r'"""(?:[^"\\]++|\\.|"(?!""))*+(?:""")?', r"'''(?:[^'\\]++|\\.|'(?!''))*+(?:''')?"
_TEMPLATE = r"`(?:[^`\\]++|\\.)*+`?"
_RUNE = r"'(?:\\.[^'\n]*|[^\\'\n])'"
#: A slash begins a pattern only where a value may stand.
_PATTERN = r"(?<=[=(,:;!&|?{}\[])[ \t]*/(?![*/])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/"
_MACRO = r"^[ \t]*\#[ \t]*define\b(?:[^\\\n]++|\\\r?\n|\\.)*+"
_RAW_C, _RAW_RUST = r'R"(?P<c>\w*)\((?:.*?\)(?P=c)"|.*)', r'\br(?P<r>\#*)"(?:.*?"(?P=r)|.*)'
_HEREDOC = r"<<[~-]?(?P<q>['\"`]?)(?P<tag>[A-Z_]\w*)(?P=q)[^\n]*\n(?:[^\n]*\n)*?[ \t]*(?P=tag)\b"
_RUBY_BLOCK = r"^=begin\b(?:.*?^=end\b[^\n]*|.*)"

_TOKENS = {
    lang: re.compile("|".join(parts), re.S | re.M)
    for lang, parts in {
        "go": (_SLASHES, _BLOCK, r"`[^`]*+`?", _LINE_DOUBLE, _RUNE),
        "c": (_SLASHES, _BLOCK, _MACRO, _RAW_C, _LINE_DOUBLE, _LINE_SINGLE),
        "javascript": (_SLASHES, _BLOCK, _TEMPLATE, _LINE_DOUBLE, _LINE_SINGLE, _PATTERN),
        "typescript": (_SLASHES, _BLOCK, _TEMPLATE, _LINE_DOUBLE, _LINE_SINGLE, _PATTERN),
        "python": (_HASH, _TRIPLE_DOUBLE, _TRIPLE_SINGLE, _LINE_DOUBLE, _LINE_SINGLE),
        "java": (_SLASHES, _BLOCK, _TRIPLE_DOUBLE, _LINE_DOUBLE, _LINE_SINGLE),
        "kotlin": (_SLASHES, _BLOCK, _TRIPLE_DOUBLE, _LINE_DOUBLE, _LINE_SINGLE),
        "rust": (_SLASHES, _BLOCK, _RAW_RUST, _LONG_DOUBLE, _RUNE),
        "ruby": (_RUBY_BLOCK, _HASH, _HEREDOC, _LONG_DOUBLE, _LONG_SINGLE, _PATTERN),
    }.items()
}
_COMMENT_EDGE = re.compile(r"/\*|\*/")
_NOT_LINE_END = re.compile(r"[^\n]")


def _comment_end(text: str, at: int, nests: bool) -> int:
    if not nests:
        end = text.find("*/", at + 2)
        return len(text) if end < 0 else end + 2
    depth = 0
    for m in _COMMENT_EDGE.finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def masked(text: str, lang: str) -> str:
    """The text, as long and with the same lines, whose comments (and macros of C) are blanks and
    whose strings hold only FILLER between their quotes."""
    find, out, done = _TOKENS[lang], [], 0
    while m := find.search(text, done):
        a, b = m.span()
        block = text.startswith("/*", a)
        if block:
            b = _comment_end(text, a, lang in _NESTING)
        token = text[a:b]
        if block or token.startswith(("//", "=begin")) or token.lstrip(" \t").startswith("#"):
            new = _NOT_LINE_END.sub(" ", token)
        else:
            new = _NOT_LINE_END.sub(FILLER, token)
            if len(token) > 1 and token[0] in "\"'`" and token[-1] == token[0]:
                new = token[0] + new[1:-1] + token[0]
        out += text[done:a], new
        done = b
    return "".join([*out, text[done:]])


_MARK = re.compile(r"[(){}\[\];\n]")
_CLOSED_BY = {"(": ")", "[": "]", "{": "}"}


def _brackets(code: str, inner: str) -> tuple[dict[int, int], list[tuple[int, bool]]]:
    """Where each opening bracket closes, and the places where a statement may begin, with whether
    no bracket is open there. inner: the brackets in which statements stand."""
    pair, heads, stack = {}, [(0, True)], []
    for m in _MARK.finditer(code):
        c, at = m[0], m.start()
        if c in _CLOSED_BY:
            stack.append(at)
        elif c in ")]}":
            # what a brace closes ends round and square brackets that nothing has closed
            while c == "}" and stack and code[stack[-1]] != "{":
                stack.pop()
            if stack and _CLOSED_BY[code[stack[-1]]] == c:
                pair[stack.pop()] = at
        elif c == "\n" and stack and code[stack[-1]] != "{" and re.match(r"(?:def|class|func|fn|fun|function|struct|type|public|export)\b", code[at + 1 : at + 12]):
            # a definition at a line's very begin: an earlier bracket was never closed
            while stack and code[stack[-1]] != "{":
                stack.pop()
        if c in "{};\n" and (not stack or code[stack[-1]] in inner):
            heads.append((at + 1, not stack))
    return pair, heads


_STOP = re.compile(r"[({;\n]")
_OPEN_END = re.compile(r"[,(:=>]\s*$")
_GOES_ON = re.compile(r"[ \t]*(?:\{|:|where\b|throws\b|extends\b|implements\b)")


def _signature(code: str, at: int, pair: dict[int, int], blocks: bool) -> tuple[str, int, int]:
    """(text, length of its first line, where it stops): what stands from a place up to a body, a
    semicolon or the end of a line that doesn't go on; arguments are left out."""
    said, first, pos = [], None, at
    length = 0
    while m := _STOP.search(code, pos):
        part = code[pos : m.start()]
        c = m[0]
        said.append(part)
        length += len(part)
        if c == "(" and m.start() in pair:
            said.append("()")
            length += 2
            pos = pair[m.start()] + 1
        elif c == "(" or (c in "{;" and not blocks):
            said.append(c)
            length += 1
            pos = m.end()
        elif c in "{;":
            said.append(c)
            length += 1
            return "".join(said), length if first is None else first, m.start()
        else:
            first = length if first is None else first
            so_far = "".join(said[-3:])
            if not blocks or not (_OPEN_END.search(so_far) or (so_far.strip() and _GOES_ON.match(code, m.end()))):
                return "".join(said), first, m.start()
            said.append(" ")
            length += 1
            pos = m.end()
    rest = code[pos:]
    return "".join([*said, rest]), length + len(rest) if first is None else first, len(code)


_BLANKS = re.compile(r"[ \t]*")
#: Words that stand before brackets and braces without being a name.
_NO_NAMES = frozenset("if for while switch catch return new else throw synchronized try do function when match loop unless until".split())


def definitions(text: str, lang: str, rules: list[tuple[str, re.Pattern]], code: str | None = None) -> list[tuple[str, str, int, int]]:
    """(kind, symbol, start, end) of each definition, in characters, by start. code: masked(), if
    it is known.

    One that begins a line has that line from its begin, and that of its end unless more is
    defined there; others have their own characters only. A definition of a block language ends
    where its body closes, or on its line without one; Python's before the next statement that
    isn't indented deeper, Ruby's at the `end` of its indent.
    """
    code = masked(text, lang) if code is None else code
    blocks = lang not in BY_INDENT
    pair, heads = _brackets(code, "{" if lang != "python" else "")
    begins = {0, *(m.end() for m in re.finditer("\n", code))}
    found = []
    for at, outer in heads:
        if not blocks and at not in begins:
            continue
        midline = at not in begins
        if midline and outer:
            at = _BLANKS.match(code, at).end()
        said, first, stop = _signature(code, at, pair, blocks)
        if not said.strip():
            continue
        for kind, pattern in rules:
            m = pattern.match(said)
            if m and m.end(1) <= first and m[1] not in _NO_NAMES:
                start = at + len(said) - len(said.lstrip(" \t")) if midline else at
                found.append((kind, m[1], start, midline, stop))
                break
    if not blocks:
        return _by_indent(code, lang, sorted(begins), found)
    out = []
    for kind, symbol, start, midline, stop in found:
        end = stop
        if code[stop : stop + 1] == "{":
            end = pair.get(stop, len(code) - 1) + 1
        # what stands within a line isn't followed to the line's end: the line may be the whole file
        if not midline:
            line_end = code.find("\n", end)
            line_end = len(code) if line_end < 0 else line_end
            midline = "{" in code[end:line_end]
        out.append((kind, symbol, start, end + (code[end : end + 1] == ";") if midline else line_end))
    return out


def _by_indent(code: str, lang: str, begins: list[int], found: list) -> list[tuple[str, str, int, int]]:
    lines = [code[a : b - 1] for a, b in pairwise([*begins, len(code) + 1])]
    _, heads = _brackets(code, "")
    statement = {at for at, _ in heads}
    indents = [len(s) - len(s.lstrip(" \t")) for s in lines]
    closed: list[int | None] = [None] * len(lines)
    if lang == "python":
        waiting: list[int] = []
        for i in range(len(lines) - 1, -1, -1):
            if not lines[i].strip() or begins[i] not in statement or lines[i][0] == FILLER:
                continue
            while waiting and indents[waiting[-1]] > indents[i]:
                waiting.pop()
            closed[i] = waiting[-1] if waiting else None
            waiting.append(i)
    else:
        at_indent: dict[int, int] = {}
        for i in range(len(lines) - 1, -1, -1):
            closed[i] = at_indent.get(indents[i])
            if re.match(r"\s*end\b", lines[i]):
                at_indent[indents[i]] = i
    filled, last = [0] * len(lines), 0
    for i, line in enumerate(lines):
        filled[i] = last
        last = i if line.strip() else last
    out = []
    for kind, symbol, start, _, _ in found:
        i = bisect_right(begins, start) - 1
        if lang == "python":
            end = last if closed[i] is None else filled[closed[i]]
        elif re.search(r"\bend\s*$|^\s*def\s+[\w.?!]+\s*(?:\(.*\))?\s+=\s", lines[i]):
            end = i
        else:
            end = last if closed[i] is None else closed[i]
        end = max(end, i)
        out.append((kind, symbol, start, begins[end] + len(lines[end])))
    return out


def chunk_rows(text: str, lang: str, rules: list[tuple[str, re.Pattern]], code: str | None = None) -> Iterator[tuple[str, str, int, int, int, str]]:
    """(kind, symbol, number among equal ones, first line, first byte, body) of each definition."""
    seen: dict[tuple[str, str], int] = {}
    at = line = n_bytes = 0
    for kind, symbol, start, end in sorted(definitions(text, lang, rules, code), key=lambda d: (d[2], -d[3])):
        between = text[at:start]
        line, n_bytes, at = line + between.count("\n"), n_bytes + len(between.encode("utf-8", "surrogatepass")), start
        n = seen[kind, symbol] = seen.get((kind, symbol), -1) + 1
        yield kind, symbol, n, line + 1, n_bytes, re.sub(r"(?:\n[ \t\r]*)+\Z", "", text[start:end])


def around(held: list[tuple], start: int, end: int) -> tuple | None:
    """The innermost of the open (id, start, end) that is longer than a definition; those that are
    over are taken off. Definitions of code nest or stand apart."""
    while held and held[-1][2] < end:
        held.pop()
    return next((c for c in reversed(held) if c[2] - c[1] > end - start), None)


def smallest_at_lines(spans: list[tuple[int, int, str]], n_lines: int) -> list[int]:
    """For each line the number of the smallest of spans(first line, last line, key) over it, of
    equals that with the least key; -1 without one."""
    order = sorted(range(len(spans)), key=lambda i: spans[i][0])
    out, at, opened = [], 0, []
    for line in range(1, n_lines + 1):
        while at < len(order) and spans[order[at]][0] <= line:
            first, last, key = spans[order[at]]
            heappush(opened, (last - first, key, order[at], last))
            at += 1
        while opened and opened[0][3] < line:
            heappop(opened)
        out.append(opened[0][2] if opened else -1)
    return out


def compiled(rules: dict[str, list[tuple[str, str]]]) -> dict[str, list[tuple[str, re.Pattern]]]:
    return {lang: [(kind, re.compile(p, re.A)) for kind, p in own] for lang, own in rules.items()}
