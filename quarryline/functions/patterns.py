"""Regular expressions of POSIX tools in the form that Spark's functions read."""

from __future__ import annotations

import re

#: Characters that Java's expressions give a meaning.
SPECIAL = set("\\[](){}.*+?^$|")
#: POSIX classes and their Java names (fixed values).
CLASSES = {
    "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "blank": r"\p{Blank}",
    "punct": r"\p{Punct}", "print": r"\p{Print}", "graph": r"\p{Graph}", "cntrl": r"\p{Cntrl}", "xdigit": r"\p{XDigit}",
}
_BRACKET = re.compile(r"\[(\^?)(\]?(?:\[:\w+:\]|[^\]])*)\]")


def posix_pattern(pattern: str, extended: bool = False) -> str:
    """A basic expression, where + ? | ( ) { } mean themselves unless escaped, or an extended one,
    where it is the other way round. In brackets a backslash means itself."""
    out, at, start = [], 0, True
    while at < len(pattern):
        c, begins = pattern[at], start
        start = False
        if c == "[" and (m := _BRACKET.match(pattern, at)):
            out.append(f"[{m[1]}{_members(m[2])}]")
            at = m.end()
            continue
        if c == "\\" and at + 1 < len(pattern):
            c = pattern[at + 1]
            at += 2
            if c in "+?|(){}" and not extended:
                out.append(c)
                start = c in "(|"
            elif c in "<>":
                out.append(r"\b")
            elif c.isdigit() or c in "wWsSbB":
                out.append("\\" + c)
            else:
                out.append("\\" + c if c in SPECIAL else re.escape(c))
            continue
        at += 1
        if c in "+?|(){}" and not extended:
            out.append("\\" + c)
        elif c == "*" and begins:
            out.append(r"\*")
        elif c == "^" and not extended and not begins:
            out.append(r"\^")
        elif c == "$" and not extended and pattern[at : at + 2] not in ("", r"\)", r"\|"):
            out.append(r"\$")
        elif c == "{" and not re.match(r"\d*,?\d*\}", pattern[at:]):
            out.append(r"\{")
        else:
            out.append(c)
            start = c in "(|^"
    return "".join(out)


def _members(text: str) -> str:
    parts = re.split(r"(\[:\w+:\])", text)
    return "".join(CLASSES.get(p[2:-2], "") if p.startswith("[:") and p.endswith(":]") else re.sub(r"([\\\[\]&^])", r"\\\1", p) for p in parts)
