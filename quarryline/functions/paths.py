"""Path predicates and glob patterns as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.schemas import LANGUAGE_OF, SKIP_DIRS


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def language_of(path: str | Column) -> Column:
    """Language by the last extension; `unknown` for others."""
    pairs = [F.lit(x) for pair in LANGUAGE_OF.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[F.regexp_extract(_col(path), r"\.([^.]+)$", 1)], F.lit("unknown"))


def in_skipped_dir(path: str | Column) -> Column:
    """Whether a directory on the way to the file is one that walks leave out."""
    segments = F.split(_col(path), "/")
    dirs = F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*map(F.lit, SKIP_DIRS)))


def under_prefix(path: str | Column, prefix: str) -> Column:
    """Whether the path is the prefix or lies below it, whole components only; null never."""
    p, prefix = _col(path), prefix.rstrip("/")
    if not prefix:
        return p.isNotNull()
    return F.coalesce((p == prefix) | p.startswith(prefix + "/"), F.lit(False))


def is_safe_relative(path: str | Column) -> Column:
    """Neither absolute nor with a .. component."""
    p = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    return ~p.startswith("/") & ~F.array_contains(F.split(p, "/"), "..")


def _escape(c: str) -> str:
    return "\\" + c if not (c.isalnum() or c == "_" or ord(c) > 127) else c


def _class_end(glob: str, i: int) -> int:
    """Where the bracket expression that opens at i closes; -1 if it doesn't."""
    start = i + 2 if glob[i + 1 : i + 2] in ("!", "^") else i + 1
    return glob.find("]", start + 1)


def _bracket(body: str) -> str:
    negated = body[:1] in ("!", "^")
    inner = (body[1:] if negated else body).replace("\\", "\\\\").replace("[", "\\[")
    return f"[^/{inner}]" if negated else f"[{inner}]"


def pathname_glob(glob: str) -> str:
    """Regex of a glob in which * and ? don't cross a slash."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and (end := _class_end(glob, i)) > 0:
            out += _bracket(glob[i + 1 : end])
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += _escape(glob[i])
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or _escape(c)
        i += 1
    return f"^{out}$"


def double_star_glob(glob: str) -> str:
    """Regex of a glob with ** for any number of directories and {a,b} for alternatives."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out += "(?:[^/]+/)*"
            i += 3
            continue
        if glob.startswith("/**", i) and i + 3 == len(glob):
            out += "(?:/.*)?"
            i += 3
            continue
        if glob.startswith("**", i):
            out += ".*" if i == 0 and len(glob) == 2 else "[^/]*"
            i += 2
            continue
        if c == "{":
            out += "(?:"
            depth += 1
        elif c == "}" and depth:
            out += ")"
            depth -= 1
        elif c == "," and depth:
            out += "|"
        elif c == "[" and (end := _class_end(glob, i)) > 0:
            out += _bracket(glob[i + 1 : end])
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += _escape(glob[i])
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or _escape(c)
        i += 1
    return f"^{out}$"


def search_glob(glob: str) -> str:
    """Regex of a search tool's --glob: without a slash it applies to the base name anywhere."""
    if "/" not in glob.rstrip("/"):
        return double_star_glob("**/" + glob)
    return double_star_glob(glob.lstrip("/"))


def matches_glob(path: str | Column, glob: str, dialect=pathname_glob) -> Column:
    return _col(path).rlike(dialect(glob))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
