"""Workspace tools over files(repo, path, text): grep, glob, read, listings, counts, filters."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.patterns import posix_pattern
from quarryline.functions.paths import double_star_glob, in_skipped_dir, search_glob
from quarryline.schemas import FILE_BYTES

GREP_LIMIT, GLOB_LIMIT, TREE_LIMIT, TREE_DEPTH, HEAD_LINES = 200, 500, 2000, 3, 20


class Rejected(ValueError):
    """An input that the read-only tools don't run."""


class UnsafePipe(Rejected):
    pass


class UnsafeSed(Rejected):
    pass


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def lines_of(text: Column | None = None) -> Column:
    """Lines without the empty one behind a last line end."""
    t = _text() if text is None else text
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, "\n$", ""), "\n", -1))


def grep(files: DataFrame, pattern: str, literal: bool = False, path_glob: str | None = None, limit: int | None = GREP_LIMIT) -> DataFrame:
    """(repo, path, line_no, line) of lines that match, in file order. Texts that can't match are
    left out before their lines are exploded."""
    if path_glob:
        files = files.filter(F.col("path").rlike(search_glob(path_glob)))
    test = (lambda c: F.contains(c, F.lit(pattern))) if literal else (lambda c: c.rlike(pattern))
    if literal:
        files = files.filter(test(_text()))
    each = files.select("repo", "path", F.posexplode(lines_of()).alias("pos", "line"))
    hit = each.filter(test(F.col("line"))).select("repo", "path", (F.col("pos") + 1).alias("line_no"), "line")
    return hit if limit is None else hit.orderBy("repo", "path", "line_no").limit(limit)


def glob(files: DataFrame, pattern: str, limit: int = GLOB_LIMIT) -> DataFrame:
    return files.filter(F.col("path").rlike(double_star_glob(pattern))).select("repo", "path").orderBy("repo", "path").limit(limit)


def read_file(files: DataFrame, start: int = 1, end: int | None = None) -> DataFrame:
    """Lines start to end (from 1, both included, clamped), at most FILE_BYTES bytes of them."""
    rows = files.withColumn("lines", lines_of()).withColumn("total_lines", F.size("lines"))
    first = F.least(F.greatest(F.lit(start), F.lit(1)), F.greatest(F.col("total_lines"), F.lit(1)))
    last = F.greatest(F.least(F.lit(end if end else 1 << 30), F.col("total_lines")), first)
    part = F.array_join(F.slice("lines", first, last - first + 1), "\n")
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(part, "UTF-8"), 1, FILE_BYTES).cast("string")), "�+$", "")
    rows = rows.withColumn("content", F.when(F.octet_length(part) <= FILE_BYTES, part).otherwise(cut))
    return rows.select("repo", "path", first.alias("start_line"), F.when(F.col("total_lines") == 0, 0).otherwise(last).alias("end_line"), "total_lines", "content")


def list_dir(files: DataFrame, directory: str = "") -> DataFrame:
    """(repo, name, is_dir) of the immediate entries."""
    prefix = directory.strip("/") + "/" if directory.strip("/") else ""
    rest = F.substring("path", len(prefix) + 1, 1 << 20)
    below = files.filter(F.col("path").startswith(prefix)) if prefix else files
    return below.select("repo", F.element_at(F.split(rest, "/"), 1).alias("name"), rest.contains("/").alias("is_dir")).distinct()


def tree(files: DataFrame, max_depth: int = TREE_DEPTH, limit: int | None = TREE_LIMIT) -> DataFrame:
    """(repo, path, depth, is_dir) of all entries down to a depth, skipped directories left out."""
    parts = F.split("path", "/")
    rows = files.filter(~in_skipped_dir("path")).select("repo", parts.alias("parts"))
    each = rows.select("repo", "parts", F.explode(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(max_depth)))).alias("depth"))
    out = each.select("repo", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("path"), "depth", (F.col("depth") < F.size("parts")).alias("is_dir")).distinct()
    return out if limit is None else out.orderBy("repo", "path").limit(limit)


def head(files: DataFrame, n: int = HEAD_LINES) -> DataFrame:
    return files.select("repo", "path", F.array_join(F.slice(lines_of(), 1, n), "\n").alias("content"))


def tail(files: DataFrame, n: int = HEAD_LINES) -> DataFrame:
    lines = lines_of()
    return files.select("repo", "path", F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n), "\n").alias("content"))


def wc(files: DataFrame) -> DataFrame:
    """Lines (one more without a last line end), words and bytes."""
    words = F.filter(F.split(_text(), r"[ \t\n\r\x0B\f]+"), lambda w: w != "")
    return files.select("repo", "path", F.size(lines_of()).cast("long").alias("lines"), F.size(words).cast("long").alias("words"), F.octet_length(_text()).cast("long").alias("bytes"))


@dataclass
class SedCommand:
    name: str
    hit: Column | None  # None: every line
    arguments: tuple[str, ...] = ()
    needs_total: bool = False


_SED_ADDRESS = re.compile(r"(?:(?P<re>/(?:\\.|\[\^?\]?[^\]]*\]|[^/\\\[])+/)(?P<fold>I?)|(?P<first>\d+)(?:~(?P<step>\d+)|,(?P<plus>\+?)(?P<last>\d+|\$))?|(?P<end>\$))?\s*(?P<not>!?)\s*")


def sed_commands(script: str, extended: bool = False) -> list[SedCommand]:
    """The commands of a script: s, y, d, p, q, = and G, each with a line, a range of lines, every
    n-th line, the last line or a pattern before it, or `!`; others are rejected."""
    out, at = [], 0
    while at < len(script):
        if script[at] in " \t;\n":
            at += 1
            continue
        if script[at] == "#":
            at = (script + "\n").index("\n", at)
            continue
        m = _SED_ADDRESS.match(script, at)
        at = m.end()
        hit = _sed_hit(m, extended)
        name = script[at : at + 1]
        at += 1
        arguments: tuple[str, ...] = ()
        if name in ("s", "y"):
            if at >= len(script):
                raise UnsafeSed(f"sed command {name!r} without an end")
            mark = re.escape(script[at])
            part = rf"((?:\\.|\[\^?\]?[^\]\n]*\]|(?!{mark})[^\n])*)" if name == "s" else rf"((?:\\.|(?!{mark})[^\n])*)"
            body = re.compile(rf"{mark}{part}{mark}((?:\\.|(?!{mark})[^\n])*){mark}([^;\n]*)", re.DOTALL).match(script, at)
            if not body or not re.fullmatch("[gIip]*" if name == "s" else "", body[3].strip()) or not body[1]:
                raise UnsafeSed(f"sed command {script[at - 1 :]!r}")
            delimiter = script[at]
            arguments = tuple(x.replace("\\" + delimiter, delimiter) if delimiter not in "\\()[]{}.*+?^$|" else x for x in (body[1], body[2])) + (body[3].strip(),)
            at = body.end()
        elif not name or name not in "dpq=G":
            raise UnsafeSed(f"sed command {script[at - 1 :]!r}")
        elif not re.match(r"[ \t]*(?:[;\n#]|$)", script[at:]):
            raise UnsafeSed(f"{script[at:]!r} behind sed command {name!r}")
        out.append(SedCommand(name, hit, arguments, bool(m["end"] or m["last"] == "$")))
    if not out:
        raise UnsafeSed("an empty sed script")
    return out


def _sed_hit(m: re.Match, extended: bool) -> Column | None:
    n = F.col("line_no")
    if m["re"]:
        fold = "(?iu)" if m["fold"] else ""
        hit = F.col("line").rlike(f"(?d){fold}{posix_pattern(m['re'][1:-1].replace(chr(92) + '/', '/'), extended)}")
    elif m["end"]:
        hit = n == F.col("last_no")
    elif m["first"] is None:
        if m["not"]:
            raise UnsafeSed("'!' without an address")
        return None
    elif m["step"]:
        first, step = int(m["first"]), int(m["step"])
        hit = (n >= first) & (F.pmod(n - first, F.lit(step)) == 0) if step else n == first
    else:
        first = int(m["first"])
        if m["last"] == "$":
            hit = n >= first
        else:
            last = first + int(m["last"]) if m["plus"] else int(m["last"] or first)
            hit = n.between(first, max(first, last))
    return ~hit if m["not"] else hit


def _sed_with(text: str, shift: int) -> str:
    """A replacement as Java writes it, group numbers raised by `shift`."""
    out = []
    for unit in re.findall(r"\\.|.", text, re.DOTALL):
        if re.fullmatch(r"\\\d", unit):
            out.append(f"${int(unit[1]) + shift}")
        elif unit == "&":
            out.append(f"${shift}" if shift else "$0")
        elif len(unit) > 1 and unit[1] == "n":
            raise UnsafeSed("a line end in a replacement of sed")
        else:
            c = {"\\t": "\t"}.get(unit, unit[-1])
            out.append("\\" + c if c in "\\$" else c)
    return "".join(out)


def _substituted(command: SedCommand, extended: bool) -> tuple[Column, Column]:
    """The line after an s command, and whether it matched."""
    pattern, text, flags = command.arguments
    java = posix_pattern(pattern, extended)
    head = "(?diu)" if "i" in flags.lower() else "(?d)"
    if "g" in flags:
        new = F.regexp_replace("line", head + java, _sed_with(text, 0))
    else:  # only the first match: what stands before it is held by a group of its own, the match by another
        java_shifted = re.sub(r"\\(\\|\d)", lambda g: g[0] if g[1] == "\\" else f"\\{int(g[1]) + 2}", java)
        new = F.regexp_replace("line", f"{head}^((?s:.*?))({java_shifted})", "$1" + _sed_with(text, 2))
    return new, F.col("line").rlike(head + java)


def edited(rows: DataFrame, script: str, quiet: bool = False, extended: bool = False) -> tuple[DataFrame, bool]:
    """rows(line_no, line, …) after a script, and whether a line can appear more than once: then the
    column `copy` counts a line's prints. line_no is the number that addresses mean."""
    commands = sed_commands(script, extended)
    own = rows.columns
    if any(c.needs_total for c in commands):
        rows = rows.crossJoin(F.broadcast(rows.agg(F.max("line_no").alias("last_no"))))  # one row
    prints = any(c.name in "p=G" or (c.name == "s" and "p" in c.arguments[2]) for c in commands) or quiet
    if prints:
        rows = rows.withColumn("printed", F.array().cast("array<string>")).withColumn("live", F.lit(True))
    stops = any(c.name == "q" for c in commands)
    if stops:
        rows = rows.withColumn("stopped", F.lit(False))
    for c in commands:
        hit = F.lit(True) if c.hit is None else c.hit
        if prints:
            hit = F.col("live") & hit
        if stops:
            hit = ~F.col("stopped") & hit
        if c.name == "s":
            new, matched = _substituted(c, extended)
            if "p" in c.arguments[2]:
                rows = rows.withColumn("matched", hit & matched)
            rows = rows.withColumn("line", new if c.hit is None and not prints and not stops else F.when(hit, new).otherwise(F.col("line")))
            if "p" in c.arguments[2]:
                rows = rows.withColumn("printed", F.when(F.col("matched"), F.array_append("printed", F.col("line"))).otherwise(F.col("printed"))).drop("matched")
        elif c.name == "y":
            plain = [re.sub(r"\\(.)", r"\1", x) for x in c.arguments[:2]]
            if len(plain[0]) != len(plain[1]):
                raise UnsafeSed("sets of different length in y")
            rows = rows.withColumn("line", F.when(hit, F.translate("line", *plain)).otherwise(F.col("line")))
        elif c.name == "d":
            rows = rows.withColumn("live", F.col("live") & ~hit) if prints else rows.filter(~hit)
        elif c.name == "q":
            stop = rows.filter(hit).agg(F.min("line_no").alias("stop_no"))  # one row
            rows = rows.crossJoin(F.broadcast(stop)).filter(F.col("stop_no").isNull() | (F.col("line_no") <= F.col("stop_no")))
            rows = rows.withColumn("stopped", F.col("line_no").eqNullSafe(F.col("stop_no"))).drop("stop_no")
        elif c.name == "G":
            # the pattern space gets an empty line behind it: printed as a line of its own
            raise_if_edited_after(commands, c)
            rows = rows.withColumn("printed", F.when(hit, F.array_append("printed", F.col("line"))).otherwise(F.col("printed"))).withColumn("line", F.when(hit, F.lit("")).otherwise(F.col("line")))
        else:
            shown = F.col("line") if c.name == "p" else F.col("line_no").cast("string")
            rows = rows.withColumn("printed", F.when(hit, F.array_append("printed", shown)).otherwise(F.col("printed")))
    if not prints:
        return rows.select(*own), False
    all_ = F.when(F.col("live") & F.lit(not quiet), F.array_append("printed", F.col("line"))).otherwise(F.col("printed"))
    rest = [c for c in own if c != "line"]
    return rows.select(*rest, F.posexplode(all_).alias("copy", "line")), True


def raise_if_edited_after(commands: list[SedCommand], command: SedCommand) -> None:
    if commands[-1] is not command:
        raise UnsafeSed("commands behind G")


def sed(rows: DataFrame, script: str, quiet: bool = False, extended: bool = False) -> DataFrame:
    """rows(line_no, line, …) edited by a script of sed_commands()."""
    return edited(rows, script, quiet, extended)[0].select(*rows.columns)


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """(diff_id, path, line) of the lines that unified diffs(diff_id, text) touch in new files. A
    hunk without new lines touches the one it stands at; /dev/null ends a path."""
    each = diffs.select("diff_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    path = F.when(F.col("line").startswith("+++ b/"), F.substring("line", 7, 1 << 20)).when(F.col("line").startswith("+++ /dev/null"), "")
    order = Window.partitionBy("diff_id").orderBy("pos")
    rows = each.withColumn("path", F.last(path, ignorenulls=True).over(order)).filter(F.col("line").startswith("@@") & (F.col("path") != ""))
    start = F.regexp_extract("line", r"^@@[^+]*\+(\d+)(?=[ ,])", 1).try_cast("int")
    count = F.coalesce(F.regexp_extract("line", r"^@@[^+]*\+\d+,(\d+)", 1).try_cast("int"), F.lit(1))
    rows = rows.withColumn("start", start).withColumn("n", F.greatest(count, F.lit(1))).filter("start > 0")
    return rows.select("diff_id", "path", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("line")).distinct()


def git_log(lines: DataFrame, limit: int | None = 200) -> DataFrame:
    """(hash, author, date, subject) of captured log lines with four fields; others are dropped."""
    parts = F.split("line", "\u001f", -1)
    rows = lines.filter(F.size(parts) == 4).select("line_no", *[F.get(parts, i).alias(n) for i, n in enumerate(("hash", "author", "date", "subject"))])
    return rows if limit is None else rows.orderBy("line_no").limit(limit)
