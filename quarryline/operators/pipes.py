"""Read-only pipes over lines: each stage is a DataFrame step over (line_no, line).

A command is parted into stages and checked before anything runs: commands, flags and operands
that aren't implemented are rejected, none is passed over. Where a stage needs to know which line
follows which, lines are numbered from one written sort. Order is that of bytes (the C locale).
Counts and line numbers aren't padded with spaces, and a stage's output isn't cut, but for what is
one line made of all (`paste -s`), which is cut to FILE_BYTES.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.paths import search_glob
from quarryline.functions.patterns import posix_pattern
from quarryline.operators.chunkers import cut_bytes
from quarryline.operators.ordering import numbered
from quarryline.operators.workspace import UnsafePipe, edited, lines_of
from quarryline.schemas import FILE_BYTES

#: What a pipe may run and the flags it may never have (fixed values).
PIPE_COMMANDS = "rg grep head tail wc sort uniq cut tr nl cat paste sed".split()
DENIED_FLAGS = {"rg": ["--pre", "--pre-glob", "--hostname-bin", "--search-zip", "-z"], "sort": ["-o", "--output", "--files0-from"], "sed": ["-i", "--in-place", "-f", "--file"]}
#: Short flags whose value may be written behind them.
VALUED_FLAGS = {"rg": "efgtTmABCjrM", "sort": "ktSTo", "sed": "efl"}
SHELL_OPERATORS = "><;&$`(){}\n\r"

#: Flags that are carried out: those alone, those with a value, and their long names.
_SEARCH = ("ivcFowxlHhn", "em", {"--ignore-case": "i", "--invert-match": "v", "--count": "c", "--fixed-strings": "F", "--only-matching": "o", "--word-regexp": "w", "--line-regexp": "x", "--files-with-matches": "l", "--with-filename": "H", "--no-filename": "h", "--line-number": "n", "--regexp": "e", "--max-count": "m"})
FLAGS: dict[str, tuple[str, str, dict[str, str]]] = {
    "grep": (_SEARCH[0] + "EGr", _SEARCH[1], _SEARCH[2] | {"--extended-regexp": "E", "--basic-regexp": "G", "--recursive": "r"}),
    "rg": (_SEARCH[0] + "NI", _SEARCH[1] + "g", _SEARCH[2] | {"--glob": "g", "--no-line-number": "N"}),
    "head": ("q", "nc", {"--lines": "n", "--bytes": "c", "--quiet": "q"}),
    "tail": ("q", "nc", {"--lines": "n", "--bytes": "c", "--quiet": "q"}),
    "wc": ("lwcm", "", {"--lines": "l", "--words": "w", "--bytes": "c", "--chars": "m"}),
    "sort": ("nrufsb", "kt", {"--numeric-sort": "n", "--reverse": "r", "--unique": "u", "--ignore-case": "f", "--stable": "s", "--ignore-leading-blanks": "b", "--key": "k", "--field-separator": "t"}),
    "uniq": ("cdui", "", {"--count": "c", "--repeated": "d", "--unique": "u", "--ignore-case": "i"}),
    "cut": ("s", "dfc", {"--only-delimited": "s", "--delimiter": "d", "--fields": "f", "--characters": "c"}),
    "tr": ("dscC", "", {"--delete": "d", "--squeeze-repeats": "s", "--complement": "c"}),
    "nl": ("", "bsv", {"--body-numbering": "b", "--number-separator": "s", "--starting-line-number": "v"}),
    "cat": ("nbE", "", {"--number": "n", "--number-nonblank": "b", "--show-ends": "E"}),
    "paste": ("s", "d", {"--serial": "s", "--delimiters": "d"}),
    "sed": ("nEr", "e", {"--quiet": "n", "--silent": "n", "--regexp-extended": "E", "--expression": "e"}),
}
#: Lines up to which the first or last ones are kept by a top k within every task.
TOP_LINES = 10_000
#: Lines within which a line before is looked up without another block.
BLOCK_BITS = 13

_TOKEN = re.compile(r"'(?P<single>[^']*)'|\"(?P<double>(?:\\[\"\\]|[^\"])*)\"|\\(?P<escaped>.)|(?P<gap>[ \t]+)|(?P<bar>\|)|(?P<plain>[^ \t|'\"\\><;&$`(){}\n\r]+)", re.DOTALL)


def tokenize_pipe(command: str) -> list[list[str]]:
    """Words of each stage of a command; quotes are removed, shell operators rejected."""
    stages, word, at = [[]], None, 0
    while at < len(command):
        m = _TOKEN.match(command, at)
        if not m:
            raise UnsafePipe(f"{command[at]!r} in a pipe" if command[at] in SHELL_OPERATORS else "a quote without an end")
        at = m.end()
        if m["gap"] or m["bar"]:
            if word is not None:
                stages[-1].append(word)
            word = None
            if m["bar"]:
                stages.append([])
            continue
        part = m["single"] if m["single"] is not None else re.sub(r"\\([\"\\])", r"\1", m["double"]) if m["double"] is not None else m["escaped"] or m["plain"]
        word = (word or "") + part
    if word is not None:
        stages[-1].append(word)
    if not all(stages):
        raise UnsafePipe("an empty stage")
    return stages


def check_stage(argv: list[str]) -> None:
    """Rejects commands, flags and paths that a read-only pipe may not have."""
    command, *args = argv
    if command not in PIPE_COMMANDS:
        raise UnsafePipe(f"command {command!r}")
    for a in args:
        denied = DENIED_FLAGS.get(command, ())
        if a.startswith("-") and a.split("=", 1)[0] in denied:
            raise UnsafePipe(f"flag {a!r} of {command}")
        for letter in a[1:] if re.match("-[^-]", a) else "":
            if f"-{letter}" in denied:
                raise UnsafePipe(f"flag {a!r} of {command}")
            if letter in VALUED_FLAGS.get(command, ""):
                break
        for path in (a, a.partition("=")[2]):
            if path.startswith("/") or ".." in path.replace("\\", "/").split("/"):
                raise UnsafePipe(f"path {path!r}")


@dataclass
class Stage:
    """A command with its flags (a letter: its values, or none) and operands."""

    command: str
    flags: dict[str, list[str]] = field(default_factory=dict)
    operands: list[str] = field(default_factory=list)

    def __contains__(self, letter: str) -> bool:
        return letter in self.flags

    def value(self, letter: str, default: str = "") -> str:
        return self.flags.get(letter, [default])[-1]

    def number(self, letter: str, default: int) -> int:
        value = self.value(letter, str(default))
        if not re.fullmatch(r"[+-]?\d+", value):
            raise UnsafePipe(f"{value!r} isn't a number for -{letter} of {self.command}")
        return int(value)


def parse_stage(argv: list[str]) -> Stage:
    """The stage's flags by the allow-list of its command; any other is rejected."""
    check_stage(argv)
    command, *args = argv
    alone, valued, long = FLAGS[command]
    stage, args = Stage(command), list(args)
    while args:
        a = args.pop(0)
        if a == "--":
            stage.operands += args
            break
        if command in ("head", "tail") and re.fullmatch(r"-\d+", a):
            stage.flags["n"] = [a[1:]]
        elif a.startswith("--"):
            name, has_value, value = a.partition("=")
            letter = long.get(name)
            if letter is None or (has_value and letter not in valued):
                raise UnsafePipe(f"flag {a!r} of {command}")
            if letter in valued and not has_value:
                value = _next(args, a, command)
            stage.flags.setdefault(letter, []).append(value)
        elif a.startswith("-") and len(a) > 1:
            at = 1
            while at < len(a):
                letter = a[at]
                at += 1
                if letter in valued:
                    stage.flags.setdefault(letter, []).append(a[at:] or _next(args, a, command))
                    break
                if letter not in alone:
                    raise UnsafePipe(f"flag -{letter} of {command}")
                stage.flags.setdefault(letter, []).append("")
        else:
            stage.operands.append(a)
    return stage


def _next(args: list[str], flag: str, command: str) -> str:
    if not args:
        raise UnsafePipe(f"flag {flag!r} of {command} without a value")
    return args.pop(0)


@dataclass
class Lines:
    """rows(line_no, line), and whether line_no is 1, 2, 3, …"""

    rows: DataFrame
    dense: bool = False

    def numbered(self) -> Lines:
        return self if self.dense else in_order(self.rows, ["line_no"])


def in_order(rows: DataFrame, order: list[Column | str]) -> Lines:
    found = numbered(rows, order, name="place").select((F.col("place") + 1).alias("line_no"), "line")
    return Lines(found, True)


def run_pipe(rows: DataFrame, command: str) -> DataFrame:
    """rows(line_no, line) through the stages of a command; the result has line_no and line again."""
    stages = [parse_stage(argv) for argv in tokenize_pipe(command)]
    for stage in stages:
        _check_operands(stage, False)
    return reduce(_run, stages, Lines(rows.select("line_no", "line"))).rows


def run_pipe_on_files(files: DataFrame, command: str) -> DataFrame:
    """files(repo, path, text) through a command whose first stage names files, as a shell in the
    repository's root would: `cat a b`, `grep x a`, `rg x src/`, `sort a`. rg and grep -r search
    what lies below the paths given (rg without any: all), by path."""
    stages = [parse_stage(argv) for argv in tokenize_pipe(command)]
    for i, stage in enumerate(stages):
        _check_operands(stage, i == 0)
    return reduce(_run, stages[1:], _first(files, stages[0])).rows


def _own_operands(stage: Stage) -> int:
    """How many operands aren't files."""
    if stage.command in ("grep", "rg"):
        return 0 if "e" in stage else 1
    if stage.command == "sed":
        return 0 if "e" in stage else 1
    if stage.command == "tr":
        return 1 if "d" in stage and "s" not in stage else 1 if "s" in stage and len(stage.operands) == 1 else 2
    return 0


def _check_operands(stage: Stage, files: bool) -> None:
    own = _own_operands(stage)
    if len(stage.operands) < own:
        raise UnsafePipe(f"{stage.command} without its operand")
    rest = stage.operands[own:]
    if stage.command == "paste" and rest and set(rest) == {"-"}:
        return
    if any(x != "-" for x in rest) and (not files or stage.command in ("tr", "paste")):
        raise UnsafePipe(f"operand {rest[0]!r} of {stage.command}")
    if len(rest) > 1 and stage.command in ("head", "tail", "wc", "uniq"):
        raise UnsafePipe(f"several files of {stage.command}")


def _first(files: DataFrame, stage: Stage) -> Lines:
    names = [x for x in stage.operands[_own_operands(stage) :] if x != "-"]
    if stage.command == "rg" or (stage.command == "grep" and "r" in stage):
        below = [n.strip("/").removeprefix("./") for n in names if n.strip("/") not in ("", ".")]
        wanted = reduce(lambda a, b: a | b, [(F.col("path") == n) | F.col("path").startswith(n + "/") for n in below], F.lit(not below))
        for glob in stage.flags.get("g", []):
            pattern = search_glob(glob.removeprefix("!") if "/" in glob else "**/" + glob.removeprefix("!"))
            hit = F.col("path").rlike(pattern) | F.element_at(F.split("path", "/"), -1).rlike(search_glob(glob.removeprefix("!")))
            wanted &= ~hit if glob.startswith("!") else hit
        return _search_files(files.filter(wanted), stage, "h" not in stage and "I" not in stage)
    if not names:
        raise UnsafePipe(f"{stage.command} without a file")
    order = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    files = files.filter(F.col("path").isin(names)).withColumn("turn", order[F.col("path")])
    if stage.command == "grep":
        return _search_files(files, stage, "H" in stage or (len(names) > 1 and "h" not in stage))
    each = files.select("turn", "repo", F.posexplode(lines_of()).alias("pos", "line"))
    lines = in_order(each, ["turn", "repo", "pos"])
    return _run(lines, Stage(stage.command, stage.flags, stage.operands[: _own_operands(stage)]))


def _search_files(files: DataFrame, stage: Stage, named: bool) -> Lines:
    hit = _matches(stage)
    each = files.select("repo", "path", F.posexplode(lines_of()).alias("pos", "line")).filter(hit)
    if "l" in stage:
        return in_order(each.select("repo", "path").distinct().withColumn("line", F.col("path")), ["path", "repo"])
    if "c" in stage:
        counts = each.groupBy("repo", "path").agg(F.count(F.lit(1)).cast("string").alias("line"))
    else:
        counts = each
        if "m" in stage:
            best = Window.partitionBy("repo", "path").orderBy("pos")
            counts = counts.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= stage.number("m", 0))
        if "o" in stage:
            counts = counts.select("repo", "path", "pos", F.posexplode(_found(stage)).alias("at", "line"))
        if "n" in stage:
            counts = counts.withColumn("line", F.concat((F.col("pos") + 1).cast("string"), F.lit(":"), "line"))
    if named:
        counts = counts.withColumn("line", F.concat("path", F.lit(":"), "line"))
    return in_order(counts, [c for c in ("path", "repo", "pos", "at") if c in counts.columns])


def _run(lines: Lines, stage: Stage) -> Lines:
    return {
        "grep": _grep, "rg": _grep, "head": _head, "tail": _tail, "wc": _wc, "sort": _sort, "uniq": _uniq, "cut": _cut, "tr": _tr, "nl": _nl, "cat": _cat, "paste": _paste, "sed": _sed,
    }[stage.command](lines, stage)


# --- grep


def _pattern(stage: Stage) -> str:
    own = stage.flags.get("e") or stage.operands[:1]
    patterns = [p for x in own for p in x.split("\n")]
    if "F" in stage:
        patterns = [re.sub(r"([\\\[\](){}.*+?^$|])", r"\\\1", p) for p in patterns]
    elif stage.command == "grep":
        patterns = [posix_pattern(p, "E" in stage) for p in patterns]
    out = "|".join(f"(?:{p})" for p in patterns) if len(patterns) > 1 else patterns[0]
    if "x" in stage:
        out = f"^(?:{out})$"
    elif "w" in stage:
        out = rf"(?<![\p{{L}}\p{{N}}_])(?:{out})(?![\p{{L}}\p{{N}}_])"
    return f"(?iu){out}" if "i" in stage else out


def _matches(stage: Stage) -> Column:
    hit = F.col("line").rlike(_pattern(stage))
    return ~hit if "v" in stage else hit


def _found(stage: Stage) -> Column:
    if "v" in stage:
        return F.array().cast("array<string>")
    return F.filter(F.regexp_extract_all("line", F.lit(_pattern(stage)), F.lit(0)), lambda x: x != "")


def _grep(lines: Lines, stage: Stage) -> Lines:
    if "l" in stage or "H" in stage or "r" in stage or "g" in stage:
        raise UnsafePipe(f"a flag of {stage.command} for files, behind a bar")
    if "n" in stage:
        lines = lines.numbered()
    rows = lines.rows.filter(_matches(stage))
    if "m" in stage:
        rows = _head(Lines(rows), Stage("head", {"n": [stage.value("m")]})).rows
    if "c" in stage:
        return Lines(rows.agg(F.lit(1).alias("line_no"), F.count(F.lit(1)).cast("string").alias("line")), True)
    number = [F.col("line_no").cast("string"), F.lit(":")] if "n" in stage else []
    if "o" in stage:
        each = rows.select("line_no", F.posexplode(_found(stage)).alias("at", "line"))
        return in_order(each.withColumn("line", F.concat(*number, "line")), ["line_no", "at"])
    return Lines(rows.withColumn("line", F.concat(*number, "line")) if number else rows)


# --- head and tail


def _with_total(lines: Lines) -> DataFrame:
    total = lines.rows.agg(F.coalesce(F.max("line_no"), F.lit(0)).alias("total"))  # one row
    return lines.rows.crossJoin(F.broadcast(total))


def _head(lines: Lines, stage: Stage) -> Lines:
    if "c" in stage:
        return _bytes(lines, stage.number("c", 0), False)
    value = stage.value("n", "10")
    n = stage.number("n", 10)
    if value.startswith("-"):
        return Lines(_with_total(lines.numbered()).filter(F.col("line_no") <= F.col("total") + n).select("line_no", "line"), True)
    if lines.dense or n > TOP_LINES:
        return Lines(lines.numbered().rows.filter(F.col("line_no") <= n), True)
    return Lines(lines.rows.orderBy("line_no").limit(n))


def _tail(lines: Lines, stage: Stage) -> Lines:
    if "c" in stage:
        return _bytes(lines, stage.number("c", 0), True)
    value = stage.value("n", "10")
    n = abs(stage.number("n", 10))
    if value.startswith("+"):
        return Lines(lines.numbered().rows.filter(F.col("line_no") >= n))
    if n > TOP_LINES:
        return Lines(_with_total(lines.numbered()).filter(F.col("line_no") > F.col("total") - n).select("line_no", "line"))
    return Lines(lines.rows.orderBy(F.desc("line_no")).limit(n))


def _bytes(lines: Lines, n: int, last: bool) -> Lines:
    """The first or last n bytes; n is bounded, and a line has a byte at least, so n lines hold them."""
    if not 0 <= n <= FILE_BYTES:
        raise UnsafePipe(f"-c takes 0 to {FILE_BYTES} bytes")
    order = F.desc("line_no") if last else F.asc("line_no")
    size = F.octet_length("line") + 1
    rows = lines.rows.orderBy(order).limit(n).withColumn("left", F.lit(n) - F.sum(size).over(Window.orderBy(order)) + size)
    if last:  # the line end is the last byte of a line
        whole = F.encode("line", "UTF-8")
        part = F.substring(whole, F.octet_length("line") - F.col("left") + 2, F.col("left") - 1).try_cast("string")
        part = F.when(F.col("left") == 1, F.lit("")).otherwise(F.regexp_replace(F.make_valid_utf8(part), "^\ufffd+", ""))
    else:
        part = cut_bytes(F.col("line"), F.col("left"))
    cut = F.when(size <= F.col("left"), F.col("line")).otherwise(part)
    return Lines(rows.filter(F.col("left") > 0).select("line_no", cut.alias("line")))


# --- counts, order, repeats


def _wc(lines: Lines, stage: Stage) -> Lines:
    words = F.size(F.filter(F.split("line", r"[ \t\n\r\x0B\f]+"), lambda w: w != ""))
    size = {"l": F.count(F.lit(1)), "w": F.sum(words), "m": F.sum(F.length("line") + 1), "c": F.sum(F.octet_length("line") + 1)}
    shown = [size[f] for f in "lwmc" if f in stage] or [size[f] for f in "lwc"]
    return Lines(lines.rows.agg(F.lit(1).alias("line_no"), F.concat_ws(" ", *[F.coalesce(s, F.lit(0)).cast("string") for s in shown]).alias("line")), True)


@dataclass
class SortKey:
    first: int
    last: int | None
    flags: str

    @classmethod
    def parse(cls, text: str) -> SortKey:
        m = re.fullmatch(r"(\d+)([nrfb]*)(?:,(\d+)([nrfb]*))?", text)
        if not m or m[1] == "0":
            raise UnsafePipe(f"sort key {text!r}")
        return cls(int(m[1]), int(m[3]) if m[3] else None, m[2] + (m[4] or ""))

    def column(self, separator: str | None) -> Column:
        """The fields first to last; without a separator, a field begins with the blanks before it."""
        line = F.col("line")
        if separator is None:
            fields = F.regexp_extract_all(line, F.lit(r"[ \t]*[^ \t]+|[ \t]+$"), F.lit(0))
            parts = F.slice(fields, self.first, F.lit(1 << 20 if self.last is None else max(self.last - self.first + 1, 0)))
            return F.array_join(parts, "")
        parts = F.slice(F.split(line, _quoted(separator), -1), self.first, F.lit(1 << 20 if self.last is None else max(self.last - self.first + 1, 0)))
        return F.array_join(parts, separator)


def _quoted(text: str) -> str:
    return re.sub(r"([\\\[\](){}.*+?^$|])", r"\\\1", text)


def _sort_value(key: Column, flags: str) -> Column:
    if "n" in flags:  # what isn't a number counts as 0
        return F.coalesce(F.regexp_extract(key, r"^[ \t]*(-?[0-9]*\.?[0-9]+|-?[0-9]+)", 1).try_cast("double"), F.lit(0.0))
    if "b" in flags:
        key = F.regexp_replace(key, "^[ \t]+", "")
    return F.upper(key) if "f" in flags else key


def _sort(lines: Lines, stage: Stage) -> Lines:
    separator = stage.value("t") if "t" in stage else None
    if separator is not None and len(separator) != 1:
        raise UnsafePipe("a separator of sort is one character")
    own = "".join(c for c in "nfb" if c in stage)
    keys = []
    for key in map(SortKey.parse, stage.flags.get("k", [])):
        flags = key.flags or own + ("r" if "r" in stage else "")
        keys.append((_sort_value(key.column(separator), flags), "r" in flags))
    keys = keys or [(_sort_value(F.col("line"), own), "r" in stage)]
    names = [f"key{i}" for i in range(len(keys))]
    rows = lines.rows.select("line_no", "line", *[k.alias(n) for (k, _), n in zip(keys, names, strict=True)])
    order = [F.desc(n) if down else F.asc(n) for (_, down), n in zip(keys, names, strict=True)]
    if "u" in stage:  # of equal keys the first line
        rows = rows.groupBy(*names).agg(F.min(F.struct("line_no", "line")).alias("first")).select("first.*", *names)
    elif "s" not in stage:
        order.append(F.desc("line") if "r" in stage else F.asc("line"))
    return in_order(rows, [*order, F.asc("line_no")])


def _uniq(lines: Lines, stage: Stage) -> Lines:
    """The first line of each run of equal ones. A line meets the one before it within a block of
    lines; a block's first line meets the last one of the block before."""
    lines = lines.numbered()
    key = F.lower("line") if "i" in stage else F.col("line")
    place = F.col("line_no") - 1
    rows = lines.rows.select("line_no", "line", key.alias("key"), F.shiftright(place, BLOCK_BITS).alias("block"))
    mask = (1 << BLOCK_BITS) - 1
    ends = rows.filter(place.bitwiseAND(F.lit(mask)) == mask).select((F.col("block") + 1).alias("block"), F.col("key").alias("across"))
    before = F.lag("key").over(Window.partitionBy("block").orderBy("line_no"))
    marked = rows.withColumn("before", before).join(ends, "block", "left")
    before = F.when(place.bitwiseAND(F.lit(mask)) == 0, F.col("across")).otherwise(F.col("before"))
    starts = marked.filter((F.col("line_no") == 1) | (before != F.col("key"))).select("line_no", "line")
    if not any(f in stage for f in "cdu"):
        return Lines(starts)
    runs = numbered(starts, ["line_no"], name="run")
    following = runs.select((F.col("run") - 1).alias("run"), F.col("line_no").alias("next"))
    total = lines.rows.agg(F.max("line_no").alias("total"))
    sized = runs.join(following, "run", "left").crossJoin(F.broadcast(total)).withColumn("n", F.coalesce("next", F.col("total") + 1) - F.col("line_no"))
    if "d" in stage:
        sized = sized.filter("n > 1")
    if "u" in stage:
        sized = sized.filter("n = 1")
    line = F.concat(F.col("n").cast("string"), F.lit(" "), F.col("line")) if "c" in stage else F.col("line")
    return Lines(sized.select("line_no", line.alias("line")))


# --- parts of lines


def _spans(text: str) -> list[tuple[int, int]]:
    """A list of `3`, `2-5`, `4-` and `-2`."""
    out = []
    for part in text.split(","):
        m = re.fullmatch(r"(\d+)?(-)?(\d+)?", part)
        if not m or not (m[1] or m[3]) or (m[1] and m[3] and not m[2]) or m[1] == "0":
            raise UnsafePipe(f"list {text!r} of cut")
        first = int(m[1] or 1)
        last = int(m[3]) if m[3] else 1 << 30 if m[2] else first
        if last < first:
            raise UnsafePipe(f"list {text!r} of cut")
        out.append((first, last))
    return out


def _cut(lines: Lines, stage: Stage) -> Lines:
    if ("f" in stage) == ("c" in stage) or ("c" in stage and ("d" in stage or "s" in stage)):
        raise UnsafePipe("cut takes -f or -c, and -d and -s with -f only")
    spans = _spans(stage.value("f" if "f" in stage else "c"))
    chosen = lambda i: reduce(lambda a, b: a | b, [(i + 1).between(a, b) for a, b in spans])
    if "c" in stage:
        whole = F.split("line", "")
        return Lines(lines.rows.withColumn("line", F.array_join(F.filter(whole, lambda _, i: chosen(i)), "")), lines.dense)
    separator = stage.value("d", "\t")
    if len(separator) != 1:
        raise UnsafePipe("a delimiter of cut is one character")
    picked = F.array_join(F.filter(F.split("line", _quoted(separator), -1), lambda _, i: chosen(i)), separator)
    has = F.contains("line", F.lit(separator))
    rows = lines.rows.filter(has) if "s" in stage else lines.rows
    return Lines(rows.withColumn("line", F.when(has, picked).otherwise(F.col("line"))), lines.dense and "s" not in stage)


#: Classes of characters that tr knows (fixed values).
TR_CLASSES = {
    "upper": "A-Z", "lower": "a-z", "digit": "0-9", "alpha": "A-Za-z", "alnum": "0-9A-Za-z", "space": " \t\n\v\f\r", "blank": " \t", "punct": "!-/:-@[-`{-~", "xdigit": "0-9A-Fa-f",
}


def tr_set(text: str) -> str:
    """The characters of a set with ranges, classes and escapes, in order."""
    text = re.sub(r"\[:(\w+):\]", lambda m: TR_CLASSES.get(m[1]) or _reject(m[0]), text)
    out, at = [], 0
    units = re.findall(r"\\[0-7]{1,3}|\\.|.", text, re.DOTALL)
    known = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "b": "\b", "\\": "\\"}
    chars = [chr(int(u[1:], 8)) if re.fullmatch(r"\\[0-7]+", u) else known.get(u[1], u[1]) if len(u) > 1 else u for u in units]
    while at < len(chars):
        if at + 2 < len(chars) and units[at + 1] == "-":
            if chars[at + 2] < chars[at]:
                raise UnsafePipe(f"range {chars[at]}-{chars[at + 2]} of tr")
            out += map(chr, range(ord(chars[at]), ord(chars[at + 2]) + 1))
            at += 3
        else:
            out.append(chars[at])
            at += 1
    return "".join(out)


def _reject(what: str):
    raise UnsafePipe(f"{what} of tr")


def _class_of(chars: str, negated: bool = False) -> str:
    return f"[{'^' if negated else ''}{''.join(f'\\x{{{ord(c):x}}}' for c in dict.fromkeys(chars))}]"


def _tr(lines: Lines, stage: Stage) -> Lines:
    """tr within lines; characters may become line ends, but line ends don't go."""
    negated = "c" in stage or "C" in stage
    first = tr_set(stage.operands[0])
    second = tr_set(stage.operands[1]) if len(stage.operands) > 1 else ""
    if ("\n" in first) != negated and not (negated and second[-1:] == "\n"):
        raise UnsafePipe("tr of line ends")
    line, squeezed = F.col("line"), ""
    if "d" in stage:
        line, squeezed = F.regexp_replace(line, _class_of(first, negated), ""), second
    elif second:
        if negated:
            line = F.regexp_replace(line, _class_of(first, True), "\\\\" + second[-1] if second[-1] in "\\$" else second[-1])
        else:
            line = F.translate(line, first, (second + second[-1] * len(first))[: len(first)])
        squeezed = second if "s" in stage else ""
    elif "s" in stage:
        if negated:
            line = F.regexp_replace(line, f"({_class_of(first, True)})\\1+", "$1")
        squeezed = "" if negated else first
    else:
        raise UnsafePipe("tr with one set")
    if squeezed and (own := squeezed.replace("\n", "")):
        line = F.regexp_replace(line, f"({_class_of(own)})\\1+", "$1")
    if "\n" not in second:
        return Lines(lines.rows.withColumn("line", line), lines.dense)
    each = lines.numbered().rows.select("line_no", F.posexplode(F.split(line, "\n", -1)).alias("at", "line"))
    if "\n" in squeezed:  # of line ends together one is left: empty lines go, but for one at the start
        each = each.filter((F.col("line") != "") | ((F.col("line_no") == 1) & (F.col("at") == 0)))
    return in_order(each, ["line_no", "at"])


# --- numbers, joins, scripts


def _nl(lines: Lines, stage: Stage) -> Lines:
    body = stage.value("b", "t")
    if body not in ("a", "t", "n"):
        raise UnsafePipe(f"-b {body} of nl")
    numbers = F.col("line_no") - 1 + stage.number("v", 1)
    shown = lambda c: F.concat(c.cast("string"), F.lit(stage.value("s", "\t")), F.col("line"))
    if body == "n":
        return lines
    if body == "a":
        lines = lines.numbered()
        return Lines(lines.rows.withColumn("line", shown(numbers)), True)
    return _numbered_but_empty(lines, shown, stage.number("v", 1))


def _numbered_but_empty(lines: Lines, shown, start: int) -> Lines:
    """Lines with text are numbered among themselves, empty ones stay empty."""
    full = numbered(lines.rows.filter("line <> ''"), ["line_no"], name="place")
    full = full.select("line_no", shown(F.col("place") + start).alias("line"))
    return Lines(full.unionByName(lines.rows.filter("line = ''").select("line_no", "line")))


def _cat(lines: Lines, stage: Stage) -> Lines:
    if "E" in stage:
        lines = Lines(lines.rows.withColumn("line", F.concat("line", F.lit("$"))), lines.dense)
    shown = lambda c: F.concat(c.cast("string"), F.lit("\t"), F.col("line"))
    if "b" in stage:
        if "E" in stage:
            raise UnsafePipe("cat -b with -E")
        return _numbered_but_empty(lines, shown, 1)
    if "n" in stage:
        lines = lines.numbered()
        return Lines(lines.rows.withColumn("line", shown(F.col("line_no"))), True)
    return lines


def _paste(lines: Lines, stage: Stage) -> Lines:
    between = [{"\\n": "\n", "\\t": "\t", "\\0": "", "\\\\": "\\"}.get(u, u) for u in re.findall(r"\\.|.", stage.value("d", "\t"))] or [""]
    if "\n" in between:
        raise UnsafePipe("paste with line ends")
    marks = F.array(*[F.lit(b) for b in between])

    def joined(rows: Column) -> Column:
        texts = F.transform(F.array_sort(rows), lambda r: r["line"])
        return F.array_join(F.transform(texts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.get(marks, F.pmod(i - 1, F.lit(len(between))).cast("int")), x))), "")

    every = F.collect_list(F.struct("line_no", "line"))
    if "s" in stage:
        # a line takes a byte at least: the first FILE_BYTES lines hold all that is shown
        return Lines(lines.rows.orderBy("line_no").limit(FILE_BYTES).agg(F.lit(1).alias("line_no"), cut_bytes(joined(every), FILE_BYTES).alias("line")), True)
    n = len(stage.operands)
    if n <= 1:
        return lines
    rows = lines.numbered().rows
    group = F.floor((F.col("line_no") - 1) / n)
    out = rows.groupBy((group + 1).alias("line_no_")).agg(joined(every).alias("line"), F.count(F.lit(1)).alias("n"))
    # missing lines at the end are empty
    rest = F.array_join(F.transform(F.filter(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: i >= F.col("n")), lambda i: F.get(marks, F.pmod(i - 1, F.lit(len(between))).cast("int"))), "")
    return Lines(out.select(F.col("line_no_").alias("line_no"), F.concat("line", rest).alias("line")), True)


def _sed(lines: Lines, stage: Stage) -> Lines:
    script = "\n".join(stage.flags.get("e") or stage.operands[:1])
    rows, copies = edited(lines.numbered().rows, script, "n" in stage, "E" in stage or "r" in stage)
    return in_order(rows, ["line_no", "copy"]) if copies else Lines(rows.select("line_no", "line"))
