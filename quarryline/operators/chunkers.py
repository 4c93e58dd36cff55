"""Splitting files into chunks.

Input: files(repo, path, text). Output: chunks(repo, path, lang, kind, kind_name, symbol, n, key,
start_byte, end_byte, start_line, end_line, body). Spans are UTF-8 bytes; lines count from 1.
Lines are exploded and sections found by windows over a file's lines, so a file is the unit that
meets in one task, never a repository.
"""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions.paths import language_of
from quarryline.operators import lexing
from quarryline.schemas import KIND_CODE, SECTION_LINES, WINDOW_LINES

FILE = ["repo", "path"]
#: Bytes of a symbol and of a heading's title that are kept (fixed values).
SYMBOL_BYTES, TITLE_BYTES = 127, 119


def cut_bytes(text: Column, n: int) -> Column:
    """The first n bytes, without a broken character at the end."""
    head = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, n).cast("string"))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.regexp_replace(head, "\ufffd+$", ""))


def window_chunks(files: DataFrame, lines: int = WINDOW_LINES) -> DataFrame:
    """Windows of `lines` lines; the last one may be shorter. An empty file has none.

    The end line of a shorter last window of a file that ends in a line end counts the (empty)
    line behind it too.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = files.select(*FILE, F.split(text, "\n", -1).alias("lines"), F.octet_length(text).alias("n_bytes"))
    used = F.size("lines") - F.when(F.element_at("lines", -1) == "", 1).otherwise(0)
    starts = F.when(used > 0, F.sequence(F.lit(0), used - 1, F.lit(lines))).otherwise(F.array().cast("array<int>"))
    win = split.select("*", F.posexplode(starts).alias("n", "first"))
    part = F.array_join(F.slice("lines", F.col("first") + 1, lines), "\n")
    more = F.col("first") + lines < F.size("lines")
    before = F.when(F.col("first") == 0, 0).otherwise(F.octet_length(F.array_join(F.slice("lines", F.lit(1), F.col("first")), "\n")) + 1)
    out = win.select(*FILE, "n", F.when(more, F.concat(part, F.lit("\n"))).otherwise(part).alias("body"), before.alias("start_byte"), (F.col("first") + 1).alias("start_line"), F.least(F.col("first") + lines, F.size("lines")).alias("end_line"))
    out = out.withColumn("end_byte", F.col("start_byte") + F.octet_length("body")).withColumn("symbol", F.lit(None).cast("string"))
    return _finish(out, "window")


def chunk_key(kind: Column, symbol: Column, n: Column) -> Column:
    return F.concat(F.col("path"), F.lit("::"), kind.cast("string"), F.lit("::"), F.coalesce(symbol, F.lit("")), F.lit("#"), n.cast("string"))


def _finish(rows: DataFrame, kind: str | None = None) -> DataFrame:
    """Adds kind, the number n among equal (path, kind, symbol) in file order, and the key."""
    if kind is not None:
        rows = rows.withColumn("kind_name", F.lit(kind))
    codes = [F.lit(x) for pair in KIND_CODE.items() for x in pair]
    rows = rows.withColumn("kind", F.create_map(*codes)[F.col("kind_name")])
    if "n" not in rows.columns:
        order = Window.partitionBy(*FILE, "kind", "symbol").orderBy("start_byte")
        rows = rows.withColumn("n", F.row_number().over(order) - 1)
    key = chunk_key(F.col("kind"), F.col("symbol"), F.col("n"))
    return rows.select(*FILE, language_of("path").alias("lang"), "kind", "kind_name", "symbol", "n", key.alias("key"), *[F.col(c).cast("int").alias(c) for c in ("start_byte", "end_byte", "start_line", "end_line")], "body")


def line_rows(files: DataFrame) -> DataFrame:
    """repo, path, line_no, line, end (the line end or ''), start_byte; none behind a last line end."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = files.select(*FILE, F.size(F.split(text, "\n", -1)).alias("n_lines"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    rows = each.select(*FILE, (F.col("pos") + 1).alias("line_no"), "line", F.when(F.col("pos") + 1 < F.col("n_lines"), "\n").otherwise("").alias("end"))
    before = Window.partitionBy(*FILE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("line") + F.octet_length("end")
    return rows.withColumn("start_byte", F.coalesce(F.sum(size).over(before), F.lit(0))).filter((F.col("line") != "") | (F.col("end") != ""))


def _sections(lines: DataFrame, kind: str) -> DataFrame:
    """Chunks of lines(…, boundary, symbol): a boundary line begins a section, which goes on
    every SECTION_LINES lines under the same symbol. A blank preamble is left out."""
    order = Window.partitionBy(*FILE).orderBy("line_no")
    marked = lines.withColumn("section", F.sum(F.col("boundary").cast("int")).over(order))
    within = Window.partitionBy(*FILE, "section")
    marked = marked.withColumn("first", F.min("line_no").over(within)).withColumn("named", F.max(F.when(F.col("boundary"), F.col("symbol"))).over(within)).withColumn("blank", F.min(F.trim(F.regexp_replace("line", r"\s", "")) == "").over(within))
    marked = marked.filter((F.col("section") > 0) | ~F.col("blank"))
    piece = F.floor((F.col("line_no") - F.col("first")) / SECTION_LINES)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.concat("line", "end").alias("t")))), lambda x: x["t"]), "")
    rows = marked.groupBy(*FILE, "section", piece.alias("piece")).agg(
        F.max("named").alias("symbol"), text.alias("body"), F.min("start_byte").alias("start_byte"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line")
    )
    return _finish(rows.withColumn("end_byte", F.col("start_byte") + F.octet_length("body")), kind)


def yaml_chunks(files: DataFrame) -> DataFrame:
    """One chunk per key at column 0; the colon stands outside quotes, before a blank or the end."""
    line = F.regexp_replace("line", "\r$", "")
    key = F.rtrim(F.regexp_replace(F.regexp_extract(line, r"^([^ \t#\-](?:\"[^\"]*\"|'[^']*'|[^\"'#:]|:(?![ \t]|$))*?)(?=:(?:[ \t]|$))|^(\"[^\"]*\"|'[^']*')(?=[ \t]*:(?:[ \t]|$))", 0), "[ \t]+$", ""))
    named = F.when(key.rlike(r"^\"[^\"]+\"$|^'[^']+'$"), F.substring(key, 2, 1 << 20).substr(F.lit(1), F.length(key) - 2)).otherwise(key)
    lines = line_rows(files).withColumn("boundary", key != "").withColumn("symbol", F.when(key != "", cut_bytes(named, SYMBOL_BYTES)))
    return _sections(lines, "key")


def toml_chunks(files: DataFrame) -> DataFrame:
    """One chunk per [table] or [[array of tables]] header, at any indent."""
    name = F.trim(F.regexp_extract(F.regexp_replace("line", "\r$", ""), r"^[ \t]*\[\[?([^\]]*)\]", 1))
    lines = line_rows(files).withColumn("boundary", name != "").withColumn("symbol", F.when(name != "", cut_bytes(name, SYMBOL_BYTES)))
    return _sections(lines, "key")


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _in_fence(lines: pd.Series) -> pd.Series:
    """For each line of a file whether it is part of a fenced block (its fences included)."""
    import re

    fence = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$", re.DOTALL)

    def one(rows) -> list[bool]:
        out, mark = [], ""
        for line in rows:
            m = fence.match(line)
            if not mark:
                mark = m[1] if m else ""
                out.append(bool(m))
            else:
                out.append(True)
                if m and m[1][0] == mark[0] and len(m[1]) >= len(mark) and not m[2].strip(" \t\r"):
                    mark = ""
        return out

    return lines.map(one)


def markdown_chunks(files: DataFrame) -> DataFrame:
    """One chunk per section; its symbol is the breadcrumb of headings above it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    flags = files.select(*FILE, F.posexplode(_in_fence(F.split(text, "\n", -1))).alias("pos", "fenced"))
    lines = line_rows(files).join(flags.select(*FILE, (F.col("pos") + 1).alias("line_no"), "fenced"), [*FILE, "line_no"])
    plain = F.regexp_replace("line", "\r$", "")
    marks = F.regexp_extract(plain, r"^ {0,3}(#{1,6})(?:[ \t]|$)", 1)
    level = F.when(~F.col("fenced") & (marks != ""), F.length(marks))
    title = F.regexp_replace(F.regexp_extract(plain, r"^ {0,3}#{1,6}[ \t]*(.*)$", 1), r"[ \t]+$", "")
    title = F.regexp_replace(F.regexp_replace(title, r"(^|[ \t])#+$", "$1"), r"[ \t]+$", "")
    lines = lines.withColumn("level", level).withColumn("title", F.when(level.isNotNull(), cut_bytes(title, TITLE_BYTES)))
    past = Window.partitionBy(*FILE).orderBy("line_no")
    for k in range(1, 7):
        own = F.when(F.col("level") == k, F.struct("line_no", "title"))
        lines = lines.withColumn(f"h{k}", F.last(own, ignorenulls=True).over(past))
    at = lambda k: F.coalesce(F.col(f"h{k}")["line_no"], F.lit(0))
    # a heading counts while none of a smaller level has come after it
    crumb = [F.when(at(k) > (F.greatest(*[at(j) for j in range(1, k)], F.lit(0)) if k > 1 else F.lit(0)), F.col(f"h{k}")["title"]) for k in range(1, 7)]
    lines = lines.withColumn("boundary", F.col("level").isNotNull()).withColumn("symbol", F.when(F.col("level").isNotNull(), F.array_join(F.array(*crumb), " > ")))
    return _sections(lines.select(*FILE, "line_no", "line", "end", "start_byte", "boundary", "symbol"), "section")


def json_members(text: str) -> list[tuple[str | None, int, int]] | None:
    """(key, start, end) in characters of each root member from its key to the end of its value,
    comments allowed; None if the text is no object with members. What follows the object is a
    member without a key."""
    n, i, depth, members, begin, key, at_key = len(text), 0, 0, [], None, None, False
    last = 0
    while i < n:
        c = text[i]
        if text.startswith("//", i):
            i = (text.find("\n", i) + 1 or n + 1) - 1
            continue
        if text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = n if end < 0 else end + 2
            continue
        if c == '"':
            end = i + 1
            while end < n and text[end] != '"':
                end += 2 if text[end] == "\\" else 1
            if end >= n:
                return None
            if depth == 1 and at_key:
                begin, key, at_key = i, text[i + 1 : end], False
            i = end + 1
            continue
        if c in "{[":
            depth += 1
            if depth == 1:
                if c != "{":
                    return None
                at_key = True
        elif c in "}]":
            depth -= 1
            if depth < 0:
                return None
            if depth == 0:
                if begin is not None:
                    members.append((key, begin, i))
                last = i + 1
                break
        elif c == "," and depth == 1 and begin is not None:
            members.append((key, begin, i))
            begin, at_key = None, True
        elif depth == 0 and not c.isspace():
            return None
        i += 1
    if depth or not members:
        return None
    members = [(k, a, a + len(text[a:b].rstrip(" \t\r\n"))) for k, a, b in members]
    if text[last:].strip(" \t\r\n"):
        members.append((None, n - len(text[last:].lstrip(" \t\r\n")), n))
    return members


def json_pieces(text: str) -> list[dict] | None:
    """The chunks of json_members(), with counts of lines and bytes that go on from one to the next."""
    members = json_members(text)
    if members is None:
        return None
    out, at, line, n_bytes = [], 0, 1, 0
    for symbol, a, b in members:
        between = text[at:a]
        line, n_bytes, at = line + between.count("\n"), n_bytes + len(between.encode()), a
        rows = text[a:b].split("\n")
        first, begin = line, n_bytes
        for i in range(0, len(rows), SECTION_LINES):
            part = rows[i : i + SECTION_LINES]
            body = "\n".join(part) + ("\n" if i + SECTION_LINES < len(rows) else "")
            if body:
                out.append({"symbol": symbol, "body": body, "start_byte": begin, "start_line": first + i, "end_line": first + i + len(part) - 1})
            begin += len(body.encode())
    return out


_PIECE = T.StructType([*(T.StructField(c, T.StringType()) for c in ("symbol", "body")), *(T.StructField(c, T.IntegerType()) for c in ("start_byte", "start_line", "end_line"))])


@F.pandas_udf(T.ArrayType(_PIECE))
def _json_pieces(texts: pd.Series) -> pd.Series:
    return texts.map(json_pieces)


def json_chunks(files: DataFrame) -> DataFrame:
    """One chunk per root key, from the key to the end of its value, going on every SECTION_LINES
    lines under the same symbol; texts that are no object fall back to windows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = files.select(*FILE, text.alias("text")).withColumn("pieces", _json_pieces("text"))
    rows = found.filter("pieces IS NOT NULL").select(*FILE, F.explode("pieces").alias("p")).select(*FILE, "p.*")
    rows = rows.withColumn("symbol", cut_bytes(F.col("symbol"), SYMBOL_BYTES)).withColumn("end_byte", F.col("start_byte") + F.octet_length("body"))
    return _finish(rows, "key").unionByName(window_chunks(found.filter("pieces IS NULL").select(*FILE, "text")))


#: Where definitions begin, per language: (kind, pattern with the name as group 1). They hold
#: for common layouts; a parser would find more (see the README).
DEFINITIONS = {
    "go": [("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("struct", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b"), ("interface", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b")],
    "c": [("struct", r"^(?:typedef\s+)?struct\s+(\w+)\s*\{"), ("function", r"^(?!\s|typedef|struct\s+\w+\s*\{|return|else|#)[\w\s\*]*?\b(\w+)\s*\([^;]*$")],
    "javascript": [("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"), ("method", r"^\s+(?:static\s+|async\s+|get\s+|set\s+)*(?!(?:if|for|while|switch|catch|return|function)\b)(\w+)\s*\([^;]*\)\s*\{")],
    "typescript": [("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("method", r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|readonly\s+|async\s+|get\s+|set\s+)*(?!(?:if|for|while|switch|catch|return|function)\b)(\w+)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^{;]+)?\{")],
    "python": [("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("class", r"^\s*class\s+(\w+)")],
    "java": [("class", r"^\s*(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+)*class\s+(\w+)"), ("interface", r"^\s*(?:public\s+|private\s+|protected\s+|static\s+)*interface\s+(\w+)"), ("method", r"^\s+(?!(?:if|for|while|switch|catch|return|new|else|throw)\b)(?:[\w<>\[\],.?@]+\s+)*(\w+)\s*\([^;]*\)\s*(?:throws\s+[\w.,\s]+)?\{")],
    "kotlin": [("function", r"^\s*(?:[\w@]+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)"), ("class", r"^\s*(?:[\w@]+\s+)*(?:class|interface)\s+(\w+)")],
    "rust": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(\w+)"), ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+(\w+)"), ("interface", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)")],
    "ruby": [("method", r"^\s*def\s+(?:self\.)?([\w?!=]+)"), ("class", r"^\s*(?:class|module)\s+([\w:]+)")],
}


#: Blocks that name the container of what stands in them, without being a definition.
MEMBER_BLOCKS = {"rust": [("impl", r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:]+(?:<[^>]*>)?\s+for\s+)?(\w+)")]}


#: Characters of bodies after which a task hands its rows on.
_BATCH_CHARS = 4 << 20
_FOUND = "repo string, path string, kind_name string, symbol string, n int, start_line int, start_byte long, body string"


def _find_definitions(rules: dict):
    def run(batches):
        import pyarrow as pa

        own = lexing.compiled(rules)
        names = [x.split()[0] for x in _FOUND.split(", ")]
        kinds = [pa.string()] * 4 + [pa.int32(), pa.int32(), pa.int64(), pa.string()]
        full = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            rows, size = [], 0
            for repo, path, lang, text in zip(*[batch.column(c) for c in ("repo", "path", "lang", "text")], strict=True):
                for found in lexing.chunk_rows(text.as_py(), lang.as_py(), own[lang.as_py()]):
                    rows.append((repo.as_py(), path.as_py(), *found))
                    size += len(found[-1])
                    if size > _BATCH_CHARS:
                        yield full(rows)
                        rows, size = [], 0
            if rows:
                yield full(rows)

    return run


def code_chunks(files: DataFrame, rules: dict = DEFINITIONS) -> DataFrame:
    """Definitions of code files, each with its whole body; a definition inside another is a
    chunk of its own too. Files are read one by one by their tokens (lexing.definitions), so
    nothing is shuffled; a path stands once in a repository.
    """
    code = files.select(*[F.col(c).cast("string").alias(c) for c in FILE], language_of("path").alias("lang"), F.coalesce("text", F.lit("")).alias("text")).filter(F.col("lang").isin(*rules))
    rows = code.mapInArrow(_find_definitions(rules), _FOUND)
    rows = rows.withColumn("end_line", F.col("start_line") + F.regexp_count("body", F.lit("\n"))).withColumn("end_byte", F.col("start_byte") + F.octet_length("body"))
    return _finish(rows)


_DEFS = "array<struct<kind_name string, symbol string, n int, start_line int, end_line int, start_byte long, end_byte long, member_of string, container int>>"
_READ = f"bare string, defs {_DEFS}, owner array<int>, first array<int>, here array<int>"


def _holders(text: str, lang: str, code: str, found: list[tuple], blocks: dict) -> list[str | None]:
    """Of each definition the smallest member block over its first line."""
    if lang not in blocks:
        return [None] * len(found)
    spans = [(line, line + body.count("\n"), symbol) for _, symbol, _, line, _, body in lexing.chunk_rows(text, lang, blocks[lang], code)]
    at = lexing.smallest_at_lines(spans, text.count("\n") + 1)
    return [spans[at[d[3] - 1]][2] if at[d[3] - 1] >= 0 else None for d in found]


def _read_file(text: str, lang: str, rules: dict, blocks: dict) -> tuple[str, list[tuple], list[int], list[int], list[int]]:
    """The columns _READ of a file."""
    code, n_lines = lexing.masked(text, lang), text.count("\n") + 1
    found = list(lexing.chunk_rows(text, lang, rules[lang], code))
    defs, spans, held, here = [], [], [], [0] * n_lines
    for (kind, symbol, n, line, begin, body), member_of in zip(found, _holders(text, lang, code, found, blocks), strict=True):
        last, end = line + body.count("\n"), begin + len(body.encode("utf-8", "surrogatepass"))
        inside = lexing.around(held, begin, end)
        if kind in ("class", "struct", "interface"):
            held.append((len(defs), begin, end))
        spans.append((line, last, f"{KIND_CODE[kind]}::{symbol}#{n}"))
        defs.append((kind, symbol, n, line, last, begin, end, member_of, inside[0] if inside else None))
        here[line - 1] += 1
    return code, defs, lexing.smallest_at_lines(spans, n_lines), [0, *accumulate(here[:-1])], here


def _read_files(rules: dict, blocks: dict):
    def run(batches):
        import pyarrow as pa

        own, held = lexing.compiled(rules), lexing.compiled(blocks)
        kinds = [pa.string(), pa.string(), *[pa.int32()] * 3, pa.int64(), pa.int64(), pa.string(), pa.int32()]
        fields = [pa.field(x.split()[0], t) for x, t in zip(_DEFS.split("<", 2)[2].split(", "), kinds, strict=True)]
        offsets = lambda lists: pa.array([0, *accumulate(map(len, lists))], pa.int32())

        def full(batch, rows):
            codes, defs, *lines = zip(*rows, strict=True)
            columns = zip(*[d for own in defs for d in own], strict=True) if any(defs) else [()] * len(kinds)
            flat = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], fields=fields)
            new = [pa.array(codes, pa.string()), pa.ListArray.from_arrays(offsets(defs), flat), *[pa.array(x, pa.list_(pa.int32())) for x in lines]]
            return pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *[x.split()[0] for x in ("bare", "defs", "owner", "first", "here")]])

        for batch in batches:
            rows, size, begin = [], 0, 0
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                rows.append(_read_file(text.as_py(), lang.as_py(), own, held))
                size += len(rows[-1][0])
                if size > _BATCH_CHARS:
                    yield full(batch.slice(begin, len(rows)), rows)
                    rows, size, begin = [], 0, begin + len(rows)
            if rows:
                yield full(batch.slice(begin), rows)

    return run


def read_code(files: DataFrame) -> DataFrame:
    """Code files(repo, path, lang, text, …), a row each and read once by their tokens: bare (the
    text without comments and what strings hold), defs (definitions as in code_chunks(), by start,
    each with its key, the member block around it and the number of the smallest class, struct or
    interface around it) and, by line, owner (the number of the smallest definition over it, -1
    without one), first and here (how many definitions begin before and on it)."""
    rows = files.withColumn("text", F.coalesce("text", F.lit("")))
    read = rows.mapInArrow(_read_files(DEFINITIONS, MEMBER_BLOCKS), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), _READ]))
    codes = F.create_map(*[F.lit(x) for pair in KIND_CODE.items() for x in pair])
    return read.withColumn("defs", F.transform("defs", lambda d: d.withField("key", chunk_key(codes[d["kind_name"]], d["symbol"], d["n"]))))


@F.pandas_udf(T.StringType())
def _code_only(texts: pd.Series, langs: pd.Series) -> pd.Series:
    return pd.Series([lexing.masked(t, lang) for t, lang in zip(texts, langs, strict=True)], dtype=object)


def code_lines(files: DataFrame) -> DataFrame:
    """repo, path, lang, line_no, line, bare (without comments and what strings hold) of code files."""
    code = files.select(*FILE, language_of("path").alias("lang"), F.coalesce("text", F.lit("")).alias("text")).filter(F.col("lang").isin(*DEFINITIONS))
    split = code.select(*FILE, "lang", F.split("text", "\n", -1).alias("line"), F.split(_code_only("text", "lang"), "\n", -1).alias("bare"))
    each = split.select(*FILE, "lang", F.posexplode(F.arrays_zip("line", "bare")).alias("pos", "x"))
    return each.select(*FILE, "lang", (F.col("pos") + 1).alias("line_no"), "x.line", "x.bare").filter("line <> ''")


def chunk_files(files: DataFrame) -> DataFrame:
    """All files by the chunker of their language; unknown languages and files without a path by windows."""
    lang = F.coalesce(language_of("path"), F.lit("unknown"))
    of = lambda *names: files.filter(lang.isin(*names))
    out = markdown_chunks(of("markdown")).unionByName(yaml_chunks(of("yaml"))).unionByName(toml_chunks(of("toml"))).unionByName(json_chunks(of("json")))
    return out.unionByName(code_chunks(of(*DEFINITIONS))).unionByName(window_chunks(files.filter(lang == "unknown")))

