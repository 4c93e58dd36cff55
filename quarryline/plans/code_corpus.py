"""Code and markup files made from the part table, and what they hold.

Part k becomes one file in one of the KINDS by k modulo their number; every FORKED-th is in a second
repository too, under the same path. @k stands for k, @n for the
next part of the same kind, @p and @q for the packages of the two. DEFINITIONS and REFS list what
stands in each template, line by line, so that SQL can state a chunker's or the graph's result
without splitting code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGES = 20
#: Which files the second repository, `fork`, holds.
FORKED = 3
#: Tasks that the files are spread over, for each core.
TASKS_PER_CORE = 3

#: (extension, language, text) by part number modulo their count.
KINDS = [
    ("go", "go", """package p@k

import (
	"fmt"
	"example.com/app/pkg@q/sub"
)

type Box@k struct {
	n int
}

type Doer@k interface {
	Do() int
}

func (b *Box@k) Get@k() int {
	return help@k(b.n) + far@n(1) // "}" isn't an end
}

func help@k(x int) int {
	return x
}

func far@k(x int) int { return help@k(x) }
"""),
    ("c", "c", """#include <stdio.h>
#include "pkg@q/sub/f@n.c"

struct Box@k {
  int n;
};

static int help@k(int x) {
  if (x) {
    return 1;
  }
  return x;
}

int far@k(int x)
{
  return help@k(x) + far@n(x);
}

int main(void) {
  return far@k(1);
}
"""),
    ("js", "javascript", """import { far@n } from '../../pkg@q/sub/f@n.js';

class Base@k {
  get@k(x) {
    return help@k(x);
  }
}

class Box@k extends Base@k {
  run@k() {
    return far@n("a { b");
  }
}

export async function help@k(x) {
  return x;
}

export function far@k(x) {
  return help@k(x);
}
"""),
    ("ts", "typescript", """import { far@n } from '../../pkg@q/sub/f@n';

interface Doer@k {
  run(): void;
}

export abstract class Box@k implements Doer@k {
  private get@k(x: number): number {
    return help@k(x);
  }
}

export function help@k(x: number): number {
  return far@n(x);
}

function far@k(x: number) {
  return x;
}
"""),
    ("py", "python", """import os
from pkg@q.sub.f@n import far@n


class Base@k:
    pass


class Box@k(Base@k):
    def get@k(self):
        return help@k(1)

    async def run@k(self):
        return far@n(2)


def help@k(x):

    return x


def far@k(x):
    return help@k(x)
"""),
    ("java", "java", """package pkg@p;

import pkg@q.sub.f@n;

interface Doer@k {
}

public class Box@k implements Doer@k {
  private int n;

  public Box@k(int n) {
    this.n = n;
  }

  public static int help@k(int x) {
    return far@n(x);
  }
}
"""),
    ("kt", "kotlin", """import pkg@q.sub.f@n

open class Base@k

class Box@k : Base@k() {
  fun get@k(x: Int): Int {
    return help@k(x)
  }
}

fun help@k(x: Int): Int {
  return far@n(x)
}

private fun far@k(x: Int): Int {
  return x
}
"""),
    ("rs", "rust", """use crate::pkg@q::sub::f@n;

pub struct Box@k {
    n: i32,
}

trait Doer@k {
    fn run@k(&self) -> i32;
}

impl Doer@k for Box@k {
    fn get@k(&self) -> i32 {
        help@k(self.n)
    }
}

pub fn help@k(x: i32) -> i32 {
    far@n(x)
}

enum Kind@k {
    A,
}
"""),
    ("rb", "ruby", """require_relative '../../pkg@q/sub/f@n'

class Base@k
end

class Box@k < Base@k
  def get@k
    help@k(1)
  end

  def self.run@k
    far@n(2)
  end
end

def help@k(x)
  x
end
"""),
    ("md", "markdown", """intro @k

# Top @k

text

## Part @k ##

```
# not a heading
```

## Other
more
"""),
    ("yaml", "yaml", """# note
name: box@k
list:
  - a: 1
"quoted key": x
'single': "a: b"
- item
url: http://x/@k
"""),
    ("toml", "toml", """title = "@k"

[box@k]
n = 1

  [[items]]
a = [1]
[box@k]
b = 2
"""),
    ("json", "json", """{
  // note
  "name@k": {"a": [1, 2]},
  "text": "} , \\" {",
  "last": 3
}
"""),
]
INDEX = {lang: i for i, (_, lang, _) in enumerate(KINDS)}

#: (kind, symbol, first line, last line) of the definitions and sections of each template.
DEFINITIONS = {
    "go": [("struct", "Box@k", 8, 10), ("interface", "Doer@k", 12, 14), ("method", "Get@k", 16, 18), ("function", "help@k", 20, 22), ("function", "far@k", 24, 24)],
    "c": [("struct", "Box@k", 4, 6), ("function", "help@k", 8, 13), ("function", "far@k", 15, 18), ("function", "main", 20, 22)],
    "javascript": [("class", "Base@k", 3, 7), ("method", "get@k", 4, 6), ("class", "Box@k", 9, 13), ("method", "run@k", 10, 12), ("function", "help@k", 15, 17), ("function", "far@k", 19, 21)],
    "typescript": [("interface", "Doer@k", 3, 5), ("class", "Box@k", 7, 11), ("method", "get@k", 8, 10), ("function", "help@k", 13, 15), ("function", "far@k", 17, 19)],
    "python": [("class", "Base@k", 5, 6), ("class", "Box@k", 9, 14), ("function", "get@k", 10, 11), ("function", "run@k", 13, 14), ("function", "help@k", 17, 19), ("function", "far@k", 22, 23)],
    "java": [("interface", "Doer@k", 5, 6), ("class", "Box@k", 8, 18), ("method", "Box@k", 11, 13), ("method", "help@k", 15, 17)],
    "kotlin": [("class", "Base@k", 3, 3), ("class", "Box@k", 5, 9), ("function", "get@k", 6, 8), ("function", "help@k", 11, 13), ("function", "far@k", 15, 17)],
    "rust": [("struct", "Box@k", 3, 5), ("interface", "Doer@k", 7, 9), ("function", "run@k", 8, 8), ("function", "get@k", 12, 14), ("function", "help@k", 17, 19), ("struct", "Kind@k", 21, 23)],
    "ruby": [("class", "Base@k", 3, 4), ("class", "Box@k", 6, 14), ("method", "get@k", 7, 9), ("method", "run@k", 11, 13), ("method", "help@k", 16, 18)],
    "markdown": [("section", None, 1, 2), ("section", "Top @k", 3, 6), ("section", "Top @k > Part @k", 7, 12), ("section", "Top @k > Other", 13, 14)],
    "yaml": [("key", None, 1, 1), ("key", "name", 2, 2), ("key", "list", 3, 4), ("key", "quoted key", 5, 5), ("key", "single", 6, 7), ("key", "url", 8, 8)],
    "toml": [("key", None, 1, 2), ("key", "box@k", 3, 5), ("key", "items", 6, 7), ("key", "box@k", 8, 9)],
    "json": [("key", "name@k", 3, 3), ("key", "text", 4, 4), ("key", "last", 5, 5)],
}

#: (symbol that refers or None for the file, name, kind, line) of the references of each template.
REFS = {
    "go": [(None, "fmt", "IMPORTS", 4), (None, "example.com/app/pkg@q/sub", "IMPORTS", 5), ("Get@k", "Box@k", "CONTAINS", 16), ("Get@k", "help@k", "CALLS", 17), ("Get@k", "far@n", "CALLS", 17), ("far@k", "help@k", "CALLS", 24)],
    "c": [(None, "stdio.h", "IMPORTS", 1), (None, "pkg@q/sub/f@n.c", "IMPORTS", 2), ("far@k", "help@k", "CALLS", 17), ("far@k", "far@n", "CALLS", 17), ("main", "far@k", "CALLS", 21)],
    "javascript": [(None, "../../pkg@q/sub/f@n.js", "IMPORTS", 1), ("get@k", "help@k", "CALLS", 5), ("Box@k", "Base@k", "INHERITS", 9), ("run@k", "far@n", "CALLS", 11), ("far@k", "help@k", "CALLS", 20)],
    "typescript": [(None, "../../pkg@q/sub/f@n", "IMPORTS", 1), ("Box@k", "Doer@k", "INHERITS", 7), ("get@k", "help@k", "CALLS", 9), ("help@k", "far@n", "CALLS", 14)],
    "python": [(None, "os", "IMPORTS", 1), (None, "pkg@q.sub.f@n", "IMPORTS", 2), ("Box@k", "Base@k", "INHERITS", 9), ("get@k", "help@k", "CALLS", 11), ("run@k", "far@n", "CALLS", 14), ("far@k", "help@k", "CALLS", 23)],
    "java": [(None, "pkg@q.sub.f@n", "IMPORTS", 3), ("Box@k", "Doer@k", "INHERITS", 8), ("help@k", "far@n", "CALLS", 16)],
    "kotlin": [(None, "pkg@q.sub.f@n", "IMPORTS", 1), ("Box@k", "Base@k", "INHERITS", 5), ("get@k", "help@k", "CALLS", 7), ("help@k", "far@n", "CALLS", 12)],
    "rust": [(None, "crate::pkg@q::sub::f@n", "IMPORTS", 1), ("get@k", "Box@k", "CONTAINS", 12), ("get@k", "help@k", "CALLS", 13), ("help@k", "far@n", "CALLS", 18)],
    "ruby": [(None, "../../pkg@q/sub/f@n", "IMPORTS", 1), ("Box@k", "Base@k", "INHERITS", 6), ("get@k", "help@k", "CALLS", 8), ("run@k", "far@n", "CALLS", 12)],
}


def _filled(text: Column, key: Column) -> Column:
    later = key + len(KINDS)
    for mark, value in (("@k", key), ("@n", later), ("@p", key % PACKAGES), ("@q", later % PACKAGES)):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    return text


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path, text, key: a file for each part, and again for those in both repositories."""
    key = F.col("p_partkey").cast("long")
    which = F.pmod(key, F.lit(len(KINDS))).cast("int") + 1
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in KINDS]), which)
    path = _filled(F.concat(F.lit("pkg@p/sub/f@k."), pick(0)), key)
    repos = F.explode(F.when(key % FORKED == 0, F.array(F.lit("code"), F.lit("fork"))).otherwise(F.array(F.lit("code"))))
    # a row of a small file becomes a whole text: read as it lies, one task would work on all of them
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").repartition(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, "p_partkey")
    return parts.select(repos.alias("repo"), path.alias("path"), _filled(pick(2), key).alias("text"), key.alias("key"))


# --- the same in SQL -------------------------------------------------------------------------


def _quoted(value: str | None) -> str:
    return "NULL::VARCHAR" if value is None else "'" + value.replace("'", "''") + "'"


def _filled_sql(text: str, key: str = "k") -> str:
    n = len(KINDS)
    return f"replace(replace(replace(replace({text}, '@k', ({key})::VARCHAR), '@n', ({key} + {n})::VARCHAR), '@p', ({key} % {PACKAGES})::VARCHAR), '@q', (({key} + {n}) % {PACKAGES})::VARCHAR)"


FILES_SQL = f"""kinds(i, ext, lang, template) AS (VALUES {", ".join(f"({i}, {_quoted(e)}, {_quoted(lang)}, {_quoted(t)})" for i, (e, lang, t) in enumerate(KINDS))}),
code AS (SELECT p_partkey::BIGINT AS k, repo, lang, {_filled_sql("'pkg@p/sub/f@k.' || ext", "p_partkey")} AS path, {_filled_sql("template", "p_partkey")} AS text FROM part JOIN kinds ON p_partkey % {len(KINDS)} = i JOIN (VALUES ('code'), ('fork')) AS r(repo) ON repo = 'code' OR p_partkey % {FORKED} = 0)"""


def definitions_sql(langs: list[str], codes: dict[str, int], sections: bool) -> str:
    """CTEs up to defs(k, repo, lang, path, kind, kind_name, symbol, key, start_line, end_line, body).
    sections: bodies keep their last line end."""
    rows = ", ".join(f"({_quoted(lang)}, {codes[kind]}, {_quoted(kind)}, {_quoted(symbol)}, {a}, {b})" for lang in langs for kind, symbol, a, b in DEFINITIONS[lang])
    end = " || CASE WHEN end_line < len(l) THEN chr(10) ELSE '' END" if sections else ""
    return f"""{FILES_SQL},
known(lang, kind, kind_name, symbol, start_line, end_line) AS (VALUES {rows}),
found AS (SELECT c.k, c.repo, c.lang, c.path, d.kind, d.kind_name, {_filled_sql("d.symbol", "c.k")} AS symbol, d.start_line, d.end_line, string_split(c.text, chr(10)) AS l FROM code c JOIN known d ON c.lang = d.lang),
defs AS (SELECT k, repo, lang, path, kind, kind_name, symbol, path || '::' || kind || '::' || coalesce(symbol, '') || '#' || (row_number() OVER (PARTITION BY repo, path, kind, symbol ORDER BY start_line) - 1) AS key,
  start_line, end_line, array_to_string(l[start_line : end_line], chr(10)){end} AS body FROM found)"""


def refs_sql() -> str:
    """CTE refs(k, repo, lang, path, src, name, kind, line) over code."""
    rows = ", ".join(f"({_quoted(lang)}, {_quoted(symbol)}, {_quoted(name)}, {_quoted(kind)}, {line})" for lang, own in REFS.items() for symbol, name, kind, line in own)
    return f"""said(lang, symbol, name, kind, line) AS (VALUES {rows}),
refs AS (SELECT c.k, c.repo, c.lang, c.path, {_filled_sql("s.symbol", "c.k")} AS symbol, {_filled_sql("s.name", "c.k")} AS name, s.kind, s.line FROM code c JOIN said s ON c.lang = s.lang)"""
