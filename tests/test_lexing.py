"""Definitions and references by tokens: strings of many lines, comments, several on a line."""

import time

import pytest
from pyspark.sql import functions as F

from quarryline.operators import chunkers, graph, lexing

RULES = lexing.compiled(chunkers.DEFINITIONS)

#: language, text, (kind, symbol, first line, last line) of its definitions.
CASES = {
    "raw string and comment of many lines": ("go", "package a\nvar s = `\nfunc No() {\n}}}\n`\n\nfunc Long(\n\ta int,\n\tb int,\n) (int, error) {\n\treturn a, nil // }\n}\n/* func Gone() {\n*/\nfunc Two() int { return 1 }\n", [("function", "Long", 7, 12), ("function", "Two", 15, 15)]),
    "several on a line, template, pattern": ("javascript", 'class A { f() { return 1; } g(x) { return "}"; } }\nconst t = `\nfunction no() {\n`;\nit("x", function () {\n  call(1);\n});\nfunction h(a,\n  b) {\n  return a.replace(/[{"]/g, "");\n}\n', [("class", "A", 1, 1), ("method", "f", 1, 1), ("method", "g", 1, 1), ("function", "h", 8, 11)]),
    "docstring, open bracket, remark": ("python", 'class A:\n    """doc\ndef no():\n    pass\n    """\n\n    def f(self, a=(\n1)):\n        x = """\nq\n"""\n# a remark\n        return x\n\n# next\ndef g(): return 1\ndef h(\n    a,\n):\n    return a\n', [("class", "A", 1, 13), ("function", "f", 7, 13), ("function", "g", 16, 16), ("function", "h", 17, 20)]),
    "macro, char, declaration": ("c", "#define BEGIN { \\\n  if (x) {\nint a(void) { return 1; } int b(int x,\n  int y)\n{\n  char *s = \"\\\"{\";\n  char c = '{';\n  return 0;\n}\nint p(int x,\n  int y);\n", [("function", "a", 3, 3), ("function", "b", 3, 9)]),
    "nested comment, raw string, lifetime": ("rust", "/* a /* fn no() {} */ fn no2() {} */\nfn f<'a>(x: &'a str) -> char {\n    let s = r#\"}\"{\"#; let t = \"\n}\";\n    '{'\n}\nmod m { fn g() {} struct S; }\n", [("function", "f", 2, 6), ("function", "g", 7, 7), ("struct", "S", 7, 7)]),
    "text block, words that aren't names": ("java", 'public class A {\n  String s = """\n  class No {\n  """;\n  @Override\n  public void f(\n      int a)\n      throws E {\n    try (X x = y()) {\n    }\n    synchronized (this) {\n    }\n  }\n  int g() { return 1; } int h() { return 2; }\n}\n', [("class", "A", 1, 15), ("method", "f", 6, 13), ("method", "g", 14, 14), ("method", "h", 14, 14)]),
    "heredoc, one-line methods": ("ruby", "=begin\nclass No\nend\n=end\nclass A\n  def f\n    s = <<~TXT\n  end\n    def no\n    TXT\n  end\n  def g = 1\n  def h(x); x; end\nend\n", [("class", "A", 5, 14), ("method", "f", 6, 11), ("method", "g", 12, 12), ("method", "h", 13, 13)]),
    "expression bodies": ("kotlin", '/* /* */ class No */\nclass A(val x: Int,\n  val y: Int) : B(x) {\n  fun f() = x\n  fun g() { println("${x}{") }\n}\n', [("class", "A", 2, 6), ("function", "f", 4, 4), ("function", "g", 5, 5)]),
    "arguments over lines": ("typescript", "export class A {\n  f(\n    a: number,\n  ): void {\n    g(a);\n  }\n}\nexport interface I { a: string; }\n", [("class", "A", 1, 7), ("method", "f", 2, 6), ("interface", "I", 8, 8)]),
    "never closed": ("go", "func a(x int {\n\treturn\n}\n\nfunc b() {\n\tif x {\n", [("function", "a", 1, 3), ("function", "b", 5, 6)]),
}


def lines_of(text: str, lang: str) -> list:
    return [(kind, symbol, first, first + body.count("\n")) for kind, symbol, _, first, _, body in lexing.chunk_rows(text, lang, RULES[lang])]


@pytest.mark.parametrize("case", CASES)
def test_definitions(case):
    lang, text, want = CASES[case]
    assert lines_of(text, lang) == want


@pytest.mark.parametrize("lang", list(RULES))
@pytest.mark.parametrize("text", ["", "\n", '"', "'", "`", "/*", "{" * 50, "}" * 50, '"\\', "é(\x00", "<<A\n", '"""', "r#\"", "/" * 9, "class\n", "def", "\\" * 99])
def test_odd_texts_keep_their_lines(lang, text):
    assert len(lexing.masked(text, lang)) == len(text) and lexing.masked(text, lang).count("\n") == text.count("\n")
    assert lines_of(text, lang) == []


def test_own_characters_within_a_line():
    text = "const é = 1; class A { f() { return 1; } g() {} }\n"
    found = {s: (at, body) for _, s, _, _, at, body in lexing.chunk_rows(text, "javascript", RULES["javascript"])}
    assert found["f"] == (len("const é = 1; class A { ".encode()), "f() { return 1; }") and found["g"][1] == "g() {}"
    assert all(text.encode()[at : at + len(body.encode())].decode() == body for at, body in found.values())


def test_equal_names_are_numbered():
    text = "def f():\n    pass\n\n\ndef f():\n    return 1\n"
    assert [n for _, _, n, *_ in lexing.chunk_rows(text, "python", RULES["python"])] == [0, 1]


@pytest.mark.parametrize(("lang", "one"), [("go", "func f%d(a int) int {\n\treturn g(a)\n}\n"), ("python", "def f%d(a):\n    return a\n"), ("javascript", "function f%d(a) { return a; } ")])
def test_time_grows_with_the_file(lang, one):
    took = []
    for n in (5000, 40000):
        text, begin = "".join(one % i for i in range(n)), time.perf_counter()
        assert len(lines_of(text, lang)) == n
        took.append(time.perf_counter() - begin)
    assert took[1] < 8 * 3 * took[0] + 0.5


def test_files_to_chunks(spark):
    rows = [("r", f"{i}.{ext}", text) for i, (lang, text, _) in enumerate(CASES.values()) for ext in [{"javascript": "js", "typescript": "ts", "python": "py", "kotlin": "kt", "rust": "rs", "ruby": "rb"}.get(lang, lang)]]
    files = spark.createDataFrame([*rows, ("r", "null.py", None)], "repo string, path string, text string")
    found = chunkers.code_chunks(files)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    by_path = {}
    for r in found.orderBy("path", "start_byte", "end_byte").collect():
        by_path.setdefault(r["path"], []).append((r["kind_name"], r["symbol"], r["start_line"], r["end_line"]))
    for i, (_, path, _) in enumerate(rows):
        assert sorted(by_path[path]) == sorted(list(CASES.values())[i][2])


def test_strings_and_comments_refer_to_nothing(spark):
    text = 'import { a,\n  b,\n} from "./util";\n/*\nimport "./gone";\nno(1);\n*/\nconst s = `\nimport "./no";\ncall(2);\n`;\nfunction f() {\n  return real("other(3)");\n}\n'
    files = spark.createDataFrame([("r", "a.js", text), ("r", "util.js", "export function real(x) { return x; }\n")], "repo string, path string, text string")
    _, refs = graph.build_graph(files)
    found = sorted((r["kind"], r["name"], r["line"]) for r in refs.filter("kind <> 'CONTAINS'").collect())
    assert found == [("CALLS", "real", 13), ("IMPORTS", "./util", 3)]


def test_json_of_many_members(spark):
    long = '"x": [\n' + ",\n".join(str(i) for i in range(450)) + "\n]"
    text = '{\n"é": 1,\n' + long + ',\n"z": {}\n}\n'
    files = spark.createDataFrame([("r", "a.json", text)], "repo string, path string, text string")
    rows = chunkers.json_chunks(files).orderBy("start_byte").collect()
    assert [(r["symbol"], r["start_line"], r["end_line"]) for r in rows] == [("é", 2, 2), ("x", 3, 202), ("x", 203, 402), ("x", 403, 454), ("z", 455, 455)]
    assert all(text.encode()[r["start_byte"] : r["end_byte"]].decode() == r["body"] for r in rows)


def test_json_time_grows_with_the_file():
    took = []
    for n in (5000, 40000):
        text = "{\n" + ",\n".join(f'"k{i}": {{"a": [{i}]}}' for i in range(n)) + "\n}\n"
        begin = time.perf_counter()
        assert len(chunkers.json_pieces(text)) == n
        took.append(time.perf_counter() - begin)
    assert took[1] < 8 * 3 * took[0] + 0.5


def test_files_of_code_are_read_by_many_tasks(spark, sf):
    """The table behind them is one small file."""
    from quarryline.plans import code_corpus

    assert code_corpus.code_files(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_language_mix_counts_files_of_every_language(spark, sf):
    """Markup too, with the bytes of all texts."""
    from quarryline.plans import code_corpus
    from quarryline.plans.queries import QUERIES

    got = {r["lang"]: (r["files"], r["n_bytes"]) for r in QUERIES["g17_language_mix"](spark, sf).collect()}
    texts = code_corpus.code_files(spark, sf).select("text").collect()
    assert set(got) == set(code_corpus.INDEX)
    assert sum(n for n, _ in got.values()) == len(texts) and sum(b for _, b in got.values()) == sum(len(r["text"].encode()) for r in texts)


def test_language_mix_counts_what_the_graph_holds(spark, sf):
    """Its files of code and their definitions beside all files; of markup it has none."""
    from quarryline.plans import code_corpus
    from quarryline.plans.queries import QUERIES

    nodes, _ = graph.build_graph(code_corpus.code_files(spark, sf).withColumn("seq", F.col("key")))
    held = {r["lang"]: r["count"] for r in nodes.filter("kind = 'file'").groupBy("lang").count().collect()}
    symbols = {r["lang"]: r["count"] for r in nodes.filter("kind NOT IN ('file', 'module')").groupBy("lang").count().collect()}
    got = {r["lang"]: (r["files"], r["graph_files"], r["symbols"]) for r in QUERIES["g17_language_mix"](spark, sf).collect()}
    assert len(held) == 9 and all(got[x] == (n, n, symbols[x]) for x, n in held.items())
    assert {x: y[1:] for x, y in got.items() if x not in held} == dict.fromkeys(("markdown", "yaml", "toml", "json"), (0, 0))
