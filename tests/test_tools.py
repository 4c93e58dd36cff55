"""Every tool by its name, over a small indexed workspace of two repositories."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.operators import chunkers, engine, graph, vectors
from quarryline.operators.tools import Workspace, workspace_tools

GO = "package main\n\nimport \"fmt\"\n\nfunc main() {\n\tfmt.Println(parse(1))\n}\n\nfunc parse(x int) int {\n\treturn x\n}\n"
PY = "import os\n\n\nclass Reader:\n    def read(self):\n        return load(1)\n\n\ndef load(x):\n    return x\n"
DIFF = "diff\n--- a/cmd/main.go\n+++ b/cmd/main.go\n@@ -9,2 +9,2 @@ func\n+func parse(x int) int {\n"


@pytest.fixture(scope="module")
def tools(spark):
    rows = [("one", "cmd/main.go", GO), ("one", "lib/reader.py", PY), ("one", "README.md", "# Title\nread the manual\n"), ("two", "cmd/main.go", GO)]
    files = spark.createDataFrame(rows, "repo string, path string, text string").cache()
    chunks = chunkers.chunk_files(files)
    chunks = chunks.withColumn("id", F.row_number().over(Window.partitionBy("repo").orderBy("path", "start_line", "key")).cast("long")).cache()
    nodes, refs = graph.build_graph(files.withColumn("seq", F.lit(1)))
    own = vectors.embed_unique(chunks, vectors.hashed_embedding("_body")).select("repo", "id", "vector").cache()
    log = spark.createDataFrame([("one", None, 1, "abc\u001fAda\u001f2026-01-02\u001fFirst"), ("one", None, 2, "broken"), ("one", "cmd/main.go", 1, "def\u001fBo\u001f2026-01-03\u001fSecond")], "repo string, path string, line_no long, line string")
    blame = spark.createDataFrame([("one", "cmd/main.go", 1, "abcdef12 (Ada 2026-01-02 10:00:00 +0000 1) package main"), ("one", "cmd/main.go", 2, "abcdef12 (Ada 2026-01-02 10:00:00 +0000 2) ")], "repo string, path string, line_no long, line string")
    diffs = spark.createDataFrame([("one", "main", "HEAD", DIFF)], "repo string, base string, head string, text string")

    def embed(text):
        one = spark.createDataFrame([(text,)], "t string")
        return one.select(vectors.hashed_embedding("t").alias("v")).first()["v"]

    repos = spark.createDataFrame([("one", "/r/one"), ("two", "/r/two")], "repo string, root string")
    return workspace_tools(Workspace(repos, files, chunks, nodes.cache(), graph.edges_view(refs, nodes).cache(), own, embed, log, blame, diffs))


def test_all_tools_are_there_in_order(tools):
    assert tools.names() == "repos search get_chunk find_symbol file_outline hybrid_search search_graph trace_path detect_changes get_architecture find_references grep glob read_file list_dir tree head tail wc sed pipe git_log git_blame".split()


@pytest.mark.parametrize("name, args, check", [
    ("repos", {}, lambda r: [x.repo for x in r] == ["one", "two"]),
    ("search", {"query": "def load(x): return x", "k": 3, "repo": "one"}, lambda r: len(r) == 3 and r[0].symbol == "load" and r[0].score >= r[1].score),
    ("search", {"query": "func parse", "kind": "function", "path_glob": "cmd/*", "min_score": 0.01}, lambda r: r and all(x.path == "cmd/main.go" for x in r)),
    ("hybrid_search", {"query": "where is the reader class", "k": 2}, lambda r: r[0].symbol in ("Reader", "read") and len(r) == 2),
    ("get_chunk", {"repo": "two", "id": 1}, lambda r: r[0].path == "cmd/main.go" and not r[0].truncated),
    ("find_symbol", {"name": "PARSE"}, lambda r: [(x.repo, x.symbol) for x in r] == [("one", "parse"), ("two", "parse")]),
    ("file_outline", {"repo": "one", "path": "lib/reader.py"}, lambda r: [x.symbol for x in r] == ["Reader", "read", "load"]),
    ("search_graph", {"name": "parse", "repo": "two"}, lambda r: [(x.repo, x.kind) for x in r] == [("two", "function")]),
    ("search_graph", {"kind": "class"}, lambda r: [x.name for x in r] == ["Reader"]),
    ("trace_path", {"name": "parse", "repo": "one", "direction": "in"}, lambda r: [(x.repo, x.src_name) for x in r] == [("one", "main")]),
    ("detect_changes", {"repo": "one", "base": "main"}, lambda r: {(x.name, x.risk) for x in r} == {("parse", "direct"), ("main", "transitive")}),
    ("get_architecture", {"repo": "two"}, lambda r: ("language", "go") in {(x.part, x.name) for x in r} and ("language", "python") not in {(x.part, x.name) for x in r}),
    ("find_references", {"symbol": "load", "repo": "one"}, lambda r: [(x.source, x.path) for x in r] == [("graph", "lib/reader.py")]),
    ("find_references", {"symbol": "manual"}, lambda r: [(x.source, x.path, x.line) for x in r] == [("grep", "README.md", 2)]),
    ("grep", {"pattern": "func (main|parse)", "repo": "one"}, lambda r: [x.line_no for x in r] == [5, 9]),
    ("grep", {"pattern": "x int)", "literal": True, "limit": 1}, lambda r: len(r) == 1),
    ("glob", {"pattern": "**/*.py"}, lambda r: [x.path for x in r] == ["lib/reader.py"]),
    ("read_file", {"repo": "one", "path": "./cmd/../cmd/main.go", "start_line": 5, "end_line": 5}, lambda r: r[0].content == "func main() {" and r[0].total_lines == 11),
    ("list_dir", {"repo": "one"}, lambda r: {(x.name, x.is_dir) for x in r} == {("cmd", True), ("lib", True), ("README.md", False)}),
    ("tree", {"repo": "one", "path": "lib"}, lambda r: {x.path for x in r} == {"lib", "lib/reader.py"}),
    ("head", {"repo": "one", "path": "README.md", "lines": 1}, lambda r: r[0].content == "# Title"),
    ("tail", {"repo": "one", "path": "README.md", "lines": 1}, lambda r: r[0].content == "read the manual"),
    ("wc", {"repo": "one", "path": "README.md"}, lambda r: (r[0].lines, r[0].words) == (2, 5)),
    ("sed", {"repo": "one", "path": "README.md", "script": "s/the/a/;1d"}, lambda r: r[0].content == "read a manual" and not r[0].truncated),
    ("sed", {"repo": "one", "path": "README.md", "script": "2p", "quiet": True}, lambda r: r[0].content == "read the manual"),
    ("pipe", {"command": "rg -l func | wc -l", "repo": "one"}, lambda r: r[0].line == "1"),
    ("git_log", {"repo": "one"}, lambda r: [(x.hash, x.author) for x in r] == [("abc", "Ada")]),
    ("git_log", {"repo": "one", "path": "cmd/main.go"}, lambda r: [x.subject for x in r] == ["Second"]),
    ("git_blame", {"repo": "one", "path": "cmd/main.go", "end_line": 1}, lambda r: [(x.line_no, x.text) for x in r] == [(1, "package main")]),
])
def test_a_tool_by_name(tools, name, args, check):
    rows = tools.call(name, args).collect()
    assert check(rows), rows


@pytest.mark.parametrize("name, args, code", [
    ("nothing", {}, "NOT_FOUND"), ("grep", {}, "INVALID_ARGS"), ("grep", {"pattern": 1}, "INVALID_ARGS"), ("grep", {"pattern": "x", "other": 1}, "INVALID_ARGS"), ("grep", {"pattern": "x", "limit": True}, "INVALID_ARGS"), ("grep", {"pattern": "x", "limit": -1}, "INVALID_ARGS"),
    ("search", {"query": "x", "repo": "three"}, "NOT_FOUND"), ("get_chunk", {"repo": "one", "id": 999}, "NOT_FOUND"), ("file_outline", {"repo": "one", "path": "no"}, "NOT_FOUND"), ("read_file", {"path": "../x"}, "FORBIDDEN"), ("head", {"path": "/etc/passwd"}, "FORBIDDEN"), ("wc", {"repo": "one", "path": "none"}, "NOT_FOUND"),
    ("sed", {"repo": "one", "path": "README.md", "script": "w x"}, "UNSAFE_SED"), ("pipe", {"command": "cat a > b"}, "UNSAFE_PIPE"), ("pipe", {"command": "sort -M README.md"}, "UNSAFE_PIPE"), ("detect_changes", {"base": "other"}, "NOT_FOUND"), ("git_blame", {"path": "none"}, "NOT_FOUND"),
])
def test_errors_have_codes(tools, name, args, code):
    with pytest.raises(Exception) as raised:
        tools.call(name, args).collect()
    assert engine.error_code(raised.value) == code


def test_parts_that_are_not_there(spark, tools):
    empty = spark.createDataFrame([], "repo string, path string, text string")
    bare = workspace_tools(Workspace(empty.select("repo"), empty, empty, empty, empty))
    for name, args in (("search", {"query": "x"}), ("git_log", {}), ("git_blame", {"path": "x"}), ("detect_changes", {"base": "x"})):
        with pytest.raises(NotImplementedError):
            bare.call(name, args)
