"""Golden chunks of small literal files."""

import pytest

from quarryline.operators import chunkers

FILES = {
    "notes.txt": "one\ntwo\nthree\n",
    "read.md": "intro\n\n# Setup\ntext\n\n## Needs\n```\n# no heading\n```\nmore\n\n## Use ##\nrun\n\n# Help\nask\n",
    "long.md": "# Long\n" + "".join(f"line {i}\n" for i in range(200)),
    "empty.md": "",
    "conf.yaml": "# note\n\nweb:\n  host: a\n  port: 1\nstore:\n  url: b\nlast: 1\n",
    "conf.toml": "title = 'x'\n\n[web]\nport = 1\nhost = 2\n[[nodes]]\nname = 'n'\n",
    "p.json": '{\n  "name": "x",\n  "jobs": {\n    "a": [1, 2]\n  },\n  "last": 1\n}\n',
    "a.go": "package a\n\nfunc Sum(a int, b int) int {\n\treturn a + b\n}\n\ntype Area interface {\n\tSize() int\n}\n\ntype Box struct {\n\tw int\n}\n\nfunc (b *Box) Size() int {\n\treturn b.w\n}\n",
    "a.py": "import os\n\n\nclass Box:\n    def size(self):\n        if self.w:\n            return 1\n        return 2\n\n    def name(self):\n        return ''\n\n\ndef free(x):\n    return x\n",
    "a.rs": "fn sum(a: i32) -> i32 {\n    a\n}\n\npub struct P {\n    x: i32,\n}\n\nenum K {\n    A,\n}\n\ntrait S {\n    fn area(&self) -> i32;\n}\n\nimpl P {\n    fn norm(&self) -> i32 {\n        self.x\n    }\n}\n",
    "a.rb": "module M\n  class C\n    def go\n      1\n    end\n\n    def self.make\n      new\n    end\n  end\nend\n",
    "array.json": "[1, 2]\n",
    "none.json": "{}\n",
    "cut.json": '{"a": \n',
    "keys.py": "def f():\n    pass\n\n\ndef f():\n    return 1\n",
}


@pytest.fixture(scope="module")
def chunked(spark):
    """(kind, symbol, first line, last line) of each file's chunks in order; all files in one job."""
    files = spark.createDataFrame([("r", *x) for x in FILES.items()], "repo string, path string, text string")
    found = {path: [] for path in FILES}
    for r in chunkers.chunk_files(files).orderBy("path", "start_byte", "end_byte", "symbol").collect():
        found[r["path"]].append((r["kind_name"], r["symbol"], r["start_line"], r["end_line"], r["key"]))
    return {path: [c[:4] for c in rows] for path, rows in found.items()} | {"keys": [c[4] for c in found["keys.py"]]}


def test_plain_text_is_one_window(chunked):
    assert [c[:3] for c in chunked["notes.txt"]] == [("window", None, 1)]


def test_windows_cover_all_bytes(spark):
    text = "\n".join(f"zeile {i} é" for i in range(120))
    files = spark.createDataFrame([("r", "a.txt", text)], "repo string, path string, text string")
    rows = chunkers.window_chunks(files).orderBy("start_byte").collect()
    assert len(rows) == 3 and rows[0]["start_byte"] == 0 and rows[-1]["end_byte"] == len(text.encode())
    assert all(text.encode()[r["start_byte"] : r["end_byte"]].decode().rstrip("\n") == r["body"].rstrip("\n") for r in rows)


def test_markdown_sections(chunked):
    found = chunked["read.md"]
    assert [c[1] for c in found] == [None, "Setup", "Setup > Needs", "Setup > Use", "Help"]
    assert {c[0] for c in found} == {"section"}
    assert found[2][2:] == (6, 11)


def test_markdown_long_section_is_split(chunked):
    found = chunked["long.md"]
    assert [c[2:] for c in found] == [(1, 200), (201, 201)]


def test_empty_markdown(chunked):
    assert chunked["empty.md"] == []


def test_yaml_keys(chunked):
    found = chunked["conf.yaml"]
    assert [c[1] for c in found] == [None, "web", "store", "last"]
    assert found[1][2:] == (3, 5) and found[2][2:] == (6, 7)


def test_toml_tables(chunked):
    found = chunked["conf.toml"]
    assert [c[2:] for c in found][1:] == [(3, 5), (6, 7)]


def test_json_members(chunked):
    found = chunked["p.json"]
    assert [c[1] for c in found] == ["name", "jobs", "last"] and found[1][2:] == (3, 5)


def test_json_fallbacks(chunked):
    for path in ("array.json", "none.json", "cut.json"):
        assert [c[0] for c in chunked[path]] == ["window"]


def test_go(chunked):
    found = chunked["a.go"]
    assert found == [("function", "Sum", 3, 5), ("interface", "Area", 7, 9), ("struct", "Box", 11, 13), ("method", "Size", 15, 17)]


def test_python(chunked):
    found = chunked["a.py"]
    assert found == [("class", "Box", 4, 11), ("function", "size", 5, 8), ("function", "name", 10, 11), ("function", "free", 14, 15)]


def test_rust(chunked):
    found = chunked["a.rs"]
    assert [c[:2] for c in found] == [("function", "sum"), ("struct", "P"), ("struct", "K"), ("interface", "S"), ("function", "area"), ("function", "norm")]
    assert found[0][2:] == (1, 3) and found[4][2:] == (14, 14) and found[5][2:] == (18, 20)


def test_ruby(chunked):
    found = chunked["a.rb"]
    assert found == [("class", "M", 1, 11), ("class", "C", 2, 10), ("method", "go", 3, 5), ("method", "make", 7, 9)]


def test_keys_count_repeats(chunked):
    assert chunked["keys"] == ["keys.py::1::f#0", "keys.py::1::f#1"]


def test_no_files(spark):
    assert chunkers.chunk_files(spark.createDataFrame([], "repo string, path string, text string")).count() == 0
