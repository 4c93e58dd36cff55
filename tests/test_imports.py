"""What an import's name leads to: maps of whole names, unique ends of paths, else a module."""

import pytest

from quarryline.operators import graph

#: files of a repository, module prefixes, import, what it leads to.
CASES = [
    (["fmt.go", "main.go"], [], "fmt", "mod:fmt"),
    (["encoding/json.go"], ["ex.org/app"], "encoding/json", "mod:encoding/json"),
    (["internal/helper/helper.go", "pkg/util.go"], ["ex.org/app"], "ex.org/app/internal/helper", "file:internal/helper/helper.go"),
    (["pkg/b.go", "pkg/a.go", "pkg/c.txt"], ["ex.org/app"], "ex.org/app/pkg", "file:pkg/a.go"),
    (["main.go", "pkg/b.go"], ["ex.org/app"], "ex.org/app", "file:main.go"),
    (["pkg/b.go"], ["ex.org/app"], "ex.org/application/pkg", "mod:ex.org/application/pkg"),
    (["helper.ts", "json.ts"], [], "./helper", "file:helper.ts"),
    (["helper.ts", "json.ts"], [], "json", "mod:json"),
    (["util.ts", "x/util.ts"], [], "./util", "file:util.ts"),
    (["w/util.ts", "x/util.ts"], [], "./util", "mod:./util"),
    (["util/a.ts", "util/b.ts"], [], "./util", "mod:./util"),
    (["util/a.ts"], [], "./util", "file:util/a.ts"),
    (["src/helper.rs", "src/main.rs"], [], "crate::helper", "file:src/helper.rs"),
    (["src/a/b.rs"], [], "crate::a::b", "file:src/a/b.rs"),
    (["pkg/sub/__init__.py", "x/pkg/sub.py"], [], "pkg.sub", "file:pkg/sub/__init__.py"),
    (["os.py"], [], "os", "mod:os"),
    (["lib/list.h", "lib/list.c"], [], "lib/list.h", "file:lib/list.h"),
    ([], [], "./none", "mod:./none"),
]


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(f"r{i}", p) for i, (paths, *_) in enumerate(CASES) for p in paths], "repo string, path string")
    prefixes = spark.createDataFrame([(f"r{i}", p) for i, (_, own, *_) in enumerate(CASES) for p in own], "repo string, prefix string")
    imports = spark.createDataFrame([(f"r{i}", "file:x", name) for i, (_, _, name, _) in enumerate(CASES)], "repo string, src string, name string")
    return {r["repo"]: r for r in graph.resolve_imports(imports, files, prefixes).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_import(found, i):
    row, want = found[f"r{i}"], CASES[i][3]
    assert row["dst"] == want and row["confidence"] == (0.95 if want.startswith("file:") else 1.0)


def test_the_first_file_by_order(spark):
    files = spark.createDataFrame([("pkg/a.go", 2), ("pkg/b.go", 1)], "path string, seq long")
    row = graph.resolve_imports(spark.createDataFrame([("s", "m/pkg")], "src string, name string"), files, spark.createDataFrame([("m",)], "prefix string")).first()
    assert row["dst"] == "file:pkg/b.go"
