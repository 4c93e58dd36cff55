"""Engine steps, functions without a table of their own, and what must be rejected."""

import pytest
from pyspark.sql import functions as F

from quarryline import schemas
from quarryline.functions import hashing, paths, text
from quarryline.operators import chunkers, diff, engine, graph, pipes, search, vectors, workspace
from quarryline.sources import files as sources
from quarryline.sources.files import Snapshots
from quarryline.streaming import watch


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- hashes and ids


def test_known_hashes(spark):
    assert one(spark, F.hex(hashing.content_hash(F.lit(b"")))) == "7F498D4624C30160D8984701D306AA99" + "00" * 16
    assert int(one(spark, hashing.fnv1a_base36(F.lit("a"))), 36) == 0xE40C292C
    assert int(one(spark, hashing.fnv1a_base36(F.lit(""))), 36) == 0x811C9DC5


def test_node_ids_have_the_top_bit_and_differ_by_tag(spark):
    a, b = one(spark, hashing.file_node_id(F.lit("x"))), one(spark, hashing.module_node_id(F.lit("x")))
    assert a < 0 and b < 0 and a != b


def test_range_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [("r", f"k{i}", str(i)) for i in range(300)]
    of = lambda x: hashing.fingerprint_ranges(spark.createDataFrame(x, "repo string, key string, hash string"), ["repo"]).collect()
    assert of(rows) == of(rows[::-1]) != of([*rows[1:], ("r", "k0", "x")])


def test_deep_directories_are_rolled_up(spark):
    deep = "/".join(["d"] * 90) + "/f"
    root = lambda h: {(r.dir, r.depth): r.fingerprint for r in diff.directory_rollup(spark.createDataFrame([("r", deep, h), ("r", "a", "1")], "repo string, path string, hash string")).collect()}
    a, b = root("1"), root("2")
    assert max(d for _, d in a) == 90 and a[("", 0)] != b[("", 0)]


# --- kinds and names


def test_kind_names_and_masks():
    assert schemas.kind_code("Function") == 1 and schemas.kind_code("") is None
    assert schemas.node_kinds("symbol") == schemas.SYMBOL_NODES and schemas.edge_kinds("calls") == ("CALLS",)
    for call in (schemas.kind_code, schemas.node_kinds, schemas.edge_kinds):
        with pytest.raises(schemas.UnknownKind):
            call("nonsense")


def test_provider_names():
    assert sources.provider("Postgres") == "pgvector" and sources.quantisation("INT8") == "i8"
    for call in (sources.provider, sources.quantisation):
        with pytest.raises(ValueError):
            call("odd")


def test_globs(spark):
    rows = spark.createDataFrame([("a/b.go",), ("b.go",), ("a/c/b.go",)], "path string")
    hit = lambda g, d: sorted(r.path for r in rows.filter(paths.matches_glob("path", g, d)).collect())
    assert hit("*.go", paths.pathname_glob) == ["b.go"] and hit("**/b.go", paths.double_star_glob) == ["a/b.go", "a/c/b.go", "b.go"]


@pytest.mark.parametrize("path", ["/etc/passwd", "..", "a/../../b", "..\\x", "\\x"])
def test_paths_that_lead_out(path):
    with pytest.raises(engine.PathEscape):
        engine.safe_relative(path)


def test_paths_within():
    assert engine.safe_relative("a//./b/../c") == "a/c" and engine.safe_relative("") == "."


# --- trees on disk


def test_walk_reads_a_tree(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "sub/b.md": b"# \xc3\xa9 \xff\n", "node_modules/c.js": b"no", "vendor/d.go": b"no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = {r.path: (r.lang, r.text) for r in sources.read_files(spark, "r", f"file://{tmp_path}").collect()}
    assert found == {"a.py": ("python", "x = 1\n"), "sub/b.md": ("markdown", "# é \ufffd\n")}
    assert {(r.path, r.size) for r in sources.file_listing(spark, "r", f"file://{tmp_path}").collect()} == {("a.py", 6), ("sub/b.md", 7)}


TREE = [("r", "a.py", "def f():\n    return g()\n"), ("r", "b.py", "def g():\n    pass\n"), ("r", "c.md", "# T\nx\n"), ("r", "d.go", "package d\n\nfunc main() { g() }\n")]


def test_warm_run_equals_cold_run(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "repo string, path string, text string")
    later = [TREE[0], ("r", "b.py", "def g():\n    return 2\n\n\ndef h():\n    pass\n"), TREE[3], ("r", "e.txt", "new\n")]
    store, cold = Snapshots(spark, f"file://{tmp_path}/warm"), Snapshots(spark, f"file://{tmp_path}/cold")
    assert not engine.index_tree(store, frame(TREE)).warm
    second = engine.index_tree(store, frame(later))
    assert second.warm
    engine.index_tree(cold, frame(later))
    for name in ("chunks", "manifest", "nodes", "refs"):
        rows = lambda s: sorted(map(str, s.load(name).collect()))  # noqa: B023, E731
        assert rows(store) == rows(cold)


MORE = [
    ("r", "pkg/util.py", "def helper():\n    return 1\n"), ("r", "pkg/run.py", "from pkg.util import helper\n\n\ndef run():\n    return helper()\n"), ("s", "pkg/run.py", "from pkg.util import helper\n\n\nclass A:\n    def run(self):\n        return helper()\n"),
]


def test_small_steps_equal_one_cold_run_and_a_repeated_batch_changes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "KEPT", 1)
    frame = lambda rows: spark.createDataFrame(rows, "repo string, path string, text string")
    paths = lambda rows: spark.createDataFrame([r[:2] for r in rows], "repo string, path string")
    steps = Snapshots(spark, f"file://{tmp_path}/steps")
    # users of a module come first, then the file that one import means
    begun = [*TREE, MORE[1], MORE[2]]
    now = {r[:2]: r for r in begun}
    assert engine.index_step(steps, frame(begun), paths(begun), "0")
    changes = [MORE[0], ("r", "c.md", None), ("r", "b.py", "def g():\n    return 3\n")]
    for repo, path, text_ in changes:
        now.pop((repo, path), None)
        if text_ is not None:
            now[repo, path] = (repo, path, text_)
    assert engine.index_step(steps, frame(list(now.values())), paths(changes), "1")
    before = steps._last_set()
    assert not engine.index_step(steps, frame(TREE), paths(changes), "1") and steps._last_set() == before
    cold = Snapshots(spark, f"file://{tmp_path}/cold")
    engine.index_tree(cold, frame(list(now.values())))
    for name in ("chunks", "manifest", "nodes", "refs"):
        rows = lambda s: sorted(map(str, s.load_all()[0][name].collect()))  # noqa: B023, E731
        assert rows(steps) == rows(cold)
    imports = {(r.repo, r.path): r.dst for r in steps.load("refs").filter("kind = 'IMPORTS' AND name = 'pkg.util'").collect()}
    assert imports == {("r", "pkg/run.py"): "file:pkg/util.py", ("s", "pkg/run.py"): "mod:pkg.util"}
    versions = [p.name for p in (tmp_path / "steps/together").iterdir() if p.name.startswith("v=")]
    assert len(versions) == 1


def test_a_damaged_version_is_a_cold_start(spark, tmp_path):
    import shutil

    frame = spark.createDataFrame(TREE, "repo string, path string, text string")
    store = Snapshots(spark, f"file://{tmp_path}/s")
    engine.index_tree(store, frame)
    for nodes in (tmp_path / "s/together").glob("v=*/nodes"):
        shutil.rmtree(nodes)
    assert store.load_all() == ({}, "")
    assert not engine.index_tree(store, frame).warm and store.load("nodes").count() > 0
    assert engine.index_tree(store, frame).warm


def test_fragments_replace_and_remove_files(spark):
    nodes = spark.createDataFrame([("a", "x.py", "function"), ("b", "y.py", "function")], "id string, path string, kind string")
    refs = spark.createDataFrame([("a", "mod:os", "x.py", "IMPORTS"), ("b", "mod:re", "y.py", "IMPORTS")], "src string, dst string, path string, kind string")
    gone = spark.createDataFrame([("x.py",)], "path string")
    new_nodes, new_refs = graph.apply_fragment(nodes, refs, nodes.limit(0), refs.limit(0), gone)
    assert [r.id for r in new_nodes.collect()] == ["b"] and [r.dst for r in new_refs.collect()] == ["mod:re"]
    modules = spark.createDataFrame([("mod:os", None, "module"), ("mod:re", None, "module")], nodes.schema)
    assert sorted(r.id for r in graph.live_modules(new_nodes.unionByName(modules), new_refs).collect()) == ["b", "mod:re"]
    edges = new_refs.select("src", "dst", "kind")
    assert graph.edges_from(edges, "b", "IMPORTS").count() == 1 and graph.edges_to(edges, "mod:re").count() == 1


def test_module_prefixes(spark):
    rows = [("go.mod", "module ex.org/app\n\ngo 1.22\n"), ("web/package.json", '{"name": "@a/web"}'), ("rs/Cargo.toml", '[package]\nname = "my-crate"\nversion = "1"\n'), ("x.go", "module no")]
    found = graph.module_prefixes(spark.createDataFrame(rows, "path string, text string")).collect()
    assert sorted(r.prefix for r in found) == ["@a/web", "ex.org/app", "my_crate"]
    imports = spark.createDataFrame([("f", "ex.org/app/net/http"), ("g", "other.org/net/http")], "src string, name string")
    files = spark.createDataFrame([("net/http.go",)], "path string")
    out = {r.src: r.dst for r in graph.resolve_imports(imports, files, spark.createDataFrame([("ex.org/app",)], "prefix string")).collect()}
    assert out == {"f": "file:net/http.go", "g": "mod:other.org/net/http"}


# --- chunks


def test_deeply_indented_python_and_files_without_a_path(spark):
    pad = " " * 72
    body = f"class A:\n{pad}def f(self):\n{pad}    return 1\n\n{pad}def g(self):\n{pad}    return 2\nx = 1\n"
    rows = spark.createDataFrame([("r", "a.py", body), ("r", None, "some\ntext\n")], "repo string, path string, text string")
    found = chunkers.chunk_files(rows).collect()
    assert sorted((r.symbol, r.start_line, r.end_line) for r in found if r.path) == [("A", 1, 6), ("f", 2, 3), ("g", 5, 6)]
    assert [r.kind_name for r in found if r.path is None] == ["window"]


# --- tools


@pytest.mark.parametrize("command", ["cat x > y", "cat x; ls", "cat `x`", "cat $(x)", "cat x | | wc", "cat 'x", "ls", "sort -o out", "sort -oout", "sort -uo out", "sort --output=x", "sed -i s/a/b/", "sed -nf x", "rg --pre=x y", "rg -z x", "cat /etc/passwd", "cat ../x", "head x --file=../y", "", "cat x & wc"])
def test_pipes_that_are_not_run(command):
    with pytest.raises(workspace.UnsafePipe):
        for argv in pipes.tokenize_pipe(command):
            pipes.check_stage(argv)


@pytest.mark.parametrize("command", ["grep -v 'a b' | sort -u | uniq -c", "rg -e foo | head -n5", "sed -e s/f/i/ | cut -d, -f1", "tail -3 | wc -l"])
def test_pipes_that_are_run(command):
    for argv in pipes.tokenize_pipe(command):
        pipes.check_stage(argv)


@pytest.mark.parametrize("script", ["w out", "s/a/b/e", "s/a/b/w x", "e ls", "r x", "1,2!d;W x", "y/a/b/;Q"])
def test_sed_scripts_that_are_not_run(spark, script):
    with pytest.raises(workspace.UnsafeSed):
        workspace.sed(spark.createDataFrame([(1, "a")], "line_no long, line string"), script).collect()


LINES = ["b 2", "a 1", "c 3", "a 1", "d 4"]


@pytest.mark.parametrize("command, expected", [
    ("head -n 2", ["b 2", "a 1"]), ("tail -n 2", ["a 1", "d 4"]), ("tr a-c A-C", ["B 2", "A 1", "C 3", "A 1", "d 4"]), ("tr -d 0-9", ["b ", "a ", "c ", "a ", "d "]), ("wc -l", ["5"]), ("paste -s", ["\t".join(LINES)]),
    ("sort -r | head -n 1", ["d 4"]), ("sort -u | wc -l", ["4"]), ("sed -n 2p", ["a 1"]), ("grep -c a", ["2"]), ("cut -d ' ' -f 2 | sort -n | tail -n 1", ["4"]), ("nl | head -n 1", ["1\tb 2"]),
])
def test_stages_of_a_pipe(spark, command, expected):
    rows = spark.createDataFrame(list(enumerate(LINES, 1)), "line_no long, line string").repartition(3)
    assert [r.line for r in pipes.run_pipe(rows, command).orderBy("line_no").collect()] == expected


def test_paste_keeps_the_order_and_its_limit(spark):
    rows = spark.range(70_000).select((70_000 - F.col("id")).alias("line_no"), F.lit("x").alias("line"))
    out = pipes.run_pipe(rows, "paste -s").first()["line"]
    assert len(out) == schemas.FILE_BYTES and set(out) == {"x", "\t"}


def test_tools_and_error_codes():
    tools = engine.Tools()
    tools.register(engine.Tool("b", lambda n: n + 1, {"n": int}, ("n",)))
    tools.register(engine.Tool("a", lambda: None))
    tools.register(engine.Tool("b", lambda n: n + 2, {"n": int}, ("n",)))
    assert tools.names() == ["b", "a"] and engine.in_name_order(tools.names()) == ["a", "b"] and tools.call("b", {"n": 1}) == 3
    for name, args, kind in (("c", {}, engine.NotFound), ("b", {}, engine.InvalidArgument), ("b", {"n": "1"}, engine.InvalidArgument), ("b", {"n": True}, engine.InvalidArgument), ("b", {"n": 1, "m": 2}, engine.InvalidArgument)):
        with pytest.raises(kind):
            tools.call(name, args)
    codes = [(workspace.UnsafePipe(), "UNSAFE_PIPE"), (workspace.UnsafeSed(), "UNSAFE_SED"), (engine.PathEscape(), "FORBIDDEN"), (engine.NotFound(), "NOT_FOUND"), (engine.InvalidArgument(), "INVALID_ARGS"), (NotImplementedError(), "NOT_IMPLEMENTED"), (OSError(), "INTERNAL")]
    assert [engine.error_code(e) for e, _ in codes] == [c for _, c in codes]


def test_retries_then_a_rebuild():
    calls = []

    def write(codes=iter(["IO", "TIMEOUT"])):
        calls.append("w")
        if code := next(codes, None):
            raise engine.StoreError(code)

    assert engine.with_retries(write, lambda: calls.append("r"), pause=0) == "written" and calls == ["w"] * 3
    calls.clear()

    def fail():
        calls.append("w")
        raise engine.StoreError("INTERNAL")

    assert engine.with_retries(fail, lambda: calls.append("r"), pause=0) == "rebuilt" and calls == ["w"] * 4 + ["r"]
    with pytest.raises(engine.StoreError):
        engine.with_retries(lambda: (_ for _ in ()).throw(engine.StoreError("CONFLICT")), lambda: None, pause=0)


def test_unknown_repo_is_an_error(spark):
    rows = spark.createDataFrame([("r", 1)], "repo string, id long")
    assert engine.in_repo(rows, rows, None).count() == engine.in_repo(rows, rows, "r").count() == 1
    with pytest.raises(engine.NotFound):
        engine.in_repo(rows, rows, "x")


def test_sessions_by_id_or_unique_prefix(spark):
    rows = spark.createDataFrame([("abc",), ("abd",), ("ab",), ("x1",)], "id string")
    find = lambda w: [r.id for r in engine.resolve_session(rows, w).collect()]
    assert find("ab") == ["ab"] and find("abc") == ["abc"] and find("x") == ["x1"] and find("a") == [] and find("no") == []


# --- text


def test_budgets_and_formats(spark):
    assert text.history_budget(1001) == 500 and text.prune_budget(1000) == 600
    shown = text.format_scored(F.lit("a:1-2"), F.lit("f"), F.lit(0.5), F.lit(2))
    assert one(spark, shown) == "a:1-2 f  score=0.500 boost=2"
    assert one(spark, text.format_scored(F.lit("a"), F.lit(None).cast("string"), F.lit(1.0), F.lit(0))) == "a  score=1.000"


def test_evidence_of_tools_is_capped(spark):
    hit = F.struct(F.lit("r").alias("repo"), F.lit(0).alias("id"), F.lit("p").alias("path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit("").alias("symbol"))
    rows = spark.createDataFrame([("s", 1, "search"), ("s", 2, "odd")], "session string, seq long, tool string").withColumn("hits", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda _: hit))
    assert text.extract_evidence(rows).count() == text.EVIDENCE_CAPS["search"]


def test_history_of_a_path(spark):
    rows = spark.createDataFrame([("r", "p", k, i) for i, k in enumerate(["CREATE", "DELETE", "MODIFY", "CREATE", "MODIFY"])], "repo string, path string, kind string, seq long").withColumn("ts", F.timestamp_seconds("seq"))
    assert [r.merged for r in watch.ordered_kinds(rows).orderBy("seq").collect()] == ["CREATE", "DELETE", "DELETE", "CREATE", "MODIFY"]


def test_drain_over_a_limit_fails(spark):
    rows = spark.createDataFrame([("r", str(i), "MODIFY") for i in range(3)], "repo string, path string, kind string")
    assert watch.dirty_paths(rows, 3).count() == 3
    with pytest.raises(watch.Overflow):
        watch.dirty_paths(rows, 2)


def test_vectors_without_a_model(spark):
    v = one(spark, vectors.hashed_embedding(F.lit("one two two")))
    assert len(v) == 64 and sum(x * x for x in v) == pytest.approx(1) and sorted(x for x in v if x)[0] * 2 == pytest.approx(max(v))
    assert one(spark, vectors.vector_literal(F.array(F.lit(0.5), F.lit(-1.0)))) == "[0.500000000,-1.00000000]" or one(spark, vectors.vector_literal(F.array(F.lit(0.5), F.lit(-1.0)))) == "[0.5,-1]"


def test_long_bodies_are_cut(spark):
    chunks = spark.createDataFrame([("r", 1, "é" * 40_000), ("r", 2, "x")], "repo string, id long, body string")
    long, short = (search.get_chunk(chunks, "r", i).first() for i in (1, 2))
    assert long.truncated and len(long.body.encode()) == schemas.BODY_BYTES and not short.truncated
