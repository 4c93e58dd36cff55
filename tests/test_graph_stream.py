"""Graph, diff, sources and watch operators on small literal inputs."""

import random

import pytest
from pyspark.sql import functions as F

from quarryline.functions import hashing, paths
from quarryline.operators import chunkers, diff, graph
from quarryline.sources.files import Snapshots
from quarryline.streaming import watch


def test_import_resolution(spark):
    imports = spark.createDataFrame([("a", "./util"), ("b", "crate::store"), ("c", "fmt"), ("d", "./twin"), ("e", "ex.org/m/net")], "src string, name string")
    files = spark.createDataFrame([("web/util.ts",), ("src/store.rs",), ("lib/fmt.go",), ("x/twin.ts",), ("y/twin.ts",), ("net/net.go",)], "path string")
    found = {r["src"]: (r["dst"], r["confidence"]) for r in graph.resolve_imports(imports, files).collect()}
    assert found["a"] == ("file:web/util.ts", 0.95) and found["b"] == ("file:src/store.rs", 0.95)
    assert found["c"][0] == "mod:fmt" and found["d"][0] == "mod:./twin"


def test_resolved_confidence(spark):
    nodes = spark.createDataFrame([("a1", "go", "a.go", 0), ("b1", "go", "b.go", 1)] + [(f"m{i}", "many", f"m{i}.go", 10 + i) for i in range(4)], "id string, name string, path string, seq long").selectExpr("id", "'function' AS kind", "'go' AS lang", "name", "path", "1 AS start_line", "2 AS end_line", "seq")
    refs = spark.createDataFrame([("a1", "go", "a.go", 3), ("b1", "many", "b.go", 4)], "src string, name string, path string, line int").selectExpr("*", "'CALLS' AS kind")
    found = sorted((r["src"], r["dst"], round(r["confidence"], 4)) for r in graph.resolve_names(refs, nodes).collect())
    assert found == [("a1", "a1", 0.9)] + [("b1", f"m{i}", 0.5625) for i in range(4)]


def test_prefix_is_component_aware(spark):
    rows = spark.createDataFrame([("pkg/a.go",), ("pkgx/a.go",), ("pkg",), (None,)], "path string")
    assert sorted(r[0] for r in rows.filter(paths.under_prefix("path", "pkg")).collect()) == ["pkg", "pkg/a.go"]


def test_sync_rejects_null_keys(spark):
    rows = spark.createDataFrame([("r", None, "h")], "repo string, key string, hash string")
    with pytest.raises(diff.NullKey):
        diff.check_keys(rows)


def test_deleting_a_file_beside_a_folder_of_its_name(spark):
    prev = spark.createDataFrame([("r", "a.c", "1"), ("r", "a/x.c", "2")], "repo string, path string, hash string")
    found = diff.manifest_diff(prev, prev.filter("path <> 'a.c'")).collect()
    assert [(r["path"], r["op"]) for r in found] == [("a.c", "deleted")]


def test_fingerprint_ignores_order(spark):
    rows = [("r", k, bytes([i]) * 32) for i, k in enumerate("cab")]
    of = lambda x: hashing.fingerprint(spark.createDataFrame(x, "repo string, key string, hash binary"), ["repo"]).collect()
    assert of(rows) == of(rows[::-1]) != of([*rows[:2], ("r", "b", b"x" * 32)])


def test_snapshots_return_the_last_version(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}")
    assert store.load("t") is None
    store.save("t", spark.range(3).toDF("id"))
    store.save("t", spark.range(5).toDF("id"))
    assert store.load("t").count() == 5


def test_merge_kind():
    assert watch.merge_kind("DELETE", "MODIFY") == "DELETE" and watch.merge_kind("DELETE", "CREATE") == "CREATE" and watch.merge_kind("CREATE", "MODIFY") == "MODIFY"


def test_stream_equals_batch(spark, tmp_path):
    rows = [("r", f"p{i % 5}", k, 1000 + i, i) for i, k in enumerate(["CREATE", "MODIFY", "DELETE", "RENAME", "CREATE", "DELETE", "MODIFY"] * 4)]
    events = spark.createDataFrame(rows, "repo string, path string, kind string, at long, seq long").selectExpr("repo", "path", "kind", "timestamp_seconds(at) AS ts", "seq")
    events.repartition(1).write.parquet(f"file://{tmp_path}/in")
    got = {}

    def step(changes, batch_id):
        got.update({r["path"]: r["kind"] for r in changes.collect()})

    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    query = watch.run_incremental(stream, step, f"file://{tmp_path}/checkpoint")
    query.awaitTermination(120)
    assert got == {r["path"]: r["kind"] for r in watch.merge_kinds(events).collect()}
    state = watch.merged_stream(stream).writeStream.outputMode("update").format("memory").queryName("merged").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    state.awaitTermination(120)
    assert got == {r["path"]: r["kind"] for r in spark.table("merged").collect()}


def test_two_repositories_with_the_same_paths_stay_apart(spark):
    own = "def helper():\n    return 1\n\n\ndef run():\n    return helper()\n"
    other = "import a\n\n\ndef run():\n    return helper()\n"
    files = spark.createDataFrame([("one", "a.py", own, 1), ("two", "a.py", own, 1), ("two", "b.py", other, 2), ("three", "b.py", other, 2)], "repo string, path string, text string, seq long")
    nodes, refs = graph.build_graph(files)
    assert nodes.groupBy("repo", "id").count().filter("count > 1").isEmpty() and nodes.filter("kind <> 'module'").count() == 10
    edges = graph.edges_view(refs, nodes).cache()
    calls = sorted(map(tuple, edges.filter("kind = 'CALLS'").select("repo", "src", "dst").collect()))
    key = lambda path, name: next(r.id for r in nodes.collect() if r.path == path and r.name == name)
    assert calls == [("one", key("a.py", "run"), key("a.py", "helper")), ("two", key("a.py", "run"), key("a.py", "helper")), ("two", key("b.py", "run"), key("a.py", "helper"))]
    imports = sorted(map(tuple, edges.filter("kind = 'IMPORTS'").select("repo", "src", "dst").collect()))
    assert imports == [("three", "file:b.py", "mod:a"), ("two", "file:b.py", "mod:a")] or imports == [("three", "file:b.py", "mod:a"), ("two", "file:b.py", "file:a.py")]
    hops = graph.trace_path(nodes, edges, "helper", repo="one").collect()
    assert {(r.repo, r.node) for r in hops} == {("one", key("a.py", "run"))}
    assert graph.references(edges, nodes, "helper", repo="two").count() == 2 and graph.references(edges, nodes, "helper").count() == 3
    assert {(r.repo, r.degree) for r in graph.hubs(edges, nodes).collect() if r.id == key("a.py", "helper")} == {("one", 1), ("two", 2)}
    left_nodes, left_refs = graph.apply_fragment(nodes, refs, nodes.limit(0), refs.limit(0), spark.createDataFrame([("two", "a.py")], "repo string, path string"))
    assert left_nodes.filter("path = 'a.py'").select("repo").distinct().collect()[0].repo == "one"
    assert left_refs.filter("repo = 'one'").count() == refs.filter("repo = 'one'").count()
    with pytest.raises(ValueError):
        graph.trace(edges, spark.createDataFrame([("x",)], "seed string"))


def test_containers_by_a_sweep(spark):
    rng = random.Random(4)
    rows = []

    def nest(path, start, end, depth):
        at = start + 1
        while at + 4 < end and len(rows) < 3000:
            stop = rng.randrange(at + 2, end)
            rows.append(("r", path, f"{path}{len(rows)}", rng.choice(["class", "struct", "function", "method"]), at, stop))
            if depth < 6:
                nest(path, at, stop, depth + 1)
            at = stop + rng.randrange(1, 5)

    for f in range(6):
        nest(f"f{f}", 0, 2000, 0)
    defs = spark.createDataFrame(rows, "repo string, path string, id string, kind string, start int, end int")
    expected = {}
    for _, p, i, _, a, b in rows:
        around = [(d - c, j) for _, q, j, k, c, d in rows if q == p and k in ("class", "struct") and c <= a and d >= b and d - c > b - a]
        if around:
            expected[i] = min(around)[1]
    assert {r.id: r.container for r in graph.containers(defs).collect()} == expected and len(expected) > 300


def test_a_hundred_thousand_definitions_in_a_file(spark):
    rows = spark.range(100_000).select(F.lit("a").alias("path"), F.col("id").cast("string").alias("id"), F.when(F.col("id") % 10 == 0, "class").otherwise("method").alias("kind"), (F.col("id") * 10).alias("start"), F.when(F.col("id") % 10 == 0, F.col("id") * 10 + 99).otherwise(F.col("id") * 10 + 5).alias("end"))
    found = graph.containers(rows)
    assert found.count() == 90_000 and found.filter(F.col("container").cast("long") != F.floor(F.col("id").cast("long") / 10) * 10).isEmpty()


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


RUST = 'use crate::a::b;\n\nstruct Foo {\n    n: i32,\n}\n\nimpl Foo {\n    fn z(&self) -> i32 {\n        help(self.n) // no(1)\n    }\n}\n\nfn help(x: i32) -> i32 { x }\n'


def test_references_of_a_file_need_no_join(spark):
    """All that a line's references need is in the row of its file, which is read by its tokens once."""
    files = spark.createDataFrame([("r", "a.rs", "rust", RUST), ("r", "b.rs", "rust", None)], "repo string, path string, lang string, text string")
    refs = graph.extract_refs(graph.table_between_rounds(chunkers.read_code(files)))
    assert "Join" not in _plan(refs) and "MapInArrow" not in _plan(refs)
    found = sorted((r["src"], r["name"], r["kind"], r["line"], r["rev"]) for r in refs.collect())
    assert found == [("a.rs::1::z#0", "Foo", "CONTAINS", 8, True), ("a.rs::1::z#0", "help", "CALLS", 9, False), ("file:a.rs", "crate::a::b", "IMPORTS", 1, False)]


def test_names_are_resolved_once(spark):
    """Those that name their container instead along with the others; the refs' other kinds don't meet the imports."""
    nodes, refs = graph.build_graph(spark.createDataFrame([("r", "a.rs", RUST, 1)], "repo string, path string, text string, seq long"))
    edges = graph.edges_view(refs, nodes)
    assert _plan(edges).count("Window [") <= 2
    assert {(r["src"], r["dst"]) for r in edges.filter("resolution = 'TEXTUAL'").collect()} == {("a.rs::4::Foo#0", "a.rs::1::z#0"), ("a.rs::1::z#0", "a.rs::1::help#0")}


def test_changed_symbols_are_one_frontier(spark, monkeypatch):
    """A node that many of them reach is kept once, not once for each."""
    kept = []

    class Counted(graph.Rounds):
        def save(self, df):
            out = super().save(df)
            kept.append(out.count())
            return out

    monkeypatch.setattr(graph, "Rounds", Counted)
    near = [(f"n{i}", f"n{i}", "b.c", 10 * i) for i in range(30)]
    nodes = spark.createDataFrame([(f"s{i}", "s", "a.c", 1) for i in range(50)] + near + [("far", "far", "c.c", 1), ("off", "off", "c.c", 9)], "id string, name string, path string, start_line int").selectExpr("*", "start_line + 1 AS end_line")
    calls = [(f"s{i}", f"n{k}") for i in range(50) for k in range(30)] + [("far", "n7"), ("off", "far"), ("n1", "n2")]
    edges = spark.createDataFrame(calls, "src string, dst string").selectExpr("*", "'CALLS' AS kind", "1.0D AS confidence", "1 AS line")
    hunks = spark.createDataFrame([("a.c", 2)], "path string, line int")
    found = graph.changed_symbols(hunks, nodes.withColumnRenamed("name", "symbol"), edges, nodes)
    assert [tuple(r) for r in found.collect()][:1] == [("s", "a.c", "direct")]
    names = [r["name"] for r in found.filter("risk = 'transitive'").collect()]
    assert len(names) == 20 and set(names) < {f"n{i}" for i in range(30)}
    every = graph.changed_symbols(hunks, nodes.withColumnRenamed("name", "symbol"), edges, nodes, limit=100)
    assert {r["name"] for r in every.filter("risk = 'transitive'").collect()} == {f"n{i}" for i in range(30)} | {"far"}
    assert max(kept) == 50 and sum(kept) <= 2 * nodes.count()


def test_tables_of_many_rows_are_not_broadcast(spark, tmp_path, monkeypatch):
    """However small their files are; calls by odd rows are those of the SQL."""
    import duckdb

    from quarryline.operators import rounds
    from quarryline.plans import data
    from quarryline.plans.queries import REFS

    part = [(k, f"name{k % 7}", f"file{k % 5}") for k in range(40)] + [(3, "twice", "other"), (4, None, "file4"), (5, "name5", None), (None, "none", "none")]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    item = [(i, i % 45, i % 11) for i in range(500)] + [(7, None, 1), (8, 1, None), (None, 9, 2)]
    spark.createDataFrame(item, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    few = data.named_refs(spark, str(tmp_path))
    monkeypatch.setattr(rounds, "BROADCAST_ROWS", 10)
    many = data.named_refs(spark, str(tmp_path))
    physical = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in physical(few) and "Broadcast" not in physical(many)
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    wanted = sorted(con.execute(f"WITH {REFS} SELECT src, name, path, line FROM refs").fetchall(), key=repr)
    for got in (few, many):
        assert sorted((tuple(r) for r in got.select("src", "name", "path", "line").collect()), key=repr) == wanted
