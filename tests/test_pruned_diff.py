"""The diff of stored manifests reads only parts with a directory that differs."""

import pytest

from quarryline.operators import diff

PREV = {f"d{i}/s{j}/f{k}.c": f"h{i}{j}{k}" for i in range(6) for j in range(3) for k in range(2)} | {"top.c": "t"}
NOW = {p: h for p, h in PREV.items() if not p.startswith("d5/s2/")} | {"d1/s1/f0.c": "new", "d1/s1/n/x.c": "1", "d7/y.c": "2"}


@pytest.fixture
def stored(spark, tmp_path):
    def store(name, leaves):
        rows = spark.createDataFrame([("r", p, h) for p, h in leaves.items()], "repo string, path string, hash string")
        diff.by_directory(rows).write.partitionBy("part").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}"), diff.directory_rollup(rows)

    return store


def test_equals_the_whole_diff(stored):
    (a, x), (b, y) = stored("a", PREV), stored("b", NOW)
    found = diff.pruned_manifest_diff(a, b, x, y)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, diff.manifest_diff(a, b).collect()))
    assert found.count() == 5
    dirs = {r["dir"] for r in diff.changed_directories(x, y).collect()}
    assert dirs == {"", "d1", "d1/s1", "d1/s1/n", "d5", "d5/s2", "d7"}


def _files_read(spark, df) -> int:
    """Files that the scans of an executed plan have read."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        leaves = plan.collectLeaves()
        metrics = [leaves.apply(i).metrics().get("numFiles") for i in range(leaves.size())]
        paths = [leaves.apply(i).toString() for i in range(leaves.size())]
        return sum(m.get().value() for m, p in zip(metrics, paths, strict=True) if m.isDefined() and "part#" in p and "hash#" in p)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_only_parts_that_differ_are_read(spark, stored):
    (a, x), (b, y) = stored("a", PREV), stored("b", NOW)
    whole = _files_read(spark, diff.manifest_diff(a, b, ("repo", "part")))
    read = _files_read(spark, diff.pruned_manifest_diff(a, b, x, y))
    assert 0 < read < whole / 2


def test_equal_trees_read_nothing(spark, stored):
    (a, x), (b, y) = stored("a", PREV), stored("b", PREV)
    found = diff.pruned_manifest_diff(a, b, x, y)
    assert found.count() == 0 and _files_read(spark, found) == 0
