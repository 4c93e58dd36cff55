"""The stored vector index: exact by its bound, approximate by bytes, changed and opened again."""

import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import vectors
from quarryline.operators.vector_index import Conflict, VectorIndex

VECTORS, QUERIES = "id long, vector array<double>", "query_id long, q array<double>"


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))


def all_pairs(table, queries, k):
    return rows_of(vectors.knn(table, queries, k, "id", "vector"))


def clustered(n=6000, dim=16, clusters=60, seed=2, spread=0.05):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(clusters)]
    return [(i, [c + rng.gauss(0, spread) for c in centres[i % clusters]]) for i in range(n)]


def test_clusters_are_searched_exactly_in_few_cells(spark, tmp_path):
    table = spark.createDataFrame(clustered(), VECTORS).repartition(4).cache()
    queries = table.filter("id % 200 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    index = VectorIndex(spark, f"file://{tmp_path}/index").create(table)
    found = index.search(queries, 10)
    assert rows_of(found) == all_pairs(table, queries, 10)
    assert index.looked_at <= 0.15
    near = index.search(queries, 10, exact=False, probe=4)
    assert index.looked_at <= 0.15
    true = {r[:2] for r in all_pairs(table, queries, 10)}
    assert len({r[:2] for r in rows_of(near)} & true) >= 0.9 * len(true)


def test_vectors_without_clusters_by_bytes(spark, tmp_path):
    """Where no cell can be left out, bytes tell which 15 % of the vectors at most are scored in full."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = table.filter("id % 25 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    index = VectorIndex(spark, f"file://{tmp_path}/index").create(table)
    true = {r[:2] for r in all_pairs(table, queries, 10)}
    found = {r[:2] for r in rows_of(index.search(queries, 10, exact=False))}
    assert len(found) == len(true) and len(found & true) >= 0.99 * len(true)
    assert 10 * 10 <= 0.15 * table.count()
    assert rows_of(index.search(queries, 10)) == all_pairs(table, queries, 10)
    # bytes take about a quarter of 32-bit numbers, and less than the vectors' columns
    sizes = index.rows().agg(F.sum(F.octet_length("code")).alias("code"), F.sum(F.size("vector") * 4).alias("full")).first()
    assert sizes["code"] * 4 == sizes["full"]
    plan = index.rows(("id", "code", "cell"), [0, 1])._jdf.queryExecution().executedPlan().toString()
    assert "vector" not in plan.split("ReadSchema")[1] and "cell" in plan.split("PartitionFilters")[1]


@pytest.mark.parametrize("dim", [4, 768])
def test_add_remove_replace_and_reopen(spark, tmp_path, dim):
    rng = random.Random(dim)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(60)]
    folder = f"file://{tmp_path}/index"
    index = VectorIndex(spark, folder)
    assert not index.exists()
    with pytest.raises(FileNotFoundError):
        index.search(spark.createDataFrame([], QUERIES), 3)
    index.create(spark.createDataFrame(rows[:40], VECTORS))
    index.add(spark.createDataFrame(rows[40:], VECTORS))
    queries = spark.createDataFrame([(i, v) for i, v in rows[:5]], QUERIES)
    assert rows_of(VectorIndex(spark, folder).search(queries, 7)) == all_pairs(spark.createDataFrame(rows, VECTORS), queries, 7)
    index.remove(spark.createDataFrame([(0,), (7,), (99,)], "id long"))
    index.add(spark.createDataFrame([(1, [-x for x in rows[1][1]])], VECTORS))
    live = [(i, [-x for x in v] if i == 1 else v) for i, v in rows if i not in (0, 7)]
    expected = all_pairs(spark.createDataFrame(live, VECTORS), queries, 7)
    assert rows_of(VectorIndex(spark, folder).search(queries, 7)) == expected
    index.compact()
    assert rows_of(VectorIndex(spark, folder).search(queries, 7)) == expected and index.rows().count() == 58
    index.add(spark.createDataFrame([rows[0]], VECTORS))
    assert index.rows().count() == 59
    index.clear()
    assert index.exists() and rows_of(index.search(queries, 7)) == []
    index.wipe()
    assert not index.exists()


def test_orthogonal_equal_and_empty_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 2.0]), (4, [2.0, 0.0, 0.0]), (5, [0.0, 0.0, 0.0]), (6, None), (None, [1.0, 1.0, 1.0]), (7, [-1.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, VECTORS)
    whole = table.filter("id IS NOT NULL AND vector IS NOT NULL")
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, [0.0, 3.0, 4.0])], QUERIES)
    index = VectorIndex(spark, f"file://{tmp_path}/a").create(table, cells=3)
    for k in (1, 3, 20):
        assert rows_of(index.search(queries, k)) == all_pairs(whole, queries, k)
    empty = VectorIndex(spark, f"file://{tmp_path}/b").create(table.limit(0))
    assert rows_of(empty.search(queries, 3)) == []
    assert rows_of(empty.add(table).search(queries.filter("query_id = 1"), 2)) == all_pairs(whole, queries.filter("query_id = 1"), 2)
    assert rows_of(index.search(queries.limit(0), 3)) == []


def test_a_commit_is_taken_once_and_failed_ones_are_passed_over(spark, tmp_path):
    table = spark.createDataFrame(clustered(40, 4, 4), VECTORS)
    folder = f"file://{tmp_path}/index"
    index = VectorIndex(spark, folder).create(table)
    number, batches = index._last()
    index._commit(number + 1, batches)
    with pytest.raises(Conflict):
        VectorIndex(spark, folder)._commit(number + 1, batches[:1])
    (tmp_path / "index/commits/000000000009").write_text("vectors-that-were-never-written")
    assert VectorIndex(spark, folder).rows().count() == 40
    assert VectorIndex(spark, folder).add(table.limit(3)).rows().count() == 40 and index._last()[0] == 10


def test_rounding_to_zero_keeps_the_sign(spark):
    """As SQL has it: -1e-9 becomes -0.0, and half of the last digit goes away from zero."""
    values = [-1e-9, 1e-9, -0.0, 0.0, 0.1234565, -0.5, 2.5e-6, 3e12 + 0.25]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).select(vectors.rounded(F.col("x"))).collect()]
    assert [str(v) for v in got] == ["-0.0", "0.0", "-0.0", "0.0", str(got[4]), "-0.5", "3e-06", "3000000000000.25"]
    assert abs(got[4] - 0.1234565) <= 0.51e-6


def plain_knn(table, queries, k, by=lambda r: ()):
    out = {}
    for qid, q in queries:
        for r in table:
            v = r[1]
            if v is None or q is None or None in v or None in q:
                score = None
            else:
                one, other = (sum(x * x for x in w) ** 0.5 for w in (v, q))
                score = round(sum(x * y for x, y in zip(v, q, strict=True)) / (one * other), 6) if one and other else float(one == other)
            out.setdefault((qid, *by(r)), []).append((score is None, -(score or 0.0), r[0], score))
    return {(*key, i, score, n) for key, rows in out.items() for n, (_, _, i, score) in enumerate(sorted(rows, key=lambda x: x[:3])[:k], 1)}


def test_knn_by_matrices_is_knn_by_pairs(spark):
    """Ties, zero vectors, nulls, groups that are null."""
    rng = random.Random(8)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)], rng.choice(["a", "b", None])) for i in range(300)]
    rows += [(300 + i, v, "a") for i, v in enumerate([None, [0.0] * 4, [1.0, None, 0.0, 0.0], [0.0] * 4])]
    asked = [(i, rows[i][1]) for i in range(0, 300, 10)] + [(900, [0.0] * 4), (901, None)]
    table = spark.createDataFrame(rows, "id long, vector array<double>, g string").repartition(3)
    queries = spark.createDataFrame(asked, QUERIES)
    found = vectors.knn(table, queries, 5, "id", "vector")
    assert set(rows_of(found)) == plain_knn(rows, asked, 5)
    by = vectors.knn(table, queries, 400, "id", "vector", by=["g"])
    assert {tuple(r) for r in by.select("query_id", "g", "id", "score", "rank").collect()} == plain_knn(rows, asked, 400, lambda r: (r[2],))
    # no row for every pair of a vector and a query
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_cells_meet_queries_without_a_row_for_every_pair(spark, tmp_path):
    """Zero vectors and queries too; what is asked of a cell goes to the tasks as one table."""
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(400)] + [(400 + i, [0.0] * 4) for i in range(3)]
    asked = [(i, rows[i][1]) for i in range(0, 400, 9)] + [(900, [0.0] * 4)]
    table, queries = spark.createDataFrame(rows, VECTORS), spark.createDataFrame(asked, QUERIES)
    found = VectorIndex(spark, f"file://{tmp_path}/index").create(table, 9).search(queries, 7)
    assert set(rows_of(found)) == plain_knn(rows, asked, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "HashJoin" not in plan
