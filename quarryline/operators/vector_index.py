"""A stored index of vectors: cells around centroids, searched in order of distance.

Vectors are kept at length 1, so cosine and distance say the same: d^2 = 2 - 2 cos. Each lies in
the cell of its nearest centroid, and a cell has a radius: its farthest vector. A query looks into
its nearest cells first; a cell whose centroid is farther than its radius plus the distance of the
k-th best so far can't hold anything better (triangle inequality), so all others are left out and
the result is still exact. Next to the vectors the index keeps one byte a component; an
approximate search ranks by products of these and scores only the best of them in full.

Below the index's folder, a batch is one table of vectors by cell, never changed once written. A
commit is a small file named by its number that lists the live batches; making it fails if another
writer took the number, so two writers never mix, and what a failed one left is never read.
Removed ids are batches of their own: they end what earlier batches say of an id.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.operators.rounds import table_between_rounds
from quarryline.operators.vectors import ROW_BLOCK, Best, as_double, cosine, l2_normalize, matrix, query_blocks, schema_of

#: Cells that a query looks into before it has a bound, and the most cells of an index.
FIRST_CELLS, MAX_CELLS = 4, 4096
#: Vectors that centroids are fitted on, and rounds of fitting.
SAMPLE_ROWS, ROUNDS = 20_000, 8
#: Candidates by bytes for each result of an approximate search.
CANDIDATES = 10
#: Distances are exact to this.
SLACK = 1e-6
#: The cell of vectors that have no direction.
NO_CELL = -1
#: Last line of a whole commit.
END = "end"


class Conflict(RuntimeError):
    """Another writer committed first."""


class VectorIndex:
    """open() or create(); add(), remove(), search(), clear(), compact(). Ids are whole numbers."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        #: Share of all pairs of query and vector whose cell was looked into by the last search.
        self.looked_at = 0.0

    # --- storage

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _last(self) -> tuple[int, list[str]]:
        """The last number taken, and the batches of the last whole commit, oldest first."""
        log = self._path("commits")
        if not self._fs().exists(log):
            return 0, []
        names = sorted((s.getPath().getName() for s in self._fs().listStatus(log) if s.getPath().getName().isdigit()), reverse=True)
        for name in names:
            rows = self.spark.read.text(f"{self.folder}/commits/{name}").collect()  # a row per batch
            if rows and rows[-1][0] == END:
                return int(names[0]), [r[0] for r in rows[:-1]]
        return int(names[0]) if names else 0, []

    def _commit(self, number: int, batches: list[str]) -> None:
        """Takes the number by making its file, which only one writer can. A file without END, of a
        writer that failed, is passed over by readers and its number isn't used again."""
        try:
            out = self._fs().create(self._path(f"commits/{number:012}"), False)
        except Py4JJavaError as error:
            raise Conflict(f"commit {number} of {self.folder}") from error
        out.write(bytearray("\n".join([*batches, END]).encode()))
        out.close()

    def exists(self) -> bool:
        return bool(self._last()[1])

    # --- cells

    def create(self, vectors: DataFrame, cells: int | None = None) -> VectorIndex:
        """A new index of vectors(id, vector), in place of what the folder held."""
        number, _ = self._last()
        unit = _unit(vectors)
        n = unit.count()
        cells = max(1, min(MAX_CELLS, cells or round(math.sqrt(n))))
        sample = unit.filter("size(unit) > 0").select("unit").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()
        centroids = fitted_centroids([r["unit"] for r in sample], cells)
        name = f"centroids-{uuid.uuid4().hex}"
        rows = [(i, c.tolist()) for i, c in enumerate(centroids)]
        self.spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{self.folder}/{name}")
        self._commit(number + 1, [name, self._write(unit, centroids)])
        return self

    def _centroids(self, batches: list[str]) -> np.ndarray:
        rows = self.spark.read.schema("cell int, centroid array<double>").parquet(f"{self.folder}/{batches[0]}").orderBy("cell").collect()  # at most MAX_CELLS
        return np.array([r["centroid"] for r in rows]) if rows else np.zeros((0, 0))

    def _write(self, unit: DataFrame, centroids: np.ndarray) -> str:
        batch = f"vectors-{uuid.uuid4().hex}"
        schema = "id long, vector array<double>, code binary, cell int, distance double"
        placed = unit.select("id", "vector", "unit").mapInArrow(_placed(centroids), schema)
        placed.repartition("cell").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{self.folder}/{batch}")
        return batch

    def add(self, vectors: DataFrame) -> VectorIndex:
        """Adds vectors(id, vector); one of an id that the index holds takes its place."""
        number, batches = self._opened()
        self._commit(number + 1, [*batches, self._write(_unit(vectors), self._centroids(batches))])
        return self

    def _opened(self) -> tuple[int, list[str]]:
        number, batches = self._last()
        if not batches:
            raise FileNotFoundError(self.folder)
        return number, batches

    def remove(self, ids: DataFrame) -> VectorIndex:
        """Removes ids(id); one that isn't there is no error."""
        number, batches = self._opened()
        batch = f"removed-{uuid.uuid4().hex}"
        ids.select(F.col("id").cast("long")).distinct().write.parquet(f"{self.folder}/{batch}")
        self._commit(number + 1, [*batches, batch])
        return self

    def clear(self) -> VectorIndex:
        """Forgets all vectors; the cells stay."""
        number, batches = self._opened()
        self._commit(number + 1, batches[:1])
        return self

    def compact(self) -> VectorIndex:
        """Writes what is live as one batch and deletes what earlier commits held."""
        number, batches = self._opened()
        new = self._write(_unit(self.rows().select("id", "vector")), self._centroids(batches))
        self._commit(number + 1, [batches[0], new])
        for name in batches[1:]:
            self._fs().delete(self._path(name), True)
        return self

    def wipe(self) -> None:
        self._fs().delete(self._path(""), True)

    def rows(self, columns: tuple[str, ...] = ("id", "vector", "code", "cell", "distance"), cells: list[int] | None = None) -> DataFrame:
        """The live vectors, of the given cells only if any are given: others' files aren't read."""
        _, batches = self._opened()
        out = None
        for k, name in enumerate(batches[1:], 1):
            if not name.startswith("vectors-") or not self._filled(name):
                continue
            rows = self.spark.read.schema("id long, vector array<double>, code binary, distance double, cell int").parquet(f"{self.folder}/{name}").select(*columns)
            if cells is not None:
                rows = rows.filter(F.col("cell").isin(cells))
            for later in batches[k + 1 :]:  # Spark broadcasts the ids if they are few
                if self._filled(later):
                    rows = rows.join(self.spark.read.parquet(f"{self.folder}/{later}").select("id"), "id", "left_anti")
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], "id long, vector array<double>, code binary, cell int, distance double").select(*columns)
        return out

    def _filled(self, name: str) -> bool:
        return any(not s.getPath().getName().startswith("_") for s in self._fs().listStatus(self._path(name)))

    # --- search

    def _extents(self) -> dict[int, tuple[int, float]]:
        """Number of vectors and radius of each cell: a row per cell."""
        found = self.rows(("id", "cell", "distance")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()
        return {r["cell"]: (r["n"], r["radius"]) for r in found}

    def search(self, queries: DataFrame, k: int, exact: bool = True, probe: int | None = None) -> DataFrame:
        """(query_id, id, score, rank): the k best by cosine of queries(query_id, q), ties by id.

        exact: what a search over all vectors gives. Otherwise a query looks into its `probe`
        nearest cells (none given: all), ranks by bytes, and CANDIDATES * k are scored in full.
        Queries are taken in blocks of about QUERY_BLOCK.
        """
        _, batches = self._opened()
        centroids, extents = self._centroids(batches), self._extents()
        total, looked, asked, out = sum(n for n, _ in extents.values()), 0, 0, None
        for block in query_blocks(queries.select("query_id", as_double("q").alias("q"))):
            rows = block.select("query_id", "q", l2_normalize("q").alias("unit")).collect()  # about QUERY_BLOCK
            ids = [r["query_id"] for r in rows]
            near = _distances([r["unit"] for r in rows], centroids)
            found, pairs = (self._exact if exact else self._by_bytes)(block, rows, near, extents, k, probe)
            out = found if out is None else out.unionByName(found)
            looked, asked = looked + pairs, asked + len(ids)
        self.looked_at = looked / max(total * asked, 1)
        return out if out is not None else queries.select("query_id", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)

    def _exact(self, block, rows, near, extents, k, probe):
        plain = np.array([any(r["q"]) for r in rows], bool)
        cells = np.array(sorted(c for c in extents if c != NO_CELL), int)
        radius, sizes = (np.array([extents[c][i] for c in cells], float) for i in (1, 0))
        far = near[:, cells] if near.shape[1] else np.zeros((len(rows), len(cells)))
        # by cell + 1: the first column is NO_CELL's
        chosen = np.zeros((len(rows), max(cells, default=NO_CELL) + 2), bool)
        at = cells[np.argsort(far, axis=1, kind="stable")[:, :FIRST_CELLS]]
        np.put_along_axis(chosen, at + 1, True, axis=1)
        # a query without direction is equally far from all
        chosen[np.ix_(~plain, cells + 1)] = True
        chosen[:, 0] = NO_CELL in extents
        kind = block.schema["query_id"].dataType.simpleString()
        best = table_between_rounds(self._scored(rows, kind, chosen, k))
        last = {r["query_id"]: r["score"] for r in best.filter(F.col("rank") == k).select("query_id", "score").collect()}
        reach = np.array([math.sqrt(max(0.0, 2 - 2 * (last[r["query_id"]] - SLACK))) + SLACK if r["query_id"] in last else math.inf for r in rows])
        more = np.zeros_like(chosen)
        more[:, cells + 1] = (far - radius <= reach[:, None]) & ~chosen[:, cells + 1] & plain[:, None]
        looked = (chosen | more)[:, cells + 1].sum(0) @ sizes if len(cells) else 0
        pairs = int(looked) + int(chosen[:, 0].sum()) * extents.get(NO_CELL, (0, 0.0))[0]
        if not more.any():
            return best, pairs
        both = best.select("query_id", "id", "score").unionByName(self._scored(rows, kind, more, k).select("query_id", "id", "score"))
        return _ranked(both, k), pairs

    def _scored(self, rows: list, kind: str, chosen: np.ndarray, k: int) -> DataFrame:
        """The k best of each query's cells: chosen by query and cell + 1."""
        cells = (np.flatnonzero(chosen.any(0)) - 1).tolist()
        asked = np.array([r["q"] for r in rows], float)
        schema = f"query_id {kind}, id long, score double"
        met = self.rows(("id", "vector", "cell"), None if len(cells) == chosen.shape[1] else cells)
        return _ranked(met.mapInArrow(_best_of_cells([r["query_id"] for r in rows], asked, chosen, k, schema_of(schema)), schema), k)

    def _by_bytes(self, block, rows, near, extents, k, probe):
        cells = sorted(c for c in extents if c != NO_CELL)
        chosen = np.zeros((len(rows), max(cells, default=0) + 1), bool)
        for i, d in enumerate(near):
            order = sorted(cells, key=lambda c, d=d: _far(d, c))
            chosen[i, order if probe is None else order[:probe]] = True
        pairs = int(sum(chosen[:, c].sum() * extents[c][0] for c in cells))
        n = CANDIDATES * k
        kind = block.schema["query_id"].dataType.simpleString()
        used = [c for c in cells if chosen[:, c].any()]
        top = self.rows(("id", "code", "cell"), used).mapInArrow(_best_by_bytes([r["query_id"] for r in rows], _codes([r["unit"] for r in rows]), chosen, n), "query int, id long, product long")
        best = Window.partitionBy("query").orderBy(F.desc("product"), "id")
        top = top.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= n).select("query", "id")
        named = self.spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(rows)], f"query int, query_id {kind}")
        top = top.join(F.broadcast(named), "query").join(F.broadcast(block), "query_id")
        full = top.join(self.rows(("id", "vector", "cell"), used), "id")
        return _ranked(full.select("query_id", "id", F.round(cosine(F.col("vector"), F.col("q")), 6).alias("score")), k), pairs


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def _unit(vectors: DataFrame) -> DataFrame:
    """id, vector, unit (at length 1; empty where there is no direction); of rows that repeat an id
    the one with the greatest vector counts, rows without an id or vector don't."""
    rows = vectors.filter("id IS NOT NULL AND vector IS NOT NULL").select(F.col("id").cast("long").alias("id"), as_double("vector").alias("vector"))
    rows = rows.groupBy("id").agg(F.max("vector").alias("vector"))
    return rows.withColumn("unit", F.when(F.exists("vector", lambda x: x != 0), l2_normalize("vector")).otherwise(F.array().cast("array<double>")))


def _distances(units: list[list[float]], centroids: np.ndarray) -> np.ndarray:
    if not len(centroids) or not units:
        return np.zeros((len(units), len(centroids)))
    a = np.array([u if len(u) else [0.0] * centroids.shape[1] for u in units])
    squares = (a**2).sum(1)[:, None] + (centroids**2).sum(1) - 2 * a @ centroids.T
    return np.sqrt(np.maximum(squares, 0.0))


def _far(distances: np.ndarray, cell: int) -> float:
    return float(distances[cell]) if cell < len(distances) else 0.0


def fitted_centroids(units: list[list[float]], cells: int) -> np.ndarray:
    """k-means of a bounded sample: begun with vectors far from those taken before."""
    points = np.array(units)
    if not len(points):
        return np.zeros((0, 0))
    rng, chosen = np.random.Generator(np.random.PCG64(17)), [0]
    nearest = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(cells, len(points)) and nearest.sum() > 0:
        chosen.append(int(rng.choice(len(points), p=nearest / nearest.sum())))
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(1))
    centroids = points[chosen]
    for _ in range(ROUNDS):
        own = (centroids @ points.T * -2 + (centroids**2).sum(1)[:, None]).argmin(0)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        sizes = np.bincount(own, minlength=len(centroids))
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return centroids


def _codes(units: list[list[float]]) -> np.ndarray:
    dim = max(map(len, units), default=0)
    return np.rint(127 * np.array([u if len(u) else [0.0] * dim for u in units])).astype(np.int8).reshape(len(units), dim)


def _placed(centroids: np.ndarray):
    """Batches (id, vector, unit) to (id, vector, code, cell, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column(2).to_pylist()
            none = np.array([not len(u) for u in units], bool)
            distance = _distances(units, centroids)
            cell = distance.argmin(1) if distance.shape[1] else np.zeros(len(units), int)
            least = distance.min(1) if distance.shape[1] else np.full(len(units), 2.0)  # no centroid: no bound
            cell, least = np.where(none, NO_CELL, cell), np.where(none, 0.0, least)
            columns = [pa.array([c.tobytes() for c in _codes(units)], pa.binary()), pa.array(cell, pa.int32()), pa.array(least, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["id", "vector", "code", "cell", "distance"])

    return run


def _best_of_cells(ids: list, asked: np.ndarray, chosen: np.ndarray, k: int, schema: pa.Schema):
    """Batches (id, vector, cell) to (query_id, id, score): each query's k best of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(asked, len(ids), k)
        for batch in batches:
            own, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy() + 1
            rows, good = matrix(batch.column(1), asked.shape[1])
            order = np.argsort(cell, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                for a in range(0, len(part), ROW_BLOCK):
                    at = part[a : a + ROW_BLOCK]
                    best.add(own[at], rows[at], good[at], np.flatnonzero(chosen[:, cell[at[0]]]))
        query, who, score = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(ids, schema.types[0]).take(pa.array(query)), pa.array(who, pa.int64()), score], schema=schema)

    return run


def _best_by_bytes(ids: list, codes: np.ndarray, chosen: np.ndarray, n: int):
    """Batches (id, code, cell) to each query's n best of a task, by integer products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = codes.astype(np.float32)
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        for batch in batches:
            own, code, cell = batch.columns
            if not batch.num_rows:
                continue
            own, cell = own.to_numpy(), cell.to_numpy()
            rows = np.frombuffer(b"".join(code.to_pylist()), np.int8).reshape(batch.num_rows, -1).astype(np.float32)
            product = (wide @ rows.T).astype(np.int64)  # whole numbers below 2**24: exact
            for i in range(len(ids)):
                at = np.flatnonzero(chosen[i, cell])
                score, who = np.concatenate([kept[i][0], product[i, at]]), np.concatenate([kept[i][1], own[at]])
                best = np.lexsort((who, -score))[:n]
                kept[i] = score[best], who[best]
        query = np.repeat(np.arange(len(ids)), [len(s) for s, _ in kept])
        score, who = (np.concatenate([x[j] for x in kept]) if kept else np.zeros(0, np.int64) for j in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(who, pa.int64()), pa.array(score, pa.int64())], ["query", "id", "product"])

    return run
