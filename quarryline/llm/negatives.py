"""Hard negatives by inner product, searched through a pivot table.

With one more component, sqrt(M - |x|^2) for rows (M: the largest squared norm) and 0 for anchors,
the squared distance of row and anchor is M + |a|^2 - 2<x, a>: the largest inner product is the
least distance. Distances of all rows to PIVOTS pivots are stored; by the triangle inequality, the
difference and the sum of the two distances to a pivot bound the distance of row and anchor, and so
bracket their score. Rows lie in blocks by nearest pivot, so a block's extremes bound its scores as
a whole. Only pairs whose bracket reaches what is wanted are scored, exactly, in whole numbers.

Anchors go over the rows in blocks of about ANCHOR_BLOCK: once for the positives, once for the
negatives within the window that each positive sets. A sample of the rows gives both passes
thresholds to begin with; it changes what is looked at, never what is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

PIVOTS = 16
#: Anchors that one pass over the rows carries.
ANCHOR_BLOCK = 4096
#: Rows of the sample from which pivots and first thresholds are taken.
SAMPLE_ROWS = 4096
#: Rows whose pivot distances are bounded together, and rows that a task holds at once.
BLOCK_ROWS, BATCH_ROWS = 128, 4096
#: One product of a whole block costs about this many times less a pair than single pairs do.
SPARSE = 8
#: Whole numbers below this are exact in doubles.
EXACT = float(1 << 53)
LONG_MAX = (1 << 63) - 1


def _rows(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """id, label, v (scaled whole numbers), key of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), v.alias("v")).filter(sound)
    # without zeros at the end: a shorter vector counts as filled up with zeros
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("long"))
    kept = F.slice(F.col("v"), 1, F.coalesce(F.array_max(F.transform("v", lambda x, i: F.when(x != 0, i + 1).otherwise(0))), F.lit(0)))
    rows = rows.withColumn("v", whole).withColumn("v", kept)
    return rows.withColumn("key", F.sha2(F.concat(F.col("label").cast("string"), F.lit(":"), F.array_join(F.transform("v", lambda x: x.cast("string")), ",")), 256))


def _classes(rows: DataFrame, ids: int) -> DataFrame:
    """key, label, v, ids: rows of one label and vector are one; only their `ids` least ids can be
    among the best, as equal scores go by id."""
    first = Window.partitionBy("key").orderBy("vec_id")
    own = rows.select("key", "vec_id").distinct().withColumn("k", F.row_number().over(first)).filter(F.col("k") <= ids)
    own = own.groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return rows.select("key", "label", "v").dropDuplicates(["key"]).join(own, "key")


def matrix(vectors, dim: int) -> np.ndarray:
    """A matrix of lists of whole numbers (an Arrow column or any sequence), filled up with zeros:
    in doubles where all inner products are exact, else in Python's own numbers."""
    column = vectors if isinstance(vectors, pa.Array) else pa.array([list(v) for v in vectors], pa.list_(pa.int64()))
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = column.flatten().to_numpy()
    largest = float(np.abs(out.astype(np.float64)).max(initial=0.0))
    return out.astype(np.float64) if largest * largest * max(dim, 1) < EXACT else out.astype(object)


def _exact(rows: np.ndarray, anchors: np.ndarray) -> bool:
    """Whether doubles hold all inner products of rows and anchors."""
    if rows.dtype == object or anchors.dtype == object:
        return False
    return float(np.abs(rows).max(initial=0.0)) * float(np.abs(anchors).max(initial=0.0)) * max(rows.shape[1], 1) < EXACT


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, rows by anchors; beyond a long's range they are cut to it."""
    if not _exact(rows, anchors):
        whole = np.vectorize(int, otypes=[object])
        exact = np.dot(whole(rows), whole(anchors).T) if rows.size and anchors.size else np.zeros((len(rows), len(anchors)), object)
        return np.clip(exact, -LONG_MAX, LONG_MAX).astype(np.int64)
    return (rows @ anchors.T).astype(np.int64)


def pair_products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products of rows[i] and anchors[i]."""
    if not _exact(rows, anchors):
        return np.array([products(r[None], a[None])[0, 0] for r, a in zip(rows, anchors, strict=True)], np.int64)
    return np.einsum("ij,ij->i", rows, anchors).astype(np.int64)


class Space:
    """Pivots, in the space where inner products are distances."""

    def __init__(self, sample: np.ndarray, largest: float, pivots: int):
        self.largest = largest
        points = self.lifted(sample.astype(np.float64))
        chosen = [int(np.argmax((points**2).sum(1)))] if len(points) else []
        nearest = np.full(len(points), np.inf)
        while chosen and len(chosen) < pivots:  # the farthest from those chosen so far
            nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(1))
            if nearest.max() <= 0:
                break
            chosen.append(int(np.argmax(nearest)))
        self.pivots = points[chosen]

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest - (rows**2).sum(1), 0.0))
        return np.column_stack([rows, rest])

    def distances(self, points: np.ndarray) -> np.ndarray:
        squares = (points**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(squares, 0.0))

    def of_rows(self, rows: np.ndarray) -> np.ndarray:
        return self.distances(self.lifted(rows.astype(np.float64)))

    def of_anchors(self, anchors: np.ndarray) -> np.ndarray:
        return self.distances(np.column_stack([anchors.astype(np.float64), np.zeros(len(anchors))]))

    def scores(self, near: np.ndarray, far: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of pairs between two distances; the slack is far over
        what rounding can add."""
        slack = 1e-6 * (self.largest + squares) + 1
        return (self.largest + squares - far**2) / 2 - slack, (self.largest + squares - near**2) / 2 + slack

    def brackets(self, low: np.ndarray, high: np.ndarray, of_anchors: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Brackets of rows (or blocks of rows) by anchors, from their distances to the pivots."""
        near = np.zeros((len(low), len(of_anchors)))
        far = np.full((len(low), len(of_anchors)), np.inf)
        for j in range(len(self.pivots)):
            a = of_anchors[:, j]
            np.maximum(near, np.maximum(low[:, j, None] - a, a - high[:, j, None]), out=near)
            np.minimum(far, high[:, j, None] + a, out=far)
        return self.scores(near, far, squares)


class Wanted:
    """What a pass looks for: per anchor one or more windows of scores, rows of the anchor's label
    or of others, and the best n of each window."""

    def __init__(self, anchors: pd.DataFrame, dim: int, space: Space, low: np.ndarray, high: np.ndarray, same: bool, n: int):
        self.matrix = matrix(list(anchors["v"]), dim)
        self.ids, self.labels = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
        self.space, self.low, self.high, self.same, self.n = space, low, high, same, n
        self.pivots = space.of_anchors(self.matrix)
        self.squares = (self.matrix.astype(np.float64) ** 2).sum(1)

    def candidates(self, rows: np.ndarray, labels: np.ndarray, stored: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, anchor, window, score) of all pairs in a window, block by block."""
        lowest, highest = self.low.min(1), self.high.max(1)
        for first in range(0, len(rows), BLOCK_ROWS):
            part = slice(first, first + BLOCK_ROWS)
            least, most = self.space.brackets(stored[part].min(0)[None], stored[part].max(0)[None], self.pivots, self.squares)
            asked = np.flatnonzero((most[0] >= lowest) & (least[0] <= highest))
            if not len(asked):
                continue
            least, most = self.space.brackets(stored[part], stored[part], self.pivots[asked], self.squares[asked])
            open_ = (most >= lowest[asked]) & (least <= highest[asked]) & ((labels[part][:, None] == self.labels[asked]) == self.same)
            r, a = np.nonzero(open_)
            if not len(r):
                continue
            near, of = np.unique(r), np.unique(a)
            if len(r) * SPARSE < len(near) * len(of):
                score = pair_products(rows[first + r], self.matrix[asked[a]])
            else:
                score = products(rows[first + near], self.matrix[asked[of]])[np.searchsorted(near, r), np.searchsorted(of, a)]
            row, anchor = first + r, asked[a]
            for j in range(self.low.shape[1]):
                hit = (score >= self.low[anchor, j]) & (score <= self.high[anchor, j])
                yield row[hit], anchor[hit], np.full(int(hit.sum()), j), score[hit]


class Best:
    """The best n ids of each (anchor, window) met so far."""

    def __init__(self, wanted: Wanted):
        self.wanted, self.parts, self.size = wanted, [], 0

    def add(self, ids: list, row: np.ndarray, anchor: np.ndarray, window: np.ndarray, score: np.ndarray) -> None:
        if not len(row):
            return
        counts = np.array([len(ids[i]) for i in row], np.int64)
        flat = np.concatenate([np.asarray(ids[i], np.int64) for i in row])
        each = np.repeat(np.arange(len(row)), counts)
        part = np.column_stack([anchor[each], window[each], score[each], flat])
        self.parts.append(part[flat != self.wanted.ids[anchor[each]]])
        self.size += len(self.parts[-1])
        if self.size > 1 << 20:
            self.cut()

    def cut(self) -> np.ndarray:
        found = np.concatenate(self.parts) if self.parts else np.zeros((0, 4), np.int64)
        anchor, window, score, ids = found.T
        found = found[np.lexsort((ids, -score, window, anchor))]
        group = np.flatnonzero(np.append(True, (found[1:, :2] != found[:-1, :2]).any(1))) if len(found) else np.zeros(0, np.int64)
        place = np.arange(len(found)) - np.repeat(group, np.diff(np.append(group, len(found))))
        found = found[place < self.wanted.n]
        self.parts, self.size = [found], len(found)
        return found


def _pass(wanted: Wanted, dim: int):
    """Batches (label, v, ids, pivots) to the task's best (anchor, window, score, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(wanted)
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH_ROWS):
                labels, v, ids, stored = batch.slice(first, BATCH_ROWS).columns
                rows, ids = matrix(v, dim), ids.to_pylist()
                distances = stored.flatten().to_numpy().reshape(len(rows), -1)
                for found in wanted.candidates(rows, labels.to_numpy(zero_copy_only=False), distances):
                    best.add(ids, *found)
        anchor, window, score, ids = best.cut().T
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((anchor, window, score, ids), kinds, strict=True)], ["anchor", "window", "score", "id"])

    return run


FOUND = "anchor int, window int, score bigint, id bigint"


def _first_thresholds(wanted: Wanted, sample: pd.DataFrame, dim: int) -> np.ndarray:
    """Scores that the n-th best of each window reaches within the sample: what is below can't be wanted."""
    rows = matrix(list(sample["v"]), dim)
    best, low = Best(wanted), wanted.low.copy()
    ids = [list(x) for x in sample["ids"]]
    for found in wanted.candidates(rows, sample["label"].to_numpy(), wanted.space.of_rows(rows)):
        best.add(ids, *found)
    found = best.cut()
    pair, size = np.unique(found[:, :2], axis=0, return_counts=True)
    last = np.cumsum(size) - 1
    full = size == wanted.n
    low[pair[full, 0], pair[full, 1]] = found[last[full], 2]
    return low


def _pivot_table(classes: DataFrame, space: Space, dim: int) -> DataFrame:
    """label, v, ids, pivots (the distances), rows of one nearest pivot together within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distances = space.of_rows(matrix(batch.column(1), dim))
            cell = distances.argmin(1) if distances.size else np.zeros(len(distances))
            columns = [*batch.columns, pa.array(list(distances), pa.list_(pa.float64())), pa.array(cell, pa.int32()), pa.array(distances.min(1, initial=np.inf), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "pivots", "cell", "near"])

    kind = classes.schema["label"].dataType.simpleString()
    rows = classes.select("label", "v", "ids").mapInArrow(run, f"label {kind}, v array<bigint>, ids array<bigint>, pivots array<double>, cell int, near double")
    return rows.sortWithinPartitions("cell", "near").select("label", "v", "ids", "pivots")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3,
    low_percent: int = 50, high_percent: int = 95, scale: int = 256, pivots: int = PIVOTS, anchor_block: int = ANCHOR_BLOCK, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors has vec_id (a whole number), embedding and label. Scores are inner products of floor(scale * x); the
    anchors' positives are the first `positives` other rows of the same label, and each has up to
    `negatives` rows of other labels with low_percent * positive <= 100 * negative <= high_percent *
    positive, best first, ties by vec_id. Rows with a null id, label or vector, or with a null or
    non-finite component, take no part. A shorter vector counts as filled up with zeros, a component
    or score beyond a long's range as its end. Rows that repeat id, label and vector count once; rows
    that share only an id are rows of their own, and each such anchor gives its own result, but a row
    with the anchor's id is never its positive or negative. Other columns play no part. Without
    anchors the result is empty.
    """
    spark = vectors.sparkSession
    rows = materialize(_rows(vectors, F.col("label") if label is None else label, scale), "vectors")
    classes = materialize(_classes(rows, max(positives, negatives) + 1), "classes")
    size = F.aggregate(F.transform("v", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    bounds = classes.agg(F.max(size).alias("largest"), F.max(F.size("v")).alias("dim")).first()
    anchors = rows.filter(is_anchor).select("vec_id", "label", "v", "key").dropDuplicates(["vec_id", "key"])
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"anchor_id {kinds['vec_id']}, positive_id {kinds['vec_id']}, rank int, negative_id {kinds['vec_id']}, positive_score bigint, negative_score bigint"
    n_anchors = anchors.count()
    if not n_anchors:
        return spark.createDataFrame([], schema)
    dim = bounds["dim"]
    # at most sample_rows rows
    sample = classes.select("key", "label", "v", "ids").orderBy(F.xxhash64("key"), "key").limit(sample_rows).toPandas()
    space = Space(matrix(list(sample["v"]), dim), bounds["largest"], pivots)
    table = materialize(_pivot_table(classes, space, dim), "pivot-table")
    parts = math.ceil(n_anchors / anchor_block)
    out = None
    for i in range(parts):
        own = anchors if parts == 1 else anchors.filter(F.pmod(F.xxhash64("vec_id", "key"), F.lit(parts)) == i)
        block = own.select("vec_id", "label", "v").toPandas()  # about anchor_block rows
        if not len(block):
            continue
        found = _mine(table, block, sample, space, dim, positives, negatives, low_percent, high_percent)
        out = found if out is None else out.unionByName(found)
    return out.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")])


def _mine(table: DataFrame, block: pd.DataFrame, sample: pd.DataFrame, space: Space, dim: int, positives: int, negatives: int, low_percent: int, high_percent: int) -> DataFrame:
    spark, n = table.sparkSession, len(block)
    open_low, open_high = np.full((n, 1), -LONG_MAX), np.full((n, 1), LONG_MAX)
    wanted = Wanted(block, dim, space, open_low, open_high, True, positives)
    wanted.low = _first_thresholds(wanted, sample, dim)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    best = table.mapInArrow(_pass(wanted, dim), FOUND).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= positives)
    pos = best.select("anchor", "score", "id").toPandas()  # at most `positives` rows an anchor of the block
    pos = pos[pos["score"] >= 0]  # a window of a negative score is empty
    pos["window"] = pos.groupby("anchor")["score"].rank(method="dense").astype(int) - 1
    low, high = np.full((n, positives), LONG_MAX), np.full((n, positives), -LONG_MAX)
    for a, w, s in zip(pos["anchor"], pos["window"], pos["score"], strict=True):
        low[a, w], high[a, w] = -(-low_percent * int(s) // 100), high_percent * int(s) // 100
    wanted = Wanted(block, dim, space, low, high, False, negatives)
    wanted.low = _first_thresholds(wanted, sample, dim)
    found = table.mapInArrow(_pass(wanted, dim), FOUND).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    pairs = pos.assign(anchor_id=block["vec_id"].to_numpy()[pos["anchor"]])
    pairs = spark.createDataFrame(pairs[["anchor", "window", "anchor_id", "id", "score"]], "anchor int, window int, anchor_id bigint, positive_id bigint, positive_score bigint")
    return found.join(F.broadcast(pairs), ["anchor", "window"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
