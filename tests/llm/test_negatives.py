"""Hard negatives against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarryline.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, is_anchor, positives=5, n=3):
    own = []
    for vec_id, v, label in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (vec_id, tuple(math.floor(256 * float(x)) for x in v), label)
        if row not in own:
            own.append(row)
    out = []
    for a in own:
        if not is_anchor(a[0]):
            continue
        scored = sorted(((sum(x * y for x, y in zip(a[1], b[1])), b[0], b[2]) for b in own if b[0] != a[0]), key=lambda s: (-s[0], s[1]))
        for score, pos, label in [s for s in scored if s[2] == a[2]][:positives]:
            good = [s for s in scored if s[2] != a[2] and 50 * score <= 100 * s[0] <= 95 * score][:n]
            out += [(a[0], pos, k, s[1], score, s[0]) for k, s in enumerate(good, 1)]
    return sorted(out)


def f32(x):
    import numpy as np

    return float(np.float32(x))


def vectors(n=400, dim=8, seed=1, clusters=0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(clusters)]
    rows = []
    for i in range(n):
        base = centres[i % clusters] if clusters else [0.0] * dim
        rows.append((i, [f32(b + rng.gauss(0, 0.3)) for b in base], rng.randrange(4)))
    return rows


def found(spark, rows, schema=SCHEMA, **kw):
    return sorted(map(tuple, negatives.hard_negatives(spark.createDataFrame(rows, schema).repartition(3), F.col("vec_id") % 10 == 0, **kw).collect()))


@pytest.mark.parametrize("kw", [{}, {"sample_rows": 7, "pivots": 3}, {"anchor_block": 9}, {"sample_rows": 1, "pivots": 1}])
@pytest.mark.parametrize("clusters", [0, 6])
def test_as_all_pairs(spark, kw, clusters, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 16)
    rows = vectors(clusters=clusters)
    expected = plain(rows, lambda i: i % 10 == 0)
    assert len(expected) > 100 and found(spark, rows, **kw) == expected


def test_pivots_leave_most_pairs_of_clusters_unscored(monkeypatch):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (40, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    points = centres[np.arange(4000) % 40] + rng.normal(0, 0.02, (4000, 16))
    whole = np.floor(256 * points / np.linalg.norm(points, axis=1)[:, None])
    frame = pd.DataFrame({"v": [[int(x) for x in v] for v in whole], "vec_id": range(4000), "label": [i // 40 % 3 for i in range(4000)]})
    space = negatives.Space(whole[::10], float((whole**2).sum(1).max()), 16)
    stored = space.of_rows(whole)
    order = np.lexsort((stored.min(1), stored.argmin(1)))
    anchors = frame[frame["vec_id"] % 99 == 0].reset_index(drop=True)
    exact = whole @ negatives.matrix(list(anchors["v"]), 16).T
    low = np.sort(exact, 0)[-60][:, None].astype(np.int64)
    wanted = negatives.Wanted(anchors, 16, space, low, np.full((len(anchors), 1), negatives.LONG_MAX), True, 5)
    scored, whole_blocks, single = 0, negatives.products, negatives.pair_products

    def blocks(a, b):
        nonlocal scored
        scored += len(a) * len(b)
        return whole_blocks(a, b)

    def pairs(a, b):
        nonlocal scored
        scored += len(a)
        return single(a, b)

    monkeypatch.setattr(negatives, "products", blocks)
    monkeypatch.setattr(negatives, "pair_products", pairs)
    hits = sum(len(h[0]) for h in wanted.candidates(whole[order], frame["label"].to_numpy()[order], stored[order]))
    same = frame["label"].to_numpy()[:, None] == anchors["label"].to_numpy()
    assert hits == int(((exact >= low.T[0]) & same).sum())
    assert scored < 0.2 * exact.size, scored / exact.size


def test_brackets_hold():
    import numpy as np

    rng = np.random.default_rng(4)
    rows, anchors = np.floor(rng.normal(0, 60, (200, 8))), np.floor(rng.normal(0, 60, (30, 8)))
    space = negatives.Space(rows, float((rows**2).sum(1).max()), 5)
    stored = space.of_rows(rows)
    low, high = space.brackets(stored, stored, space.of_anchors(anchors), (anchors**2).sum(1))
    exact = rows @ anchors.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < 4 * np.abs(exact).max()


def test_odd_rows(spark):
    rows = vectors(120, 6)
    rows += [(200, None, 1), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (210, [float("nan")] * 6, 1), (220, [float("inf")] * 6, 1), (230, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [rows[7], rows[10], (11, [f32(0.4)] * 6, 2), (10, [f32(0.3)] * 6, 3)]  # repeated rows, repeated ids
    rows += [(300 + i, [f32(0.5), f32(0.1), 0.0, 0.0, 0.0, f32(-0.2)], 1) for i in range(40)] + [(400 + i, [f32(0.5), f32(0.1), 0.0, 0.0, 0.0, f32(-0.2)], 2) for i in range(30)]
    assert found(spark, rows, anchor_block=5) == plain(rows, lambda i: i % 10 == 0)


def test_shorter_vectors_are_filled_up_and_large_numbers_exact(spark):
    rows = [(i, v[: 3 + i % 4], label) for i, v, label in vectors(90, 6)] + [(500, [], 1), (510, [0.0], 2)]
    padded = [(i, v + [0.0] * (6 - len(v)), label) for i, v, label in rows]
    assert found(spark, rows) == plain(padded, lambda i: i % 10 == 0)
    large = [(i, [f32(x * 1e6) for x in v], label) for i, v, label in vectors(60, 4, clusters=3)]
    assert found(spark, large) == plain(large, lambda i: i % 10 == 0)
    huge = [(0, [3e30, 1.0], 1), (1, [3e30, 0.0], 1), (2, [1e30, 0.0], 2)]
    assert found(spark, huge) == []  # scores at the end of a long's range


def test_tables_without_anchors_positives_or_rows(spark):
    assert found(spark, []) == [] and found(spark, [(1, [1.0], 1)]) == [] and found(spark, [(10, [1.0], 1), (11, [1.0], 2)]) == []
    wide = "vec_id long, embedding array<float>, label int, anchor int, key string, v int, ids int, score int, rank int"
    rows = [(i, v, label, 1, "k", 2, 3, 4, 5) for i, v, label in vectors(60, 4)]
    assert found(spark, rows, wide) == plain(vectors(60, 4), lambda i: i % 10 == 0)
