"""The set of dirty paths over batches of events, and its all-or-nothing drain."""

import random

import pytest

from quarryline.streaming import watch

SCHEMA = "repo string, path string, kind string, ts timestamp, seq long"


def _events(spark, rows):
    from datetime import datetime, timedelta

    return spark.createDataFrame([("r", path, kind, datetime(2024, 1, 1) + timedelta(seconds=t), i) for i, (path, kind, t) in enumerate(rows)], SCHEMA)


def test_batches_equal_one_fold(spark):
    draw = random.Random(5)
    batches = [[(f"p{draw.randrange(12)}", draw.choice(["CREATE", "MODIFY", "DELETE", "RENAME"]), t) for t in range(30)] for _ in range(3)]
    dirty, kinds = watch.DirtySet(spark), {}
    for batch in batches:
        # times begin anew with each batch: a later batch counts as later all the same
        dirty.add(_events(spark, batch))
        for path, kind, _ in batch:
            kinds[path] = watch.merge_kind(kinds.get(path), kind)
    assert {r["path"]: r["kind"] for r in dirty.drain().collect()} == kinds
    assert dirty.drain() is None


def test_over_the_limit_nothing_is_taken(spark):
    dirty = watch.DirtySet(spark)
    dirty.add(_events(spark, [("a", "CREATE", 0), ("b", "MODIFY", 1)]))
    with pytest.raises(watch.Overflow):
        dirty.drain(1)
    assert dirty.drain(2).count() == 2
    dirty.add(_events(spark, [("c", "DELETE", 0)]))
    assert [r["path"] for r in dirty.drain(1).collect()] == ["c"]


def test_empty_batch(spark):
    dirty = watch.DirtySet(spark)
    dirty.add(_events(spark, []))
    assert dirty.drain(0).count() == 0
