"""Sharding against a plain heap, groups of any size, odd tables."""

import heapq
import random
import zlib

import pytest

from quarryline.llm import sharding

SCHEMA = "doc_id long, text string"


def plain(rows, shards=8):
    groups = {}
    for _, text in rows:
        groups[text or ""] = groups.get(text or "", 0) + len((text or "").encode()) + 1
    import hashlib

    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in groups}
    heap, placed = [(0, i) for i in range(shards)], {}
    for text in sorted(groups, key=lambda t: (-groups[t], sha[t])):
        load, i = heapq.heappop(heap)
        placed[text] = i
        heapq.heappush(heap, (load + groups[text], i))
    seen, out = [0] * shards, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, sha[r[1] or ""])):
        i = placed[text or ""]
        out.append((doc_id, len((text or "").encode()) + 1, zlib.crc32((text or "").encode()), "bytes", i, seen[i], None))
        seen[i] += 1
    return out


def found(df, **kw):
    return [tuple(r) for r in sharding.shard_documents(df, **kw).collect()]


def order(rows):
    return sorted(rows, key=repr)


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(("a", "bb", "ccc", "ä")) for _ in range(rng.randrange(0, 40)))) for i in range(n)]
    rows += [(n + i, "a hot text") for i in range(n // 2)] + [(2 * n + i, "same size %02d" % (i % 50)) for i in range(150)]
    return rows + [(5, rows[5][1]), (5, "another text of id 5"), (None, None), (None, ""), (3 * n, None), (3 * n + 1, "x" * 5000), (3 * n + 2, "漢" * 1500)]


@pytest.mark.parametrize("large", [8192, 4, 50])
def test_as_a_heap(spark, large):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert order(found(df, large=large)) == order(plain(rows))


@pytest.mark.parametrize("shards", [1, 3, 11])
def test_other_numbers_of_shards(spark, shards):
    rows = corpus(60)
    assert order(found(spark.createDataFrame(rows, SCHEMA), shards=shards)) == order(plain(rows, shards))


def test_runs_of_several_sizes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EXACT_SIZES", 32)
    monkeypatch.setattr(sharding, "SIZE_BITS", 3)
    rng = random.Random(9)
    rows = [(i, f"{i}:" + "y" * rng.randrange(0, 300)) for i in range(800)] + [(900 + i, "h" * 100) for i in range(150)]
    out = found(spark.createDataFrame(rows, SCHEMA), large=20)
    loads = [sum(r[1] for r in out if r[4] == k) for k in range(8)]
    assert max(loads) - min(loads) <= 40 and len(out) == len(rows)
    texts = {}
    for r in out:
        texts.setdefault((r[1], r[2]), set()).add(r[4])
        assert 0 <= r[5]
    assert all(len(s) == 1 for s in texts.values())
    for k in range(8):
        assert sorted(r[5] for r in out if r[4] == k) == list(range(sum(1 for r in out if r[4] == k)))


def test_rounds_are_the_heaps_choices():
    rng = random.Random(1)
    for _ in range(300):
        loads = [rng.randrange(0, 60) for _ in range(rng.randrange(1, 9))]
        size, count = rng.randrange(1, 20), rng.randrange(0, 60)
        turns, after = sharding.round_of(loads, size, count)
        heap = [(load, i) for i, load in enumerate(loads)]
        heapq.heapify(heap)
        for rank in range(count):
            first, turn = [t for t in turns if t[0] <= rank][-1]
            load, i = heapq.heappop(heap)
            assert turn[(rank - first) % len(turn)] == i
            heapq.heappush(heap, (load + size, i))
        assert after == [load for load, _ in sorted(heap, key=lambda x: x[1])]


def test_empty_tables_clashing_columns_other_ids(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert sorted(found(spark.createDataFrame([(1, None), (2, None)], SCHEMA))) == [(1, 1, 0, "bytes", 0, 0, None), (2, 1, 0, "bytes", 0, 1, None)]
    rows = spark.createDataFrame([("b", "t", 1, 2, 3, 4), ("a", "t", 1, 2, 3, 4)], "doc_id string, text string, sha int, size int, shard int, slot int")
    assert sorted(found(rows)) == [("a", 2, zlib.crc32(b"t"), "bytes", 0, 0, None), ("b", 2, zlib.crc32(b"t"), "bytes", 0, 1, None)]
