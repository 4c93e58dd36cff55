"""Importance resampling against a plain count."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from quarryline.llm import resampling

SCHEMA = "doc_id long, text string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, shortest=1, longest=1):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return [" ".join(words[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)], len(words)


def plain(rows, target, buckets=10_000, shortest=1, longest=1, percent=10, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text, shortest, longest)[0]))
    for text in target:
        t.update(map(bucket, features(text, shortest, longest)[0]))
    s_all, t_all = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets))))
    out, drawable = [], []
    for doc_id, text in rows:
        own, n_words = features(text, shortest, longest)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(own), weight, score, None])
        if n_words >= least:
            drawable.append(out[-1])
    drawable.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, row in enumerate(drawable[: percent * len(drawable) // 100], 1):
        row[4] = k
    return sorted(map(tuple, out), key=repr)


def found(spark, rows, target, schema=SCHEMA, **kw):
    docs = spark.createDataFrame(rows, schema).repartition(4)
    return sorted(map(tuple, resampling.importance_resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), **kw).collect()), key=repr)


def corpus(n=300):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)] + ["Ünïcode", "UPPER", "漢字", "don't"]
    rows = [(i, rng.choice((" ", ", ", "\n")).join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "... !!!"), (None, rows[0][1]), (None, "x " * 30)], [" ".join(rng.choice(words[:80]) for _ in range(30)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("kw", [{}, {"longest": 2}, {"shortest": 2, "longest": 3, "buckets": 64}, {"percent": 50, "least_words": 1}, {"percent": 0}, {"percent": 100, "buckets": 1 << 16}])
def test_as_a_plain_count(spark, kw):
    rows, target = corpus()
    expected = plain(rows, target, **{("least" if k == "least_words" else k): v for k, v in kw.items()})
    assert found(spark, rows, target, **kw) == expected


@pytest.mark.parametrize("longest", [1, 3])
def test_very_long_texts_by_windows(spark, monkeypatch, longest):
    monkeypatch.setattr(resampling, "WINDOW", 64)
    monkeypatch.setattr(resampling, "STREAM_FEATURES", 50)
    monkeypatch.setattr(resampling, "CACHE_WORDS", 16)
    rows, target = corpus(30)
    rows += [(1000, "word " * 5000), (1001, "é" * 3000 + " " + "b" * 400 + ".c")]
    from pyspark.sql import SparkSession  # tasks import the module anew: the small windows hold for direct calls

    assert isinstance(spark, SparkSession)
    for _, text in rows:
        own, n = features(text, 1, longest)
        got, got_n = resampling.bucket_stream((text or "").encode(), resampling.Buckets(997), 1, longest)
        assert Counter(got.tolist()) == Counter(zlib.crc32(f.encode()) % 997 for f in own) and got_n == n
    assert found(spark, rows, target) == plain(rows, target)


def test_ties_repeated_rows_and_ids(spark):
    text = " ".join(f"t{i}" for i in range(25))
    rows = [(7, text)] * 12 + [(8, text)] * 9 + [(7, "short one")]
    expected = plain(rows, ["t1 t2"])
    got = found(spark, rows, ["t1 t2"])
    assert Counter(got) == Counter(expected)


def test_empty_tables_clashing_columns_other_ids(spark):
    assert found(spark, [], ["a b"]) == []
    rows, _ = corpus(40)
    assert found(spark, rows, []) == plain(rows, [])
    wide = "doc_id long, text string, rank int, score string, number int, row_no int, ids int, stream int"
    assert found(spark, [(*r, 1, "x", 2, 3, 4, 5) for r in rows], ["w1 w2"], wide) == plain(rows, ["w1 w2"])
    named = [("a", "one two " * 20), ("b", "three " * 30)]
    assert found(spark, named, ["two"], "doc_id string, text string", percent=50) == plain(named, ["two"], percent=50)
    with pytest.raises(ValueError):
        found(spark, named, ["two"], "doc_id string, text string", buckets=1 << 17)
