import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quarryline.llm import exact_dedup as e
from quarryline.llm import neardup as n
from quarryline.llm.spans import text_buffer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], DOCS)


def test_exact_groups_against_plain_grouping(spark):
    rows = [(i, ["same  text", "same text", "other", None, " ", ""][i % 6]) for i in range(60)] + [(100, "one"), (None, "one"), (None, "alone")]
    out = e.duplicate_groups(frame(spark, rows), share=0.2).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i))
    assert len(out) == len(rows)
    for r in out:
        group = next(g for g in groups.values() if any(x[2] == r.doc_id for x in g) and (r.doc_id is not None or len(g) == r.group_size))
        if r.doc_id is not None:
            assert (r.keep_id, r.group_size) == (min(group)[2], len(group))
    assert sum(r.kept for r in out) == len(groups)


def test_hot_and_ordinary_paths_agree(spark):
    rows = [(i, "hot" if i % 3 else f"text {i // 9}") for i in range(300)]
    view = lambda share: sorted(map(tuple, e.duplicate_groups(frame(spark, rows), share).collect()))
    assert view(0.1) == view(1.0)


def test_exact_dedup_keeps_columns_and_one_of_repeated_rows(spark):
    docs = frame(spark, [(1, "a b"), (1, "a b"), (2, "ab"), (3, "c"), (None, "d")])
    out = e.exact_dedup(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "d"), (1, "a b"), (3, "c")]
    assert e.exact_dedup(docs.limit(0)).count() == 0


def words(seed, k):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 5000, k)]


def near_rows():
    rows, at = [], 0
    for group in range(12):
        base = words(group, 200)
        for copy in range(group % 4 + 1):
            own = list(base)
            for k in range(copy):
                own[40 * k + 7] = f"edit{group}x{copy}"
            rows.append((at, " ".join(own)))
            at += 1
    shared = words(99, 60)
    rows += [(at + i, " ".join(words(200 + i, 150) + shared)) for i in range(8)]
    return rows + [(500, rows[3][1]), (501, None), (502, ""), (503, "..."), (504, "one two"), (505, "One, two!"), (506, "lone")]


def brute_force(rows):
    """Pairs of different texts with a weighted Jaccard similarity of 0.8 or more."""
    texts = sorted({t or "" for _, t in rows})
    sets, counts = {}, defaultdict(int)
    for t in texts:
        h, tf, _ = n.shingles(*text_buffer(pa.array([t])))
        sets[t] = (h, tf)
    for _, t in rows:
        for h in sets[t or ""][0].tolist():
            counts[h] += 1
    often = np.array(sorted(h for h, c in counts.items() if c > n.RARE * len(rows)), np.uint64)
    idf = often, n.idf_weights(np.array([counts[h] for h in often.tolist()]), len(rows))
    weighted = {t: (h, n.weights_of(h, tf, idf)) for t, (h, tf) in sets.items()}
    return {(a, b) for a in texts for b in texts if a < b and len(sets[a][0]) and len(sets[b][0]) and n.weighted_jaccard(weighted[a], weighted[b]) >= 0.8}


def test_near_duplicates_against_all_pairs(spark):
    rows = near_rows()
    out = {r.doc_id: r for r in n.near_duplicates(frame(spark, rows)).collect()}
    pairs = brute_force(rows)
    assert len(pairs) > 5
    parent = {t or "": t or "" for _, t in rows}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in pairs:
        parent[root(a)] = root(b)
    classes = defaultdict(list)
    for i, t in rows:
        classes[root(t or "")].append(i)
    for i, t in rows:
        own = classes[root(t or "")]
        assert (out[i].class_id, out[i].class_size, out[i].kept) == (min(own), len(own), i == min(own))
    assert sorted(r.doc_id for r in n.near_dedup(frame(spark, rows)).collect()) == sorted(map(min, classes.values()))


def test_near_dedup_of_null_and_repeated_ids_keeps_one_row_of_each_class(spark):
    near = words(1, 200)
    edited = [*near[:100], "edit", *near[101:]]
    texts = [" ".join(words(300 + i, 80)) for i in range(8)]
    rows = [(1, " ".join(near)), (None, " ".join(edited)), (7, " ".join([*edited, "end"]))]  # one class, kept by id 1
    rows += [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:6]] + [(7, texts[5]), (2, texts[6]), (2, texts[6] + " more"), (None, texts[3])]
    out = sorted(((r.doc_id or 0), r.text) for r in n.near_dedup(frame(spark, rows)).collect())
    own = min([texts[6], texts[6] + " more"], key=lambda t: hashlib.sha256(t.encode()).digest())
    assert out == sorted([(1, rows[0][1]), *((0, t) for t in texts[:4]), (7, texts[4]), (7, texts[5]), (2, own)])


def test_samples_agree_as_often_as_the_similarity():
    base = words(1, 400)
    other = list(base)
    for k in range(5, 400, 40):
        other[k] = "x"
    sets = [n.shingles(*text_buffer(pa.array([" ".join(t)]))) for t in (base, other)]
    idf = np.zeros(0, np.uint64), np.zeros(0, np.float32)
    values = [n.samples(h, n.weights_of(h, tf, idf), np.array([0]), 2000)[0] for h, tf, _ in sets]
    true = n.weighted_jaccard(*[(h, n.weights_of(h, tf, idf)) for h, tf, _ in sets])
    assert abs((values[0] == values[1]).mean() - true) < 0.04


def test_empty_table_and_lone_texts(spark):
    assert n.near_duplicates(frame(spark, [])).count() == 0
    assert [tuple(r)[:4] for r in n.near_duplicates(frame(spark, [(7, "a b c d e f")])).collect()] == [(7, 7, 1, True)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 120)]
    rows = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")
    found = {r.node[0]: r.label[0] for r in n.components(rows).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(100, 120))


@pytest.mark.parametrize("text", ["a b c d e", "É é x", "a\n\nb"])
def test_shingles_of_short_texts(text):
    assert len(n.shingles(*text_buffer(pa.array([text])))[0]) == 1


def test_frequent_shingles_are_counted_exactly_over_all_rows(spark):
    texts = [f"all of these five words {i} x{i} y{i} z{i} v{i}" for i in range(150)] + ["some other five words here"] * 3 + ["seen in just one row"]
    hashes, weights = n.frequent_shingles(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7))
    of = lambda t: n.shingles(*text_buffer(pa.array([t])))[0].item()
    found = dict(zip(hashes.tolist(), weights.tolist(), strict=True))
    assert set(found) == {of("all of these five words"), of("some other five words here")}
    assert found[of("all of these five words")] == pytest.approx(0.5 + 0.5 * np.log(150 / 154) / np.log(0.01))


def test_lossy_counts_miss_no_frequent_shingle():
    rng = np.random.default_rng(3)
    held, true = n.FrequentShingles(0.01, room=500), defaultdict(int)
    for _ in range(400):
        row = np.unique(np.append(rng.integers(100, 1 << 40, 60), rng.integers(0, 40, 3))).astype(np.uint64)
        held.add(row, 1)
        for x in row.tolist():
            true[x] += 1
    counts = dict(zip(*(x.tolist() for x in held.settle()), strict=True))
    for x, k in true.items():
        assert counts.get(x, 0) <= k
        if k > 4:
            assert counts[x] >= k - 4
    assert len(counts) < 400


def star_rows(size=60):
    """Edits of one text, of which two are mostly too far apart, and texts that share a passage."""
    base, rows = words(5, 150), []
    for k in range(size):
        own, rng = list(base), np.random.default_rng(k)
        for at in rng.choice(150, 1 + k % 4, replace=False):
            own[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(own)))
    passage = words(6, 60)
    return rows + [(size + k, " ".join(passage + words(700 + k, 2 + k))) for k in range(size)]


def test_large_bucket_is_settled_without_all_its_pairs(spark):
    rows = star_rows()
    out = {r.doc_id: r.class_id for r in n.near_duplicates(frame(spark, rows)).collect()}
    parent = {t: t for _, t in rows}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in brute_force(rows):
        parent[root(a)] = root(b)
    first = {}
    for i, t in rows:
        assert out[i] == first.setdefault(root(t), i)


def test_long_words_that_collide_in_a_polynomial_are_told_apart():
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    one, other = (n.shingles(*text_buffer(pa.array([t])))[0] for t in (a, b))
    assert one[0] != other[0]
