"""The pipeline's stages against plain versions, and odd tables through all of them."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quarryline.llm import langid, mixing, neardup
from quarryline.llm.queries import tokenizer_path
from quarryline.llm.spans import text_buffer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rejected boolean, node string, copies long, mix_key string"
VOCABULARY = {"en": "the of and to in that with from which was were have".split(), "de": "der und die das ist nicht mit von auch sich eine werden".split()}


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1.0, False, "n", 1, "k") for i, t, lang, s in rows], DOCS)


def sample_rows(n=60):
    rng, rows = random.Random(5), []
    for i in range(n):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(rng.choice(VOCABULARY[lang]) + rng.choice(["", "s", "en", "ing"]) for _ in range(80)), lang, "s" if i % 3 else None))
    rows += [(n, rows[3][1] + "  ", "en", "s"), (n + 1, rows[4][1], "de", "t"), (n + 2, rows[5][1] + " more", "en", "s")]
    rows += [(n + 3, None, None, "s"), (n + 4, "", "en", None), (n + 5, "12 34", "de", "s"), (None, rows[7][1] + " und", "en", "s"), (None, rows[9][1] + " so", None, "t"), (3, rows[3][1], "en", "s")]
    return rows


def counted(df):
    return Counter(map(tuple, df.collect()))


def near_pairs(texts):
    """Pairs of different texts of weighted Jaccard similarity 0.8 or more, where all weigh alike."""
    sets = [(t, *neardup.shingles(*text_buffer(pa.array([t])))[:2]) for t in texts]
    counts = Counter(h for _, hs, _ in sets for h in hs.tolist())
    often = np.array(sorted(h for h, c in counts.items() if c > neardup.RARE * len(texts)), np.uint64)
    idf = often, neardup.idf_weights(np.array([counts[h] for h in often.tolist()]), len(texts))
    weighted = [(t, (h, neardup.weights_of(h, tf, idf))) for t, h, tf in sets if len(h)]
    return [(a, b) for i, (a, x) in enumerate(weighted) for b, y in weighted[i + 1 :] if a != b and neardup.weighted_jaccard(x, y) >= neardup.SIMILARITY]


def test_stages_against_plain_versions(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "exact dedup", "near dedup", "mixing", "packing"]
    docs = rows_of(spark, sample_rows())

    known = stages["language ID"](spark, docs, "").cache()
    told = langid.identify(docs, langid.fit_dictionaries(docs)).filter("NOT rejected").collect()
    assert known.columns == docs.columns and Counter(r.doc_id for r in told) == Counter(r.doc_id for r in known.collect())

    once = stages["exact dedup"](spark, known, "").cache()
    plain = lambda r: re.sub(r"[\x20\x09-\x0d]", "", r.text or "")
    groups = defaultdict(list)
    for r in known.collect():
        groups[plain(r)].append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
    assert Counter((plain(r), r.doc_id or 0) for r in once.collect()) == Counter((t, min(g)[2]) for t, g in groups.items())

    unlike = stages["near dedup"](spark, once, "").cache()
    rows = once.collect()
    parent = {r.text: r.text for r in rows}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in near_pairs([r.text for r in rows]):
        parent[root(a)] = root(b)
    classes = defaultdict(list)
    for r in rows:
        classes[root(r.text)].append((r.doc_id is None, r.doc_id or 0))
    assert Counter(r.doc_id or 0 for r in unlike.collect()) == Counter(min(c)[1] for c in classes.values())

    mixed = stages["mixing"](spark, unlike, "").cache()
    copies = {(r.doc_id, r.text): r.mix_copies for r in mixing.copy_counts(unlike.drop("mix_key")).select("doc_id", "text", "mix_copies").collect()}
    assert Counter((r.doc_id, r.text) for r in mixed.collect()) == Counter({k: n for k, n in copies.items() if n})

    packed = stages["packing"](spark, mixed, "").collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    assert sum(r.length for r in packed) == sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)] * 3, [(1, "", "en", "s")]], ids=["empty", "nulls", "no text"])
def test_odd_tables_pass_through(spark, rows):
    docs = rows_of(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert name == "packing" or docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert docs.count() == 0


def test_repeated_rows_leave_one(spark):
    text = "and the was of that in which have were from " * 20
    rows = [(1, text, "en", "s")] * 4 + [(2, text, "en", "s"), (6, "der und die " * 30, "de", "s")]
    docs = rows_of(spark, rows)
    for name, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, "")
    assert sorted(r.doc_id for r in docs.collect()) == [1, 6]


@pytest.mark.parametrize("stage", ["exact dedup", "near dedup"])
def test_one_repeated_id_moves_no_other_texts(spark, stage):
    """The texts of rows with an id of their own stay where they are read."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"{rng.randrange(10**9)}" for _ in range(30)), "en", "s") for i in range(2000)] + [(5, "another text of id five", "en", "s")]
    out = dict(corpus_pipeline.STAGES)[stage](spark, rows_of(spark, rows), "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    lines = plan[plan.index("Union") :].splitlines()[1:]
    own = "\n".join(lines[: next(i for i, x in enumerate(lines) if x.lstrip(" ").startswith("+-") and x.index("+-") <= lines[0].index(":-"))])
    # rows of ids of their own meet a broadcast table of ids; only the others are exchanged
    assert re.search(r"BroadcastHashJoin .*LeftAnti", own) and "Exchange hashpartitioning" not in own and "Exchange hashpartitioning" in plan
    assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in rows)
