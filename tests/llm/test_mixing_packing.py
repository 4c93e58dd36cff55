import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarryline.llm import mixing, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b\n\nc", "", None, "x <|endoftext|> y", " lead", "tail ", "it's we'll 12 34.5 ###", "é\nÀ\n", " \n", "tab\tx\r\n", "a b", "\n", "word", "\U0001f600 x", "x " * 30_000]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s" if i % 3 else "t", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_ids_equal_the_tokenizers():
    tokenizer = Tokenizer.from_file(PATH)
    encoder = packing.word_ids(PATH)
    texts = [t or "" for t in ODD] + ["some more words here, and here.", "words here"]
    data, offsets = packing.text_buffer(__import__("pyarrow").array(texts))
    ids, at = encoder.encode(data, offsets)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert encoder.fast is not None


def test_long_words_that_collide_in_a_polynomial_get_their_own_ids():
    tokenizer, encoder = Tokenizer.from_file(PATH), packing.word_ids(PATH)
    a, b = "a", "b"
    for k in range(13):
        if k in (10, 11, 12):
            for t in (f"x {a} {b}", f"{b} {a} y"):
                ids, _ = encoder.encode(*packing.text_buffer(__import__("pyarrow").array([t])))
                assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids
        a, b = a + b, b + a


PAIR = "IlIlllllllllllllllIllIIlIIIIllIlllllIllIIllIIIllllllIllIllllllll", "lIlIIlIllIlIIllIIIllIlllllllIIlIlIIlllIlllllllIIlIIIllllIllIIlIl"


def test_words_with_one_polynomial_hash_get_their_own_ids():
    tokenizer, encoder = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    texts = [f"a {PAIR[0]} b", f"a {PAIR[1]} b", " ".join(PAIR), PAIR[1]]
    data, offsets = packing.text_buffer(__import__("pyarrow").array(texts))
    ids, at = encoder.encode(data, offsets)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [0, 3, 9])
def test_ids_are_right_whatever_words_share_a_hash(bits):
    tokenizer, encoder = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    encoder.hashes = lambda data, starts, ends: packing.bytes_hashes(data, starts, ends) & np.uint64((1 << bits) - 1)
    rng = np.random.Generator(np.random.PCG64(1))
    texts = [" ".join("".join("abcdeé"[k] for k in rng.integers(0, 6, rng.integers(1, 12))) for _ in range(20)) for _ in range(60)] + [t or "" for t in ODD[:-1]] + ["x" * 700 + " y", "x" * 701 + " y", "z " + "x" * 700]
    for part in (texts[:30], texts[20:], texts):
        data, offsets = packing.text_buffer(__import__("pyarrow").array(part))
        ids, at = encoder.encode(data, offsets)
        for i, t in enumerate(part):
            assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_hashes_of_spans():
    from quarryline.llm import spans

    rng = np.random.Generator(np.random.PCG64(2))
    data = rng.integers(0, 3, 5000, dtype=np.uint8)
    starts = rng.integers(0, 4000, 3000)
    ends = starts + np.where(rng.random(3000) < 0.05, rng.integers(0, 900, 3000), rng.integers(0, 20, 3000))
    by_content = {}
    for h, a, b in zip(spans.bytes_hashes(data, starts, ends).tolist(), starts, ends, strict=True):
        assert by_content.setdefault(h, data[a:b].tobytes()) == data[a:b].tobytes()
    assert len(by_content) == len({data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)})
    values = data.astype(np.uint64)
    wide = spans.span_hashes(values, starts, ends).tolist()
    assert len(set(wide)) == len(by_content)
    other = np.concatenate([np.full(7, 9, np.uint8), data])
    assert not spans.differing(data, starts, other, starts + 7, ends - starts).any()
    other[7 + starts] ^= 1
    assert spans.differing(data, starts, other, starts + 7, ends - starts)[ends > starts].all()


def test_packing_covers_every_token_once(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = ODD + [f"text number {i} " + "lorem ipsum dolor " * (i % 90) for i in range(150)]
    rows = packing.pack(frame(spark, texts).repartition(3), PATH).collect()
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    padding = total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
        total += at
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    assert padding <= 0.01 * total + packing.CAPACITY


def test_cut_and_empty_table(spark):
    assert packing.cut(2048 + 700) == [1024, 1024, 512, 128, 60]
    assert packing.pack(frame(spark, []), PATH).count() == 0


@pytest.mark.parametrize("rate", [0.1, 1.0, 7.5, 200.0])
def test_poisson_steps_and_counts(spark, rate):
    steps = spark.range(1).select(mixing.poisson_steps(F.lit(rate)).alias("s")).first()["s"]
    p = [math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) for k in range(len(steps))]
    assert np.allclose(steps, np.cumsum(p), atol=1e-9)


def test_mixing_meets_rates_and_repeats(spark):
    docs = frame(spark, [f"text {i}" for i in range(6000)])
    out = mixing.mix_sources(docs, {"s": 3.0, "t": 1.0}, epochs=2.0)
    chars = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert abs(chars["s"] / chars["t"] - 3) < 0.3
    again = mixing.mix_sources(docs.repartition(7), {"s": 3.0, "t": 1.0}, epochs=2.0)
    key = lambda d: sorted((r.doc_id, r.mix_copy) for r in d.collect())
    assert key(out) == key(again)
    order = [r.doc_id for r in out.limit(200).collect()]
    assert order != sorted(order)


def test_large_rates_are_sums(spark):
    docs = spark.createDataFrame([(i, "x" * (1 if i < 40 else 1000), "en", "a" if i < 40 else None, 0) for i in range(80)], "doc_id long, text string, lang string, source string, n_chars long")
    counts = [r.mix_copies for r in mixing.copy_counts(docs).filter("source = 'a'").collect()]
    assert abs(np.mean(counts) - 500.5) < 20


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", "a", 0), (None, "", "en", "a", 0), (1, "x", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert mixing.copy_counts(docs).count() == 3
    odd = docs.selectExpr('*', '1 AS rate', '2 AS u', '3 AS mix_copies', '4 AS pieces')
    assert mixing.mix_sources(odd).columns == [*docs.columns, 'rate', 'u', 'pieces', 'mix_rate', 'mix_copies', 'mix_copy', 'mix_key']
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs, {"b": 1.0}).count() == 0
