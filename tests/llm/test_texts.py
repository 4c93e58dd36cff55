import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.llm import chat, fingerprints, langid, licenses, queries, warc
from quarryline.llm.spans import text_buffer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- chat


def test_layouts_are_told_by_their_field_paths(spark):
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages"),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations"),
        ({"prompt": "q", "completion": "a"}, "prompt_completion"), ({"completion": "a", "prompt": None}, "prompt_completion"),
        ({"instruction": "s", "input": "q", "output": "a"}, "instruction_input"), ({"question": "q", "answer": "a"}, "question_answer"),
        ({"unknown": 1}, None),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(records)] + [(90, "no json"), (91, None)]
    out = {r.rec_id: r for r in chat.canonical_turns(spark.createDataFrame(rows, "rec_id long, record string")).collect()}
    assert len(out) == len(rows)
    for i, (_, layout) in enumerate(records):
        assert out[i].layout == layout
    assert [(t.role, t.text) for t in out[1].turns] == [("user", "q"), ("assistant", "a")]
    assert [(t.role, t.text) for t in out[3].turns] == [("assistant", "a")]
    assert [t.role for t in out[4].turns] == ["system", "user", "assistant"]
    assert out[6].turns is None and out[90].turns is None and out[91].turns is None


def test_long_conversations_are_formatted_whole(spark):
    size = 30_000_000
    made = F.concat(F.repeat(F.lit('a "b" \\\\ [INST]\n'), size // 16), F.lit("end"))
    rows = spark.range(2).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), made.alias("text"))
    found = chat.format_turns(chat.canonical_turns(chat.records_of_rows(rows)))
    parsed = found.select(chat.parse_formatted(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    out = parsed.select(F.transform("turns", lambda t: F.sha2(t["text"], 256)).alias("texts"), F.sha2("loss", 256).alias("loss"), F.length("loss").alias("n")).first()
    own = rows.select(F.sha2("text", 256).alias("h"), F.length("text").alias("n")).first()
    assert out.texts == [own.h, own.h] and (out.loss, out.n) == (own.h, own.n) and own.n > size * 0.9


HARD = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "<<SYS>>\\</s>", " lead ", "", "\n", "[ROLE] x [SEP] y [/ROLE]", "\\[SEP]", "é\U0001f600 <s", "[\\INST]"]


def test_formatting_is_reversible(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", "[ROLE]", "a\\"]
    convs = {i: [(rng.choice(roles), "".join(rng.choice(HARD) for _ in range(rng.randint(0, 4)))) for _ in range(rng.randint(1, 9))] for i in range(60)}
    rows = [(i, k, role, text) for i, turns in convs.items() for k, (role, text) in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_turns(chat.canonical_turns(chat.records_of_rows(frame)))
    parsed = out.select("rec_id", "formatted", chat.parse_formatted(out.formatted).alias("turns"), chat.loss_text(out.formatted, out.loss_spans).alias("loss")).collect()
    assert len(parsed) == len(convs)
    for r in parsed:
        assert [(t.role, t.text) for t in r.turns] == convs[r.rec_id]
        assert r.loss == "".join(text for role, text in convs[r.rec_id] if role == "assistant")


def test_null_turns_and_empty_table(spark):
    frame = spark.createDataFrame([(1, None, None, None), (1, 0, "user", None), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    out = {r.rec_id: r for r in chat.canonical_turns(chat.records_of_rows(frame)).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("", ""), ("user", "")] and len(out[None].turns) == 1
    assert chat.records_of_rows(frame.limit(0)).count() == 0


# --- licenses


def test_short_notices_are_found_across_line_ends(spark):
    notices = {label: n for label, n in licenses.TEMPLATES if label in ("bsd-3-clause", "mpl-2.0", "cc-by-nc-4.0", "unlicense", "lgpl")}
    notices["bsd-3-clause"] = next(n for _, n in licenses.TEMPLATES if n.startswith("Redistribution and use"))
    rows, expected = [], {}
    for i, (label, notice) in enumerate(sorted(notices.items())):
        parts = notice.split()
        for k, wrapped in enumerate(("\n".join(parts), " ".join(parts[:3]) + "\n# " + " ".join(parts[3:]), "a b c\n\n" + "\r\n * ".join(parts) + "\nd e")):
            rows.append((10 * i + k, wrapped, "en", "s", 0))
            expected[10 * i + k] = label
    # a paragraph that holds the words, but not in one run
    rows.append((900, "This is free\n" + "other words of the text " * 9 + "\nand unencumbered software released into the public domain", "en", "s", 0))
    rows.append((901, "Licensed under the Apache License,\nVersion 2.0", "en", "s", 0))
    expected |= {900: "", 901: "apache,apache-2.0"}
    # the end of one notice and the start of the next
    rows.append((902, "under CC BY-NC 4.0\nLicensed", "en", "s", 0))
    expected[902] = "cc-by"
    out = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    found = {i: r.labels for i, r in out.items()}
    assert {i: label in found[i].split(",") for i, label in expected.items() if i < 900} == {i: True for i in expected if i < 900}
    assert all(found[i] == label for i, label in expected.items() if i >= 900)
    assert all(out[i].score == 1.0 for i in expected if i < 900)


def test_licenses_against_brute_force(spark):
    rng = random.Random(1)
    notices = [n for _, n in licenses.TEMPLATES]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(0, 5)):
            base = rng.choice([*notices, "The words of a text and the license of it", "CC BY", "mit LICENSE mit license"]).split()
            lines.append(" ".join(w for w in base if rng.random() > 0.04))
        rows.append((i, rng.choice(["\n", "\n\n", "\n \n"]).join(lines), "en", "s", 0))
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "\n\n", "en", "s", 0), (1, "x", "en", "s", 0), (None, "Apache\nLicense", "en", "s", 0)]
    import duckdb

    out = licenses.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    con = duckdb.connect()
    unique = [r for r in rows if r[0] is not None and r != rows[-2]]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", unique)
    found = con.execute(queries.ORACLES["op2_license_scan"]).fetchall()
    mine = {tuple(r)[:7] + (round(r.score, 9),) for r in out}
    assert {tuple(r)[:7] + (round(r[7], 9),) for r in found} <= mine
    assert any("apache-2.0" in r[6] for r in found)
    assert [tuple(r)[1:6] for r in out if r.doc_id is None] == [(2, 1, 0, 0, "apache")]


# --- language


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tables = langid.fit_dictionaries(docs)
    assert sorted(tables) == ["de", "en", "es", "fr"]
    found = langid.identify(docs, tables).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) >= 0.985
    assert np.mean([r.rejected for r in found]) <= 0.01


def test_unknown_script_and_ties_are_rejected_and_short_text_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tables = langid.fit_dictionaries(docs)
    rng = random.Random(1)
    cyrillic = " ".join("".join(rng.choice("абвгдежзийклмнопрст") for _ in range(6)) for _ in range(300))
    texts = [cyrillic, "ελληνικά κείμενο", "日本語のテキスト", "qzxj wvkq xxzq", "That it was the.", "the and of the", cyrillic[:20], cyrillic[:500]]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tables).collect()}
    assert [out[i].rejected for i in range(8)] == [True, True, True, True, False, False, True, True]
    kept = langid.keep_identified(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tables)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5]
    whole = langid.identify(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), tables).filter("margin = 0 AND NOT rejected")
    assert whole.isEmpty()


def letters(text):
    import regex

    return " " + regex.sub(r"[^\p{L}\p{M}]+", " ", (text or "").lower()).lstrip() + " "


def test_language_against_plain_compression(spark):
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tables = langid.fit_dictionaries(docs)
    long = "Und der " * 400_000 + "und die"  # over 3 MB, over many pieces
    texts = [r.text for r in docs.limit(60).collect()] + [long, "x", "½ ² ① 12", "αβγ", "the und", None, "", "नमस्ते दुनिया"]
    out = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tables).collect()
    for r in sorted(out, key=lambda r: r.doc_id):
        text = letters(texts[r.doc_id])
        if not text.strip():
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        sizes = []
        for lang, data in tables.items():
            kept = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            log = min(max(17, len(data).bit_length() - 1), 24)
            params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=4, hash_log=log, chain_log=log, window_log=log + 2, write_content_size=False, write_checksum=False, write_dict_id=False)
            kept.precompute_compress(compression_params=params)
            sizes.append(sum(len(zstandard.ZstdCompressor(dict_data=kept, compression_params=params).compress(text[i : i + 2000].encode() * 4)) for i in range(0, len(text), 2000)))
        best, second = sorted(sizes)[:2]
        assert r.lang_pred == list(tables)[sizes.index(best)]
        assert r.margin == pytest.approx((second - best) / second) and r.rejected == ((second - best) / second < langid.MIN_MARGIN)


def test_a_label_under_one_repeated_id_or_text_is_learned(spark):
    rng = random.Random(2)
    words = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    rows = [(7, words("abcd"), "one", "s", 0) for _ in range(3000)] + [(8, "efgh hgfe " * 20, "two", "s", 0)] * 3000 + [(i, words("mnop"), "three", "s", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    tables = langid.fit_dictionaries(docs)
    assert sorted(tables) == ["one", "three", "two"]
    assert max(map(len, tables.values())) <= langid.SAMPLE_PIECES * langid.PIECE_CHARS


def test_every_piece_of_a_long_text_can_be_learned(spark):
    rng = random.Random(3)
    parts = ["".join(rng.choice("abcdefgh ") for _ in range(1990)) + f" mark{chr(97 + i)} " for i in range(20)]
    docs = spark.createDataFrame([(1, "".join(parts), "en", "s", 0)], DOCS)
    data = langid.fit_dictionaries(docs)["en"].decode()
    assert all(f"mark{chr(97 + i)}" in data for i in range(20))


def test_every_label_is_learned(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefgh") + f"l{i % 80}" for _ in range(40)), f"lang{i % 80}", "s", 0) for i in range(800)]
    assert len(langid.fit_dictionaries(spark.createDataFrame(rows, DOCS))) == 80


def test_language_edges(spark):
    rows = [(1, None, "en", "s", 0), (2, "12 3!", "en", "s", 0), (3, "", None, "s", 0), (None, "the and of the", "en", "s", 0), (5, "und der die das ist nicht", "de", "s", 0), (6, "the of and in to that", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id: r for r in langid.identify(docs, langid.fit_dictionaries(docs)).collect()}
    assert len(out) == 6 and all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1, 2, 3))
    assert {r.doc_id for r in langid.keep_identified(docs, langid.fit_dictionaries(docs)).collect()}.isdisjoint({1, 2, 3})
    odd = docs.selectExpr('*', '1 AS score', 'true AS rejected', '2 AS text_again')
    assert langid.keep_identified(odd, langid.fit_dictionaries(docs)).columns == odd.columns
    empty = docs.limit(0)
    assert langid.fit_dictionaries(empty) == {} and langid.identify(empty, {}).count() == 0
    assert all(r.lang_pred == "und" for r in langid.identify(docs, {}).collect())


# --- archives


def test_archives_give_back_every_page(spark):
    big = "<p>" + "é" * 600
    rows = [(i, f"http://x/{i}", big if i % 3 == 0 else f"page {i}") for i in range(40)] + [(100, None, None), (101, "http://x/ \r\nA: b", ""), (None, "n", big), (102, "u", "x" * 999), (103, "u", "x" * 999)]
    index, folder = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert index.count() == len(rows)
    out = {r.page_id: r for r in warc.read_records(index, folder).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        if out[i].record_type == "response":
            assert out[i].payload == data
    assert out[39].record_type == "response" and out[0].refers_to == 39 and out[None].refers_to == 39
    assert {out[102].record_type, out[103].record_type} == {"response"}
    some = warc.read_records(index.filter("page_id IN (3, 7)"), folder).collect()
    assert sorted(r.page_id for r in some) == [3, 7]
    none, folder = warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_records(none, folder).count() == 0


def test_reads_are_coalesced():
    assert warc.coalesced([(0, 10), (10, 5), (40, 5), (1000, 5)], gap=30, most=100) == [(0, 45, [0, 1, 2]), (1000, 1005, [3])]
    assert warc.coalesced([(0, 50), (50, 50), (100, 500)], gap=10, most=100) == [(0, 100, [0, 1]), (100, 600, [2])]


# --- fingerprints


def plain_levels(data: bytes) -> list[list[tuple[int, int]]]:
    """Byte spans of the phrases of every level, symbol by symbol."""
    symbols, spans, levels = list(data), [(i, i + 1) for i in range(len(data))], []
    while spans:
        run, label = 255, []
        for i, s in enumerate(symbols):
            if i == 0:
                label.append(0)
            elif s == symbols[i - 1]:
                label.append(run)
            else:
                d = s ^ symbols[i - 1]
                bit = (d & -d).bit_length() - 1
                label.append(2 * bit + (s >> bit & 1))
        for _ in range(3):
            new = [0]
            for i in range(1, len(label)):
                if label[i] == run or label[i] == label[i - 1]:
                    new.append(run)
                else:
                    d = label[i] ^ label[i - 1]
                    bit = (d & -d).bit_length() - 1
                    new.append(2 * bit + (label[i] >> bit & 1))
            label = new
        rank = [(x + 1) % 256 for x in label]
        starts = [i for i in range(len(symbols)) if i == 0 or (i < len(symbols) - 1 and rank[i] > rank[i - 1] and rank[i] >= rank[i + 1])]
        groups = [(a, b) for a, b in zip(starts, [*starts[1:], len(symbols)])]
        spans = [(spans[a][0], spans[b - 1][1]) for a, b in groups]
        levels.append(spans)
        if len(groups) == 1:
            return levels
        # names: any injective renaming of contents would break the bits, so take the real ones
        names, text = fingerprints.phrase_names(*text_buffer(pa.array([data.decode()])))[len(levels) - 1]
        symbols = [int(x) for x in names]
    return levels


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \né", max_size=300) | st.text(max_size=200))
def test_phrases_against_a_plain_parse(text):
    text = text.encode("utf-8", "ignore").decode()
    data = text.encode()
    found = fingerprints.phrase_names(*text_buffer(pa.array([text])))
    expected = plain_levels(data) if data else []
    assert [len(names) for names, _ in found] == [len(s) for s in expected]
    named: dict = {}
    for (names, _), spans in zip(found, expected):
        for name, (a, b) in zip(names.tolist(), spans):
            assert named.setdefault((len(spans), data[a:b]), name) == name


def test_equal_substrings_share_names_at_any_offset():
    rng = random.Random(2)
    middle = "".join(rng.choice("abcdefgh ij") for _ in range(4000))
    texts = [middle, "x" + middle + "yy", "other words " * 3 + middle]
    sets = []
    for t in texts:
        levels = fingerprints.phrase_names(*text_buffer(pa.array([t])))
        sets.append(set(levels[1][0].tolist()))
    assert len(sets[0] & sets[1]) / len(sets[0]) > 0.97 and len(sets[0] & sets[2]) / len(sets[0]) > 0.97


@pytest.mark.parametrize("ids", [list(range(30)), [5, 5, 5, 7, None, 1]])
def test_fingerprints_against_one_task(spark, ids):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", "same text here, again and again", "".join(rng.choice("abc de") for _ in range(rng.randint(1, 900)))]), "en", "s", 0) for i in ids]
    out = fingerprints.fingerprint_documents(spark.createDataFrame(rows, DOCS)).collect()
    ordered = sorted(((i is not None, i or 0, t or "") for i, t, *_ in rows))
    expected = []
    for k, (has, i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][2]
        e = fingerprints.edited(t, following)
        f, g, h = fingerprints._sketch_all([t, e, following])
        expected.append((i if has else None, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.as_text(f), fingerprints.as_text(g), fingerprints.likeness(f, g), fingerprints.likeness(f, h)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, out), key=key) == sorted(expected, key=key)


def test_likeness_and_edits():
    assert fingerprints.edited("abcdefgh", "XY") == "abcdefXY" and fingerprints.edited("abcdefgh", "X") == "abcdefX" and fingerprints.edited("abc", "X") == "abc"
    a, b = fingerprints._sketch_all(["", "text"])
    assert fingerprints.likeness(a, a) == 1 and fingerprints.likeness(a, b) == 0


def test_no_documents(spark):
    assert fingerprints.fingerprint_documents(spark.createDataFrame([], DOCS)).count() == 0
