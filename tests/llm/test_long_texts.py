"""Very long texts, and what they are next to, through the operators that read documents."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarryline.llm import exact_dedup, fingerprints, licenses, mixing, neardup, packing, warc
from quarryline.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "\n".join(f"word{i % 997} other{i % 89} part{i}" for i in range(120_000))  # 3 MB


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "en", "s", 0), (2, LONG.replace("part777\n", "changed\n"), "en", "s", 0), (3, LONG.replace("\n", " "), "en", "t", 0), (4, "short", "en", "t", 0), (5, LONG + "\nReleased under the\nMIT license", "en", "t", 0)]
    return spark.createDataFrame(rows, DOCS).cache()


def test_exact_groups(docs):
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.duplicate_groups(docs).collect()}
    assert found[1] == found[3] == (1, 2) and found[2] == (2, 1) and found[4] == (4, 1)


def test_near_duplicates(docs):
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 5: 1, 4: 4}


def test_licenses_at_the_end(docs):
    found = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.labels) for r in licenses.scan_licenses(docs).collect()}
    n = 3 * 120_000
    assert found[1] == (n, 0, None, "") and found[5] == (n + 5, 1, n + 3, "mit")


def test_packing(docs):
    ids = Tokenizer.from_file(tokenizer_path()).encode(LONG, add_special_tokens=False).ids
    pieces = sorted((r.start, r.length, r.ids_crc32) for r in packing.pack(docs.filter("doc_id = 1"), tokenizer_path).collect())
    whole = [*ids, packing.END_ID]
    assert pieces[-1][0] + pieces[-1][1] == len(whole)
    for start, length, crc in pieces:
        assert crc == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in whole[start : start + length]))


def test_fingerprints(docs):
    found = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    k = len(LONG) // 4
    assert found[1].n_chars == len(LONG) and found[1].edited_sha256 == hashlib.sha256((LONG[: len(LONG) - k] + LONG.replace("part777\n", "changed\n")[:k]).encode()).hexdigest()
    assert found[1].near_next > 0.9 > found[3].near_next


def test_mixing_and_archives(docs):
    assert {r.doc_id for r in mixing.copy_counts(docs).collect()} == {1, 2, 3, 4, 5}
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    index, folder = warc.archive_pages(pages.unionByName(pages.filter("page_id = 1").withColumn("page_id", F.lit(9).cast("long"))))
    found = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(index, folder, payload=False).collect()}
    digest = hashlib.sha1(LONG.encode()).hexdigest()
    assert found[1] == (len(LONG), digest, "revisit", 9) and found[9] == (len(LONG), digest, "response", None)


def test_packing_keeps_few_words_in_memory():
    """A worker that meets ever new words forgets them in time: they take less than 250 MB."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import resource
import pyarrow as pa
from quarryline.llm import packing
from quarryline.llm.queries import tokenizer_path
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
packing.word_ids(tokenizer_path)
before = peak()
text = lambda d: " ".join("w%x" % ((d * 20000 + i) * 2654435761 % (1 << 40)) for i in range(20000))
batches = (pa.RecordBatch.from_arrays([pa.array([d]), pa.array([text(d)])], ["doc_id", "text"]) for d in range(80))
print(sum(b.num_rows for b in packing.pack_partition(tokenizer_path)(batches)), peak() - before)
"""
    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, check=True).stdout.split()
    assert int(out[0]) >= 80 and int(out[1]) < 250, out
