"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases, these into longer phrases, and so on. Where a phrase ends is
decided by deterministic coin tossing: a symbol's label is the place and value of the lowest
bit in which it differs from the symbol before; labels of labels soon have a handful of values,
and local maxima among them end phrases. A label depends on a few symbols to the left and one
to the right, so equal substrings are parsed alike, but for their ends, wherever they stand.
A phrase's name is the hash of its bytes' names one level below.

A fingerprint holds the text's topmost name and the SKETCH smallest names of its phrases from
level FIRST_LEVEL up; the likeness of two is the share of common names among the smallest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, text_or_empty
from .spans import bytes_hashes, chunks, mix, span_hashes, text_buffer

SKETCH = 64
FIRST_LEVEL = 2
#: Characters of a text by which rows of one doc_id are put in order.
TIE_CHARS = 256

#: Label of a symbol that repeats the one before: a run is never cut.
_RUN = 255


def _lowest_bit(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1))


def _coin_table() -> np.ndarray:
    """Labels of all pairs of bytes (before, own); runs keep their label."""
    before, own = np.meshgrid(np.arange(256, dtype=np.uint64), np.arange(256, dtype=np.uint64), indexing="ij")
    place = _lowest_bit(before ^ own)
    label = 2 * place + ((own >> place.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    label[before == own] = _RUN
    return label.astype(np.uint8).ravel()


_COIN = _coin_table()


def _tossed(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One more round on labels of a byte each; the first symbol of a text keeps label 0."""
    out = np.empty_like(label)
    out[0] = 0
    out[1:] = _COIN[(label[:-1].astype(np.uint16) << 8) | label[1:]]
    out[label == _RUN] = _RUN
    out[first] = 0
    return out


def phrase_starts(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin. symbols: bytes or 64-bit names; first: each text's first place."""
    if symbols.dtype == np.uint8:
        same = np.zeros(len(symbols), bool)
        same[1:] = symbols[1:] == symbols[:-1]
        same[first] = False
        own = np.empty_like(symbols)
        own[0] = 0
        own[1:] = _COIN[(symbols[:-1].astype(np.uint16) << 8) | symbols[1:]]
        own[same] = _RUN
        own[first] = 0
        label = own
    else:
        change = np.zeros(len(symbols), np.uint64)
        change[1:] = symbols[1:] ^ symbols[:-1]
        place = _lowest_bit(change)
        label = (2 * place + ((symbols >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
        label[change == 0] = _RUN
        label[first] = 0
    for _ in range(3):
        label = _tossed(label, first)
    rank = label + np.uint8(1)  # runs: 0, so they are never maxima
    peak = np.zeros(len(rank), bool)
    if len(rank) > 2:
        peak[1:-1] = (rank[1:-1] > rank[:-2]) & (rank[1:-1] >= rank[2:]) & (rank[1:-1] > 0)
    # neither a text's first nor its second symbol, nor its last, is judged by another text
    peak[first] = False
    last = np.append(first[1:], len(rank)) - 1
    peak[last] = False
    peak[first] = True
    return peak


def phrase_names(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(names, number of the text) level by level, from level 1 to where texts are one phrase.

    Texts that have become one phrase leave; empty texts have no phrase.
    """
    filled = np.flatnonzero(np.diff(offsets) > 0)
    levels = []
    symbols = data
    text = filled
    first = offsets[:-1][filled]
    while len(text):
        starts = np.flatnonzero(phrase_starts(symbols, first))
        names = (span_hashes if levels else bytes_hashes)(symbols, starts, np.append(starts[1:], len(symbols)))
        begin = np.searchsorted(starts, first)
        count = np.diff(np.append(begin, len(starts)))
        levels.append((names, np.repeat(text, count)))
        more = count > 1
        keep = np.repeat(more, count)
        symbols = names[keep]
        text, count = text[more], count[more]
        first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    return levels


def sketches(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Per text: its topmost name, then up to SKETCH smallest names (32 bits), ascending.

    Empty: no names. The topmost name is one of level FIRST_LEVEL or above, or the only one.
    """
    n = len(offsets) - 1
    levels = phrase_names(data, offsets)
    top = np.zeros(n, np.uint64)
    names, owners = [], []
    for level, (name, text) in enumerate(levels, 1):
        counts = np.bincount(text, minlength=n)
        single = counts[text] == 1
        top[text[single]] = name[single]
        if level >= FIRST_LEVEL:
            names.append(name)
            owners.append(text)
        else:
            names.append(name[single])
            owners.append(text[single])
    if not names:
        return [np.zeros(0, np.uint32)] * n
    small = (mix(np.concatenate(names)) >> np.uint64(32)).astype(np.uint32)
    owner = np.concatenate(owners)
    both = np.unique((owner.astype(np.uint64) << np.uint64(32)) | small)
    owner, small = (both >> np.uint64(32)).astype(np.int64), both.astype(np.uint32)
    at = np.searchsorted(owner, np.arange(n + 1))
    upper = (top >> np.uint64(32)).astype(np.uint32)
    return [np.append(upper[i : i + 1], small[at[i] : min(at[i] + SKETCH, at[i + 1])]) if at[i + 1] > at[i] else np.zeros(0, np.uint32) for i in range(n)]


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common names among the smallest of both; 1 for equal fingerprints, 0 when one
    text is empty and the other isn't."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    x, y = a[1:], b[1:]
    if not len(x) or not len(y):
        return 0.0
    # both lists hold all names, or their smallest: the union is known up to the smaller end
    k = min(SKETCH, max(len(x), len(y)))
    union = np.union1d(x, y)[: k if max(len(x), len(y)) == SKETCH else None]
    common = np.intersect1d(np.intersect1d(x, y, assume_unique=True), union, assume_unique=True)
    return len(common) / len(union)


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many first characters of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


_OUT = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _sketch_all(texts: list[str]) -> list[np.ndarray]:
    data, offsets = text_buffer(pa.array(texts, pa.large_string()))
    out: list[np.ndarray] = []
    for first, last in chunks(offsets):
        out += sketches(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
    return out


def _compare(ids: list, texts: list[str], kind: pa.DataType) -> pa.RecordBatch:
    """Rows for all texts but the last, each with the one behind it as the following text."""
    new = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    own, changed = _sketch_all(texts), _sketch_all(new)
    rows = [
        (len(t), hashlib.sha256(e.encode()).hexdigest(), as_text(f), as_text(g), likeness(f, g), likeness(f, h))
        for t, e, f, g, h in zip(texts, new, own, changed, own[1:], strict=False)
    ]
    columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _OUT, strict=True)] if rows else [pa.array([], t) for _, t in _OUT]
    return pa.RecordBatch.from_arrays([pa.array(ids[: len(rows)], kind), *columns], ["doc_id", *(n for n, _ in _OUT)])


#: What a row of a walked range is: a finished one, or the range's first or last text.
_DONE, _FIRST, _LAST = 0, 1, 2


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished rows for all texts of an ordered range but the last one, then the range's first
    and last text, whose neighbours other ranges have."""
    part = TaskContext.get().partitionId()
    held = first = kind = None

    def mark(found: pa.RecordBatch, what: int, text: str | None) -> pa.RecordBatch:
        n = found.num_rows
        more = [pa.array([part] * n, pa.int32()), pa.array([what] * n, pa.int32()), pa.array([text] * n, pa.string())]
        return pa.RecordBatch.from_arrays([*found.columns, *more], [*found.schema.names, "part", "what", "text"])

    def border(what: int, row: tuple) -> pa.RecordBatch:
        none = [pa.array([None], t) for _, t in _OUT]
        return mark(pa.RecordBatch.from_arrays([pa.array([row[0]], kind), *none], ["doc_id", *(n for n, _ in _OUT)]), what, row[1])

    for batch in batches:
        kind = batch.schema.types[0]
        for at in range(0, batch.num_rows, 512):
            ids, texts = (c.to_pylist() for c in batch.slice(at, 512).columns)
            if held:
                ids, texts = [held[0], *ids], [held[1], *texts]
            else:
                first = ids[0], texts[0]
            if len(ids) > 1:
                yield mark(_compare(ids, texts, kind), _DONE, None)
            held = ids[-1], texts[-1]
    if held:
        yield border(_FIRST, first)
        yield border(_LAST, held)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, following text)."""
    for batch in batches:
        for i in range(batch.num_rows):
            doc_id, text, following = (c[i].as_py() for c in batch.columns)
            yield _compare([doc_id, None], [text, following], batch.schema.types[0])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text counts as empty; an empty text's fingerprint is ''. Order: doc_id (null first),
    then the text's first TIE_CHARS characters, then as read; so rows that repeat a doc_id, or
    a text too, may be any number. After the last document comes the first.

    Texts are dealt out once, by range of that order; each task walks its range. The first and
    the last text of every range, two rows a task, then meet those of the ranges beside it.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", text_or_empty("text").alias("text")).withColumn("tie", F.substring("text", 1, TIE_CHARS)).withColumn("row_no", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("doc_id"), "tie", "row_no"]
    ranges = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    walked = materialize(ranges.mapInArrow(_walk, f"doc_id {kind}, {FIELDS}, part int, what int, text string"), "walked")
    first = walked.filter(F.col("what") == _FIRST).select("part", F.col("text").alias("following"))
    # as many numbers as tasks
    around = first.select("part").withColumn("next_part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    last = walked.filter(F.col("what") == _LAST).select("doc_id", "text", "part").join(around, "part")
    met = last.join(first.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "following")
    done = walked.filter(F.col("what") == _DONE).select("doc_id", *(name for name, _ in _OUT))
    return done.unionByName(met.mapInArrow(_meet, f"doc_id {kind}, {FIELDS}"))
