"""Importance resampling towards a target, by an external sort-count of hashed features.

One pass over the texts writes packed streams of 16-bit bucket numbers with the offsets of the
documents in them; the same pass sorts each stream and run-length encodes it, and the runs are
summed to counts per bucket. Gains of buckets, a table of fixed size, come from the counts of both
sides. A second pass, over the streams alone, gathers each feature's gain and adds them up by
document. The ranks of the draw come from one global sort of narrow rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.ordering import numbered

from .shared import materialize

#: Buckets are numbered by 16 bits.
BUCKETS = 10_000
#: Features that a stream holds before it is written; one longer document has its own.
STREAM_FEATURES = 1 << 20
#: Bytes of text whose words are listed at once.
WINDOW = 1 << 20
#: Words whose buckets a worker remembers.
CACHE_WORDS = 1 << 19
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_PART = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


class Buckets(dict):
    """The bucket of each feature seen lately; forgets all when it is full."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z as a-z, by windows that end between words."""
    at = 0
    while at < len(text):
        end = _PART.search(text, min(at + WINDOW, len(text)))
        stop = end.start() if end else len(text)
        yield WORD.findall(text[at:stop].translate(_LOWER))
        at = stop


def bucket_stream(text: bytes, buckets: Buckets, shortest: int, longest: int) -> tuple[np.ndarray, int]:
    """Bucket numbers of all runs of `shortest` to `longest` consecutive words, joined by a space;
    and the number of words."""
    parts, before, n_words = [], [], 0
    for found in words(text):
        n_words += len(found)
        for n in range(shortest, longest + 1):
            own = found if n == 1 else _runs(before, found, n)
            parts.append(np.fromiter(map(buckets.__getitem__, own), np.uint16, len(own)))
        before = (before + found)[-(longest - 1) :] if longest > 1 else []
    return np.concatenate(parts) if parts else np.zeros(0, np.uint16), n_words


def _runs(before: list[bytes], found: list[bytes], n: int) -> list[bytes]:
    """Runs of n words that end in `found` and may begin in the n - 1 words before it."""
    row = before[-(n - 1) :] + found
    return [b" ".join(row[i : i + n]) for i in range(len(row) - n + 1)]


def _streams(buckets: int, shortest: int, longest: int):
    """Batches (doc_id, text) to rows (ids, n_words, offsets, stream, run_buckets, run_lengths)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        for batch in batches:
            ids, texts = batch.columns
            first, parts, size = 0, [], 0
            for i in range(len(texts)):
                text = texts[i]
                parts.append(bucket_stream(text.as_buffer().to_pybytes() if text.is_valid else b"", known, shortest, longest))
                size += len(parts[-1][0])
                if size >= STREAM_FEATURES:
                    yield _packed(ids.slice(first, len(parts)), *zip(*parts, strict=True))
                    first, parts, size = i + 1, [], 0
            if parts:
                yield _packed(ids.slice(first, len(parts)), *zip(*parts, strict=True))

    return run


def _packed(ids: pa.Array, parts: tuple[np.ndarray, ...], n_words: tuple[int, ...]) -> pa.RecordBatch:
    stream = np.concatenate(parts)
    ordered = np.sort(stream)
    edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(edges, len(ordered)))
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    columns = [
        one(ids), one(pa.array(n_words, pa.int64())), one(pa.array(offsets, pa.int64())), pa.array([stream.astype("<u2").tobytes()], pa.binary()),
        one(pa.array(ordered[edges].astype(np.int32))), one(pa.array(lengths.astype(np.int64))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["ids", "n_words", "offsets", "stream", "run_buckets", "run_lengths"])


def bucket_streams(texts: DataFrame, buckets: int, shortest: int, longest: int) -> DataFrame:
    """texts(doc_id, text) as packed streams, written to the shared folder."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"ids array<{kind}>, n_words array<bigint>, offsets array<bigint>, stream binary, run_buckets array<int>, run_lengths array<bigint>"
    return materialize(texts.select("doc_id", "text").mapInArrow(_streams(buckets, shortest, longest), schema), "streams")


def bucket_counts(streams: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket: the streams' runs merged. The result has `buckets` rows."""
    runs = streams.select(F.explode(F.arrays_zip("run_buckets", "run_lengths")).alias("r")).select("r.*")
    out = np.zeros(buckets, np.int64)
    for r in runs.groupBy("run_buckets").agg(F.sum("run_lengths").alias("n")).collect():
        out[r["run_buckets"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the source."""
    buckets = len(source)
    total_s, total_t = float(source.sum() + buckets), float(target.sum() + buckets)
    ratios = [((t + 1.0) * total_s) / ((s + 1.0) * total_t) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def _weights(gains: np.ndarray):
    """Streams to rows (doc_id, n_words, n_features, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n_words, offsets, streams = batch.columns
            for i in range(batch.num_rows):
                at = offsets[i].values.to_numpy()
                own = gains[np.frombuffer(streams[i].as_buffer(), "<u2")]
                n = np.diff(at)
                weight = np.zeros(len(n), np.int64)
                # a document without features would take its neighbour's first gain
                if (n > 0).any():
                    weight[n > 0] = np.add.reduceat(own, at[:-1][n > 0])
                yield pa.RecordBatch.from_arrays([ids[i].values, n_words[i].values, pa.array(n, pa.int64()), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return run


def importance_resample(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, shortest: int = 1, longest: int = 1,
    percent: int = 10, least_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank, a row per row of docs; target has a column text.

    Features are runs of `shortest` to `longest` words. score is the weight plus Gumbel noise from
    a hash of seed and doc_id, so the floor(percent * N / 100) highest scores of the N rows with at
    least `least_words` words are a draw without replacement by weight; they have ranks from 1,
    ties by doc_id, then by row. Others' rank is null. A null text has no features and weight 0; a
    null doc_id counts as '' in the hash and is last of a tie. Rows that repeat a doc_id are drawn
    each for itself. An empty target gives every bucket an equal share there. Only doc_id and
    text are read.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are numbered by 16 bits")
    source = bucket_streams(docs, buckets, shortest, longest)
    wanted = bucket_streams(target.select(F.lit(0).alias("doc_id"), "text"), buckets, shortest, longest)
    gains = bucket_gains(bucket_counts(source, buckets), bucket_counts(wanted, buckets))
    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = source.select("ids", "n_words", "offsets", "stream").mapInArrow(_weights(gains), f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = materialize(weighed.select("*", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("drawable"), F.monotonically_increasing_id().alias("row_no")), "scored")
    drawn = scored.filter("drawable").count() * percent // 100
    ordered = numbered(scored, [F.desc("drawable"), F.desc("score"), F.col("doc_id").asc_nulls_last(), "row_no"])
    rank = F.when(F.col("drawable") & (F.col("number") < drawn), F.col("number") + 1)
    return ordered.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
