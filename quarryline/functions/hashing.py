"""Content hashes and order-independent fingerprints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digests are 32 bytes: 16 of the hash, 16 zeros (fixed value).
_PAD = b"\0" * 16


@F.pandas_udf(T.BinaryType())
def content_hash(body: pd.Series) -> pd.Series:
    """XXH3-128 of the bytes in little-endian layout, padded to 32 bytes; null stays null."""
    import xxhash

    return body.map(lambda b: None if b is None else xxhash.xxh3_128_digest(b)[::-1] + _PAD)


@F.pandas_udf(T.BinaryType())
def _stream_hash(parts: pd.Series) -> pd.Series:
    import xxhash

    def one(rows) -> bytes:
        if rows is None or len(rows) == 0:
            return b"\0" * 32
        h = xxhash.xxh3_128()
        for r in rows:
            h.update(r["key"].encode() + b"\0" + bytes(r["hash"]))
        return h.digest()[::-1] + _PAD

    return parts.map(one)


def fingerprint(rows: DataFrame, by: list[str], key: str = "key", digest: str = "hash") -> DataFrame:
    """One digest per group of (key, digest) rows, whatever their order; keys sort by bytes."""
    pairs = F.array_sort(F.collect_list(F.struct(F.encode(key, "UTF-8").alias("k"), F.col(key).alias("key"), F.col(digest).alias("hash"))))
    return rows.groupBy(*by).agg(_stream_hash(F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), p["hash"].alias("hash")))).alias("fingerprint"))


def fingerprint_md5(rows: DataFrame, by: list[str], key: str = "key", digest: str = "hash") -> DataFrame:
    """The same with MD5 over `key:hash` text, in SQL functions only."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(digest).alias("h"))))
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit(":"), p["h"])), ",")
    return rows.groupBy(*by).agg(F.md5(joined).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


def fingerprint_ranges(rows: DataFrame, by: list[str], key: str = "key", digest: str = "hash") -> DataFrame:
    """A digest per group for groups of any size: rows are put into 65536 ranges by a hash of the
    key, each range has the digest of its sorted rows, the group that of its ranges' digests."""
    ranged = rows.withColumn("_range", F.substring(F.md5(F.col(key).cast("binary")), 1, 4))
    parts = fingerprint_md5(ranged, [*by, "_range"], key, digest)
    whole = fingerprint_md5(parts, by, "_range", "fingerprint").drop("n")
    return whole.join(parts.groupBy(*by).agg(F.sum("n").alias("n")), by)


@F.pandas_udf(T.LongType())
def tagged_id(tag_and_name: pd.Series) -> pd.Series:
    """Id of a file ('F\\0path') or module ('M\\0name') node: 64 bits of the hash, top bit set."""
    import xxhash

    def one(s: str) -> int:
        low = int.from_bytes(xxhash.xxh3_128_digest(s.encode())[8:], "big") | (1 << 63)
        return low - (1 << 64)

    return tag_and_name.map(one)


def file_node_id(path: str | Column) -> Column:
    return tagged_id(F.concat(F.lit("F\0"), F.col(path) if isinstance(path, str) else path))


def module_node_id(name: str | Column) -> Column:
    return tagged_id(F.concat(F.lit("M\0"), F.col(name) if isinstance(name, str) else name))


@F.pandas_udf(T.StringType())
def fnv1a_base36(text: pd.Series) -> pd.Series:
    """32-bit FNV-1a of UTF-16 code units in base 36 (fixed constants of the hash)."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"

    def one(s: str) -> str:
        h = 0x811C9DC5
        units = s.encode("utf-16-le")
        for i in range(0, len(units), 2):
            h = ((h ^ (units[i] | units[i + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
        out = ""
        while h:
            h, r = divmod(h, 36)
            out = digits[r] + out
        return out or "0"

    return text.map(one)
