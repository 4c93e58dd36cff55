"""Mixing sources to target weights by Poisson replication.

A document's number of copies is the inverse of a Poisson distribution, whose mean is its
source's target repetition rate, at a uniform number hashed from seed, id and text. So the
count needs no state, no order and no neighbour: every row decides for itself, and a rerun
decides alike. Only the totals per source are aggregated (map-side first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, text_or_empty

#: A Poisson of a larger mean is the sum of independent ones of at most this mean, which
#: keeps exp(-mean) far from underflow.
PIECE = 256.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... up to where double precision ends."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    zero = F.exp(-rate)
    start = F.struct(zero.alias("p"), zero.alias("c"), F.array(zero).alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["steps"], F.array(c)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["steps"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None, epochs: float) -> DataFrame:
    """source, rate, pieces, steps. Without weights every source gets the same weight."""
    totals = docs.groupBy("source").agg(F.sum(F.length(text_or_empty("text")).cast("long")).alias("chars"))
    if weights is None:
        weighted = totals.withColumn("weight", F.lit(1.0))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weighted = totals.withColumn("weight", F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)))
    # one row: the totals of all sources
    overall = weighted.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    known = F.col("all_chars") * F.col("weight") / F.nullif(F.col("all_weight"), F.lit(0.0)) / F.nullif(F.col("chars"), F.lit(0))
    # no weight: no copies; a weighted source without characters: as it is
    rate = F.when(F.col("weight") <= 0, F.lit(0.0)).when(F.col("chars") > 0, F.coalesce(known, F.lit(0.0))).otherwise(F.lit(1.0))
    rates = weighted.crossJoin(F.broadcast(overall)).select("source", (rate * F.lit(float(epochs))).alias("rate"))
    pieces = F.greatest(F.ceil(F.col("rate") / PIECE).cast("int"), F.lit(1))
    return rates.withColumn("pieces", pieces).withColumn("steps", poisson_steps(F.col("rate") / F.col("pieces")))


#: What mixing adds; columns of docs with these names are replaced.
ADDED = ("mix_rate", "mix_copies", "mix_copy", "mix_key")


def _counted(docs: DataFrame, weights: dict[str, float] | None, epochs: float, seed: int) -> DataFrame:
    """row (all columns of docs), id and content (what the hashes are made of), rate, copies."""
    rates = materialize(source_rates(docs, weights, epochs), "rates").withColumnRenamed("source", "rate_source")
    content = F.md5(text_or_empty("text"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED]).alias("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), content.alias("content"), F.col("source").alias("own_source"))
    key = [F.lit(str(seed)), F.col("id"), F.col("content")]
    # one row per source; the optimizer broadcasts it if its measured size allows
    joined = packed.join(rates, F.col("own_source").eqNullSafe(F.col("rate_source")), "left").withColumn("u", uniform(*key, F.lit("0")))
    first = F.size(F.filter("steps", lambda c: c <= F.col("u")))
    more = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.col("pieces") - 1, F.lit(1))), F.lit(0),
        lambda n, i: n + F.size(F.filter("steps", lambda c: c <= uniform(*key, i.cast("string")))),
    )
    count = F.when(F.col("pieces") > 1, first + more).otherwise(first)
    return joined.select("row", "id", "content", "rate", count.cast("long").alias("copies"))


def copy_counts(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 7) -> DataFrame:
    """docs with the columns mix_rate and mix_copies.

    A null text counts as empty, a null source is a source of its own; in a source that has
    only empty texts the rate is `epochs`. With weights, a source that isn't named gets no
    copies, whatever its texts. Rows that repeat id and text get equal counts.
    """
    return _counted(docs, weights, epochs, seed).select("row.*", F.col("rate").alias("mix_rate"), F.col("copies").alias("mix_copies"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 7) -> DataFrame:
    """Every document as often as its count says, in a random order over all files.

    Adds mix_rate, mix_copies, mix_copy (from 0) and mix_key, a hash by which the rows are
    range-partitioned and sorted; copies of a document get keys of their own.
    """
    copies = _counted(docs, weights, epochs, seed).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.col("id"), F.col("content"), F.col("copy").cast("string")))
    placed = copies.select("row.*", F.col("rate").alias("mix_rate"), F.col("copies").alias("mix_copies"), F.col("copy").alias("mix_copy"), key.alias("mix_key"))
    return placed.sort("mix_key")
