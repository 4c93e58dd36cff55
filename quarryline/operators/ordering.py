"""Numbers of rows in a global order, without a task that holds them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.rounds import table_between_rounds

#: Bits of monotonically_increasing_id() below the partition's number (fixed value).
PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[Column | str], by: list[str] | None = None, name: str = "number") -> DataFrame:
    """rows and a long column `name`: 0, 1, 2, … within each value of the columns `by`, in the order given.

    The rows are sorted by range and written once, each with its partition and its place there.
    What stands before a partition is counted from that table and joined to it, so all numbers
    come from one run of the sort. Ties of the order are numbered as they were written. Ranges
    part any key whose rows differ in `order`; a tie-breaker there keeps equal rows apart too.
    The counts, a row per partition and value of `by` in it, are broadcast: `by` must have a
    bounded number of values.
    """
    by = by or []
    place = _free(rows, "_place")
    keys = [F.col(b) for b in by] + list(order)
    table = table_between_rounds(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(place, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(place), PLACE_BITS)
    marks = [f"{place}{i}" for i in range(len(by))]
    sizes = table.groupBy(part.alias(f"{place}part"), *[F.col(b).alias(m) for b, m in zip(by, marks, strict=True)]).agg(F.count(F.lit(1)).alias(f"{place}n"), F.min(place).alias(f"{place}first"))
    earlier = Window.partitionBy(*marks).orderBy(f"{place}part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn(f"{place}before", F.coalesce(F.sum(f"{place}n").over(earlier), F.lit(0))).drop(f"{place}n")
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(m)) for b, m in zip(by, marks, strict=True)], part == F.col(f"{place}part"))
    return table.join(F.broadcast(starts), same).select(*rows.columns, (F.col(place) - F.col(f"{place}first") + F.col(f"{place}before")).alias(name))


def _free(rows: DataFrame, name: str) -> str:
    while any(c.lower().startswith(name) for c in rows.columns):
        name = "_" + name
    return name
