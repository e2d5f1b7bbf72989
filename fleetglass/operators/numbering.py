"""Row numbers over a whole table without sending it through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import fresh, written

_PLACES = 33  # bits that a monotonically increasing id leaves for the row's place in its partition


def numbered(df: DataFrame, *order: str, name: str = "row_no") -> DataFrame:
    """Adds the row's place from 1 in the given order: places inside range partitions, plus one total for each of these.

    The sorted table is written once, as a second evaluation might cut the ranges elsewhere. Totals are one row for each
    range partition. Rows that are equal in the order are numbered in any order.
    """
    place, part, n, before = fresh(df, "_place", "_part", "_n", "_before")
    table = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()), "numbered")
    table = table.withColumn(part, F.shiftright(place, _PLACES))
    totals = table.groupBy(part).agg(F.count("*").alias(n))
    sums = totals.select(part, (F.sum(n).over(Window.orderBy(part)) - F.col(n)).alias(before))
    row = F.col(before) + F.col(place).bitwiseAND((1 << _PLACES) - 1) + 1
    return table.join(F.broadcast(sums), part).select(*[F.col(f"`{c}`") for c in df.columns], row.alias(name))
