"""Places of rows within their group, without a task for a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.shared import stored

#: monotonically_increasing_id holds the partition above so many bits, the row's place in it below.
PLACE_BITS = 33


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str = "place", size: str | None = None) -> DataFrame:
    """rows with each one's place in its group (long, from 0, gapless), in the order of the columns `order`, nulls first, and
    with the group's number of rows under the name `size`, if given.

    rows must be the same when read again (see `shared.stored`). Columns of `by` may be null. Rows that are equal in `by` and
    `order` stand next to one another in any order; they are dealt over ranges like others, by the place where they were read.
    The rows are sorted by range and written once. A place is the row's place in its range less the place of its group's first
    row there, plus the group's rows in the ranges before, which are counts by range and group. An empty table gives no row.
    """
    tie, at = "_tie", "_at"
    keys = [*by, *order, tie]
    spread = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(spread.drop(tie).withColumn(at, F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright(at, PLACE_BITS))
    counts = placed.groupBy("_part", *by).agg(F.min(at).alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = [] if size is None else [F.sum("_n").over(Window.partitionBy(*by)).alias(size)]
    firsts = counts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], (before - F.col("_first")).alias("_shift"), *total)
    same = F.col("_part") == F.col("_p")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{k}"))
    told = placed.join(firsts, same).withColumn(name, F.col(at) + F.col("_shift"))
    return told.select(*rows.columns, name, *([] if size is None else [size]))
