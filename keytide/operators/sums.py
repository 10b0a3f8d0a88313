"""Running sums along a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, value: str, by: list[str], bucket: int = 1 << 16, then: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``running``: the sum of ``value`` up to each seq, rows of
    one seq in order of ``then``.

    Done in two levels, so that one group of any size is spread over tasks:
    totals per range of seq are summed first, then rows inside each range.
    """
    cut = rows.withColumn("_b", F.floor(F.col("seq") / bucket))
    totals = cut.groupBy(*by, "_b").agg(F.sum(value).alias("_t"))
    before = totals.select(*by, "_b", (F.sum("_t").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_t")).alias("_before"))
    inside = Window.partitionBy(*by, "_b").orderBy("seq", *then).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumn("_in", F.sum(value).over(inside)).join(before, [*by, "_b"])
    return out.withColumn("running", F.col("_before") + F.col("_in")).drop("_b", "_in", "_before")
