"""Latency and throughput statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERCENTS = (50, 95, 99)


#: Ranges of value that a group is cut into.
RANGES = 1024


def index_percentiles(rows: DataFrame, value: str, by: list[str], percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """``sorted[n * p // 100]`` (from 0) per group: one row, n, p50, p95, p99.

    Values are numbers; null ones are left out.  Equal values are counted first.
    Running counts are taken in two levels, over RANGES ranges of value in each
    group and then inside each range, so few groups are still many tasks.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    inner = [f"_by{i}" for i in range(len(by))]
    names = [F.col(c).alias(i) for c, i in zip(by, inner)]
    same = [F.col(c).eqNullSafe(F.col(i)) for c, i in zip(by, inner)] or F.lit(True)
    ends = counts.groupBy(*by).agg(F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high"), F.sum("k").alias("n"))
    share = F.when(F.col("_high") > F.col("_low"), (F.col(value).cast("double") - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    cut = counts.join(ends.select(*names, "_low", "_high", "n"), same).select(*by, value, "k", "n", F.floor(share * (RANGES - 1)).alias("_b"))
    totals = cut.groupBy(*by, "_b").agg(F.sum("k").alias("_t"))
    before = totals.select(*names, F.col("_b").alias("_at"), (F.sum("_t").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_t")).alias("_before"))
    upto = F.col("_before") + F.sum("k").over(Window.partitionBy(*by, "_b").orderBy(value))
    run = cut.join(before, [*(same if by else []), F.col("_b") == F.col("_at")]).select(*by, value, "n", upto.alias("upto"))
    picks = [F.min(F.when(F.col("upto") > F.expr(f"n * {p} div 100"), F.col(value))).alias(f"p{p}") for p in percents]
    return run.groupBy(*by).agg(F.max("n").alias("n"), *picks)


def throughput(rows: DataFrame, ts_us: str, by: list[str]) -> DataFrame:
    """Count, elapsed microseconds and operations a second per group; null
    where no time passes."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), (F.max(ts_us) - F.min(ts_us)).alias("elapsed_us"))
    return out.withColumn("per_second", F.when(F.col("elapsed_us") > 0, F.col("n") * F.lit(1e6) / F.col("elapsed_us")))


def delivery_rate(delivered: DataFrame, subscribers: int) -> DataFrame:
    """Published, expected and delivered messages, and the rate in percent,
    from one ``delivered`` count per message."""
    out = delivered.agg(F.count("*").alias("published"), F.coalesce(F.sum("delivered"), F.lit(0)).alias("received"))
    out = out.withColumn("expected", F.col("published") * subscribers)
    return out.withColumn("rate", F.when(F.col("expected") > 0, F.col("received") * 100.0 / F.col("expected")))
