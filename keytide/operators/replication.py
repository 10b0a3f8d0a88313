"""Replicas: a full copy at a known point, then what was written after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def full_sync(ops: DataFrame, cut: int) -> DataFrame:
    """(key, value) as of operation ``cut``: last writes, without expiries."""
    last = ops.filter((F.col("seq") <= cut) & F.col("op").isin("SET", "DEL")).groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("e"))
    return last.filter("e.op = 'SET'").select("key", "e.value")


def forwarded(ops: DataFrame, cut: int) -> DataFrame:
    """(seq, op, key, value) sent after the copy: writes and deletes only."""
    return ops.filter((F.col("seq") > cut) & F.col("op").isin("SET", "DEL")).select("seq", "op", "key", "value")


def apply(copy: DataFrame, delta: DataFrame) -> DataFrame:
    """(key, value) of a replica: the copy and what followed."""
    base = copy.select(F.lit(-1).cast("bigint").alias("seq"), F.lit("SET").alias("op"), "key", "value")
    last = base.unionByName(delta).groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("e"))
    return last.filter("e.op = 'SET'").select("key", "e.value")


def lines(copy: DataFrame) -> DataFrame:
    """The copy as text lines ``SET key value`` (column ``value``)."""
    return copy.select(F.concat_ws(" ", F.lit("SET"), "key", "value").alias("value"))


def parse_lines(text: DataFrame) -> DataFrame:
    """(op, key, value) of such lines: at most three parts, so a key with a
    space loses its rest to the value."""
    parts = F.split("value", " ", 3)
    return text.filter("value <> ''").select(F.upper(parts[0]).alias("op"), F.try_element_at(parts, F.lit(2)).alias("key"), F.try_element_at(parts, F.lit(3)).alias("value"))


def session(ops: DataFrame, cut: int) -> DataFrame:
    """What a replica is sent, (ord, value): the full copy between its two
    markers, then each later write and delete as a line."""
    copy = lines(full_sync(ops, cut)).select(F.lit(1).cast("bigint").alias("ord"), "value")
    marks = copy.sparkSession.createDataFrame([(0, "+FULLSYNC"), (2, "+FULLSYNC_DONE")], "ord bigint, value string")
    later = forwarded(ops, cut).select((F.col("seq") + 3).alias("ord"), F.concat_ws(" ", "op", "key", F.when(F.col("op") == "SET", F.col("value"))).alias("value"))
    return marks.unionByName(copy).unionByName(later)
