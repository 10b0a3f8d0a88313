"""Schemas of the engine's tables, and how they are read from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPS = "seq bigint, conn bigint, ts_us bigint, op string, key string, value string, exp_us bigint"
KV = "key string, value string, expires_at_us bigint, last_seq bigint"
CMDS = "conn bigint, seq bigint, ts_us bigint, cmd string, args array<string>"
NODES = "id string, addr string, state string, role string, master_id string, last_pong_us bigint, slots array<struct<start:int,end:int>>"
TRIGGERS = "id string, ord int, event string, pattern string, module string, func string"

#: The instant of a timestamp without zone, in microseconds.
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ops_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as an operation log: view and purchase write, click
    sets an expiry, error deletes, signup makes a key permanent."""
    op = F.when(F.col("event_type").isin("view", "purchase"), "SET").when(F.col("event_type") == "click", "EXPIRE").when(F.col("event_type") == "error", "DEL").otherwise("PERSIST")
    ts = F.expr(MICROS.format("ts"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 16).alias("conn"), ts.alias("ts_us"), op.alias("op"), F.concat(F.lit("user:"), F.col("user_id")).alias("key"), F.col("props").alias("value"),
        (ts + F.round(F.col("value") * 3600).cast("bigint") * 1_000_000).alias("exp_us"),
    )


def last_instant(ops: DataFrame) -> int:
    """The latest operation's time: one number."""
    return ops.agg(F.max("ts_us")).first()[0] or 0
