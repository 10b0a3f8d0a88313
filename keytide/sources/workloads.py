"""Generated client loads, spread by number over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the standard load: one write in five, values of 100 bytes.
WRITE_EVERY = 5
VALUE_BYTES = 100
STRIDE = 7919  # a prime, so that keys are visited in scattered order


def mixed(spark: SparkSession, n: int, keys: int, connections: int = 50) -> DataFrame:
    """n commands (conn, seq, ts_us, cmd, args): 80 % GET, 20 % SET."""
    key = F.concat(F.lit("key:"), F.col("id") * STRIDE % keys)
    write = F.col("id") % WRITE_EVERY == 0
    return spark.range(n).select(
        (F.col("id") % connections).alias("conn"), F.col("id").alias("seq"), (F.col("id") * 10).alias("ts_us"), F.when(write, "SET").otherwise("GET").alias("cmd"),
        F.when(write, F.array(key, F.lit("x" * VALUE_BYTES))).otherwise(F.array(key)).alias("args"),
    )


def expiring(spark: SparkSession, n: int, seconds: int = 60, connections: int = 50) -> DataFrame:
    """n writes with an expiry each, then n commands that renew it."""
    key = F.concat(F.lit("ttl_key:"), F.col("id") % n)
    first = F.col("id") < n
    return spark.range(2 * n).select(
        (F.col("id") % connections).alias("conn"), F.col("id").alias("seq"), (F.col("id") * 10).alias("ts_us"), F.when(first, "SET").otherwise("EXPIRE").alias("cmd"),
        F.when(first, F.array(key, F.lit("x" * VALUE_BYTES), F.lit("EX"), F.lit(str(seconds)))).otherwise(F.array(key, F.lit(str(2 * seconds)))).alias("args"),
    )


def published(spark: SparkSession, messages: int, subscribers: int = 10, channel: str = "bench:pubsub") -> tuple[DataFrame, DataFrame]:
    """(subscription log, messages): all subscribe, then messages follow."""
    log = spark.range(subscribers).select(F.col("id").alias("seq"), F.col("id").alias("conn"), F.lit("SUBSCRIBE").alias("op"), F.lit(channel).alias("channel"))
    sent = spark.range(messages).select((F.col("id") + subscribers).alias("seq"), F.lit(channel).alias("channel"), F.concat(F.lit("msg_"), "id").alias("payload"))
    return log, sent
