"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_keytide_work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df``, computed once: written as Parquet and read back.

    The folder is ``spark.checkpoint.dir``, or where that is unset, as in tests,
    one in the warehouse.  The files stay until it is cleaned.
    """
    spark = df.sparkSession
    path = _folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_rows(spark: SparkSession, rows: Iterator[tuple], schema: str, name: str = "rows", size: int = 50_000) -> DataFrame:
    """Rows that the driver makes one after another, written ``size`` at a time."""
    path, batch = _folder(spark, name), None
    while batch is None or len(batch) == size:
        batch = list(islice(rows, size))
        spark.createDataFrame(batch, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
