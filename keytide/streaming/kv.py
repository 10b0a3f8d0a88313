"""Key state kept up to date from a stream of operations."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from keytide.operators import state
from keytide.sources import wal


def read_log(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet log files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def write_log(ops: DataFrame, path: str, files: int = 4) -> None:
    """The log as a new folder of ``files`` Parquet files for ``read_log``, by
    ranges of seq.

    A stream takes files in order of their modification times, and tasks end in
    any order: so the files get times of their own, a second apart, in the log's
    order.  The folder is a path that all nodes mount.
    """
    folder = wal.local_path(path)
    ops.repartitionByRange(files, "seq").write.parquet(path)
    made = sorted((f for f in os.listdir(folder) if f.startswith("part-")), key=lambda f: (int(f.split("-")[1]), f))
    now = int(time.time())
    for i, f in enumerate(made, 1 - len(made)):
        os.utime(os.path.join(folder, f), (now + i, now + i))


def last_writes(ops: DataFrame) -> DataFrame:
    """(key, op, value, seq): each key's last write or delete, as a streaming
    aggregation whose state is one row a key."""
    return ops.filter(F.col("op").isin("SET", "DEL")).groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("e")).select("key", "e.op", "e.value", "e.seq")


#: State processors need a store with several tables a key.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_to_files(stream: DataFrame, checkpoint: str, mode: str = "update", provider: str = ROCKSDB) -> DataFrame:
    """Run all data there is through a query, each batch's rows to Parquet files
    beside the checkpoint, and return what all batches wrote, with ``batch``.

    A batch that runs again replaces its own files.  The state store's kind is
    set for this query only.
    """
    spark, out = stream.sparkSession, f"{checkpoint.rstrip('/')}-rows"

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, provider)
    try:
        stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    made = spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).option("basePath", out).parquet(f"{out}/batch=*")
    except AnalysisException:  # no batch had run
        return made


def current(rows: DataFrame) -> DataFrame:
    """``last_writes`` as of the last batch, from the changes that batches wrote."""
    return rows.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("e")).select("key", "e.op", "e.value", "e.seq")


def replica(ops: DataFrame, cut: int, checkpoint: str, copy: DataFrame) -> DataFrame:
    """A replica from a copy at ``cut`` and the stream of what followed."""
    from keytide.operators import replication

    delta = current(run_to_files(last_writes(ops.filter(F.col("seq") > cut)), checkpoint))
    return replication.apply(copy, delta.select("seq", "op", "key", "value"))


class KeyState(StatefulProcessor):
    """One key's value and absolute expiry, in order of seq inside a batch.

    Every operation gives a row (key, seq, op, value, expires_at_us, exists)
    of the state after it.  An expiry that is due by an operation's own time
    is carried out first.  State of deleted keys is cleared.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "value string, expires_at_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        value, exp, exists = None, None, False
        if self.held.exists():
            value, exp = self.held.get()
            exists = True
        out = []
        batch = pd.concat(list(rows)).sort_values("seq")  # the group's rows of one trigger
        for seq, ts, op, v, e in zip(*(batch[c].tolist() for c in ("seq", "ts_us", "op", "value", "exp_us"))):
            if exists and exp is not None and exp <= ts:
                value, exp, exists = None, None, False
            if op == "SET":
                value, exists = v, True
            elif op == "DEL":
                value, exp, exists = None, None, False
            elif op == "EXPIRE" and exists:
                exp = int(e)
            elif op == "PERSIST":
                exp = None
            out.append((key[0], seq, op, value, exp, exists))
        if exists:
            self.held.update((value, exp))
        else:
            self.held.clear()
        frame = pd.DataFrame(out, columns=["key", "seq", "op", "value", "expires_at_us", "exists"])
        frame["expires_at_us"] = frame["expires_at_us"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


STATE = "key string, seq bigint, op string, value string, expires_at_us bigint, exists boolean"


def live_states(ops: DataFrame) -> DataFrame:
    """The state after every operation of a stream (RocksDB state store).
    Operations that don't count in a replay give no row."""
    return state.known(ops).groupBy("key").transformWithStateInPandas(KeyState(), outputStructType=STATE, outputMode="Append", timeMode="None")
