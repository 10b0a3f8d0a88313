"""Key state from an operation log.

Two readings of expiry exist and differ by design.  ``replay`` is recovery: an
expiry is held against one instant for the whole log, in log order.  ``live``
is what clients saw: each operation meets the state as of its own time.
Visible means ``expires_at_us > now`` throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keytide import model
from keytide.functions import hashing


def known(ops: DataFrame) -> DataFrame:
    """Operations that count: unknown ones, those without a key or a place in
    the log, and expiries without an instant don't."""
    timed = (F.col("op") != "EXPIRE") | F.col("exp_us").isNotNull()
    return ops.filter(F.col("op").isin("SET", "DEL", "EXPIRE", "PERSIST") & timed & F.col("key").isNotNull() & F.col("seq").isNotNull())


def replay(ops: DataFrame, as_of: int) -> DataFrame:
    """Recovery of (seq, op, key, value, exp_us): two last-value aggregates.

    A key exists if the last of its writes, deletes and expiries already past
    is a write.  Its expiry is that of its last delete, expiry or persist, if
    that is a coming expiry.  A write doesn't clear an expiry.  Unknown
    operations, null keys and expiries without an instant count for nothing; an
    empty log has no keys.

    Values are strings, so a task sorts its part of the log by key and combines
    it to one row a key, which is all that moves.  Taking the last places as
    numbers first would spare that sort, but the values of all writes would have
    to move to be joined to them.
    """
    past = (F.col("op") == "EXPIRE") & (F.col("exp_us") <= as_of)
    event = F.struct("seq", "op", "value")
    lease = F.struct("seq", "op", "exp_us")
    last = known(ops).groupBy("key").agg(
        F.max(F.when(F.col("op").isin("SET", "DEL") | past, event)).alias("e"),
        F.max(F.when(F.col("op") != "SET", lease)).alias("t"),
        F.max("seq").alias("last_seq"),
    )
    live_lease = (F.col("t.op") == "EXPIRE") & (F.col("t.exp_us") > as_of)
    return last.filter("e.op = 'SET'").select("key", F.col("e.value").alias("value"), F.when(live_lease, F.col("t.exp_us")).alias("expires_at_us"), "last_seq")


def live(ops: DataFrame, as_of: int) -> DataFrame:
    """Time-ordered state of (seq, ts_us, op, key, value, exp_us).

    Held expiries that are due are carried out before each operation and once
    more at ``as_of``.  What doesn't count in ``replay`` doesn't here.

    Whether an expiry counts depends on whether the key is there, which depends
    on the expiries that counted before: a chain in order of the log that no
    aggregate or window has.  So rows stream through tasks sorted by key and
    seq, and a task holds one key's state; one key's operations are one task.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = value = exp = seq = None
        exists = started = False
        out: list[tuple] = []

        def emit():
            if started and exists and (exp is None or exp > as_of):
                out.append((key, value, exp, seq))

        for frame in frames:
            for k, s, ts, op, v, e in zip(*(frame[c].tolist() for c in ("key", "seq", "ts_us", "op", "value", "exp_us"))):
                if not started or k != key:
                    emit()
                    key, value, exp, exists, started = k, None, None, False, True
                if exp is not None and exp <= ts:
                    value, exp, exists = None, None, False
                if op == "SET":
                    value, exists = v, True
                elif op == "DEL":
                    value, exp, exists = None, None, False
                elif op == "EXPIRE" and exists:
                    exp = int(e)
                elif op == "PERSIST":
                    exp = None
                seq = s
            if len(out) >= 10_000:
                yield _kv_frame(out)
                out = []
        emit()
        yield _kv_frame(out)

    rows = known(ops).select("key", "seq", "ts_us", "op", "value", "exp_us")
    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(fold, model.KV)


def _kv_frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "value", "expires_at_us", "last_seq"])
    out["expires_at_us"] = out["expires_at_us"].astype("Int64")
    out["last_seq"] = out["last_seq"].astype("Int64")
    return out


def visible(kv: DataFrame, now: int) -> DataFrame:
    return kv.filter(F.col("expires_at_us").isNull() | (F.col("expires_at_us") > now))


def get(kv: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """(key, value): null for keys that aren't there or are due."""
    return keys.select("key").join(visible(kv, now).select("key", "value"), "key", "left")


def exists(kv: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """Those of ``keys`` that are visible."""
    return keys.select("key").join(visible(kv, now).select("key"), "key", "left_semi")


def ttl(kv: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """(key, ttl): -2 absent, -1 without expiry, else whole seconds left, 0
    when due."""
    left = F.floor(F.greatest(F.col("expires_at_us") - now, F.lit(0)) / 1_000_000).cast("bigint")
    held = kv.select("key", F.when(F.col("expires_at_us").isNull(), F.lit(-1)).otherwise(left).cast("bigint").alias("ttl"))
    return keys.select("key").join(held, "key", "left").select("key", F.coalesce("ttl", F.lit(-2)).cast("bigint").alias("ttl"))


def dbsize(kv: DataFrame, now: int) -> DataFrame:
    """One row: entries held, due ones among them included, and visible ones."""
    seen = F.col("expires_at_us").isNull() | (F.col("expires_at_us") > now)
    return kv.agg(F.count("*").alias("physical"), F.count(F.when(seen, 1)).alias("logical"), F.count("expires_at_us").alias("with_ttl"))


def due(kv: DataFrame, now: int, limit: int = 100) -> DataFrame:
    """The first ``limit`` entries to be evicted, by expiry and key."""
    return kv.filter(F.col("expires_at_us") <= now).orderBy("expires_at_us", "key").limit(limit)


def evict(kv: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(what stays, events): all due entries go at once, each with an event
    (event, key, ts_us) at its instant."""
    gone = kv.filter(F.col("expires_at_us") <= now)
    return visible(kv, now), gone.select(F.lit("EXPIRE").alias("event"), "key", F.col("expires_at_us").alias("ts_us"))


def since_flush(ops: DataFrame) -> DataFrame:
    """The log after its last FLUSH; the position of that is one number."""
    last = ops.filter("op = 'FLUSH'").agg(F.max("seq")).first()[0]
    return ops if last is None else ops.filter(F.col("seq") > last)


def keys_in_slot(kv: DataFrame, slot: int, count: int) -> DataFrame:
    """Up to ``count`` keys of a slot, the least first."""
    return kv.filter(hashing.slot(F.col("key")) == slot).select("key").orderBy("key").limit(count)


def shard_sizes(kv: DataFrame) -> DataFrame:
    return kv.groupBy(hashing.shard64(F.col("key")).alias("shard")).agg(F.count("*").alias("n"))


def compact(ops: DataFrame, cut: int, as_of: int, drop_ttl: bool = False) -> DataFrame:
    """A log that replays to the same state: one write per key as of ``cut``,
    then the operations after it.

    Keys that expire keep their expiry as an operation of its own, unless
    ``drop_ttl`` asks for the lossy form that forgets expiries.
    """
    state = replay(ops.filter(F.col("seq") <= cut), as_of)
    rank = F.col("last_seq")
    sets = state.select(rank.alias("seq"), F.lit(0).alias("sub"), F.lit("SET").alias("op"), "key", "value", F.lit(None).cast("bigint").alias("exp_us"))
    out = sets
    if not drop_ttl:
        out = out.unionByName(state.filter("expires_at_us is not null").select(rank.alias("seq"), F.lit(1).alias("sub"), F.lit("EXPIRE").alias("op"), "key", F.lit(None).cast("string").alias("value"), F.col("expires_at_us").alias("exp_us")))
    tail = ops.filter(F.col("seq") > cut).select("seq", F.lit(0).alias("sub"), "op", "key", "value", "exp_us")
    return out.unionByName(tail)


def replay_compacted(log: DataFrame, as_of: int) -> DataFrame:
    """``replay`` of a log with (seq, sub) order."""
    order = F.struct("seq", "sub")
    renamed = log.withColumn("seq", order)
    return replay(renamed, as_of).withColumn("last_seq", F.col("last_seq.seq"))


def at_operation(ops: DataFrame, reads: DataFrame) -> DataFrame:
    """What each read (seq, key) finds in the log just after operation ``seq``:
    (seq, key, value), the last write before or at it unless deleted since.

    An as-of join without a join: log and reads go through one window per key.
    """
    log = ops.filter(F.col("op").isin("SET", "DEL")).select("key", "seq", F.lit(0).alias("kind"), F.struct("op", "value").alias("w"))
    asked = reads.select("key", "seq", F.lit(1).alias("kind"), F.lit(None).cast(log.schema["w"].dataType).alias("w"))
    w = Window.partitionBy("key").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = log.unionByName(asked).withColumn("last", F.last("w", ignorenulls=True).over(w))
    return seen.filter("kind = 1").select("seq", "key", F.when(F.col("last.op") == "SET", F.col("last.value")).alias("value"))
