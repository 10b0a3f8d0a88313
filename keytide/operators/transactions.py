"""Transactions per connection: MULTI, EXEC, DISCARD."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MARKERS = ("MULTI", "EXEC", "DISCARD")


def resolve(cmds: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(conn, seq, cmd, tx, status, outcome, exec_seq, position) of commands
    (conn, seq, cmd), with their columns ``carry``.

    status is what the command itself is told; outcome is EXEC, DISCARD or
    LOST (the connection ended) for queued commands, RUN for those outside a
    transaction and null for markers.  Queued commands aren't checked.
    Executed ones take effect in order of (exec_seq, position).
    """
    before = Window.partitionBy("conn").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("conn").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    marker = F.when(F.col("cmd").isin(*MARKERS), F.col("cmd"))
    rows = cmds.select("conn", "seq", F.upper("cmd").alias("cmd"), *carry).withColumn("inside", F.coalesce(F.last(marker, ignorenulls=True).over(before) == "MULTI", F.lit(False)))
    rows = rows.withColumn("tx_no", F.sum(((F.col("cmd") == "MULTI") & ~F.col("inside")).cast("bigint")).over(upto))
    per = Window.partitionBy("conn", "tx_no")
    ends = F.col("cmd").isin("EXEC", "DISCARD") & F.col("inside")
    queued = F.col("inside") & ~F.col("cmd").isin(*MARKERS)
    rows = rows.withColumn("end", F.max(F.when(ends, F.struct("seq", "cmd"))).over(per))
    position = F.sum(queued.cast("bigint")).over(per.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    status = (
        F.when((F.col("cmd") == "MULTI") & F.col("inside"), "-ERR MULTI calls can not be nested")
        .when(F.col("cmd") == "MULTI", "+OK")
        .when((F.col("cmd") == "EXEC") & ~F.col("inside"), "-ERR EXEC without MULTI")
        .when((F.col("cmd") == "DISCARD") & ~F.col("inside"), "-ERR DISCARD without MULTI")
        .when(F.col("cmd") == "DISCARD", "+OK")
        .when(F.col("cmd") == "EXEC", "*")
        .when(queued, "+QUEUED")
    )
    outcome = F.when(queued, F.coalesce("end.cmd", F.lit("LOST"))).when(~F.col("cmd").isin(*MARKERS), "RUN")
    done = (outcome == "RUN") | (outcome == "EXEC")
    return rows.withColumn("position", position).select(
        "conn", "seq", "cmd", F.when(F.col("inside") | (F.col("cmd") == "MULTI"), F.col("tx_no")).alias("tx"), status.alias("status"), outcome.alias("outcome"),
        F.when(done, F.when(queued, F.col("end.seq")).otherwise(F.col("seq"))).alias("exec_seq"), F.when(done, F.when(queued, F.col("position")).otherwise(F.lit(0))).cast("bigint").alias("position"), *carry,
    )


def effective(cmds: DataFrame) -> DataFrame:
    """The commands that take effect, with the order in which they do."""
    return resolve(cmds).filter(F.col("outcome").isin("RUN", "EXEC")).select("conn", "seq", "cmd", "exec_seq", "position")


def exec_replies(resolved: DataFrame, replies: DataFrame) -> DataFrame:
    """(conn, exec_seq, replies array<string>): what each EXEC returns, one
    reply a queued command in its order; errors stay in their places."""
    ran = resolved.filter("outcome = 'EXEC'").join(replies, ["conn", "seq"], "left")
    pairs = F.array_sort(F.collect_list(F.struct("position", "reply")))
    return ran.groupBy("conn", "exec_seq").agg(F.transform(pairs, lambda p: p["reply"]).alias("replies"))


def module_effects(calls: DataFrame) -> DataFrame:
    """Effects of function calls that survive: (call_id, n, kind, key, value).

    Writes between a begin and its commit count only with the commit; deletes
    and messages count at once, inside a transaction or not.
    """
    before = Window.partitionBy("call_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("call_id").orderBy("n").rowsBetween(0, Window.unboundedFollowing)
    marker = F.when(F.col("kind").isin("tx_begin", "tx_commit"), F.col("kind"))
    rows = calls.withColumn("open", F.coalesce(F.last(marker, ignorenulls=True).over(before) == "tx_begin", F.lit(False)))
    rows = rows.withColumn("next", F.first(marker, ignorenulls=True).over(after))
    keep = F.col("kind").isin("kv_del", "publish") | ((F.col("kind") == "kv_set") & (~F.col("open") | (F.col("next") == "tx_commit")))
    return rows.filter(keep).drop("open", "next")
