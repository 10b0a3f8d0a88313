"""Publish and subscribe over a log: live intervals, fan-out, backpressure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keytide.operators.sums import running_sum
from keytide.sources.written import written

BUFFER = 256


def changes(log: DataFrame) -> DataFrame:
    """(conn, channel, seq, delta): when a connection's membership of a channel
    changes.  ``log`` has (seq, conn, op, channel) with SUBSCRIBE, UNSUBSCRIBE
    and CLOSE; a null channel unsubscribes from all.  Repeats change nothing.
    """
    joins = log.filter("op = 'SUBSCRIBE'").select("conn", "channel", "seq", F.lit(1).alias("on"))
    leaves = log.filter("op = 'UNSUBSCRIBE' and channel is not null").select("conn", "channel", "seq", F.lit(0).alias("on"))
    ends = log.filter("op = 'CLOSE' or (op = 'UNSUBSCRIBE' and channel is null)").select("conn", "seq")
    every = ends.join(joins.select("conn", "channel").distinct(), "conn").select("conn", "channel", "seq", F.lit(0).alias("on"))
    w = Window.partitionBy("conn", "channel").orderBy("seq")
    rows = joins.unionByName(leaves).unionByName(every).withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(0)))
    return rows.filter("on <> was").select("conn", "channel", "seq", (F.col("on") * 2 - 1).alias("delta"))


def intervals(log: DataFrame) -> DataFrame:
    """(conn, channel, from_seq, to_seq); to_seq is null while it lasts."""
    w = Window.partitionBy("conn", "channel").orderBy("seq")
    return changes(log).withColumn("to_seq", F.lead("seq").over(w)).filter("delta = 1").select("conn", "channel", F.col("seq").alias("from_seq"), "to_seq")


def delivered(log: DataFrame, messages: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """(seq, channel, delivered) for messages (seq, channel): how many
    connections hear each.

    A running sum of membership changes, over ranges of ``bucket`` places, gives
    the count; subscribers and messages of a channel never meet in a join.
    """
    both = changes(log).select("channel", "seq", "delta", F.lit(False).alias("m")).unionByName(messages.select("channel", "seq", F.lit(0).alias("delta"), F.lit(True).alias("m")))
    return running_sum(both, "delta", ["channel"], bucket, ("delta",)).filter("m").select("seq", "channel", F.col("running").alias("delivered"))


def deliveries(log: DataFrame, messages: DataFrame) -> DataFrame:
    """(seq, channel, conn), a row for every message and connection that hears
    it: an equi-join on the channel with the interval as its condition."""
    live = intervals(log).select("channel", "conn", "from_seq", "to_seq")
    heard = messages.select("channel", "seq").join(live, "channel")
    return heard.filter((F.col("seq") > F.col("from_seq")) & (F.col("to_seq").isNull() | (F.col("seq") < F.col("to_seq")))).select("seq", "channel", "conn")


def heard_intervals(log: DataFrame, messages: DataFrame) -> DataFrame:
    """(conn, channel, from_seq, to_seq, first, heard): of each interval that
    hears a message, the place of its first one among the channel's messages,
    from 0, and how many it hears.

    A channel's messages are counted up to each membership change; subscribers
    and messages never meet in a join.  At one seq leaving comes first, then the
    message, then joining: neither end of an interval hears what is at its own seq.
    """
    moved = changes(log).select("channel", "conn", "seq", "delta", F.lit(0).alias("m"))
    sent = messages.select("channel", F.lit(None).cast(moved.schema["conn"].dataType).alias("conn"), "seq", F.lit(0).alias("delta"), F.lit(1).alias("m"))
    counted = running_sum(moved.unionByName(sent), "m", ["channel"], then=("delta",)).filter("m = 0")
    w = Window.partitionBy("conn", "channel").orderBy("seq")
    ends = counted.withColumn("to_seq", F.lead("seq").over(w)).withColumn("upto", F.lead("running").over(w)).filter("delta = 1")
    ends = ends.join(messages.groupBy("channel").agg(F.count("*").alias("sent")), "channel")
    heard = F.when(F.col("to_seq").isNull(), F.col("sent")).otherwise(F.col("upto")) - F.col("running")
    return ends.select("conn", "channel", F.col("seq").alias("from_seq"), "to_seq", F.col("running").alias("first"), heard.alias("heard")).filter("heard > 0")


def fanout(log: DataFrame, messages: DataFrame) -> DataFrame:
    """(channel, n, first_seq, conns) of channels that are heard: deliveries, the
    first message delivered, and how many connections hear any.  As
    ``deliveries`` grouped by channel, from counts alone."""
    heard = heard_intervals(log, messages).groupBy("channel").agg(F.sum("heard").alias("n"), F.countDistinct("conn").alias("conns"))
    first = delivered(log, messages).filter("delivered > 0").groupBy("channel").agg(F.min("seq").alias("first_seq"))
    return heard.join(first, "channel").select("channel", "n", "first_seq", "conns")


def confirmations(log: DataFrame) -> DataFrame:
    """(seq, conn, channel, channels): each SUBSCRIBE's confirmation, with the
    number of channels its connection then has."""
    asked = log.filter("op = 'SUBSCRIBE'").select("conn", "channel", "seq", F.lit(0).alias("delta"), F.lit(1).alias("q"))
    moved = changes(log).select("conn", "channel", "seq", "delta", F.lit(0).alias("q"))
    w = Window.partitionBy("conn").orderBy("seq", "q").rowsBetween(Window.unboundedPreceding, 0)
    return moved.unionByName(asked).withColumn("channels", F.sum("delta").over(w)).filter("q = 1").select("seq", "conn", "channel", "channels")


def overflows(delivered_rows: DataFrame, reads: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """(conn, seq): the first message that finds a connection's buffer full,
    which ends the connection.  ``reads`` has (conn, seq), a row per message
    that the connection has taken out of its buffer."""
    both = delivered_rows.select("conn", "seq", F.lit(1).alias("d")).unionByName(reads.select("conn", "seq", F.lit(-1).alias("d")))
    w = Window.partitionBy("conn").orderBy("seq", "d").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("held", F.sum("d").over(w)).filter((F.col("d") == 1) & (F.col("held") > buffer)).groupBy("conn").agg(F.min("seq").alias("seq"))


def first_overflows(log: DataFrame, messages: DataFrame, reads: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """``overflows`` of ``deliveries``, which are made only as far as they decide.

    A connection that reads r messages is full by its delivery of number
    buffer + 1 + r.  So of an interval no message past that number counts, nor any
    of an interval that begins after as many were heard in intervals that had ended.
    """
    taken = reads.groupBy(F.col("conn").alias("of")).agg(F.count("*").alias("r"))
    heard = heard_intervals(log, messages).join(taken, F.col("conn").eqNullSafe(F.col("of")), "left").withColumn("most", F.coalesce("r", F.lit(0)) + buffer + 1)
    ends = F.array(F.struct(F.col("from_seq").alias("at"), F.lit(0).cast("bigint").alias("n")), F.struct(F.col("to_seq").alias("at"), F.col("heard").alias("n")))
    rows = heard.select("conn", "channel", "first", "heard", "most", F.explode(ends).alias("e")).filter("e.at is not null")
    rows = rows.withColumn("ended", F.sum("e.n").over(Window.partitionBy("conn").orderBy("e.at"))).filter("e.n = 0 and ended < most")
    size, n = 4096, F.least("heard", "most")
    cut = rows.select("conn", "channel", "first", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size))).alias("b"))
    places = cut.select("conn", "channel", F.explode(F.sequence(F.col("first") + F.col("b") * size + 1, F.col("first") + F.least("n", (F.col("b") + 1) * size))).alias("place"))
    numbered = running_sum(messages.select("channel", "seq", F.lit(1).alias("m")), "m", ["channel"]).select("channel", "seq", F.col("running").alias("place"))
    return overflows(places.join(numbered, ["channel", "place"]).select("conn", "seq"), reads, buffer)


def delivered_to_readers(log: DataFrame, messages: DataFrame, reads: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """``delivered`` where a full buffer ends its connection: neither the message
    that finds it full nor any later one counts for it, and what it asks for
    afterwards counts for nothing.  ``reads`` as in ``overflows``."""
    full = written(first_overflows(log, messages, reads, buffer), "full").withColumnRenamed("seq", "full_seq")
    # an end counts before the message at its place, as in ``delivered``
    kept = log.join(full, "conn", "left").filter(F.col("full_seq").isNull() | (F.col("seq") < F.col("full_seq"))).select("seq", "conn", "op", "channel")
    ends = full.select(F.col("full_seq").alias("seq"), "conn", F.lit("CLOSE").alias("op"), F.lit(None).cast("string").alias("channel"))
    return delivered(kept.unionByName(ends), messages)
