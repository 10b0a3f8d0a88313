"""Routing by hash slot, and topology reports.

Slot tables have at most SLOTS = 16,384 rows, as they are grouped by slot, and are
broadcast.  Node tables are counted before they are, and may have as many rows.
Where nodes claim the same slot, or a slot moves to several, the least id wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytide.functions.hashing import SLOTS, slot

PFAIL_AFTER_US = 10_000_000
FAIL_AFTER_US = 30_000_000


def few(nodes: DataFrame, most: int = SLOTS) -> DataFrame:
    """``nodes`` to be broadcast: more than ``most`` of them are an error."""
    if nodes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} nodes")
    return F.broadcast(nodes)


def slot_table(nodes: DataFrame) -> DataFrame:
    """(slot, id, addr) of assigned slots, from nodes' ranges."""
    ranges = nodes.select("id", "addr", F.explode("slots").alias("r"))
    return ranges.select(F.explode(_slots("r")).alias("slot"), "id", "addr").groupBy("slot").agg(F.min(F.struct("id", "addr")).alias("n")).select("slot", "n.*")


def _slots(r: str) -> Column:
    """The slots there are of a range; none of one that ends before it starts."""
    low, high = F.greatest(F.col(f"{r}.start"), F.lit(0)), F.least(F.col(f"{r}.end"), F.lit(SLOTS - 1))
    return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))


def route(keys: DataFrame, nodes: DataFrame, me: str, importing: DataFrame | None = None, replica_reads: bool = False) -> DataFrame:
    """(key, slot, reply): null where ``me`` serves the key, else MOVED or
    CLUSTERDOWN.  ``importing`` has (slot) being taken over, served without
    being asked; a replica serves reads of every key."""
    owners = F.broadcast(slot_table(nodes).withColumnRenamed("slot", "s"))
    rows = keys.select("key", slot(F.col("key")).alias("slot"))
    rows = rows.join(owners, rows["slot"] == owners["s"], "left")
    taken = F.lit(False)
    if importing is not None:
        rows = rows.join(F.broadcast(importing.filter(F.col("slot").between(0, SLOTS - 1)).select("slot").distinct().withColumn("taken", F.lit(True))), "slot", "left")
        taken = F.coalesce("taken", F.lit(False))
    served = taken | (F.col("id") == me) | F.lit(replica_reads)
    down = F.concat(F.lit("CLUSTERDOWN Hash slot "), F.col("slot"), F.lit(" is not served"))
    moved = F.concat(F.lit("MOVED "), F.col("slot"), F.lit(" "), F.col("addr"))
    return rows.select("key", "slot", F.when(served, F.lit(None)).when(F.col("id").isNull(), down).otherwise(moved).alias("reply"))


def ask(keys: DataFrame, kv: DataFrame, migrating: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, slot, reply): ASK for keys of migrating slots (slot, target) that
    are no longer here, else null."""
    moving = migrating.filter(F.col("slot").between(0, SLOTS - 1)).groupBy("slot").agg(F.min("target").alias("id"))
    rows = keys.select("key", slot(F.col("key")).alias("slot"))
    rows = rows.join(F.broadcast(moving), "slot", "left").join(few(nodes.groupBy("id").agg(F.min("addr").alias("addr"))), "id", "left")
    rows = rows.join(kv.select("key").distinct().withColumn("here", F.lit(True)), "key", "left")
    gone = F.col("addr").isNotNull() & F.col("here").isNull()
    return rows.select("key", "slot", F.when(gone, F.concat(F.lit("ASK "), F.col("slot"), F.lit(" "), F.col("addr"))).alias("reply"))


def info(nodes: DataFrame) -> DataFrame:
    """One row: state, slots_assigned, slots_ok, known_nodes, size, text."""
    assigned = slot_table(nodes).agg(F.count("*").alias("slots_assigned"))
    known = nodes.agg(F.count("*").alias("known_nodes"), F.count(F.when(F.size("slots") > 0, 1)).alias("size"))
    row = assigned.join(F.broadcast(known), F.lit(True)).withColumn("state", F.when(F.col("slots_assigned") == SLOTS, "ok").otherwise("fail"))
    text = F.format_string(
        "cluster_state:%s\r\ncluster_slots_assigned:%d\r\ncluster_slots_ok:%d\r\ncluster_known_nodes:%d\r\ncluster_size:%d\r\n", "state", "slots_assigned", "slots_assigned", "known_nodes", "size"
    )
    return row.select("state", "slots_assigned", F.col("slots_assigned").alias("slots_ok"), "known_nodes", "size", text.alias("text"))


def islands(owned: DataFrame) -> DataFrame:
    """(id, start, end) runs of neighbouring slots (slot, id) of one owner."""
    w = Window.partitionBy("id").orderBy("slot")
    runs = owned.withColumn("g", F.col("slot") - F.row_number().over(w)).groupBy("id", "g")
    return runs.agg(F.min("slot").alias("start"), F.max("slot").alias("end")).drop("g")


def slots_report(nodes: DataFrame) -> DataFrame:
    """(start, end, id, host, port) of contiguous runs of one owner."""
    runs = islands(slot_table(nodes).select("slot", "id")).join(few(nodes.select("id", "addr")), "id")
    host, port = split_addr(F.col("addr"))
    return runs.select("start", "end", "id", host.alias("host"), port.alias("port"))


def split_addr(addr: Column) -> tuple[Column, Column]:
    """Host and port; an address without exactly one colon has port 0."""
    parts = F.split(addr, ":")
    two = F.size(parts) == 2
    return F.when(two, parts[0]).otherwise(addr), F.when(two, F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("int"), F.lit(0))).otherwise(0)


def ranges_text(nodes: DataFrame) -> DataFrame:
    """(id, ranges): ``0-5460,5463``; a single slot has no dash."""
    owned = nodes.select("id", F.explode("slots").alias("r")).select(F.explode(_slots("r")).alias("slot"), "id").distinct()
    one = F.when(F.col("start") == F.col("end"), F.col("start").cast("string")).otherwise(F.concat_ws("-", "start", "end"))
    lists = islands(owned).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", one.alias("t")))).alias("l"))
    return lists.select("id", F.array_join(F.transform("l", lambda r: r["t"]), ",").alias("ranges"))


def nodes_report(nodes: DataFrame, me: str) -> DataFrame:
    """(id, line): ``<id> <addr> <flags> <ranges or ->``."""
    rows = nodes.join(ranges_text(nodes), "id", "left")
    flags = F.when(F.col("id") == me, F.concat(F.lit("myself,"), F.lower("state"))).otherwise(F.lower("state"))
    return rows.select("id", F.concat_ws(" ", "id", "addr", flags, F.coalesce("ranges", F.lit("-"))).alias("line"))


def meet(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """``nodes`` with those of ``asked`` (id, addr, start, end) whose address
    isn't known; their slots only if the range lies in 0 .. SLOTS-1.  Of the
    same new address the least id joins."""
    new = asked.join(few(nodes.select("addr")), "addr", "left_anti").groupBy("addr").agg(F.min(F.struct("id", "start", "end")).alias("n"))
    whole = (F.col("n.start") >= 0) & (F.col("n.end") < SLOTS) & (F.col("n.start") <= F.col("n.end"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    made = {"id": F.col("n.id"), "addr": F.col("addr"), "state": F.lit("ONLINE"), "role": F.lit("master"), "slots": F.when(whole, F.array(F.struct(F.col("n.start").cast("int").alias("start"), F.col("n.end").cast("int").alias("end")))).otherwise(none)}
    return nodes.unionByName(new.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in nodes.schema]))


def replicate(nodes: DataFrame, me: str, master: str) -> DataFrame:
    """``me`` becomes a replica of ``master``; nothing changes if unknown."""
    known = F.broadcast(nodes.filter(F.col("id") == master).select(F.lit(True).alias("known")).limit(1))
    mine = (F.col("id") == me) & F.coalesce("known", F.lit(False))
    out = nodes.join(known, F.lit(True), "left")
    return out.withColumn("role", F.when(mine, "replica").otherwise(F.col("role"))).withColumn("master_id", F.when(mine, master).otherwise(F.col("master_id"))).drop("known")


def setslot(owners: DataFrame, log: DataFrame, nodes: DataFrame, me: str) -> DataFrame:
    """(slot, id, migrating_to, importing_from) after a log of (seq, slot,
    action, node) on a table of owners (slot, id).

    NODE gives the slot away and clears both marks; MIGRATING counts only
    while ``me`` owns the slot; unknown nodes, actions and slots count for
    nothing.  Later entries replace earlier ones.
    """
    known = log.filter(F.col("slot").between(0, SLOTS - 1)).join(few(nodes.select(F.col("id").alias("node"))), "node", "left_semi").withColumn("action", F.upper("action"))
    base = owners.select(F.lit(-1).cast("bigint").alias("seq"), "slot", F.lit("NODE").alias("action"), F.col("id").alias("node"))
    w = Window.partitionBy("slot").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = base.unionByName(known.filter(F.col("action").isin("NODE", "MIGRATING", "IMPORTING")).select("seq", "slot", "action", "node"))
    rows = rows.withColumn("owner", F.last(F.when(F.col("action") == "NODE", F.col("node")), ignorenulls=True).over(w))
    rows = rows.filter((F.col("action") != "MIGRATING") | F.coalesce(F.col("owner") == me, F.lit(False)))
    pick = lambda a: F.max(F.when(F.col("action") == a, F.struct("seq", "node")))
    last = rows.groupBy("slot").agg(pick("NODE").alias("o"), pick("MIGRATING").alias("m"), pick("IMPORTING").alias("i"))
    after = lambda c: F.when(F.col(f"{c}.seq") > F.coalesce("o.seq", F.lit(-2)), F.col(f"{c}.node"))
    return last.select("slot", F.col("o.node").alias("id"), after("m").alias("migrating_to"), after("i").alias("importing_from"))


def merge_gossip(nodes: DataFrame, news: DataFrame, me: str) -> DataFrame:
    """(id, addr, slots) known after news (seq, id, addr, slots): the latest
    per id; about ``me``, by id or address, nothing is learnt."""
    own = nodes.filter(F.col("id") == me).select("addr")
    heard = news.filter(F.col("id") != me).join(F.broadcast(own), "addr", "left_anti").select("seq", "id", "addr", "slots")
    rows = nodes.select(F.lit(-1).cast("bigint").alias("seq"), "id", "addr", "slots").unionByName(heard)
    return rows.groupBy("id").agg(F.max_by(F.struct("addr", "slots"), "seq").alias("n")).select("id", "n.*")


def detect_failures(nodes: DataFrame, now_us: int, me: str) -> DataFrame:
    """``nodes`` with the state that silence since the last pong gives: FAIL
    after 30 s, PFAIL after 10 s if online till now; ``me`` isn't judged."""
    quiet = F.lit(now_us) - F.col("last_pong_us")
    state = F.when(F.col("id") == me, F.col("state")).when(quiet > FAIL_AFTER_US, "FAIL").when((quiet > PFAIL_AFTER_US) & (F.col("state") == "ONLINE"), "PFAIL").otherwise(F.col("state"))
    return nodes.withColumn("state", state)


def failover(nodes: DataFrame) -> DataFrame:
    """``nodes`` after replicas took over the slots of masters in FAIL: of
    several replicas the least id, which becomes a master."""
    failed = nodes.filter("state = 'FAIL' and role = 'master'").select(F.col("id").alias("lost"), F.col("slots").alias("lost_slots"))
    heirs = nodes.filter("role = 'replica' and state <> 'FAIL'").groupBy("master_id").agg(F.min("id").alias("heir"))
    moves = F.broadcast(failed.join(F.broadcast(heirs), F.col("lost") == F.col("master_id")).select("lost", "lost_slots", "heir"))
    out = nodes.join(moves.select(F.col("heir").alias("id"), "lost_slots"), "id", "left").join(moves.select(F.col("lost").alias("id"), F.lit(True).alias("gave")), "id", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    took = F.col("lost_slots").isNotNull()
    slots = F.when(F.col("gave"), none).when(took, F.concat("slots", "lost_slots")).otherwise(F.col("slots"))
    return out.select(*[{"slots": slots.alias("slots"), "role": F.when(took, "master").otherwise(F.col("role")).alias("role"), "master_id": F.when(took, F.lit(None)).otherwise(F.col("master_id")).alias("master_id")}.get(c, F.col(c)) for c in nodes.columns])


def migrate(kv: DataFrame, moves: DataFrame) -> DataFrame:
    """(node, key, value) held after keys moved: kv (node, key, value) and
    moves (seq, key, source, target).  Values move without their expiry; the
    last move from a node that holds the key counts."""
    chain = moves.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "source", "target"))).alias("m"))
    rows = kv.join(chain, "key", "left")
    where = F.aggregate(F.coalesce("m", F.array().cast("array<struct<seq:bigint,source:string,target:string>>")), F.col("node"), lambda at, m: F.when(m["source"] == at, m["target"]).otherwise(at))
    return rows.select(where.alias("node"), "key", "value")


def setslot_replies(owners: DataFrame, log: DataFrame, nodes: DataFrame, me: str) -> DataFrame:
    """(seq, reply) for each entry of the log of ``setslot``: OK, or why it counts
    for nothing.  MIGRATING asks who owns the slot by then."""
    known = few(nodes.select(F.col("id").alias("node"), F.lit(True).alias("known")).distinct())
    action = F.upper("action")
    rows = log.join(known, "node", "left").withColumn("action", action)
    good = F.col("slot").between(0, SLOTS - 1) & F.col("known").isNotNull()
    gives = F.when((F.col("action") == "NODE") & good, F.col("node"))
    base = owners.select(F.lit(-1).cast("bigint").alias("seq"), "slot", F.lit("NODE").alias("action"), F.col("id").alias("node"), F.lit(True).alias("known"))
    w = Window.partitionBy("slot").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    told = base.unionByName(rows.select("seq", "slot", "action", "node", "known")).withColumn("owner", F.last(gives, ignorenulls=True).over(w)).filter("seq >= 0")
    name = F.col("action")
    reply = (
        F.when(F.col("slot").isNull() | ~F.col("slot").between(0, SLOTS - 1), "-ERR invalid slot number")
        .when(name.isNull() | ~name.isin("NODE", "MIGRATING", "IMPORTING"), "-ERR unknown setslot action")
        .when(F.col("node").isNull(), F.concat(F.lit("-ERR missing node-id for "), name))
        .when((name == "MIGRATING") & ~F.coalesce(F.col("owner") == me, F.lit(False)), "-ERR I'm not the owner of this slot")
        .when(F.col("known").isNull(), F.concat(F.lit("-ERR unknown node "), "node"))
        .otherwise("+OK")
    )
    return told.select("seq", reply.alias("reply"))


def my_id(me: str) -> str:
    """The reply to CLUSTER MYID."""
    return f"${me}"
