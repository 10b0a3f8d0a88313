"""The engine's operators applied to the test tables, by name.

``QUERIES`` has what runs on Spark, ``SQL`` the same in DuckDB where SQL can
say it.  Events are read as an operation log, orders as payments, events again
as subscriptions and messages, conversations as client connections.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide import model
from keytide.functions import hashing, stats
from keytide.operators import cluster, commands, pubsub, replication, state, transactions, triggers
from keytide.sources import resp, wal, workloads

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def work_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, as a plain path; where
    ``spark.checkpoint.dir`` isn't set, as in tests, one in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return os.path.join(wal.local_path(base), f"keytide-{uuid.uuid4().hex}")


# ---------------------------------------------------------------- key state

OPS_SQL = """ops AS (SELECT event_id AS seq, user_id % 16 AS conn, epoch_us(ts) AS ts_us,
  CASE WHEN event_type IN ('view', 'purchase') THEN 'SET' WHEN event_type = 'click' THEN 'EXPIRE' WHEN event_type = 'error' THEN 'DEL' ELSE 'PERSIST' END AS op,
  'user:' || user_id AS key, props AS value, epoch_us(ts) + CAST(round(value * 3600) AS BIGINT) * 1000000 AS exp_us FROM events),
now AS (SELECT max(ts_us) AS as_of FROM ops)"""
REPLAY_SQL = (
    "WITH "
    + OPS_SQL
    + """,
e AS (SELECT key, arg_max(op, seq) AS op, arg_max_null(value, seq) AS value FROM ops, now WHERE op IN ('SET', 'DEL') OR (op = 'EXPIRE' AND exp_us <= as_of) GROUP BY key),
t AS (SELECT key, arg_max(op, seq) AS op, arg_max(exp_us, seq) AS exp_us FROM ops WHERE op <> 'SET' GROUP BY key),
l AS (SELECT key, max(seq) AS last_seq FROM ops GROUP BY key),
kv AS (SELECT e.key, e.value, CASE WHEN t.op = 'EXPIRE' AND t.exp_us > as_of THEN t.exp_us END AS expires_at_us, last_seq
       FROM e JOIN l USING (key) LEFT JOIN t USING (key), now WHERE e.op = 'SET')"""
)
ASKED_SQL = "asked AS (SELECT DISTINCT 'user:' || (user_id * 3 % 400) AS key FROM events)"


def _replayed(spark, sf_dir) -> tuple[DataFrame, int]:
    ops = model.ops_from_events(spark, sf_dir)
    as_of = model.last_instant(ops)
    return state.replay(ops, as_of), as_of


def _asked(spark, sf_dir) -> DataFrame:
    return model.table(spark, sf_dir, "events").select(F.concat(F.lit("user:"), F.col("user_id") * 3 % 400).alias("key")).distinct()


@query(REPLAY_SQL + " SELECT * FROM kv")
def kv_replay(spark, sf_dir):
    return _replayed(spark, sf_dir)[0]


@query(REPLAY_SQL + ", " + ASKED_SQL + " SELECT asked.key, kv.value FROM asked LEFT JOIN kv ON asked.key = kv.key")
def kv_get_multi(spark, sf_dir):
    kv, now = _replayed(spark, sf_dir)
    return state.get(kv, _asked(spark, sf_dir), now)


@query(REPLAY_SQL + ", " + ASKED_SQL + " SELECT asked.key FROM asked JOIN kv USING (key)")
def kv_exists(spark, sf_dir):
    kv, now = _replayed(spark, sf_dir)
    return state.exists(kv, _asked(spark, sf_dir), now)


@query(REPLAY_SQL + ", " + ASKED_SQL + " SELECT asked.key, CAST(CASE WHEN kv.key IS NULL THEN -2 WHEN expires_at_us IS NULL THEN -1 ELSE (expires_at_us - as_of) // 1000000 END AS BIGINT) AS ttl FROM asked LEFT JOIN kv USING (key), now")
def kv_ttl(spark, sf_dir):
    kv, now = _replayed(spark, sf_dir)
    return state.ttl(kv, _asked(spark, sf_dir), now)


@query(REPLAY_SQL + " SELECT count(*) AS physical, count(*) FILTER (expires_at_us IS NULL OR expires_at_us > as_of + 3600000000) AS logical, count(expires_at_us) AS with_ttl FROM kv, now")
def kv_dbsize(spark, sf_dir):
    """An hour later than the log's end, so that some entries are due."""
    kv, now = _replayed(spark, sf_dir)
    return state.dbsize(kv, now + 3_600_000_000)


@query(REPLAY_SQL + " SELECT key, value, expires_at_us, last_seq FROM kv, now WHERE expires_at_us <= as_of + 86400000000 ORDER BY expires_at_us, key LIMIT 100")
def kv_due(spark, sf_dir):
    kv, now = _replayed(spark, sf_dir)
    return state.due(kv, now + 86_400_000_000)


@query("WITH " + OPS_SQL + " SELECT op, count(*) AS n, count(DISTINCT key) AS keys FROM ops GROUP BY op")
def op_counts(spark, sf_dir):
    return model.ops_from_events(spark, sf_dir).groupBy("op").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


@query(
    "WITH RECURSIVE "
    + OPS_SQL
    + """,
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n, count(*) OVER (PARTITION BY key) AS k FROM ops),
f AS (SELECT key, n, k, seq, CASE WHEN op = 'SET' THEN value END AS value, op = 'SET' AS here, CAST(NULL AS BIGINT) AS exp FROM r WHERE n = 1
  UNION ALL
  SELECT r.key, r.n, r.k, r.seq,
    CASE WHEN r.op = 'SET' THEN r.value WHEN r.op = 'DEL' OR f.exp <= r.ts_us THEN NULL ELSE f.value END,
    CASE WHEN r.op = 'SET' THEN TRUE WHEN r.op = 'DEL' OR f.exp <= r.ts_us THEN FALSE ELSE f.here END,
    CASE WHEN r.op IN ('DEL', 'PERSIST') THEN NULL
         WHEN r.op = 'EXPIRE' AND f.here AND NOT coalesce(f.exp <= r.ts_us, FALSE) THEN r.exp_us
         WHEN f.exp <= r.ts_us THEN NULL ELSE f.exp END
  FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1)
SELECT key, value, exp AS expires_at_us, seq AS last_seq FROM f, now WHERE n = k AND here AND (exp IS NULL OR exp > as_of)"""
)
def kv_live(spark, sf_dir):
    ops = model.ops_from_events(spark, sf_dir)
    return state.live(ops, model.last_instant(ops))


@query(REPLAY_SQL + " SELECT * FROM kv")
def compact_then_replay(spark, sf_dir):
    """Compaction at half of the log keeps the state."""
    ops = model.ops_from_events(spark, sf_dir)
    as_of = model.last_instant(ops)
    half = ops.agg(F.max("seq")).first()[0] // 2
    return state.replay_compacted(state.compact(ops, half, as_of), as_of)


@query("WITH " + OPS_SQL + ", w AS (SELECT *, last_value(CASE WHEN op IN ('SET', 'DEL') THEN seq END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq) AS s FROM ops) SELECT w.seq, w.key, CASE WHEN o.op = 'SET' THEN o.value END AS value FROM w LEFT JOIN ops o ON o.seq = w.s WHERE w.op = 'EXPIRE'")
def kv_get_at_operation(spark, sf_dir):
    """What each EXPIRE finds under its key at that point of the log."""
    ops = model.ops_from_events(spark, sf_dir)
    return state.at_operation(ops, ops.filter("op = 'EXPIRE'").select("seq", "key"))


SESSION = ("SET", "GET", "TTL", "DEL", "EXPIRE", "PERSIST", "DBSIZE", "PING", "nosuch", "SUBSCRIBE", "UNSUBSCRIBE", "PUBLISH", "CLUSTER", "MIGRATE", "PSYNC", "WASM.LIST", "WASM.INFO")
SESSION_SQL = (
    "WITH RECURSIVE "
    + OPS_SQL
    + """,
c AS (SELECT seq, conn, ts_us, key, value, seq % 17 AS k, 'ch' || (seq % 3) AS channel FROM ops),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM c WHERE k <= 5),
f AS (SELECT key, 0::BIGINT AS n, NULL::BIGINT AS conn, NULL::BIGINT AS seq, NULL::VARCHAR AS value, NULL::BIGINT AS exp, NULL::VARCHAR AS reply, 0 AS delta FROM r WHERE n = 1
  UNION ALL
  SELECT r.key, r.n, r.conn, r.seq,
    CASE WHEN r.k = 0 THEN r.value WHEN r.k = 3 OR (r.k = 1 AND f.exp <= r.ts_us) THEN NULL ELSE f.value END,
    CASE WHEN r.k = 0 AND r.seq % 2 = 0 THEN r.ts_us + 7200000000 WHEN r.k IN (3, 5) OR (r.k = 1 AND f.exp <= r.ts_us) THEN NULL
         WHEN r.k = 4 AND f.value IS NOT NULL THEN r.ts_us + 3600000000 ELSE f.exp END,
    CASE r.k WHEN 0 THEN '+OK' WHEN 1 THEN CASE WHEN f.value IS NULL OR f.exp <= r.ts_us THEN '$-1' ELSE '$' || f.value END
      WHEN 2 THEN CASE WHEN f.value IS NULL THEN ':-2' WHEN f.exp IS NULL THEN ':-1' ELSE ':' || (greatest(f.exp - r.ts_us, 0) // 1000000) END
      WHEN 3 THEN CASE WHEN f.value IS NULL THEN ':0' ELSE ':1' END WHEN 4 THEN CASE WHEN f.value IS NULL THEN ':0' ELSE ':1' END
      ELSE CASE WHEN f.exp IS NULL THEN ':0' ELSE ':1' END END,
    CASE WHEN r.k = 0 AND f.value IS NULL THEN 1 WHEN (r.k = 3 OR (r.k = 1 AND f.exp <= r.ts_us)) AND f.value IS NOT NULL THEN -1 ELSE 0 END
  FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1),
sizes AS (SELECT c.seq, c.conn, c.k, sum(coalesce(f.delta, 0)) OVER (ORDER BY c.seq) AS held FROM c LEFT JOIN f ON f.seq = c.seq),
l AS (SELECT seq, conn, channel, k = 9 AS j, coalesce(lag(k = 9) OVER (PARTITION BY conn, channel ORDER BY seq), FALSE) AS was FROM c WHERE k IN (9, 10)),
d AS (SELECT seq, conn, channel, CASE WHEN j THEN 1 ELSE -1 END AS delta FROM l WHERE j <> was),
told AS (SELECT c.conn, c.seq, '*3 $subscribe $' || c.channel || ' :' || (SELECT coalesce(sum(delta), 0) FROM d WHERE d.conn = c.conn AND d.seq <= c.seq) AS reply FROM c WHERE k = 9
  UNION ALL SELECT c.conn, c.seq, ':' || (SELECT coalesce(sum(delta), 0) FROM d WHERE d.channel = c.channel AND d.seq < c.seq) FROM c WHERE k = 11)
SELECT conn, seq, reply FROM f WHERE n > 0 UNION ALL SELECT conn, seq, ':' || held FROM sizes WHERE k = 6 UNION ALL SELECT * FROM told
UNION ALL SELECT conn, seq, CASE k WHEN 7 THEN '+PONG' WHEN 8 THEN '-ERR unknown command ''NOSUCH''' WHEN 10 THEN '+OK' WHEN 15 THEN '*0' WHEN 16 THEN '-ERR module ''' || key || ''' not found' ELSE '-ERR cluster mode is not enabled' END FROM c WHERE k IN (7, 8, 10, 12, 13, 14, 15, 16)"""
)


def _commands(spark, sf_dir) -> DataFrame:
    """A client session made of the events: every command in turn."""
    ops = model.ops_from_events(spark, sf_dir)
    cmd = F.element_at(F.array(*map(F.lit, SESSION)), (F.col("seq") % len(SESSION) + 1).cast("int"))
    channel = F.concat(F.lit("ch"), (F.col("seq") % 3).cast("string"))
    timed = F.when(F.col("seq") % 2 == 0, F.array("key", "value", F.lit("ex"), F.lit("7200"))).otherwise(F.array("key", "value"))
    args = F.when(cmd == "EXPIRE", F.array("key", F.lit("3600"))).when(cmd == "SET", timed).when(cmd.isin("SUBSCRIBE", "UNSUBSCRIBE"), F.array(channel)).when(cmd == "PUBLISH", F.array(channel, "value")).otherwise(F.array("key"))
    return ops.select("conn", "seq", "ts_us", cmd.alias("cmd"), args.alias("args"))


@query(SESSION_SQL)
def command_replies(spark, sf_dir):
    """One reply to each command of a session."""
    return commands.replies(_commands(spark, sf_dir))


@query("SELECT count(*) AS commands, count(*) AS replies, count(*) FILTER (event_id % 5 = 1 OR event_id % 5 IN (2, 3)) AS told FROM events")
def session_transactions(spark, sf_dir):
    """The events as sessions of MULTI, two or more queued commands, EXEC: every
    command has one reply; see the tests for what they are."""
    ops = model.ops_from_events(spark, sf_dir)
    k = F.col("seq") % 5
    cmd = F.when(k == 1, "MULTI").when(k == 4, "EXEC").when(k == 2, "SET").when(k == 3, "GET").otherwise("PING")
    rows = ops.select(F.floor(F.col("seq") / 5).alias("conn"), "seq", "ts_us", cmd.alias("cmd"), F.when(k == 2, F.array("key", "value")).otherwise(F.array("key")).alias("args"))
    out = commands.replies(rows)
    told = F.col("reply").isin("+OK", "+QUEUED")
    return rows.agg(F.count("*").alias("commands")).crossJoin(out.agg(F.count("*").alias("replies"), F.count(F.when(told, 1)).alias("told")))


@query(REPLAY_SQL + " SELECT 'EXPIRE' AS event, key, expires_at_us AS ts_us FROM kv, now WHERE expires_at_us <= as_of + 86400000000")
def kv_expired_events(spark, sf_dir):
    kv, now = _replayed(spark, sf_dir)
    return state.evict(kv, now + 86_400_000_000)[1]


@query(REPLAY_SQL.replace("ops AS (", "all_ops AS (").replace("FROM events),\nnow", "FROM events),\nops AS (SELECT * FROM all_ops WHERE seq > (SELECT max(seq) // 2 FROM all_ops)),\nnow") + " SELECT key, value FROM kv")
def kv_after_flush(spark, sf_dir):
    """A flush at half of the log."""
    ops = model.ops_from_events(spark, sf_dir)
    half = ops.agg(F.max("seq")).first()[0] // 2
    mark = ops.filter(F.col("seq") == half).withColumn("op", F.lit("FLUSH"))
    log = state.since_flush(ops.filter(F.col("seq") != half).unionByName(mark))
    return state.replay(log, model.last_instant(ops)).select("key", "value")


@query("WITH n AS (SELECT i, i % 5 = 0 AS w, 'key:' || (i * 7919 % 100000) AS key FROM range(100000) t(i)) SELECT CASE WHEN w THEN 'SET' ELSE 'GET' END AS cmd, count(*) AS n, count(DISTINCT key) AS keys FROM n GROUP BY 1")
def workload_mixed(spark, sf_dir):
    rows = workloads.mixed(spark, 100_000, 100_000)
    return rows.groupBy("cmd").agg(F.count("*").alias("n"), F.countDistinct(F.col("args")[0]).alias("keys"))


@query("WITH k AS (SELECT i, i * 7919 % 100000 AS key, i % 5 = 0 AS w FROM range(100000) t(i)), s AS (SELECT key, min(i) AS first FROM k WHERE w GROUP BY key) SELECT CASE WHEN w THEN '+' WHEN first < i THEN '$x' ELSE '$-1' END AS reply, count(*) AS n FROM k LEFT JOIN s USING (key) GROUP BY 1")
def workload_replies(spark, sf_dir):
    """The mixed load at its usual size, answered: kinds of replies."""
    rows = commands.replies(workloads.mixed(spark, 100_000, 100_000))
    kind = F.when(F.col("reply").startswith("$x"), "$x").when(F.col("reply") == "+OK", "+").otherwise(F.col("reply"))
    return rows.groupBy(kind.alias("reply")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN i < 100000 THEN '+OK' ELSE ':1' END AS reply, count(*) AS n, count(DISTINCT i % 50) AS conns FROM range(200000) t(i) GROUP BY 1")
def workload_expiring(spark, sf_dir):
    """Writes with an expiry, each renewed before it ends."""
    rows = commands.replies(workloads.expiring(spark, 100_000))
    return rows.groupBy("reply").agg(F.count("*").alias("n"), F.countDistinct("conn").alias("conns"))


@query("SELECT count(*) AS published, (count(*) * 10)::BIGINT AS received, (count(*) * 10)::BIGINT AS expected, 100.0::DOUBLE AS rate FROM range(10000) t(i)")
def workload_pubsub(spark, sf_dir):
    log, sent = workloads.published(spark, 10_000)
    return stats.delivery_rate(pubsub.delivered(log, sent), 10)


# ------------------------------------------------------- hashing and routing

BYTES = "list_transform(string_split({k}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
_X1 = "xor(acc >> 8, b)"
_X = f"xor({_X1}, {_X1} >> 4)"
CRC_SQL = f"list_reduce(list_prepend(CAST(0 AS BIGINT), {BYTES}), lambda acc, b: xor(xor(xor(acc << 8, {_X} << 12), {_X} << 5), {_X}) & 65535)"
FNV32_SQL = f"list_reduce(list_prepend(CAST(2166136261 AS BIGINT), {BYTES}), lambda acc, b: (xor(acc, b) * 16777619) & 4294967295)"
FNV64_SQL = f"list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform({BYTES}, lambda z: CAST(z AS HUGEINT))), lambda acc, b: (xor(acc, b) * 1099511628211) % 18446744073709551616)"
KEYS_SQL = "keys AS (SELECT c_name AS key FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT n_name FROM nation)"
SLOT_SQL = "WITH " + KEYS_SQL + ", s AS (SELECT key, CAST(" + CRC_SQL.format(k="key") + " % 16384 AS INTEGER) AS slot FROM keys)"
NODES = [("a1", "10.0.1.1:6380", "ONLINE", "master", None, 99_000_000, [(0, 5460)]), ("b2", "10.0.2.1:6380", "ONLINE", "master", None, 85_000_000, [(5461, 10922)]), ("c3", "10.0.3.1:6380", "PFAIL", "master", None, 60_000_000, [(10923, 12000), (12100, 12100), (12200, 16383)]), ("d4", "10.0.4.1:6380", "ONLINE", "replica", "c3", 98_000_000, [])]
RANGES_SQL = "(VALUES ('a1', '10.0.1.1:6380', 0, 5460), ('b2', '10.0.2.1:6380', 5461, 10922), ('c3', '10.0.3.1:6380', 10923, 12000), ('c3', '10.0.3.1:6380', 12100, 12100), ('c3', '10.0.3.1:6380', 12200, 16383)) r(id, addr, lo, hi)"


def _nodes(spark) -> DataFrame:
    return spark.createDataFrame(NODES, model.NODES)


def _keys(spark, sf_dir) -> DataFrame:
    names = (("customer", "c_name"), ("supplier", "s_name"), ("nation", "n_name"))
    a, b, c = (model.table(spark, sf_dir, t).select(F.col(k).alias("key")) for t, k in names)
    return a.unionByName(b).unionByName(c)


@query(SLOT_SQL + " SELECT key, slot FROM s")
def slot_of_key(spark, sf_dir):
    return _keys(spark, sf_dir).select("key", hashing.slot(F.col("key")).alias("slot"))


@query(SLOT_SQL + " SELECT slot // 1024 AS bucket, count(*) AS n FROM s GROUP BY 1")
def slot_histogram(spark, sf_dir):
    return _keys(spark, sf_dir).groupBy(F.floor(hashing.slot(F.col("key")) / 1024).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


@query("WITH " + KEYS_SQL + ", h AS (SELECT CAST(" + FNV64_SQL.format(k="key") + " % 256 AS INTEGER) AS shard FROM keys) SELECT shard, count(*) AS n FROM h GROUP BY shard")
def fnv_shard_histogram(spark, sf_dir):
    return state.shard_sizes(_keys(spark, sf_dir))


@query("WITH " + KEYS_SQL + ", h AS (SELECT CAST(" + FNV32_SQL.format(k="key") + " % 256 AS INTEGER) AS shard FROM keys) SELECT shard, count(*) AS n FROM h GROUP BY shard")
def fnv32_shard_histogram(spark, sf_dir):
    return _keys(spark, sf_dir).groupBy(hashing.shard32(F.col("key")).alias("shard")).agg(F.count("*").alias("n"))


@query(SLOT_SQL + " SELECT key FROM s WHERE slot = (SELECT min(slot) FROM s) ORDER BY key LIMIT 10")
def keys_in_slot(spark, sf_dir):
    keys = _keys(spark, sf_dir)
    return state.keys_in_slot(keys, keys.agg(F.min(hashing.slot(F.col("key")))).first()[0], 10)


@query(SLOT_SQL + f" SELECT key, slot, CASE WHEN id = 'a1' OR slot BETWEEN 5461 AND 5600 THEN NULL WHEN id IS NULL THEN 'CLUSTERDOWN Hash slot ' || slot || ' is not served' ELSE 'MOVED ' || slot || ' ' || addr END AS reply FROM s LEFT JOIN {RANGES_SQL} ON slot BETWEEN lo AND hi")
def route_moved(spark, sf_dir):
    """Seen from node a1, which is taking over slots 5461 to 5600."""
    importing = spark.range(5461, 5601).select(F.col("id").cast("int").alias("slot"))
    return cluster.route(_keys(spark, sf_dir), _nodes(spark), "a1", importing)


@query(SLOT_SQL + ", here AS (SELECT DISTINCT c_name AS key FROM customer WHERE c_custkey % 2 = 0) SELECT s.key, slot, CASE WHEN slot < 3000 AND here.key IS NULL THEN 'ASK ' || slot || ' 10.0.2.1:6380' END AS reply FROM s LEFT JOIN here USING (key)")
def route_ask(spark, sf_dir):
    """Slots below 3000 are moving to b2; customers of even number are still here."""
    moving = spark.range(0, 3000).select(F.col("id").cast("int").alias("slot"), F.lit("b2").alias("target"))
    here = model.table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_name").alias("key")).distinct()
    return cluster.ask(_keys(spark, sf_dir), here, moving, _nodes(spark))


@query(SLOT_SQL + " SELECT key, slot, CAST(NULL AS VARCHAR) AS reply FROM s")
def route_replica_reads(spark, sf_dir):
    """Seen from a replica that serves reads of all keys."""
    return cluster.route(_keys(spark, sf_dir), _nodes(spark), "d4", replica_reads=True)


@query(f"WITH a AS (SELECT 'n' || c_custkey AS id, '10.1.' || (c_custkey % 9) || '.1:6380' AS addr, c_custkey % 20000 AS lo, c_custkey % 20000 + c_custkey % 3 - 1 AS hi FROM customer), m AS (SELECT addr, min(id) AS id FROM a WHERE addr NOT IN (SELECT addr FROM {RANGES_SQL}) GROUP BY addr) SELECT a.id, a.addr, 'master' AS role, CASE WHEN hi < 16384 AND lo <= hi THEN hi - lo + 1 ELSE 0 END AS slots FROM a JOIN m USING (id, addr) UNION ALL SELECT DISTINCT id, addr, 'master', sum(hi - lo + 1) FROM {RANGES_SQL} GROUP BY id, addr UNION ALL SELECT 'd4', '10.0.4.1:6380', 'replica', 0")
def cluster_meet(spark, sf_dir):
    """Customers as nodes that ask to join, nine addresses in all."""
    k = F.col("c_custkey")
    asked = model.table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), k).alias("id"), F.concat(F.lit("10.1."), k % 9, F.lit(".1:6380")).alias("addr"), (k % 20000).alias("start"), (k % 20000 + k % 3 - 1).alias("end"))
    joined = cluster.meet(_nodes(spark), asked)
    return joined.select("id", "addr", "role", F.aggregate("slots", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"] + 1).alias("slots"))


@query("SELECT n_name AS id, CASE WHEN n_nationkey = 3 THEN 'replica' ELSE 'master' END AS role, CASE WHEN n_nationkey = 3 THEN (SELECT n_name FROM nation WHERE n_nationkey = 5) END AS master_id FROM nation")
def cluster_replicate(spark, sf_dir):
    """Nations as nodes: number 3 becomes a replica of number 5, then asks for one that isn't there."""
    rows = model.table(spark, sf_dir, "nation")
    name = {r.n_nationkey: r.n_name for r in rows.filter("n_nationkey in (3, 5)").collect()}
    nodes = rows.select(F.col("n_name").alias("id"), F.lit("master").alias("role"), F.lit(None).cast("string").alias("master_id"))
    return cluster.replicate(cluster.replicate(nodes, name[3], name[5]), name[3], "nowhere")


@query(
    """WITH log AS (SELECT event_id AS seq, event_id % 20000 - 100 AS slot, CASE event_type WHEN 'view' THEN 'node' WHEN 'click' THEN 'MIGRATING' WHEN 'purchase' THEN 'IMPORTING' ELSE 'x' END AS action, CASE user_id % 5 WHEN 0 THEN 'a1' WHEN 1 THEN 'b2' WHEN 2 THEN 'c3' WHEN 3 THEN 'zz' END AS node FROM events),
b AS (SELECT -1 AS seq, CAST(s AS BIGINT) AS slot, 'NODE' AS action, id AS node FROM """
    + RANGES_SQL
    + """, unnest(generate_series(lo, hi)) g(s) UNION ALL SELECT seq, slot, upper(action), node FROM log),
w AS (SELECT *, last_value(CASE WHEN action = 'NODE' AND node IN ('a1', 'b2', 'c3') AND slot BETWEEN 0 AND 16383 THEN node END IGNORE NULLS) OVER (PARTITION BY slot ORDER BY seq) AS owner FROM b)
SELECT seq, CASE WHEN slot NOT BETWEEN 0 AND 16383 THEN '-ERR invalid slot number' WHEN action = 'X' THEN '-ERR unknown setslot action' WHEN node IS NULL THEN '-ERR missing node-id for ' || action
  WHEN action = 'MIGRATING' AND coalesce(owner, '') <> 'a1' THEN '-ERR I''m not the owner of this slot' WHEN node = 'zz' THEN '-ERR unknown node zz' ELSE '+OK' END AS reply FROM w WHERE seq >= 0"""
)
def setslot_replies(spark, sf_dir):
    action = F.when(F.col("event_type") == "view", "node").when(F.col("event_type") == "click", "MIGRATING").when(F.col("event_type") == "purchase", "IMPORTING").otherwise("x")
    node = F.element_at(F.array(F.lit("a1"), F.lit("b2"), F.lit("c3"), F.lit("zz"), F.lit(None)), (F.col("user_id") % 5 + 1).cast("int"))
    log = model.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 20000 - 100).cast("int").alias("slot"), action.alias("action"), node.alias("node"))
    nodes = _nodes(spark)
    return cluster.setslot_replies(cluster.slot_table(nodes).select("slot", "id"), log, nodes, "a1")


@query(f"SELECT lo AS start, hi AS \"end\", id, split_part(addr, ':', 1) AS host, CAST(split_part(addr, ':', 2) AS INTEGER) AS port FROM {RANGES_SQL}")
def cluster_slots(spark, sf_dir):
    return cluster.slots_report(_nodes(spark))


@query(f"SELECT 'fail' AS state, sum(hi - lo + 1)::BIGINT AS slots_assigned, sum(hi - lo + 1)::BIGINT AS slots_ok, 4::BIGINT AS known_nodes, count(DISTINCT id) AS size, printf('cluster_state:fail\r\ncluster_slots_assigned:%d\r\ncluster_slots_ok:%d\r\ncluster_known_nodes:4\r\ncluster_size:%d\r\n', sum(hi - lo + 1), sum(hi - lo + 1), count(DISTINCT id)) AS text FROM {RANGES_SQL}")
def cluster_info(spark, sf_dir):
    return cluster.info(_nodes(spark))


@query("SELECT * FROM (VALUES ('a1', 'a1 10.0.1.1:6380 myself,online 0-5460'), ('b2', 'b2 10.0.2.1:6380 online 5461-10922'), ('c3', 'c3 10.0.3.1:6380 pfail 10923-12000,12100,12200-16383'), ('d4', 'd4 10.0.4.1:6380 online -')) v(id, line)")
def cluster_nodes(spark, sf_dir):
    return cluster.nodes_report(_nodes(spark), "a1")


@query("SELECT n_name AS id, CASE WHEN n_nationkey = 0 THEN 'ONLINE' WHEN n_nationkey * 2 > 30 THEN 'FAIL' WHEN n_nationkey * 2 > 10 THEN 'PFAIL' ELSE 'ONLINE' END AS state FROM nation")
def node_health(spark, sf_dir):
    """Nations as nodes, number k silent for 2k seconds; number 0 is the observer."""
    rows = model.table(spark, sf_dir, "nation")
    me = rows.filter("n_nationkey = 0").first()["n_name"]
    nodes = rows.select(F.col("n_name").alias("id"), F.lit("ONLINE").alias("state"), (F.lit(100_000_000) - F.col("n_nationkey").cast("bigint") * 2_000_000).alias("last_pong_us"))
    return cluster.detect_failures(nodes, 100_000_000, me).select("id", "state")


@query(f"SELECT CASE id WHEN 'c3' THEN 'd4' ELSE id END AS id, 'master' AS role, sum(hi - lo + 1)::BIGINT AS slots FROM {RANGES_SQL} GROUP BY id UNION ALL SELECT 'c3', 'master', 0")
def failover_owners(spark, sf_dir):
    """Node c3 is silent for 40 s; its replica d4 takes its slots."""
    nodes = cluster.failover(cluster.detect_failures(_nodes(spark), 100_000_000, "a1"))
    return nodes.select("id", "role", F.aggregate("slots", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"] + 1).alias("slots"))


@query(
    """WITH log AS (SELECT event_id AS seq, CAST(event_id * 7919 % 16384 AS INTEGER) AS slot, CASE event_type WHEN 'view' THEN 'NODE' WHEN 'click' THEN 'MIGRATING' WHEN 'purchase' THEN 'IMPORTING' END AS action, CASE user_id % 4 WHEN 0 THEN 'a1' WHEN 1 THEN 'b2' WHEN 2 THEN 'c3' ELSE 'zz' END AS node FROM events),
b AS (SELECT -1 AS seq, CAST(s AS INTEGER) AS slot, 'NODE' AS action, id AS node FROM """
    + RANGES_SQL
    + """, unnest(generate_series(lo, hi)) g(s) UNION ALL SELECT * FROM log WHERE action IS NOT NULL AND node <> 'zz'),
w AS (SELECT *, last_value(CASE WHEN action = 'NODE' THEN node END IGNORE NULLS) OVER (PARTITION BY slot ORDER BY seq) AS owner FROM b),
k AS (SELECT * FROM w WHERE action <> 'MIGRATING' OR coalesce(owner = 'a1', FALSE)),
l AS (SELECT slot, max(seq) FILTER (action = 'NODE') AS o, max(seq) FILTER (action = 'MIGRATING') AS m, max(seq) FILTER (action = 'IMPORTING') AS i FROM k GROUP BY slot)
SELECT l.slot, ko.node AS id, CASE WHEN m > coalesce(o, -2) THEN km.node END AS migrating_to, CASE WHEN i > coalesce(o, -2) THEN ki.node END AS importing_from
FROM l LEFT JOIN k ko ON ko.slot = l.slot AND ko.seq = o LEFT JOIN k km ON km.slot = l.slot AND km.seq = m LEFT JOIN k ki ON ki.slot = l.slot AND ki.seq = i"""
)
def setslot_final(spark, sf_dir):
    nodes = _nodes(spark)
    action = F.when(F.col("event_type") == "view", "NODE").when(F.col("event_type") == "click", "MIGRATING").when(F.col("event_type") == "purchase", "IMPORTING")
    node = F.element_at(F.array(*map(F.lit, ("a1", "b2", "c3", "zz"))), (F.col("user_id") % 4 + 1).cast("int"))
    log = model.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") * 7919 % 16384).cast("int").alias("slot"), action.alias("action"), node.alias("node"))
    return cluster.setslot(cluster.slot_table(nodes).select("slot", "id"), log, nodes, "a1")


@query("WITH n AS (SELECT event_id AS seq, 'n' || (user_id % 40) AS id, '10.0.0.' || (user_id % 40) || ':' || (6000 + event_id % 3) AS addr FROM events), h AS (SELECT id, arg_max(addr, seq) AS addr FROM n WHERE id <> 'n0' AND addr <> '10.0.0.0:6000' GROUP BY id) SELECT * FROM h UNION ALL SELECT 'n0', '10.0.0.0:6000'")
def gossip_merge(spark, sf_dir):
    empty = F.array().cast("array<struct<start:int,end:int>>")
    me = spark.range(1).select(F.lit("n0").alias("id"), F.lit("10.0.0.0:6000").alias("addr"), empty.alias("slots"))
    u = F.col("user_id") % 40
    news = model.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("n"), u).alias("id"), F.concat(F.lit("10.0.0."), u, F.lit(":"), F.lit(6000) + F.col("event_id") % 3).alias("addr"), empty.alias("slots"))
    return cluster.merge_gossip(me, news, "n0").select("id", "addr")


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'b2' WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN 'c3' ELSE 'a1' END AS node, c_name AS key, c_mktsegment AS value FROM customer")
def migrate_keys(spark, sf_dir):
    """Customers start on a1; every third moves to b2, and of those left with
    remainder 1 the even ones to c3."""
    rows = model.table(spark, sf_dir, "customer")
    kv = rows.select(F.lit("a1").alias("node"), F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    first = rows.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("seq"), F.col("c_name").alias("key"), F.lit("a1").alias("source"), F.lit("b2").alias("target"))
    then = rows.filter("c_custkey % 2 = 0 and c_custkey % 3 <> 2").select((F.col("c_custkey") + 10_000_000).alias("seq"), F.col("c_name").alias("key"), F.lit("a1").alias("source"), F.lit("c3").alias("target"))
    return cluster.migrate(kv, first.unionByName(then))


# -------------------------------------------------------- rules and triggers

PAY_SQL = """p AS (SELECT o_orderkey, CAST(floor(o_totalprice / 5) AS BIGINT) AS amount, CASE n_nationkey % 8 WHEN 0 THEN 'NK' WHEN 1 THEN 'IR' WHEN 2 THEN 'SY' ELSE 'US' END AS country
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
q AS (SELECT *, CASE WHEN amount > 50000 THEN 100 ELSE CASE WHEN amount > 10000 THEN 50 WHEN amount > 5000 THEN 30 WHEN amount > 1000 THEN 10 ELSE 0 END + CASE WHEN country IN ('NK', 'IR', 'SY') THEN 50 ELSE 0 END END AS score FROM p),
s AS (SELECT *, CASE WHEN score >= 80 THEN 'BLOCKED' WHEN score >= 50 THEN 'REVIEW' ELSE 'OK' END AS decision FROM q)"""


def _payments(spark, sf_dir) -> DataFrame:
    """Orders as writes of payment records under tx:<order>."""
    orders, customer, nation = (model.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.select("o_orderkey", "o_custkey", "o_totalprice").join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(nation.select("n_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    code = F.when(F.col("n_nationkey") % 8 == 0, "NK").when(F.col("n_nationkey") % 8 == 1, "IR").when(F.col("n_nationkey") % 8 == 2, "SY").otherwise("US")
    value = F.format_string('{"amount":%d,"country":"%s"}', F.floor(F.col("o_totalprice") / 5).cast("bigint"), code)
    return rows.select(F.col("o_orderkey").alias("seq"), F.lit("SET").alias("op"), F.concat(F.lit("tx:"), F.col("o_orderkey")).alias("key"), value.alias("value"))


@query("WITH " + PAY_SQL + " SELECT o_orderkey AS seq, amount, country, CAST(score AS INTEGER) AS score, decision FROM s")
def fraud_score(spark, sf_dir):
    return triggers.score(_payments(spark, sf_dir)).select("seq", "amount", "country", F.col("score").cast("int").alias("score"), "decision")


@query("WITH " + PAY_SQL + " SELECT decision, count(*) AS n, sum(amount)::BIGINT AS amount FROM s GROUP BY decision")
def fraud_decision_counts(spark, sf_dir):
    return triggers.score(_payments(spark, sf_dir)).groupBy("decision").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query("WITH " + PAY_SQL + """ SELECT o_orderkey AS seq, 3 AS sub_seq, 'PUBLISH' AS op, NULL AS key, 'BLOCKED: tx:' || o_orderkey || ' score=' || score || ' country=' || country AS value, 'fraud_alerts' AS channel FROM s WHERE decision = 'BLOCKED'
UNION ALL SELECT o_orderkey, CASE WHEN decision = 'BLOCKED' THEN 4 ELSE 3 END, 'SET', 'fraud:tx:' || o_orderkey, '{"score":' || score || ',"decision":"' || decision || '","amount":' || amount || ',"country":"' || country || '"}', NULL FROM s""")
def fraud_effects(spark, sf_dir):
    """Writes and alerts of the scorer, triggered by payments."""
    ops = _payments(spark, sf_dir)
    rules = spark.createDataFrame([("trigger_1", 1, "SET", "tx:*", "fraud", "process"), ("trigger_2", 2, "DEL", "tx:*", "fraud", "process")], model.TRIGGERS)
    return triggers.fraud_effects(triggers.match(ops, rules), ops)


PATTERNS = [("trigger_1", 1, "SET", "user:?", "m", "f"), ("trigger_2", 2, "SET", "user:1*", "m", "g"), ("trigger_3", 3, "DEL", "user:[0-4]*", "m", "f"), ("trigger_4", 4, "EXPIRE", "*", "m", "h"), ("trigger_5", 5, "SET", "user:[", "m", "f"), ("trigger_6", 6, "DEL", "*[^0-9]", "m", "f")]


@query("WITH " + OPS_SQL + r""", t(id, ord, event, rx, module, func) AS (VALUES ('trigger_1', 1, 'SET', 'user:[^/]', 'm', 'f'), ('trigger_2', 2, 'SET', 'user:1[^/]*', 'm', 'g'), ('trigger_3', 3, 'DEL', 'user:[0-4][^/]*', 'm', 'f'), ('trigger_4', 4, 'EXPIRE', '[^/]*', 'm', 'h'), ('trigger_6', 6, 'DEL', '[^/]*[^0-9]', 'm', 'f'))
SELECT seq, key, id AS trigger_id, ord, module, func FROM ops JOIN t ON op = event AND regexp_full_match(key, rx)""")
def trigger_matches(spark, sf_dir):
    return triggers.match(model.ops_from_events(spark, sf_dir), spark.createDataFrame(PATTERNS, model.TRIGGERS))


@query("WITH u AS (SELECT page_id, url FROM pages) SELECT page_id AS seq, url AS key, 'trigger_1' AS trigger_id, 1 AS ord, 'm' AS module, 'f' AS func FROM u WHERE regexp_full_match(url, 'https://[^/]*/en/[^/]*')")
def trigger_matches_paths(spark, sf_dir):
    """Keys with slashes: a star stays inside its part."""
    ops = model.table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.lit("SET").alias("op"), F.col("url").alias("key"))
    return triggers.match(ops, spark.createDataFrame([("trigger_1", 1, "SET", "https://*/en/*", "m", "f")], model.TRIGGERS))


def _registry() -> triggers.Registry:
    out = triggers.Registry(clock=lambda: 1_700_000_000_000_000)
    out.load("m", {"f": lambda key: len(key), "g": lambda key: None, "h": lambda key: 1 // 0})
    out.load("other", {"answer": lambda: 42})
    out.execute("other", "answer")
    return out


@query("WITH " + OPS_SQL + " SELECT seq, 1 AS ord, 'm' AS module, 'f' AS func, CAST(length(key) AS BIGINT) AS result, CAST(NULL AS VARCHAR) AS error FROM ops WHERE op = 'SET' AND regexp_full_match(key, 'user:[^/]') UNION ALL SELECT seq, 4, 'm', 'h', NULL, 'ZeroDivisionError: ' || CASE WHEN TRUE THEN (SELECT 'integer division or modulo by zero') END FROM ops WHERE op = 'EXPIRE' AND key = 'user:7'")
def udf_exec(spark, sf_dir):
    rules = spark.createDataFrame([PATTERNS[0], ("trigger_4", 4, "EXPIRE", "user:7", "m", "h")], model.TRIGGERS)
    return _registry().run(triggers.match(model.ops_from_events(spark, sf_dir), rules))


def _tally(host, key):
    host.set(f"last:{key}", host.get(key) or "")
    host.tx_begin()
    host.set(f"twice:{key}", (host.get(f"last:{key}") or "") * 2)
    host.tx_commit()
    host.publish("changes", key)
    return host.now_ms() % 1000


def _forget(host, key):
    host.delete(f"last:{key}")
    host.tx_begin()
    host.set(f"lost:{key}", host.get("user:1") or "none")
    host.publish("changes", f"-{key}")


_forget.reads = lambda key: ["user:1"]


def _spin(host, key):
    host.set(f"spun:{key}", "1")
    while True:
        pass


EFFECTS = [("trigger_1", 1, "SET", "user:?", "e", "tally"), ("trigger_2", 2, "DEL", "user:[0-4]*", "e", "forget"), ("trigger_3", 3, "DEL", "user:7", "e", "spin"), ("trigger_4", 4, "DEL", "user:7", "e", "nosuch")]
EFFECTS_SQL = """t AS (SELECT * FROM ops WHERE op = 'SET' AND regexp_full_match(key, 'user:[^/]')), g AS (SELECT * FROM ops WHERE op = 'DEL' AND regexp_full_match(key, 'user:[0-4][^/]*')), s AS (SELECT * FROM ops WHERE op = 'DEL' AND key = 'user:7')"""


def _effect_calls(spark, sf_dir) -> tuple[triggers.Registry, DataFrame]:
    ops = model.ops_from_events(spark, sf_dir)
    registry = triggers.Registry(clock=lambda: 1_700_000_000_000_000)
    registry.load("e", {"tally": _tally, "forget": _forget, "spin": _spin})
    return registry, registry.call(triggers.match(ops, spark.createDataFrame(EFFECTS, model.TRIGGERS)), ops)


@query("WITH " + OPS_SQL + ", " + EFFECTS_SQL + """
SELECT seq, 1001 AS sub_seq, 'SET' AS op, 'last:' || key AS key, value, NULL AS channel FROM t UNION ALL SELECT seq, 1003, 'SET', 'twice:' || key, value || value, NULL FROM t UNION ALL SELECT seq, 1005, 'PUBLISH', NULL, key, 'changes' FROM t
UNION ALL SELECT seq, 2001, 'DEL', 'last:' || key, NULL, NULL FROM g UNION ALL SELECT seq, 2004, 'PUBLISH', NULL, '-' || key, 'changes' FROM g UNION ALL SELECT seq, 3001, 'SET', 'spun:' || key, '1', NULL FROM s""")
def udf_effects(spark, sf_dir):
    """Writes, deletes and messages of functions, committed or not, cut short or not."""
    return triggers.effects(_effect_calls(spark, sf_dir)[1])


@query("WITH " + OPS_SQL + ", " + EFFECTS_SQL + """
SELECT 'tally' AS func, count(*) AS n, sum(ts_us // 1000 % 1000)::BIGINT AS total, NULL AS error FROM t HAVING count(*) > 0 UNION ALL SELECT 'forget', count(*), NULL, NULL FROM g HAVING count(*) > 0
UNION ALL SELECT 'spin', count(*), NULL, 'DeadlineError: more than 10 ms' FROM s HAVING count(*) > 0 UNION ALL SELECT 'nosuch', count(*), NULL, 'KeyError: (''e'', ''nosuch'')' FROM s HAVING count(*) > 0""")
def udf_results(spark, sf_dir):
    return _effect_calls(spark, sf_dir)[1].groupBy("func", "error").agg(F.count("*").alias("n"), F.sum("result").alias("total"))


@query("WITH " + OPS_SQL + ", " + EFFECTS_SQL + " SELECT 'e' AS name, 1700000000000000 AS loaded_at_us, (SELECT count(*) FROM t) + (SELECT count(*) FROM g) + (SELECT count(*) FROM s) AS exec_count")
def udf_counts(spark, sf_dir):
    """A module's count of calls after its triggers fired."""
    registry, calls = _effect_calls(spark, sf_dir)
    registry.record(calls)
    return registry.list(spark)


@query("SELECT * FROM (VALUES ('m', 1700000000000000, 0::BIGINT), ('other', 1700000000000000, 1::BIGINT)) v(name, loaded_at_us, exec_count)")
def module_list(spark, sf_dir):
    return _registry().list(spark)


# ------------------------------------------------------------- subscriptions

PS_SQL = """e AS (SELECT event_id AS seq, user_id AS conn, 'ch' || (event_id % 8) AS channel, event_type FROM events),
l AS (SELECT *, CASE event_type WHEN 'signup' THEN 'S' ELSE 'U' END AS op FROM e WHERE event_type IN ('signup', 'error')),
c AS (SELECT *, coalesce(lag(op) OVER (PARTITION BY conn, channel ORDER BY seq), 'U') AS was FROM l),
d AS (SELECT conn, channel, seq, op FROM c WHERE op <> was),
i AS (SELECT * FROM (SELECT *, lead(seq) OVER (PARTITION BY conn, channel ORDER BY seq) AS to_seq FROM d) WHERE op = 'S'),
m AS (SELECT seq, channel FROM e WHERE event_type = 'purchase'),
f AS (SELECT m.seq, m.channel, count(DISTINCT i.conn) AS delivered FROM m LEFT JOIN i ON m.channel = i.channel AND m.seq > i.seq AND (i.to_seq IS NULL OR m.seq < i.to_seq) GROUP BY ALL)"""


def _pubsub(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = model.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("conn"), F.concat(F.lit("ch"), F.col("event_id") % 8).alias("channel"), "event_type")
    op = F.when(F.col("event_type") == "signup", "SUBSCRIBE").otherwise("UNSUBSCRIBE")
    return rows.filter(F.col("event_type").isin("signup", "error")).select("seq", "conn", op.alias("op"), "channel"), rows.filter("event_type = 'purchase'").select("seq", "channel")


@query("WITH " + PS_SQL + " SELECT seq, channel, delivered FROM f")
def pubsub_delivered(spark, sf_dir):
    return pubsub.delivered(*_pubsub(spark, sf_dir))


@query("WITH " + PS_SQL + " SELECT count(*) AS published, sum(delivered)::BIGINT AS received, count(*) * 100 AS expected, sum(delivered) * 100.0 / (count(*) * 100) AS rate FROM f")
def pubsub_rate(spark, sf_dir):
    return stats.delivery_rate(pubsub.delivered(*_pubsub(spark, sf_dir)), 100)


@query("WITH " + PS_SQL + " SELECT m.channel, count(*) AS n, min(m.seq) AS first_seq, count(DISTINCT i.conn) AS conns FROM m JOIN i ON m.channel = i.channel AND m.seq > i.seq AND (i.to_seq IS NULL OR m.seq < i.to_seq) GROUP BY m.channel")
def pubsub_fanout(spark, sf_dir):
    return pubsub.fanout(*_pubsub(spark, sf_dir))


@query("WITH " + PS_SQL + ", u AS (SELECT conn, seq, CASE op WHEN 'S' THEN 1 ELSE -1 END AS delta FROM d) SELECT l.seq, l.conn, l.channel, (SELECT sum(delta) FROM u WHERE u.conn = l.conn AND u.seq <= l.seq)::BIGINT AS channels FROM l WHERE op = 'S'")
def pubsub_confirmations(spark, sf_dir):
    return pubsub.confirmations(_pubsub(spark, sf_dir)[0])


@query("WITH " + PS_SQL + ", r AS (SELECT i.conn, m.seq, row_number() OVER (PARTITION BY i.conn ORDER BY m.seq) AS n FROM m JOIN i ON m.channel = i.channel AND m.seq > i.seq AND (i.to_seq IS NULL OR m.seq < i.to_seq)) SELECT conn, min(seq) AS seq FROM r WHERE n > 20 GROUP BY conn")
def pubsub_overflows(spark, sf_dir):
    """Connections that never read, with a buffer of 20."""
    never = spark.createDataFrame([], "conn bigint, seq bigint")
    return pubsub.first_overflows(*_pubsub(spark, sf_dir), never, 20)


@query("WITH " + PS_SQL + ", r AS (SELECT i.conn, m.seq, row_number() OVER (PARTITION BY i.conn ORDER BY m.seq) AS n FROM m JOIN i ON m.channel = i.channel AND m.seq > i.seq AND (i.to_seq IS NULL OR m.seq < i.to_seq)) SELECT m.seq, m.channel, count(r.conn) AS delivered FROM m LEFT JOIN r ON r.seq = m.seq AND r.n <= 20 GROUP BY ALL")
def pubsub_backpressure(spark, sf_dir):
    """Counts where connections never read and end with the 21st message."""
    log, messages = _pubsub(spark, sf_dir)
    never = spark.createDataFrame([], "conn bigint, seq bigint")
    return pubsub.delivered_to_readers(log, messages, never, 20)


@query("WITH " + PS_SQL + ", x AS (SELECT *, count(*) FILTER (op = 'U') OVER (PARTITION BY conn ORDER BY seq) AS ends FROM l), y AS (SELECT conn, channel, ends, min(seq) AS seq FROM x WHERE op = 'S' GROUP BY ALL), z AS (SELECT y.*, (SELECT min(seq) FROM x WHERE x.conn = y.conn AND x.op = 'U' AND x.seq > y.seq) AS to_seq FROM y) SELECT m.seq, m.channel, count(DISTINCT z.conn) AS delivered FROM m LEFT JOIN z ON m.channel = z.channel AND m.seq > z.seq AND (z.to_seq IS NULL OR m.seq < z.to_seq) GROUP BY ALL")
def pubsub_unsubscribe_all(spark, sf_dir):
    """Leaving every channel at once: by name of none, or by the connection's end."""
    log, messages = _pubsub(spark, sf_dir)
    gone = F.col("op") == "UNSUBSCRIBE"
    log = log.withColumn("channel", F.when(~gone, F.col("channel"))).withColumn("op", F.when(gone & (F.col("seq") % 2 == 0), "CLOSE").otherwise(F.col("op")))
    return pubsub.delivered(log, messages)


# -------------------------------------------------------------- transactions

TX_SQL = """c AS (SELECT conv_id AS conn, turn AS seq, CASE WHEN turn % 5 = 1 THEN 'MULTI' WHEN turn % 5 = 4 AND conv_id % 3 = 0 THEN 'DISCARD' WHEN turn % 5 = 4 AND conv_id % 3 = 1 THEN 'EXEC' WHEN role = 'user' THEN 'SET' ELSE 'GET' END AS cmd FROM conversations),
a AS (SELECT *, coalesce(last_value(CASE WHEN cmd IN ('MULTI', 'EXEC', 'DISCARD') THEN cmd END IGNORE NULLS) OVER (PARTITION BY conn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'MULTI', FALSE) AS inside FROM c),
b AS (SELECT *, sum(CASE WHEN cmd = 'MULTI' AND NOT inside THEN 1 ELSE 0 END) OVER (PARTITION BY conn ORDER BY seq) AS tx_no, inside AND cmd NOT IN ('MULTI', 'EXEC', 'DISCARD') AS queued FROM a),
g AS (SELECT *, max(CASE WHEN cmd IN ('EXEC', 'DISCARD') AND inside THEN seq END) OVER (PARTITION BY conn, tx_no) AS end_seq, max(CASE WHEN cmd IN ('EXEC', 'DISCARD') AND inside THEN cmd END) OVER (PARTITION BY conn, tx_no) AS end_cmd, sum(CASE WHEN queued THEN 1 ELSE 0 END) OVER (PARTITION BY conn, tx_no ORDER BY seq) AS pos FROM b),
h AS (SELECT conn, seq, cmd, CASE WHEN inside OR cmd = 'MULTI' THEN CAST(tx_no AS BIGINT) END AS tx,
 CASE WHEN cmd = 'MULTI' AND inside THEN '-ERR MULTI calls can not be nested' WHEN cmd = 'MULTI' THEN '+OK' WHEN cmd = 'EXEC' AND NOT inside THEN '-ERR EXEC without MULTI' WHEN cmd = 'DISCARD' AND NOT inside THEN '-ERR DISCARD without MULTI' WHEN cmd = 'DISCARD' THEN '+OK' WHEN cmd = 'EXEC' THEN '*' WHEN queued THEN '+QUEUED' END AS status,
 CASE WHEN queued THEN coalesce(end_cmd, 'LOST') WHEN cmd NOT IN ('MULTI', 'EXEC', 'DISCARD') THEN 'RUN' END AS outcome, queued, end_seq, pos FROM g),
r AS (SELECT conn, seq, cmd, tx, status, outcome, CASE WHEN outcome = 'RUN' THEN seq WHEN outcome = 'EXEC' THEN end_seq END AS exec_seq, CAST(CASE WHEN outcome = 'RUN' THEN 0 WHEN outcome = 'EXEC' THEN pos END AS BIGINT) AS position FROM h)"""


def _session(spark, sf_dir) -> DataFrame:
    turn = F.col("turn") % 5
    cmd = F.when(turn == 1, "MULTI").when((turn == 4) & (F.col("conv_id") % 3 == 0), "DISCARD").when((turn == 4) & (F.col("conv_id") % 3 == 1), "EXEC").when(F.col("role") == "user", "SET").otherwise("GET")
    return model.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conn"), F.col("turn").alias("seq"), cmd.alias("cmd"))


@query("WITH " + TX_SQL + " SELECT * FROM r")
def tx_resolve(spark, sf_dir):
    return transactions.resolve(_session(spark, sf_dir))


@query("WITH " + TX_SQL + " SELECT conn, seq, cmd, exec_seq, position FROM r WHERE outcome IN ('RUN', 'EXEC')")
def tx_effective_ops(spark, sf_dir):
    return transactions.effective(_session(spark, sf_dir))


@query("WITH " + TX_SQL + " SELECT conn, exec_seq, string_agg(cmd || seq, ' ' ORDER BY position) AS replies FROM r WHERE outcome = 'EXEC' GROUP BY conn, exec_seq")
def tx_exec_replies(spark, sf_dir):
    session = _session(spark, sf_dir)
    told = session.select("conn", "seq", F.concat("cmd", F.col("seq").cast("string")).alias("reply"))
    return transactions.exec_replies(transactions.resolve(session), told).withColumn("replies", F.array_join("replies", " "))


# ---------------------------------------------------------------- statistics


@query("WITH g AS (SELECT event_type AS op, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS us FROM events), s AS (SELECT op, list_sort(list(us)) AS v, count(*) AS n FROM g WHERE us IS NOT NULL GROUP BY op) SELECT op, n, v[n * 50 // 100 + 1] AS p50, v[n * 95 // 100 + 1] AS p95, v[n * 99 // 100 + 1] AS p99 FROM s")
def latency_percentiles(spark, sf_dir):
    """Gaps between a user's events as latencies."""
    from pyspark.sql import Window

    rows = model.table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), "user_id", "event_id", F.expr(model.MICROS.format("ts")).alias("t"))
    gaps = rows.withColumn("us", F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("event_id")))
    return stats.index_percentiles(gaps, "us", ["op"])


@query("SELECT event_type AS op, count(*) AS n, max(epoch_us(ts)) - min(epoch_us(ts)) AS elapsed_us, CASE WHEN max(ts) > min(ts) THEN count(*) * 1e6 / (max(epoch_us(ts)) - min(epoch_us(ts))) END AS per_second FROM events GROUP BY 1")
def throughput(spark, sf_dir):
    rows = model.table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), F.expr(model.MICROS.format("ts")).alias("t"))
    return stats.throughput(rows, "t", ["op"])


@query("SELECT l_orderkey, l_quantity AS quantity, l_linenumber AS last_line FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1")
def upsert_lines(spark, sf_dir):
    """A large upsert log: the last line of each order wins."""
    rows = model.table(spark, sf_dir, "lineitem")
    last = rows.groupBy("l_orderkey").agg(F.max(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("x"))
    return last.select("l_orderkey", F.col("x.l_quantity").alias("quantity"), F.col("x.l_linenumber").alias("last_line"))


# --------------------------------------------------- log files and protocols


@query(REPLAY_SQL + " SELECT key, value, expires_at_us FROM kv")
def wal_roundtrip(spark, sf_dir):
    """Write the log as binary files, read them back, replay."""
    ops, folder = model.ops_from_events(spark, sf_dir), work_dir(spark)
    wal.write_ops(ops, folder, files=4)
    return state.replay(wal.read_ops(spark, folder), model.last_instant(ops)).drop("last_seq")


@query(REPLAY_SQL + " SELECT key, value, expires_at_us FROM kv")
def wal_compact(spark, sf_dir):
    """The same after compacting the folder to a snapshot."""
    ops, folder = model.ops_from_events(spark, sf_dir), work_dir(spark)
    as_of = model.last_instant(ops)
    wal.write_ops(ops, folder, files=4)
    wal.compact(spark, folder, as_of)
    return state.replay(wal.read_ops(spark, folder), as_of).drop("last_seq")


@query(REPLAY_SQL + " SELECT key, value, expires_at_us FROM kv")
def wal_append_twice(spark, sf_dir):
    """The log in two appends of different numbers of files."""
    ops, folder = model.ops_from_events(spark, sf_dir), work_dir(spark)
    half = ops.agg(F.max("seq")).first()[0] // 2
    wal.write_ops(ops.filter(F.col("seq") <= half), folder, files=5)
    wal.write_ops(ops.filter(F.col("seq") > half), folder, files=2)
    return state.replay(wal.read_ops(spark, folder), model.last_instant(ops)).drop("last_seq")


@query(REPLAY_SQL + " SELECT key, value, expires_at_us FROM kv")
def wal_rotate(spark, sf_dir):
    """A snapshot of half of the log in several files, and what was appended since."""
    ops, folder = model.ops_from_events(spark, sf_dir), work_dir(spark)
    as_of, half = model.last_instant(ops), ops.agg(F.max("seq")).first()[0] // 2
    wal.write_ops(ops.filter(F.col("seq") <= half), folder, files=3)
    kept = state.compact(wal.read_ops(spark, folder), 1 << 62, as_of).withColumn("seq", F.col("seq") * 2 + F.col("sub"))
    closed = [p for p in wal.rotate(folder)]
    wal.write_ops(kept, folder, snapshot=True, files=3)
    wal.write_ops(ops.filter(F.col("seq") > half), folder, files=2)
    for p in closed:
        os.unlink(p)
    return state.replay(wal.read_ops(spark, folder), as_of).drop("last_seq")


@query("WITH " + OPS_SQL + " SELECT seq, 'SET ' || key || ' ' || value AS line, CAST(NULL AS VARCHAR) AS err FROM ops WHERE op = 'SET'")
def resp_roundtrip(spark, sf_dir):
    ops = model.ops_from_events(spark, sf_dir).filter("op = 'SET'")
    raw = ops.select("seq", resp.command(F.array(F.lit("SET"), "key", "value")).alias("raw"))
    return resp.decode_commands(raw).select("seq", F.array_join("args", " ").alias("line"), "err")


@query("""WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS k, text IS NULL OR length(text) = 0 AS blank, octet_length(encode(text)) AS n FROM conversations)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'SET|a|b' WHEN 1 THEN 'GET|k|42' WHEN 2 THEN 'PING' END AS line, CASE k WHEN 3 THEN 'not a number: b''1_0''' WHEN 4 THEN 'bad length' WHEN 5 THEN 'unexpected end' END AS err FROM c""")
def resp_errors(spark, sf_dir):
    """Commands in plain words, integers in a command, and what no parser takes."""
    raw = F.element_at(F.array(*map(F.lit, ("SET a b\r\n", "*3\r\n$3\r\nGET\r\n$1\r\nk\r\n:42\r\n", "*1\r\n$4\r\nPING\r\n", "*1_0\r\n", "*1\r\n$9\r\nshort\r\n", "*2\r\n$4\r\nPING\r\n"))), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    rows = model.table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw"))
    return resp.decode_commands(rows).select("conv_id", "turn", F.array_join("args", "|").alias("line"), "err")


@query("SELECT 'trigger_' || (n_nationkey + 1) AS id, CAST(n_nationkey + 1 AS INTEGER) AS ord, 'SET' AS event, n_name || ':*' AS pattern, 'm' AS module, 'f' AS func FROM nation")
def trigger_file(spark, sf_dir):
    """A registry written to a folder and read back: its triggers, by number."""
    from keytide.sources import registry_files

    registry, folder = triggers.Registry(), work_dir(spark)
    for r in model.table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        registry.add_trigger("set", f"{r.n_name}:*", "m", "f")
    registry_files.save(registry, folder, {"m": "def f(key):\n    return len(key)\n"})
    back = registry_files.restore(folder)
    if back.execute("m", "f", "four") != 4:
        raise ValueError("the module isn't the one saved")
    return registry_files.read_triggers(spark, f"{folder}/triggers.json").join(back.trigger_table(spark).select("id"), "id", "left_semi")


# ------------------------------------------------------ streams and replicas


def _log_folder(spark, sf_dir) -> tuple[str, DataFrame]:
    """The operation log as a folder of files for a stream to read in order."""
    from keytide.streaming import kv

    folder = work_dir(spark)
    ops = model.ops_from_events(spark, sf_dir)
    kv.write_log(ops, f"{folder}/log")
    return folder, ops


@query("WITH " + OPS_SQL + ", w AS (SELECT * FROM ops WHERE op IN ('SET', 'DEL')) SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value, max(seq) AS seq FROM w GROUP BY key")
def stream_kv_availablenow(spark, sf_dir):
    from keytide.streaming import kv

    folder, ops = _log_folder(spark, sf_dir)
    return kv.current(kv.run_to_files(kv.last_writes(kv.read_log(spark, f"{folder}/log", ops.schema, 1)), f"{folder}/state"))


@query("WITH " + OPS_SQL + ", w AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM ops WHERE op IN ('SET', 'DEL') GROUP BY key) SELECT key, value FROM w WHERE op = 'SET'")
def stream_replica(spark, sf_dir):
    """A copy at half of the log and the stream of the rest."""
    from keytide.streaming import kv

    folder, ops = _log_folder(spark, sf_dir)
    half = ops.agg(F.max("seq")).first()[0] // 2
    return kv.replica(kv.read_log(spark, f"{folder}/log", ops.schema), half, f"{folder}/state", replication.full_sync(ops, half))


@query(SQL["kv_live"])
def stream_kv_live(spark, sf_dir):
    """The state processor with expiry over the log as a stream of files."""
    from keytide.streaming import kv

    folder, ops = _log_folder(spark, sf_dir)
    as_of = model.last_instant(ops)
    rows = kv.run_to_files(kv.live_states(kv.read_log(spark, f"{folder}/log", ops.schema, 1)), f"{folder}/state", "append")
    last = rows.groupBy("key").agg(F.max(F.struct("seq", "exists", "value", "expires_at_us")).alias("e")).filter("e.exists")
    return state.visible(last.select("key", "e.value", "e.expires_at_us", F.col("e.seq").alias("last_seq")), as_of)


@query("WITH " + OPS_SQL + ", h AS (SELECT max(seq) // 2 AS half FROM ops), c AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM ops, h WHERE op IN ('SET', 'DEL') AND seq <= half GROUP BY key) SELECT 1::BIGINT AS ord, 'SET ' || key || ' ' || value AS value FROM c WHERE op = 'SET' UNION ALL SELECT seq + 3, CASE op WHEN 'SET' THEN 'SET ' || key || ' ' || value ELSE 'DEL ' || key END FROM ops, h WHERE op IN ('SET', 'DEL') AND seq > half UNION ALL SELECT 0, '+FULLSYNC' UNION ALL SELECT 2, '+FULLSYNC_DONE'")
def replica_session(spark, sf_dir):
    ops = model.ops_from_events(spark, sf_dir)
    return replication.session(ops, ops.agg(F.max("seq")).first()[0] // 2)


@query("WITH " + OPS_SQL + ", w AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM ops WHERE op IN ('SET', 'DEL') GROUP BY key) SELECT key, value FROM w WHERE op = 'SET'")
def replica_sync(spark, sf_dir):
    ops = model.ops_from_events(spark, sf_dir)
    half = ops.agg(F.max("seq")).first()[0] // 2
    copy = replication.parse_lines(replication.lines(replication.full_sync(ops, half))).select("key", "value")
    return replication.apply(copy, replication.forwarded(ops, half))
