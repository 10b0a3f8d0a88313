import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from keytide import model
from keytide.operators import cluster, pubsub, transactions, triggers
from keytide.streaming import kv as streaming


def tx(spark, *cmds):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(cmds)], "conn bigint, seq bigint, cmd string")
    return {r.seq: (r.status, r.outcome, r.exec_seq, r.position) for r in transactions.resolve(df).collect()}


def test_transactions(spark):
    got = tx(spark, "get", "MULTI", "SET", "multi", "GET", "EXEC", "EXEC", "DISCARD", "MULTI", "SET", "DISCARD", "MULTI", "SET")
    assert got[0] == (None, "RUN", 0, 0) and got[1][0] == "+OK" and got[2] == ("+QUEUED", "EXEC", 5, 1)
    assert got[3][0] == "-ERR MULTI calls can not be nested" and got[4] == ("+QUEUED", "EXEC", 5, 2) and got[5][0] == "*"
    assert got[6][0] == "-ERR EXEC without MULTI" and got[7][0] == "-ERR DISCARD without MULTI"
    assert got[9] == ("+QUEUED", "DISCARD", None, None) and got[12] == ("+QUEUED", "LOST", None, None)


def test_module_effects(spark):
    calls = [("kv_set", "a"), ("tx_begin", None), ("kv_set", "b"), ("kv_del", "c"), ("publish", "d"), ("tx_commit", None), ("tx_begin", None), ("kv_set", "e"), ("kv_del", "f")]
    df = spark.createDataFrame([(1, n, k, x, None) for n, (k, x) in enumerate(calls)], "call_id bigint, n int, kind string, key string, value string")
    assert {r.key for r in transactions.module_effects(df).collect()} == {"a", "b", "c", "d", "f"}


def test_pubsub_agrees_with_a_simulation(spark):
    rng = random.Random(4)
    log, messages, subs, want, confirm = [], [], {}, {}, {}
    for i in range(800):
        conn, ch = rng.randrange(12), f"c{rng.randrange(3)}"
        kind = rng.choice(["SUBSCRIBE", "SUBSCRIBE", "UNSUBSCRIBE", "ALL", "CLOSE", "PUBLISH", "PUBLISH"])
        if kind == "PUBLISH":
            messages.append((i, ch))
            want[i] = {c for c, s in subs.items() if ch in s}
        elif kind == "SUBSCRIBE":
            log.append((i, conn, kind, ch))
            subs.setdefault(conn, set()).add(ch)
            confirm[i] = len(subs[conn])
        elif kind == "UNSUBSCRIBE":
            log.append((i, conn, kind, ch))
            subs.get(conn, set()).discard(ch)
        else:
            log.append((i, conn, "UNSUBSCRIBE" if kind == "ALL" else kind, None))
            subs.pop(conn, None)
    ldf = spark.createDataFrame(log, "seq bigint, conn bigint, op string, channel string")
    mdf = spark.createDataFrame(messages, "seq bigint, channel string")
    assert {r.seq: r.delivered for r in pubsub.delivered(ldf, mdf).collect()} == {k: len(v) for k, v in want.items()}
    rows = pubsub.deliveries(ldf, mdf)
    assert {(r.seq, r.conn) for r in rows.collect()} == {(k, c) for k, v in want.items() for c in v}
    assert {r.seq: r.channels for r in pubsub.confirmations(ldf).collect()} == confirm
    held, first = {}, {}
    for k in sorted(want):
        for c in want[k]:
            held[c] = held.get(c, 0) + 1
            if held[c] > 30:
                first.setdefault(c, k)
    got = pubsub.overflows(rows.select("conn", "seq"), rows.select("conn", "seq").filter("false"), 30)
    assert {r.conn: r.seq for r in got.collect()} == first


def test_overflows_and_fanout_make_few_deliveries(spark):
    """Connections that read some, ends of intervals at a message's own seq, and
    a plan without the join of every message and every connection."""
    rng = random.Random(9)
    log, messages, reads = [], [], []
    for i in range(1500):
        kind = rng.choice(["SUBSCRIBE", "SUBSCRIBE", "UNSUBSCRIBE", "PUBLISH", "PUBLISH", "READ"])
        conn, ch = rng.randrange(10), f"c{rng.randrange(4)}"
        if kind == "READ":
            reads.append((conn, i))
        elif kind == "PUBLISH":
            messages.append((i, ch))
        else:
            log.append((i, conn if conn else None, kind, ch))
            if rng.random() < 0.2:
                messages.append((i, ch))
    ldf = spark.createDataFrame(log, "seq bigint, conn bigint, op string, channel string")
    mdf, rdf = spark.createDataFrame(messages, "seq bigint, channel string"), spark.createDataFrame(reads, "conn bigint, seq bigint")
    rows = pubsub.deliveries(ldf, mdf).cache()
    want = rows.groupBy("channel").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.countDistinct("conn").alias("conns"))
    assert sorted(pubsub.fanout(ldf, mdf).collect()) == sorted(want.collect())
    heard = {(r.seq, r.channel): r.n for r in rows.filter("conn is not null").groupBy("seq", "channel").agg(F.count("*").alias("n")).collect()}
    named = ldf.filter("conn is not null")
    assert {(r.seq, r.channel): r.delivered for r in pubsub.delivered(named, mdf).collect() if r.delivered} == heard
    for buffer, read in ((0, rdf), (3, rdf), (3, rdf.filter("false")), (40, rdf)):
        want = {r.conn: r.seq for r in pubsub.overflows(rows.select("conn", "seq"), read, buffer).collect()}
        assert {r.conn: r.seq for r in pubsub.first_overflows(ldf, mdf, read, buffer).collect()} == want and want


@pytest.mark.parametrize("name", ["pubsub_overflows", "pubsub_backpressure", "pubsub_fanout"])
def test_pubsub_rows_grow_with_the_log(spark, tmp_path, name):
    """100 connections on one channel all along, 3,000 messages: 300,000 deliveries."""
    from keytide.plans import catalog

    i = F.col("id")
    kind = F.when(i < 100, "signup").otherwise("purchase")
    spark.range(3_100).select((i * 8).alias("event_id"), (i % 100).alias("user_id"), kind.alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    df.collect()
    made, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kids = [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if p.nodeName().endswith("QueryStage") else [p.children().apply(k) for k in range(p.children().size())]
        todo += kids
        if p.metrics().contains("numOutputRows"):
            made = max(made, p.metrics().apply("numOutputRows").value())
    assert 0 < made < 30_000


def nodes(spark, *rows):
    return spark.createDataFrame([(i, a, s, r, m, p, x) for i, a, s, r, m, p, x in rows], model.NODES)


def test_topology(spark):
    df = nodes(spark, ("a", "h1:1", "ONLINE", "master", None, 0, [(0, 9), (11, 11)]), ("b", "h2", "FAIL", "master", None, 0, [(5, 20)]), ("r", "h3:3:3", "ONLINE", "replica", "b", 0, []))
    assert {(r.start, r.end, r.id) for r in cluster.slots_report(df).collect()} == {(0, 9, "a"), (10, 10, "b"), (11, 11, "a"), (12, 20, "b")}
    assert {(r.host, r.port) for r in cluster.slots_report(df).collect()} == {("h1", 1), ("h2", 0)}
    assert {r.line for r in cluster.nodes_report(df, "b").collect()} == {"a h1:1 online 0-9,11", "b h2 myself,fail 5-20", "r h3:3:3 online -"}
    info = cluster.info(df).first()
    assert (info.state, info.slots_assigned, info.known_nodes, info.size) == ("fail", 21, 3, 2)
    after = {r.id: r for r in cluster.failover(df).collect()}
    assert after["b"].slots == [] and [tuple(s) for s in after["r"].slots] == [(5, 20)] and after["r"].role == "master"
    whole = nodes(spark, ("a", "h:1", "ONLINE", "master", None, 0, [(0, 16383)]))
    assert cluster.info(whole).first().state == "ok"


def test_membership(spark):
    df = nodes(spark, ("a", "h1:1", "ONLINE", "master", None, 0, [(0, 9)]))
    asked = spark.createDataFrame([("x", "h1:1", 1, 2), ("y", "h2:2", 10, 20), ("z", "h3:3", -1, -1), ("w", "h4:4", 5, 16384)], "id string, addr string, start int, end int")
    met = {r.id: [tuple(s) for s in r.slots] for r in cluster.meet(df, asked).collect()}
    assert met == {"a": [(0, 9)], "y": [(10, 20)], "z": [], "w": []}
    assert cluster.replicate(cluster.meet(df, asked), "y", "a").filter("id = 'y'").first().role == "replica"
    assert cluster.replicate(df, "a", "nosuch").first().role == "master"
    quiet = nodes(spark, ("me", "h:1", "ONLINE", "master", None, 0, []), ("p", "h:2", "ONLINE", "master", None, 89_999_999, []), ("q", "h:3", "ONLINE", "master", None, 90_000_000, []), ("f", "h:4", "PFAIL", "master", None, 69_999_999, []), ("g", "h:5", "FAIL", "master", None, 80_000_000, []))
    assert {r.id: r.state for r in cluster.detect_failures(quiet, 100_000_000, "me").collect()} == {"me": "ONLINE", "p": "PFAIL", "q": "ONLINE", "f": "FAIL", "g": "FAIL"}


def test_setslot(spark):
    df = nodes(spark, ("a", "h:1", "ONLINE", "master", None, 0, [(0, 3)]), ("b", "h:2", "ONLINE", "master", None, 0, []))
    log = [(1, 0, "migrating", "b"), (2, 1, "MIGRATING", "b"), (3, 1, "NODE", "b"), (4, 1, "MIGRATING", "b"), (5, 2, "IMPORTING", "b"), (6, 3, "MIGRATING", "zz"), (7, 99999, "NODE", "b"), (8, 3, "bogus", "b"), (9, 2, "NODE", "a")]
    out = cluster.setslot(cluster.slot_table(df).select("slot", "id"), spark.createDataFrame(log, "seq bigint, slot int, action string, node string"), df, "a")
    assert {r.slot: (r.id, r.migrating_to, r.importing_from) for r in out.collect()} == {0: ("a", "b", None), 1: ("b", None, None), 2: ("a", None, None), 3: ("a", None, None)}


def test_migrate_follows_holders(spark):
    kv = spark.createDataFrame([("a", "k", "v"), ("a", "s", "w")], "node string, key string, value string")
    moves = spark.createDataFrame([(1, "k", "a", "b"), (2, "k", "a", "c"), (3, "k", "b", "d")], "seq bigint, key string, source string, target string")
    assert {tuple(r) for r in cluster.migrate(kv, moves).collect()} == {("d", "k", "v"), ("a", "s", "w")}


def test_triggers_and_registry(spark):
    reg = triggers.Registry()
    reg.load("m", {"f": lambda key: len(key)})
    assert reg.add_trigger("SET", "a*", "m", "f") == "trigger_1" and reg.add_trigger("SET", "*", "gone", "f") == "trigger_2"
    assert reg.add_trigger("DEL", "[", "m", "f") == "trigger_3" and reg.remove_trigger("trigger_3") and not reg.remove_trigger("trigger_3")
    ops = spark.createDataFrame([(1, "SET", "abc"), (2, "SET", "b"), (3, "DEL", "abc"), (4, "SET", "a/b")], "seq bigint, op string, key string")
    fired = triggers.match(ops, reg.trigger_table(spark))
    assert {(r.seq, r.trigger_id) for r in fired.collect()} == {(1, "trigger_1"), (1, "trigger_2"), (2, "trigger_2")}
    ran = {(r.seq, r.ord): (r.result, r.error is None) for r in reg.run(fired).collect()}
    assert ran == {(1, 1): (3, True), (1, 2): (None, False), (2, 2): (None, False)}
    assert "module:m" in reg.info("m") and reg.list(spark).count() == 1
    reg.drop("m")
    assert reg.list(spark.getActiveSession()).count() == 0 if reg.modules else not reg.modules


def test_no_trigger_matches_nothing(spark):
    ops = spark.createDataFrame([(1, "SET", "a")], "seq bigint, op string, key string")
    assert triggers.match(ops, spark.createDataFrame([], model.TRIGGERS)).count() == 0


def test_stream_of_states(spark, tmp_path):
    from folds import live

    rng = random.Random(6)
    ops = [{"seq": i, "ts_us": i * 3, "op": rng.choice(["SET", "DEL", "EXPIRE", "PERSIST"]), "key": f"k{rng.randrange(4)}", "value": f"v{i}", "exp_us": i * 3 + rng.randrange(1, 40)} for i in range(120)]
    schema = "seq bigint, ts_us bigint, op string, key string, value string, exp_us bigint"
    for part in range(3):
        rows = [tuple(o.values()) for o in ops[part * 40 : part * 40 + 40]]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = streaming.live_states(streaming.read_log(spark, f"{tmp_path}/log", schema, 1))
    out = streaming.run_to_files(stream, f"{tmp_path}/cp", "append")
    last = {r.key: r.e for r in out.groupBy("key").agg(F.max(F.struct("seq", "exists", "value", "expires_at_us")).alias("e")).collect()}
    got = {k: (e.value, e.expires_at_us) for k, e in last.items() if e.exists and (e.expires_at_us is None or e.expires_at_us > 400)}
    assert got == live(ops, 400)


def test_a_log_folder_streams_in_the_order_of_the_log(spark, tmp_path, monkeypatch):
    """The first range takes longest to write, so its file is the last to be done."""
    from folds import live

    from keytide.plans import catalog

    seq = F.col("id")
    long = F.when(seq < 100, F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8000)), lambda i: F.sha2(F.concat_ws("-", seq, i), 256)), "")).otherwise(F.concat(F.lit("v"), seq))
    op = F.when(seq % 4 == 3, "EXPIRE").when(seq < 100, "SET").otherwise("PERSIST")
    rows = spark.range(400).select(seq.alias("seq"), (seq % 16).alias("conn"), (seq * 3).alias("ts_us"), op.alias("op"), F.concat(F.lit("k"), seq % 7).alias("key"), long.alias("value"), (seq * 3 + 2_000).alias("exp_us"))
    rows.write.parquet(f"{tmp_path}/ops")
    ops = spark.read.parquet(f"{tmp_path}/ops")
    monkeypatch.setattr(model, "ops_from_events", lambda spark, sf_dir: ops)
    folder, _ = catalog._log_folder(spark, "")
    files = sorted((f for f in Path(folder, "log").iterdir() if f.name.startswith("part-")), key=lambda f: f.stat().st_mtime_ns)
    spans = [spark.read.parquet(f"file://{f}").agg(F.min("seq"), F.max("seq")).first() for f in files]
    assert len(files) == 4 and sorted(spans) == spans and len({int(f.stat().st_mtime) for f in files}) == 4
    got = {r.key: (r.value, r.expires_at_us) for r in catalog.stream_kv_live(spark, "").collect()}
    assert got == live([r.asDict() for r in ops.collect()], 399 * 3) and len(got) == 7


def test_functions_read_as_of_their_operation(spark):
    def reader(host, key):
        host.tx_begin()
        host.set("sum", (host.get("a") or "-") + (host.get("b") or "-"))
        assert host.get("sum") is None
        host.tx_commit()
        return len(host.get("sum"))

    reader.reads = lambda key: ["a", "b"]

    def sleeper(host, key):
        import time

        host.publish("c", "before")
        time.sleep(30)

    ops = spark.createDataFrame([(1, 10, "SET", "a", "1"), (2, 20, "SET", "x", "?"), (3, 30, "SET", "b", "22"), (4, 40, "DEL", "a", None), (5, 50, "SET", "x", "?"), (6, None, "DEL", "y", None)], "seq bigint, ts_us bigint, op string, key string, value string")
    reg = triggers.Registry()
    reg.load("m", {"r": reader, "s": sleeper})
    reg.add_trigger("SET", "x", "m", "r")
    reg.add_trigger("DEL", "y", "m", "s")
    calls = reg.call(triggers.match(ops, reg.trigger_table(spark)), ops, deadline_ms=5).cache()
    assert {(r.seq, r.result, (r.error or "")[:13]) for r in calls.collect()} == {(2, 2, ""), (5, 3, ""), (6, None, "DeadlineError")}
    assert {(r.seq, r.sub_seq, r.op, r.key, r.value, r.channel) for r in triggers.effects(calls).collect()} == {(2, 1002, "SET", "sum", "1-", None), (5, 1002, "SET", "sum", "-22", None), (6, 2001, "PUBLISH", None, "before", "c")}
    reg.record(calls)
    assert reg.modules["m"].exec_count == 3


def test_node_tables_are_counted_before_they_are_broadcast(spark, monkeypatch):
    import pytest

    with pytest.raises(ValueError, match="more than 3"):
        cluster.few(spark.range(4), 3)
    assert cluster.few(spark.range(3), 3).count() == 3


def test_setslot_replies(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    owners = spark.createDataFrame([(1, "a"), (2, "b")], "slot int, id string")
    log = [(1, 1, "migrating", "b", "+OK"), (2, 2, "MIGRATING", "a", "-ERR I'm not the owner of this slot"), (3, 1, "NODE", "b", "+OK"), (4, 1, "MIGRATING", "b", "-ERR I'm not the owner of this slot"), (5, 2, "NODE", "z", "-ERR unknown node z"), (6, 99999, "NODE", "a", "-ERR invalid slot number"), (7, None, "NODE", "a", "-ERR invalid slot number"), (8, 2, "IMPORTING", None, "-ERR missing node-id for IMPORTING"), (9, 2, "NODE", "a", "+OK"), (10, 2, "MIGRATING", "b", "+OK")]
    df = spark.createDataFrame([r[:4] for r in log], "seq bigint, slot int, action string, node string")
    assert {r.seq: r.reply for r in cluster.setslot_replies(owners, df, nodes, "a").collect()} == {r[0]: r[4] for r in log}
    assert cluster.my_id("a") == "$a"
