import random

import pytest
from folds import live, replay, session
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keytide import model
from keytide.operators import commands, replication, state

SCHEMA = "seq bigint, ts_us bigint, op string, key string, value string, exp_us bigint"
AS_OF = 100


def log(*steps):
    """Steps like 'SET', 'DEL', 'PERSIST' or ('EXPIRE', instant) on key k."""
    out = []
    for i, s in enumerate(steps):
        op, exp = (s, None) if isinstance(s, str) else s
        out.append({"seq": i, "ts_us": i, "op": op, "key": "k", "value": f"v{i}" if op == "SET" else None, "exp_us": exp})
    return out


def frame(spark, ops):
    return spark.createDataFrame([tuple(o[c] for c in ("seq", "ts_us", "op", "key", "value", "exp_us")) for o in ops], SCHEMA)


def held(df):
    return {r.key: (r.value, r.expires_at_us) for r in df.collect()}


@pytest.mark.parametrize(
    ("steps", "want"),
    [
        (("SET", ("EXPIRE", 50), "PERSIST"), {}),
        (("SET", ("EXPIRE", 50), ("EXPIRE", 200)), {}),
        (("SET", ("EXPIRE", 50), "SET"), {"k": ("v2", None)}),
        (("SET", ("EXPIRE", 200), "SET"), {"k": ("v2", 200)}),
        (("SET", ("EXPIRE", 200), "PERSIST"), {"k": ("v0", None)}),
        ((("EXPIRE", 200), "SET"), {"k": ("v1", 200)}),
        (("SET", ("EXPIRE", 200), "DEL", "SET"), {"k": ("v3", None)}),
        (("SET", ("EXPIRE", 100)), {}),
        (("SET", "NOSUCH"), {"k": ("v0", None)}),
    ],
)
def test_replay_rules(spark, steps, want):
    ops = log(*steps)
    assert replay([o for o in ops if o["op"] != "NOSUCH"], AS_OF) == want
    assert held(state.replay(frame(spark, ops), AS_OF)) == want


def random_log(rng, n, keys=5):
    return [
        {"seq": i, "ts_us": i * 3, "op": rng.choice(["SET", "SET", "DEL", "EXPIRE", "PERSIST"]), "key": f"k{rng.randrange(keys)}", "value": rng.choice([f"v{i}", None, ""]), "exp_us": i * 3 + rng.randrange(-9, 30)}
        for i in range(n)
    ]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), n=st.integers(0, 120))
def test_folds_agree(spark, seed, n):
    ops = random_log(random.Random(seed), n)
    df = frame(spark, ops)
    as_of = n * 3 // 2
    assert held(state.replay(df, as_of)) == replay(ops, as_of)
    assert held(state.live(df, n * 3 + 2)) == live(ops, n * 3 + 2)


def test_compaction_keeps_state(spark):
    ops = random_log(random.Random(3), 200)
    df = frame(spark, ops)
    for as_of in (0, 300, 700):
        whole = held(state.replay(df, as_of))
        assert held(state.replay_compacted(state.compact(df, 120, as_of), as_of)) == whole
    lossy = held(state.replay_compacted(state.compact(df, 200, 0, drop_ttl=True), 0))
    assert lossy == {k: (v, None) for k, (v, _) in held(state.replay(df, 0)).items()}


def test_reads(spark):
    kv = spark.createDataFrame([("a", "1", None, 1), ("b", "2", 5_000_000, 2), ("c", "3", 1_000_000, 3)], model.KV)
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    now = 1_000_000
    assert {tuple(r) for r in state.get(kv, keys, now).collect()} == {("a", "1"), ("b", "2"), ("c", None), ("d", None)}
    assert {r.key for r in state.exists(kv, keys, now).collect()} == {"a", "b"}
    assert {tuple(r) for r in state.ttl(kv, keys, now + 1).collect()} == {("a", -1), ("b", 3), ("c", 0), ("d", -2)}
    assert tuple(state.dbsize(kv, now).first()) == (3, 2, 2)
    assert [r.key for r in state.due(kv, 10**9).collect()] == ["c", "b"]


def test_at_operation(spark):
    ops = log("SET", "SET", "DEL", "SET")
    reads = spark.createDataFrame([(s, "k") for s in range(4)] + [(9, "other")], "seq bigint, key string")
    got = {(r.seq, r.key): r.value for r in state.at_operation(frame(spark, ops), reads).collect()}
    assert got == {(0, "k"): "v0", (1, "k"): "v1", (2, "k"): None, (3, "k"): "v3", (9, "other"): None}


def test_replies_agree_with_a_session(spark):
    rng = random.Random(5)
    pick = {"SET": lambda: [f"v{rng.randrange(9)}", *rng.choice([[], ["EX", "2"], ["ex", "0"], ["EX", "x"], ["EX"], ["PX", "9"]])], "EXPIRE": lambda: [rng.choice(["1", "+3", "0", "-2", "x", ""])]}
    cmds = []
    for i in range(600):
        cmd = rng.choice(["SET", "set", "GET", "DEL", "EXPIRE", "TTL", "PERSIST", "DBSIZE", "PING", "nosuch"])
        args = [f"k{rng.randrange(4)}", *pick.get(cmd.upper(), list)()]
        if rng.random() < 0.05:
            args = []
        cmds.append({"conn": i % 3, "seq": i, "ts_us": i * 400_000, "cmd": cmd, "args": args})
    df = spark.createDataFrame([tuple(c[k] for k in ("conn", "seq", "ts_us", "cmd", "args")) for c in cmds], model.CMDS)
    got = {(r.conn, r.seq): r.reply for r in commands.replies(df).collect()}
    assert got == session(cmds)


def test_running_sum_over_ranges(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.randrange(-3, 4)) for g in "ab" for i in sorted(rng.sample(range(10_000), 300))]
    df = commands.running_sum(spark.createDataFrame(rows, "g string, seq bigint, v bigint"), "v", ["g"], bucket=64)
    want, total = {}, {}
    for g, i, v in sorted(rows):
        total[g] = total.get(g, 0) + v
        want[g, i] = total[g]
    assert {(r.g, r.seq): r.running for r in df.collect()} == want


def test_replica(spark):
    ops = random_log(random.Random(8), 150)
    for o in ops:
        o["value"] = o["value"] or "x"
    df = frame(spark, ops)
    copy = replication.parse_lines(replication.lines(replication.full_sync(df, 70))).select("key", "value")
    got = {r.key: r.value for r in replication.apply(copy, replication.forwarded(df, 70)).collect()}
    kv = {}
    for o in ops:
        if o["op"] == "SET":
            kv[o["key"]] = o["value"]
        elif o["op"] == "DEL":
            kv.pop(o["key"], None)
    assert got == kv


def test_empty_log(spark):
    df = frame(spark, [])
    assert state.replay(df, 0).count() == 0 and state.live(df, 0).count() == 0


def test_expiry_without_an_instant_counts_for_nothing(spark):
    ops = [{"seq": i, "ts_us": i, "op": op, "key": k, "value": "v", "exp_us": e} for i, (op, k, e) in enumerate([("SET", "k", None), ("EXPIRE", "k", 90), ("EXPIRE", "k", None), ("SET", None, None), ("NOSUCH", "k", None)])]
    df = frame(spark, ops)
    assert held(state.replay(df, 10)) == {"k": ("v", 90)} == held(state.live(df, 10))


def test_sessions_with_transactions_and_channels(spark):
    rng = random.Random(17)
    cmds = []
    for i in range(900):
        cmd = rng.choice(["SET", "GET", "DEL", "TTL", "EXPIRE", "MULTI", "EXEC", "EXEC", "DISCARD", "SUBSCRIBE", "UNSUBSCRIBE", "PUBLISH", "DBSIZE", "PING", "nosuch", None, "CLUSTER", "MIGRATE", "PSYNC", "WASM.LIST", "WASM.INFO", "WASM.TRIGGER"])
        args = [f"k{rng.randrange(5)}"]
        if cmd == "SET":
            args = [*args, f"v{i}"]
        elif cmd == "EXPIRE":
            args = [*args, "2"]
        elif cmd in ("SUBSCRIBE", "UNSUBSCRIBE"):
            args = [f"c{rng.randrange(3)}" for _ in range(rng.randrange(0 if cmd == "UNSUBSCRIBE" else 1, 3))]
        elif cmd == "PUBLISH":
            args = [f"c{rng.randrange(3)}", "m"]
        cmds.append({"conn": rng.randrange(4), "seq": i, "ts_us": i * 400_000, "cmd": cmd, "args": args})
    df = spark.createDataFrame([tuple(c[k] for k in ("conn", "seq", "ts_us", "cmd", "args")) for c in cmds], model.CMDS)
    got = [(r.conn, r.seq, r.reply) for r in commands.replies(df).collect()]
    assert len(got) == len(cmds)

    order, told, queue = [], {}, {}  # what takes effect, in order
    for c in cmds:
        at, cmd = (c["conn"], c["seq"]), c["cmd"] and c["cmd"].upper()
        if cmd is None:
            told[at] = "-ERR invalid command"
        elif cmd in ("MULTI", "EXEC", "DISCARD"):
            inside = c["conn"] in queue
            if cmd == "MULTI":
                told[at] = "-ERR MULTI calls can not be nested" if inside else "+OK"
                queue.setdefault(c["conn"], [])
            elif not inside:
                told[at] = f"-ERR {cmd} without MULTI"
            else:
                held_back = queue.pop(c["conn"])
                told[at] = "+OK" if cmd == "DISCARD" else [(q["conn"], q["seq"]) for q in held_back]
                order += [{**q, "ts_us": c["ts_us"]} for q in held_back] if cmd == "EXEC" else []
        elif c["conn"] in queue:
            queue[c["conn"]].append(c)
            told[at] = "+QUEUED"
        else:
            order.append(c)
    keyed = [{**c, "was": c["seq"], "seq": i} for i, c in enumerate(order)]
    answers = {(c["conn"], c["was"]): r for c, r in zip(keyed, session(keyed).values())}
    on = set()
    for c in order:
        at, cmd, args = (c["conn"], c["seq"]), c["cmd"].upper(), c["args"]
        if cmd == "SUBSCRIBE":
            parts = []
            for ch in args:
                on.add((c["conn"], ch))
                parts.append(f"*3 $subscribe ${ch} :{sum(k == c['conn'] for k, _ in on)}")
            answers[at] = " ".join(parts)
        elif cmd == "UNSUBSCRIBE":
            on -= {x for x in on if x[0] == c["conn"] and (not args or x[1] in args)}
            answers[at] = "+OK"
        elif cmd == "PUBLISH":
            answers[at] = f":{sum(ch == args[0] for _, ch in on)}"
        elif cmd in ("CLUSTER", "MIGRATE", "PSYNC"):
            answers[at] = "-ERR cluster mode is not enabled"
        elif cmd.startswith("WASM"):
            answers[at] = {"WASM.LIST": "*0", "WASM.INFO": f"-ERR module '{args[0]}' not found", "WASM.TRIGGER": "-ERR usage: WASM.TRIGGER <SET|DEL> <pattern> <module> <func>"}[cmd]
    want = {}
    for at, r in told.items():
        want[at] = " ".join([f"*{len(r)}", *(answers[q] for q in r)]) if isinstance(r, list) else r
    want |= {at: r for at, r in answers.items() if at not in want}
    assert {(c, s): r for c, s, r in got} == want


def test_administration_in_order(spark):
    from keytide.operators import triggers

    reg = triggers.Registry(clock=lambda: 0)
    steps = [("WASM.LOAD", ["m", "7"]), ("WASM.EXEC", ["m", "f"]), ("WASM.EXEC", ["m", "g"]), ("WASM.LIST", []), ("WASM.INFO", ["m"]), ("WASM.TRIGGER", ["set", "a*", "m", "f"]), ("WASM.TRIGGERS", []), ("WASM.UNTRIGGER", ["trigger_1"]), ("WASM.UNTRIGGER", ["trigger_1"]), ("WASM.DROP", ["m"]), ("WASM.DROP", ["m"]), ("WASM.LOADFILE", ["m", "/x"]), ("CLUSTER", ["MYID"])]
    df = spark.createDataFrame([(1, i, i, c, a) for i, (c, a) in enumerate(steps)], model.CMDS)

    def admin(cmd, args):
        return "$me" if cmd == "CLUSTER" else reg.admin(cmd, args, loader=lambda name, text: {"f": lambda: int(text)})

    got = [r.reply for r in commands.replies(df, admin).orderBy("seq").collect()]
    assert got == ["+OK", ":7", "-ERR function 'g' not found in module 'm'", "*1 $m", "$module:m loaded_at:1970-01-01T00:00:00Z exec_count:1", "+trigger_1", "*1 $trigger_1 SET a* m.f", "+OK", "-ERR trigger not found", "+OK", "-ERR module 'm' not found", "-ERR modules can't be loaded here", "$me"]


@pytest.mark.parametrize("own", [False, True])
def test_any_number_of_administration_commands(spark, own):
    n, names = 120_000, ("WASM.LIST", "WASM.INFO", "WASM.EXEC", "WASM.TRIGGERS", "WASM.UNTRIGGER", "WASM.LOADFILE", "WASM.DROP")
    i = F.col("id")
    cmd = F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    args = F.when(cmd == "WASM.LIST", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("m"), i % 3), F.lit(None).cast("string")))
    rows = spark.range(n).select((i % 5).alias("conn"), (n - i).alias("seq"), i.alias("ts_us"), cmd.alias("cmd"), args.alias("args"))
    calls = []

    def admin(name, args):
        calls.append((name, args))
        return f"+{len(calls)}"

    out = commands.replies(rows, admin if own else None)
    got = {r.seq: r.reply for r in out.collect()}
    assert len(got) == n
    if own:
        assert [got[k] for k in range(1, n + 1)] == [f"+{k}" for k in range(1, n + 1)] and calls[-1] == ("WASM.LIST", []) and calls[-2] == ("WASM.INFO", ["m1", ""])
    else:
        told = {"WASM.LIST": "*0", "WASM.TRIGGERS": "*0", "WASM.UNTRIGGER": "-ERR trigger not found", "WASM.LOADFILE": "-ERR modules can't be loaded here"}
        assert all(got[n - k] == told.get(names[k % len(names)], f"-ERR module 'm{k % 3}' not found") for k in range(n))
