"""Functions that run when keys change: matching, effects, and a registry.

Triggers are a small dimension, at most MAX_TRIGGERS rows, and are matched by
expressions built from them: no join, so the log streams through one stage of
generated code.  Effects of a function come right after its operation, as
(seq, 1), (seq, 2) ..., and set off nothing themselves.
"""

from __future__ import annotations

import logging
import signal
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.functions import fraud, glob
from keytide.operators import transactions

MAX_TRIGGERS = 10_000
log = logging.getLogger(__name__)


def match(ops: DataFrame, triggers: DataFrame) -> DataFrame:
    """(seq, key, trigger_id, ord, module, func), a row per firing, for client
    operations (seq, op, key) and triggers (id, ord, event, pattern, module,
    func).  Of each operation, firings run in order of ``ord``."""
    rows = triggers.orderBy("ord").limit(MAX_TRIGGERS + 1).collect()
    if len(rows) > MAX_TRIGGERS:
        raise ValueError(f"more than {MAX_TRIGGERS} triggers")
    fired = F.array().cast("array<struct<trigger_id:string,ord:int,module:string,func:string>>")
    hits = []
    for t in rows:
        regex = glob.to_regex(t.pattern)
        if regex == glob.NOTHING:
            continue
        test = (F.col("op") == t.event) & F.col("key").startswith(glob.literal_prefix(t.pattern)) & F.col("key").rlike(regex)
        hits.append(F.when(test, F.struct(F.lit(t.id).alias("trigger_id"), F.lit(t.ord).cast("int").alias("ord"), F.lit(t.module).alias("module"), F.lit(t.func).alias("func"))))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else fired
    events = sorted({t.event for t in rows})
    return ops.filter(F.col("op").isin(*events)).select("seq", "key", F.explode(found).alias("t")).select("seq", "key", "t.*")


def fraud_effects(firings: DataFrame, ops: DataFrame) -> DataFrame:
    """What the payment scorer does at its firings: (seq, sub_seq, op, key,
    value, channel).  It reads the value as of the operation, stores the result
    under its own key, and publishes an alert for blocked payments, the alert
    first."""
    from keytide.operators import state

    seen = state.at_operation(ops, firings.select("seq", "key").distinct())
    rows = score(firings.join(seen, ["seq", "key"])).filter("value is not null")
    alert = F.when(F.col("decision") == "BLOCKED", F.struct(F.lit("PUBLISH").alias("op"), F.lit(None).cast("string").alias("key"), fraud.alert(F.col("key"), F.col("score"), F.col("country")).alias("value"), F.lit(fraud.ALERT_CHANNEL).alias("channel")))
    store = F.struct(F.lit("SET").alias("op"), F.concat(F.lit(fraud.RESULT_PREFIX), F.col("key")).alias("key"), fraud.result(F.col("score"), F.col("decision"), F.col("amount"), F.col("country")).alias("value"), F.lit(None).cast("string").alias("channel"))
    effects = F.filter(F.array(alert, store), lambda e: e.isNotNull())
    return rows.select("seq", "ord", F.posexplode(effects).alias("i", "e")).select("seq", (F.col("ord") * 2 + F.col("i") + 1).alias("sub_seq"), "e.*")


def score(payments: DataFrame) -> DataFrame:
    """``payments`` (…, value) with amount, country, score and decision."""
    rows = payments.withColumn("amount", fraud.amount(F.col("value"))).withColumn("country", fraud.country(F.col("value")))
    rows = rows.withColumn("score", fraud.score(F.col("amount"), F.col("country")))
    return rows.withColumn("decision", fraud.decision(F.col("score")))


#: Processor time a call may take, and by the clock so many times that.
DEADLINE_MS = 10
CLOCK_FACTOR = 100


class DeadlineError(Exception):
    pass


@contextmanager
def deadline(ms: int) -> Iterator[None]:
    """Ends what runs in it after ``ms`` of processor time, or CLOCK_FACTOR times
    that by the clock.  Only a main thread, as a Python worker's, can be ended."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def end(*_):
        raise DeadlineError(f"more than {ms} ms")

    timers = ((signal.ITIMER_VIRTUAL, signal.SIGVTALRM, ms / 1000), (signal.ITIMER_REAL, signal.SIGALRM, ms * CLOCK_FACTOR / 1000))
    old = [signal.signal(s, end) for _, s, _ in timers]
    try:
        for which, _, after in timers:
            signal.setitimer(which, after)
        yield
    finally:
        for which, _, _ in timers:
            signal.setitimer(which, 0)
        for (_, s, _), handler in zip(timers, old):
            signal.signal(s, handler)


class Host:
    """What a function may do: its calls are kept, in order, as effects."""

    def __init__(self, values: dict[str, str | None], now_us: int):
        self.values, self.now_us, self.calls, self.open = dict(values), now_us, [], False

    def get(self, key: str) -> str | None:
        """The value as of the operation, or what this call wrote since; of keys
        that the function declares to read, its own among them."""
        return self.values.get(key)

    def set(self, key: str, value: str) -> int:
        self.calls.append(("kv_set", key, value))
        if not self.open:
            self.values[key] = value
        return 1

    def delete(self, key: str) -> int:
        self.calls.append(("kv_del", key, None))
        self.values[key] = None
        return 1

    def publish(self, channel: str, message: str) -> int:
        self.calls.append(("publish", channel, message))
        return 1

    def tx_begin(self) -> int:
        self.calls.append(("tx_begin", None, None))
        self.open = True
        return 1

    def tx_commit(self) -> int:
        if not self.open:
            return 0
        at = max(i for i, c in enumerate(self.calls) if c[0] == "tx_begin")
        self.values |= {k: v for kind, k, v in self.calls[at:] if kind == "kv_set"}
        self.calls.append(("tx_commit", None, None))
        self.open = False
        return 1

    def now_ms(self) -> int:
        """The operation's own time, so that a call's result can be repeated."""
        return self.now_us // 1000

    def log_info(self, message: str) -> None:
        log.info("%s", message)

    def log_error(self, message: str) -> None:
        log.error("%s", message)


CALLS = "seq bigint, ord int, module string, func string, key string, result bigint, error string, effects array<struct<n:int,kind:string,key:string,value:string>>"


@dataclass
class Module:
    name: str
    functions: dict[str, Callable]
    loaded_at_us: int
    exec_count: int = 0


@dataclass
class Registry:
    """Modules of Python functions by name, and the triggers that call them.

    Functions take (key) for ``run``, (host, key) for ``call``, or nothing for
    ``execute``; ``reads`` of a function names the keys it asks for besides its
    own.  A module replaces one of its name.  Triggers of a dropped module stay and their
    failures are logged.
    """

    modules: dict[str, Module] = field(default_factory=dict)
    triggers: list[tuple[str, int, str, str, str, str]] = field(default_factory=list)
    next_id: int = 1
    clock: Callable[[], int] = lambda: time.time_ns() // 1000

    def load(self, name: str, functions: dict[str, Callable]) -> None:
        self.modules[name] = Module(name, dict(functions), self.clock())

    def load_file(self, name: str, path: str, allowed: str) -> None:
        """A Python file under the folder ``allowed``."""
        import os
        import runpy

        real, root = os.path.realpath(path), os.path.realpath(allowed)
        if os.path.commonpath([real, root]) != root:
            raise PermissionError(f"{path} isn't in {allowed}")
        self.load(name, {k: v for k, v in runpy.run_path(real).items() if callable(v) and not k.startswith("_")})

    def drop(self, name: str) -> None:
        if name not in self.modules:
            raise KeyError(f"module '{name}' not found")
        del self.modules[name]

    def list(self, spark: SparkSession) -> DataFrame:
        rows = [(m.name, m.loaded_at_us, m.exec_count) for m in self.modules.values()]
        return spark.createDataFrame(rows, "name string, loaded_at_us bigint, exec_count bigint").orderBy("name")

    def info(self, name: str) -> str:
        if name not in self.modules:
            raise KeyError(f"ERR module '{name}' not found")
        m = self.modules[name]
        at = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(m.loaded_at_us // 1_000_000))
        return f"module:{m.name} loaded_at:{at} exec_count:{m.exec_count}"

    def execute(self, name: str, func: str, *args, deadline_ms: int = DEADLINE_MS):
        """The function's integer result, or OK."""
        if name not in self.modules:
            raise KeyError(f"module '{name}' not found")
        m = self.modules[name]
        if func not in m.functions:
            raise KeyError(f"function '{func}' not found in module '{name}'")
        m.exec_count += 1
        with deadline(deadline_ms):
            out = m.functions[func](*args)
        return out if isinstance(out, int) else "OK"

    def add_trigger(self, event: str, pattern: str, module: str, func: str) -> str:
        name = f"trigger_{self.next_id}"
        self.triggers.append((name, self.next_id, event.upper(), pattern, module, func))
        self.next_id += 1
        return name

    def remove_trigger(self, name: str) -> bool:
        before = len(self.triggers)
        self.triggers = [t for t in self.triggers if t[0] != name]
        return len(self.triggers) < before

    def trigger_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.triggers, "id string, ord int, event string, pattern string, module string, func string")

    def run(self, firings: DataFrame, deadline_ms: int = DEADLINE_MS) -> DataFrame:
        """(seq, ord, module, func, result, error) of calling each firing's
        function with its key, on the executors; errors are kept as text."""
        functions = self._functions()

        def work(frames):
            for frame in frames:
                results, errors = [], []
                for module, func, key in zip(frame["module"], frame["func"], frame["key"]):
                    result, error = _guarded(functions, module, func, deadline_ms, key)
                    results.append(result)
                    errors.append(error)
                frame["result"], frame["error"] = results, errors
                frame["result"] = frame["result"].astype("Int64")
                yield frame[["seq", "ord", "module", "func", "result", "error"]]

        return firings.select("seq", "ord", "module", "func", "key").mapInPandas(work, "seq bigint, ord int, module string, func string, result bigint, error string")

    def _functions(self) -> dict[tuple[str, str], Callable]:
        return {(m.name, f): c for m in self.modules.values() for f, c in m.functions.items()}

    def call(self, firings: DataFrame, ops: DataFrame, deadline_ms: int = DEADLINE_MS) -> DataFrame:
        """CALLS: each firing's function called with a ``Host`` and its key.

        The host gives values as of the operation in ``ops`` (seq, ts_us, op,
        key, value) and its time.  What a call did before it failed or met its
        deadline stays among its effects.  A call reads few keys, so what is
        gathered for it is small.
        """
        from keytide.operators import state

        functions = self._functions()

        def wanted(frames):
            for frame in frames:
                rows = []
                for seq, n, module, func, key in zip(*(frame[c].tolist() for c in ("seq", "ord", "module", "func", "key"))):
                    more = getattr(functions.get((module, func)), "reads", None)
                    rows += [(seq, n, module, func, key, k) for k in dict.fromkeys([key, *(more(key) if more else [])])]
                yield pd.DataFrame(rows, columns=["seq", "ord", "module", "func", "key", "asked"])

        def work(frames):
            for frame in frames:
                out = []
                for seq, n, module, func, key, now, found in zip(*(frame[c].tolist() for c in ("seq", "ord", "module", "func", "key", "ts_us", "found"))):
                    host = Host({f["asked"]: f["value"] for f in found}, int(now))
                    result, error = _guarded(functions, module, func, deadline_ms, host, key)
                    out.append((seq, n, module, func, key, result, error, [{"n": i + 1, "kind": k, "key": x, "value": v} for i, (k, x, v) in enumerate(host.calls)]))
                frame = pd.DataFrame(out, columns=["seq", "ord", "module", "func", "key", "result", "error", "effects"])
                frame["result"] = frame["result"].astype("Int64")
                yield frame

        asked = firings.select("seq", "ord", "module", "func", "key").mapInPandas(wanted, "seq bigint, ord int, module string, func string, key string, asked string")
        seen = state.at_operation(ops, asked.select("seq", F.col("asked").alias("key")).distinct())
        found = asked.join(seen.withColumnRenamed("key", "asked"), ["seq", "asked"]).groupBy("seq", "ord", "module", "func", "key").agg(F.collect_list(F.struct("asked", "value")).alias("found"))
        return found.join(ops.select("seq", F.coalesce("ts_us", F.lit(0)).alias("ts_us")), "seq").mapInPandas(work, CALLS)

    def record(self, calls: DataFrame) -> None:
        """Add what ``run`` or ``call`` did to the modules' counts of calls: a
        function that isn't there isn't counted.  One row a function comes back."""
        functions = self._functions()
        for r in calls.groupBy("module", "func").agg(F.count("*").alias("n")).filter(F.col("module").isin(*self.modules)).collect():
            if (r.module, r.func) in functions:
                self.modules[r.module].exec_count += r.n

    def admin(self, cmd: str, args: list[str], loader: Callable[[str, str], dict[str, Callable]] | None = None, allowed: str | None = None) -> str:
        """The reply to a WASM.* command, with its effect on the registry.

        ``loader`` makes functions of a module's name and text; LOADFILE reads
        Python files of the folder ``allowed``.
        """
        try:
            if cmd == "WASM.LOAD":
                if loader is None:
                    return "-ERR modules can't be loaded here"
                self.load(args[0], loader(args[0], args[1]))
            elif cmd == "WASM.LOADFILE":
                if allowed is None:
                    return "-ERR modules can't be loaded here"
                import os

                self.load_file(args[0], args[1], allowed)
                return f"+OK loaded {os.path.getsize(args[1])} bytes"
            elif cmd == "WASM.DROP":
                self.drop(args[0])
            elif cmd == "WASM.LIST":
                return " ".join([f"*{len(self.modules)}", *(f"${n}" for n in sorted(self.modules))])
            elif cmd == "WASM.INFO":
                return "$" + self.info(args[0])
            elif cmd == "WASM.EXEC":
                out = self.execute(args[0], args[1])
                return "+OK" if out == "OK" else f":{out}"
            elif cmd == "WASM.TRIGGER":
                return "+" + self.add_trigger(*args[:4])
            elif cmd == "WASM.UNTRIGGER":
                return "+OK" if self.remove_trigger(args[0]) else "-ERR trigger not found"
            elif cmd == "WASM.TRIGGERS":
                return " ".join([f"*{len(self.triggers)}", *(f"${i} {event} {pattern} {module}.{func}" for i, _, event, pattern, module, func in self.triggers)])
            else:
                return f"-ERR unknown command '{cmd}'"
        except Exception as e:  # noqa: BLE001  a failure is the command's reply
            text = str(e.args[0]) if e.args else str(e)
            return f"-ERR {text.removeprefix('ERR ')}"
        return "+OK"


def _guarded(functions: dict, module: str, func: str, deadline_ms: int, *args) -> tuple[int | None, str | None]:
    """(integer result, error) of a call."""
    try:
        with deadline(deadline_ms):
            out = functions[module, func](*args)
        return out if isinstance(out, int) else None, None
    except Exception as e:  # noqa: BLE001  a function's failure is its firing's result
        log.error("%s.%s: %s", module, func, e)
        return None, f"{type(e).__name__}: {e}"


def effects(calls: DataFrame) -> DataFrame:
    """(seq, sub_seq, op, key, value, channel): the effects of calls (CALLS) that
    survive, after their operation and in order; a call has under 1000."""
    rows = calls.select("seq", "ord", F.explode("effects").alias("e")).select(F.concat_ws("/", "seq", "ord").alias("call_id"), "seq", "ord", "e.*")
    kept = transactions.module_effects(rows)
    message = F.col("kind") == "publish"
    op = F.when(message, "PUBLISH").when(F.col("kind") == "kv_set", "SET").otherwise("DEL")
    return kept.select("seq", (F.col("ord") * 1000 + F.col("n")).alias("sub_seq"), op.alias("op"), F.when(~message, F.col("key")).alias("key"), "value", F.when(message, F.col("key")).alias("channel"))
