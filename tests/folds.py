"""Plain sequential versions of what the engine computes, to test it against."""


def replay(ops, as_of):
    """Recovery in log order: {key: (value, expiry)}."""
    kv, ttl = {}, {}
    for op in sorted(ops, key=lambda o: o["seq"]):
        k = op["key"]
        if op["op"] == "SET":
            kv[k] = op["value"]
        elif op["op"] == "DEL":
            kv.pop(k, None)
            ttl.pop(k, None)
        elif op["op"] == "EXPIRE":
            if op["exp_us"] > as_of:
                ttl[k] = op["exp_us"]
            else:
                kv.pop(k, None)
        elif op["op"] == "PERSIST":
            ttl.pop(k, None)
    return {k: (v, ttl.get(k)) for k, v in kv.items()}


def live(ops, as_of):
    """Time-ordered state: {key: (value, expiry)}."""
    kv, ttl = {}, {}

    def evict(k, now):
        if k in ttl and ttl[k] <= now:
            kv.pop(k, None)
            ttl.pop(k, None)

    for op in sorted(ops, key=lambda o: o["seq"]):
        k = op["key"]
        evict(k, op["ts_us"])
        if op["op"] == "SET":
            kv[k] = op["value"]
        elif op["op"] == "DEL":
            kv.pop(k, None)
            ttl.pop(k, None)
        elif op["op"] == "EXPIRE" and k in kv:
            ttl[k] = op["exp_us"]
        elif op["op"] == "PERSIST":
            ttl.pop(k, None)
    for k in list(ttl):
        evict(k, as_of)
    return {k: (v, ttl.get(k)) for k, v in kv.items()}


def session(cmds):
    """Replies by (conn, seq) of a whole client session."""
    kv, ttl, out = {}, {}, {}
    arity = {"SET": 2, "GET": 1, "DEL": 1, "EXPIRE": 2, "TTL": 1, "PERSIST": 1}

    def secs(t):
        body = t[1:] if t[:1] in "+-" else t
        return int(t) if body.isascii() and body.isdigit() and int(t) > 0 else None

    for c in sorted(cmds, key=lambda c: c["seq"]):
        cmd, args, now = c["cmd"].upper(), c["args"], c["ts_us"]
        if cmd in arity and len(args) < arity[cmd]:
            r = f"-ERR wrong number of arguments for '{cmd}'"
        elif cmd == "PING":
            r = "+PONG"
        elif cmd == "DBSIZE":
            r = f":{len(kv)}"
        elif cmd == "SET":
            kv[args[0]], r = args[1], "+OK"
            if len(args) >= 4 and args[2].upper() == "EX":
                if secs(args[3]) is None:
                    r = "-ERR invalid expire time"
                else:
                    ttl[args[0]] = now + secs(args[3]) * 1_000_000
        elif cmd == "GET":
            k = args[0]
            if k in ttl and ttl[k] <= now:
                kv.pop(k, None)
                ttl.pop(k)
            r = f"${kv[k]}" if k in kv else "$-1"
        elif cmd == "DEL":
            r = f":{int(kv.pop(args[0], None) is not None)}"
            ttl.pop(args[0], None)
        elif cmd == "EXPIRE":
            r = ":0"
            if args[0] in kv:
                r = ":1" if secs(args[1]) else "-ERR invalid expire time"
                if secs(args[1]):
                    ttl[args[0]] = now + secs(args[1]) * 1_000_000
        elif cmd == "TTL":
            k = args[0]
            r = ":-2" if k not in kv else ":-1" if k not in ttl else f":{max(0, ttl[k] - now) // 1_000_000}"
        elif cmd == "PERSIST":
            r = f":{int(ttl.pop(args[0], None) is not None)}"
        else:
            r = f"-ERR unknown command '{cmd}'"
        out[c["conn"], c["seq"]] = r
    return out
