"""The line protocol of clients: encoding by expressions, decoding in batches.

Values are (typ, str, num, items): ``+`` simple, ``-`` error, ``:`` integer,
``$`` bulk (null for length -1), ``*`` array.  Arrays nest at most MAX_DEPTH.
"""

from __future__ import annotations

import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 8
MAX_ITEMS = 1 << 20
NUMBER = re.compile(rb"[+-]?[0-9]{1,40}")


class ProtocolError(ValueError):
    pass


def bulk(text: Column) -> Column:
    """``$<bytes>\\r\\n<text>\\r\\n``; null is ``$-1``."""
    whole = F.concat(F.lit("$"), F.octet_length(text).cast("string"), F.lit("\r\n"), text, F.lit("\r\n"))
    return F.when(text.isNull(), F.lit("$-1\r\n")).otherwise(whole)


def command(args: Column) -> Column:
    """A command: the array of its words as bulk strings."""
    return F.concat(F.lit("*"), F.size(args).cast("string"), F.lit("\r\n"), F.array_join(F.transform(args, bulk), ""))


def simple(text: Column) -> Column:
    return F.concat(F.lit("+"), text, F.lit("\r\n"))


def error(text: Column) -> Column:
    return F.concat(F.lit("-"), text, F.lit("\r\n"))


def integer(number: Column) -> Column:
    return F.concat(F.lit(":"), number.cast("string"), F.lit("\r\n"))


def _line(raw: bytes, at: int) -> tuple[bytes, int]:
    end = raw.find(b"\n", at)
    if end < 0:
        raise ProtocolError("unexpected end")
    return raw[at : max(at, end - 1)], end + 1


def _number(text: bytes) -> int:
    """Digits and a sign, nothing else, within 64 bits."""
    if NUMBER.fullmatch(text) and -(1 << 63) <= int(text) < 1 << 63:
        return int(text)
    raise ProtocolError(f"not a number: {text!r}")


def parse(raw: bytes, at: int = 0, depth: int = 0) -> tuple[Any, int]:
    """One value at ``at`` and where it ends: ('+', s), ('-', s), (':', n),
    ('$', bytes or None), ('*', list).  Other first bytes are a command in
    plain words."""
    if at >= len(raw):
        raise ProtocolError("unexpected end")
    kind = raw[at : at + 1]
    if kind not in b"+-:$*":
        end = raw.find(b"\n", at)
        words = raw[at : len(raw) if end < 0 else end].split()
        if not words:
            raise ProtocolError("empty command")
        return ("*", [("$", w) for w in words]), len(raw) if end < 0 else end + 1
    head, at = _line(raw, at + 1)
    if kind in b"+-":
        return (kind.decode(), head), at
    n = _number(head)
    if kind == b":":
        return (":", n), at
    if kind == b"$":
        if n == -1:
            return ("$", None), at
        if n < 0 or at + n + 2 > len(raw):
            raise ProtocolError("bad length")
        return ("$", raw[at : at + n]), at + n + 2
    if not 0 <= n <= MAX_ITEMS or depth >= MAX_DEPTH:
        raise ProtocolError("bad array")
    items = []
    for _ in range(n):
        item, at = parse(raw, at, depth + 1)
        items.append(item)
    return ("*", items), at


def marshal(value: Any) -> bytes:
    """The bytes of a parsed value; of anything else none."""
    if not value:
        return b""
    kind, v = value
    if kind in "+-":
        return kind.encode() + v + b"\r\n"
    if kind == ":":
        return b":%d\r\n" % v
    if kind == "$":
        return b"$-1\r\n" if v is None else b"$%d\r\n%s\r\n" % (len(v), v)
    return b"*%d\r\n" % len(v) + b"".join(map(marshal, v))


def decode_commands(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``rows`` with ``args`` array<string> and ``err``, from a command per row."""

    def work(frames):
        for frame in frames:
            args, errs = [], []
            for text in frame[raw]:
                try:
                    if text is None:
                        raise ProtocolError("no command")
                    value, _ = parse(text if isinstance(text, bytes) else str(text).encode())
                    if value[0] != "*" or not value[1]:
                        raise ProtocolError("ERR invalid command")
                    args.append([_text(v) for v in value[1]])
                    errs.append(None)
                except ProtocolError as e:
                    args.append(None)
                    errs.append(str(e))
            frame["args"], frame["err"] = pd.Series(args, index=frame.index, dtype=object), errs
            yield frame

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(work, f"{kinds}, args array<string>, err string")


def _text(v: tuple) -> str | None:
    kind, x = v
    return None if x is None else str(x) if kind == ":" else x.decode("utf-8", "replace") if kind in "+-$" else marshal(v).decode("utf-8", "replace")
