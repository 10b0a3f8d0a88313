"""Path globs as Java regular expressions.

``*`` and ``?`` don't cross ``/``; ``[...]``, ``[^...]`` and ``\\`` escape as in
shell-style path matching.  A malformed pattern matches nothing.
"""

from __future__ import annotations

NOTHING = r"(?!)"
_PLAIN = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_:/ ,;=@%&\"'<>~`!#")


def _quote(c: str) -> str:
    return c if c in _PLAIN or ord(c) > 127 else "\\" + c if c.isprintable() else f"\\x{ord(c):02x}"


def _member(p: str, i: int) -> tuple[str, int] | None:
    """One end of a range at i, and where it ends."""
    if i < len(p) and p[i] == "\\":
        i += 1
        return (p[i], i + 1) if i + 1 < len(p) else None
    return (p[i], i + 1) if i + 1 < len(p) and p[i] not in "-]" else None


def _class(p: str, i: int) -> tuple[str, int] | None:
    """The class whose text starts at i, and where it ends; None if malformed."""
    negate = p[i : i + 1] == "^"
    i += negate
    ranges, any_range = [], False
    while not any_range or p[i] != "]":
        low = high = _member(p, i)
        if low is None:
            return None
        i = low[1]
        if p[i] == "-":
            high = _member(p, i + 1)
            if high is None:
                return None
            i = high[1]
        any_range = True
        if low[0] <= high[0]:
            ranges.append(f"{_in_class(low[0])}-{_in_class(high[0])}")
    if not ranges:
        return "(?s:.)" if negate else NOTHING, i + 1
    return f"[{'^' if negate else ''}{''.join(ranges)}]", i + 1


def _in_class(c: str) -> str:
    return f"\\x{{{ord(c):x}}}"


def to_regex(pattern: str) -> str:
    """A regex for the whole key; use it with ``rlike``."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            got = _class(pattern, i)
            if got is None:
                return NOTHING
            out.append(got[0])
            i = got[1]
        elif c == "\\":
            if i >= len(pattern):
                return NOTHING
            out.append(_quote(pattern[i]))
            i += 1
        else:
            out.append(_quote(c))
    return r"(?s)\A" + "".join(out) + r"\z"


def literal_prefix(pattern: str) -> str:
    """What every match starts with: a cheap test before the regex."""
    out = []
    i = 0
    while i < len(pattern) and pattern[i] not in "*?[":
        if pattern[i] == "\\":
            i += 1
            if i >= len(pattern):
                break
        out.append(pattern[i])
        i += 1
    return "".join(out)
