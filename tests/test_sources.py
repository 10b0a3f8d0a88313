import json
import os
import struct
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from keytide.operators import state, triggers
from keytide.sources import registry_files, resp, wal

RECORDS = [(1, b"k", b"v"), (2, "é".encode(), b""), (3, b"k", wal.pack_expiry(1_700_000_000_000_001)), (4, b"", b"")]


def whole():
    return b"".join(wal.encode(*r) for r in RECORDS)


def test_log_record_layout():
    raw = wal.encode(1, b"ab", b"xyz")
    payload = b"\x01" + struct.pack("<I", 2) + b"abxyz"
    assert raw == struct.pack("<II", zlib.crc32(payload), len(payload)) + payload


def test_log_roundtrip_and_expiry():
    assert list(wal.decode(whole())) == RECORDS
    assert wal.unpack_expiry(RECORDS[2][2]) == 1_700_000_000_000_001
    assert wal.unpack_expiry(struct.pack(">Q", 1999)) == 1 and wal.unpack_expiry(b"short") is None


@pytest.mark.parametrize("tail", [b"\x01\x02", struct.pack("<II", 0, 100) + b"x", struct.pack("<II", 1, 5) + b"\x01\x00\x00\x00\x00", struct.pack("<II", zlib.crc32(b"\x01\xff\x00\x00\x00a"), 6) + b"\x01\xff\x00\x00\x00a", struct.pack("<II", zlib.crc32(b"\x01"), 1) + b"\x01"])
def test_corrupt_tail_ends_the_file(tail):
    assert list(wal.decode(whole() + tail + whole())) == RECORDS


def test_folder_order_and_corruption_in_one_file(spark, tmp_path):
    (tmp_path / "wal_2.log").write_bytes(wal.encode(1, b"k", b"two") + wal.encode(9, b"k", b"unknown"))
    (tmp_path / "wal_1.log").write_bytes(wal.encode(1, b"k", b"one") + b"garbage here and more")
    (tmp_path / "snapshot.wal").write_bytes(wal.encode(1, b"k", b"zero") + wal.encode(1, b"z", b"z"))
    (tmp_path / "other.txt").write_bytes(b"no")
    rows = wal.read_ops(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.key, r.value) for r in rows] == [("k", "zero"), ("z", "z"), ("k", "one"), ("k", "two")]
    assert wal.read_ops(spark, str(tmp_path / "missing")).count() == 0


def test_write_compact_replay(spark, tmp_path):
    folder = str(tmp_path / "log")
    ops = spark.createDataFrame([(i, ["SET", "EXPIRE", "DEL", "SET"][i % 4], f"k{i % 7}", f"v{i}", 10_000 + i) for i in range(60)], "seq bigint, op string, key string, value string, exp_us bigint")
    wal.write_ops(ops, folder, files=3)
    want = {tuple(r) for r in state.replay(ops, 10_020).drop("last_seq").collect()}
    got = lambda: {tuple(r) for r in state.replay(wal.read_ops(spark, folder), 10_020).drop("last_seq").collect()}
    assert got() == want and not wal.compact_if_large(spark, folder, 10_020)
    assert wal.compact_if_large(spark, folder, 10_020, limit=10)
    assert os.listdir(folder) == ["snapshot.wal"] and got() == want
    wal.write_ops(spark.createDataFrame([(0, "SET", "k0", "new", None)], ops.schema), folder, files=1)
    assert {r.value for r in wal.read_ops(spark, folder).filter("key = 'k0'").collect()} >= {"new"}


@pytest.mark.parametrize(
    ("raw", "value"),
    [(b"+OK\r\n", ("+", b"OK")), (b"-ERR x\r\n", ("-", b"ERR x")), (b":42\r\n", (":", 42)), (b"$5\r\nhello\r\n", ("$", b"hello")), (b"$-1\r\n", ("$", None)), (b"$0\r\n\r\n", ("$", b"")), (b"*2\r\n:1\r\n*1\r\n$1\r\na\r\n", ("*", [(":", 1), ("*", [("$", b"a")])])), (b"SET a  b\r\n", ("*", [("$", b"SET"), ("$", b"a"), ("$", b"b")]))],
)
def test_protocol_values(raw, value):
    assert resp.parse(raw) == (value, len(raw))


@pytest.mark.parametrize("raw", [b"", b"\r\n", b"$5\r\nhel", b"*-3\r\n", b":x\r\n", b"*1\r\n", b"+OK", b"*1\r\n" * 20])
def test_protocol_errors(raw):
    with pytest.raises(resp.ProtocolError):
        resp.parse(raw)


values = st.recursive(
    st.one_of(st.tuples(st.just(":"), st.integers(-(2**62), 2**62)), st.tuples(st.just("$"), st.one_of(st.none(), st.binary(max_size=20))), st.tuples(st.sampled_from("+-"), st.text("abc é", max_size=5).map(str.encode))),
    lambda inner: st.tuples(st.just("*"), st.lists(inner, max_size=3)),
    max_leaves=8,
)


@given(values)
def test_protocol_roundtrip(value):
    def deep(v):
        return 1 + max(map(deep, v[1]), default=0) if v[0] == "*" else 0

    if deep(value) < resp.MAX_DEPTH:
        raw = resp.marshal(value)
        assert resp.parse(raw) == (value, len(raw))


def test_marshal_of_nothing():
    assert resp.marshal(None) == b"" and resp.marshal(()) == b""


def test_decode_commands(spark):
    rows = spark.createDataFrame([(1, "*2\r\n$3\r\nGET\r\n$2\r\né\r\n"), (2, "PING\r\n"), (3, "*0\r\n"), (4, None), (5, "+OK\r\n")], "n bigint, raw string")
    got = {r.n: (r.args, r.err) for r in resp.decode_commands(rows).collect()}
    assert got[1] == (["GET", "é"], None) and got[2] == (["PING"], None)
    assert all(got[n][0] is None and got[n][1] for n in (3, 4, 5))


def test_registry_files(spark, tmp_path):
    reg = triggers.Registry()
    reg.add_trigger("set", "a*", "m", "f")
    reg.add_trigger("DEL", "b", "m", "f")
    reg.remove_trigger("trigger_1")
    registry_files.save(reg, str(tmp_path), {"m": "def f(key=None):\n    return 5\n", "bad": "1/0\n"})
    back = registry_files.restore(str(tmp_path))
    assert back.triggers == [("trigger_1", 1, "DEL", "b", "m", "f")] and list(back.modules) == ["m"] and back.execute("m", "f") == 5
    (tmp_path / "t.json").write_text(json.dumps([{"event": "set", "pattern": "a", "module": "m", "func": "f"}, {"event": "DEL", "pattern": "b", "module": "m", "func": "g"}]))
    assert [r.id for r in registry_files.read_triggers(spark, str(tmp_path / "t.json")).collect()] == ["trigger_1", "trigger_2"]
    with pytest.raises(PermissionError):
        back.load_file("x", "/etc/hosts", str(tmp_path))


def test_later_appends_are_replayed_later(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/log", "seq bigint, op string, key string, value string, exp_us bigint"
    for n, files in enumerate((4, 1, 3, 12)):
        rows = [(i, "SET", f"k{i % 5}", f"v{n}", None) for i in range(40)]
        wal.write_ops(spark.createDataFrame(rows, schema), folder, files=files)
        assert {r.value for r in state.replay(wal.read_ops(spark, folder), 0).collect()} == {f"v{n}"}
    wal.compact(spark, folder, 0)
    assert [r.value for r in state.replay(wal.read_ops(spark, folder), 0).collect()] == ["v3"] * 5


def test_snapshots_in_parts(spark, tmp_path, monkeypatch):
    folder, schema = str(tmp_path / "log"), "seq bigint, op string, key string, value string, exp_us bigint"
    write = lambda v: wal.write_ops(spark.createDataFrame([(i, "SET", f"k{i}", v, None) for i in range(50)], schema), folder, files=2)
    got = lambda: {(r.key, r.value) for r in state.replay(wal.read_ops(spark, folder), 0).collect()}
    for n, size in enumerate((100, 1 << 20, 100, 100)):  # several files, one, several
        write(f"v{n}")
        monkeypatch.setattr(wal, "SNAPSHOT_BYTES", size)
        wal.compact(spark, folder, 0)
        names = sorted(os.listdir(folder))
        assert (names == ["snapshot.wal"]) == (size > 100) and not [x for x in names if x.startswith("wal_")]
        assert got() == {(f"k{i}", f"v{n}") for i in range(50)}
    open(f"{folder}/snapshot_00000099_000000.wal", "wb").close()  # of a job that never committed
    assert len(got()) == 50


def test_other_file_systems_are_an_error():
    for folder in ("hdfs://host/x", "s3a://bucket/x"):
        with pytest.raises(ValueError, match="mount"):
            wal.files_in_order(folder)
    assert wal.local_path("file:///a/b") == wal.local_path("file:/a/b") == wal.local_path("/a/b") == "/a/b"


def test_numbers_of_the_protocol():
    assert resp.parse(b":+12\r\n")[0] == (":", 12)
    for raw in (b":1_0\r\n", b": 1\r\n", b":\r\n", b"$ 1\r\na\r\n", b":99999999999999999999\r\n", b":0x1\r\n"):
        with pytest.raises(resp.ProtocolError):
            resp.parse(raw)
