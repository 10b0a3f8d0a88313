"""The binary operation log as a Spark data source.

A record is ``crc32 u32 | length u32 | op u8 | key length u32 | key | value``,
little-endian; length counts from op on, as does the checksum.  An expiry's
value is its instant in nanoseconds, 8 bytes big-endian.  A file ends at its
first short, corrupt or undecodable record.  A file is read by one task, record
by record.

A snapshot comes first, then the logs ``wal_<append>_<part>_<job>.log`` by name:
appends are numbered on from the largest number there is, so a later append is
replayed later.  Appends that run at the same time have no order.  A snapshot is
one file ``snapshot.wal``, or files ``snapshot_<number>_<part>.wal``, of which the
largest number with a file ``snapshot_<number>.ok`` counts.  New files are written
under other names and renamed when their job commits.

Folders are local or mounted paths that all nodes see; of other file systems the
source says so.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from keytide.operators import state

# Fixed values of the format.
CODES = {"SET": 1, "DEL": 2, "EXPIRE": 3, "PERSIST": 4}
SNAPSHOT, PREFIX, SUFFIX = "snapshot.wal", "wal_", ".log"
SNAPSHOT_PART, SNAPSHOT_DONE = re.compile(r"snapshot_(\d{8})_\d{6}\.wal"), re.compile(r"snapshot_(\d{8})\.ok")
NAMES = {v: k for k, v in CODES.items()}
HEAD, BODY = struct.Struct("<II"), struct.Struct("<BI")
SCHEMA = "file_ord int, rec_no bigint, op string, key string, value binary"


def encode(op: int, key: bytes, value: bytes) -> bytes:
    payload = BODY.pack(op, len(key)) + key + value
    return HEAD.pack(zlib.crc32(payload), len(payload)) + payload


def decode(raw: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """Records up to the first that isn't whole and right."""
    yield from read_records(io.BytesIO(raw), len(raw))


def read_records(f: BinaryIO, size: int) -> Iterator[tuple[int, bytes, bytes]]:
    """The records of an open file of ``size`` bytes, one in memory at a time."""
    left = size
    while left >= HEAD.size:
        crc, n = HEAD.unpack(f.read(HEAD.size))
        left -= HEAD.size + n
        if left < 0 or n < BODY.size:
            return
        payload = f.read(n)
        if len(payload) < n or zlib.crc32(payload) != crc:
            return
        op, k = BODY.unpack_from(payload)
        if BODY.size + k > n:
            return
        yield op, payload[BODY.size : BODY.size + k], payload[BODY.size + k :]


def pack_expiry(us: int) -> bytes:
    return struct.pack(">Q", us * 1000)


def unpack_expiry(value: bytes) -> int | None:
    """Microseconds: the part below is cut off."""
    return struct.unpack(">Q", value)[0] // 1000 if len(value) == 8 else None


def local_path(folder: str) -> str:
    """A folder as a plain path; other file systems than ``file:`` are an error."""
    path = re.sub(r"^file:(//)?", "", folder)
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        raise ValueError(f"log folders must be paths that all nodes mount, not {folder}")
    return path


def _names(folder: str) -> list[str]:
    folder = local_path(folder)
    return os.listdir(folder) if os.path.isdir(folder) else []


def snapshot_number(folder: str) -> int:
    """The number of the snapshot that counts; 0 is ``snapshot.wal`` or none."""
    return max((int(m[1]) for n in _names(folder) if (m := SNAPSHOT_DONE.fullmatch(n))), default=0)


def files_in_order(folder: str) -> list[str]:
    names, number = _names(folder), snapshot_number(folder)
    logs = sorted(n for n in names if n.startswith(PREFIX) and n.endswith(SUFFIX))
    parts = sorted(n for n in names if (m := SNAPSHOT_PART.fullmatch(n)) and int(m[1]) == number) if number else [SNAPSHOT] * (SNAPSHOT in names)
    return [os.path.join(local_path(folder), n) for n in parts + logs]


def rotate(folder: str) -> list[str]:
    """The files of the log so far.  Every append begins files of its own, so
    these are closed: whatever is appended from now on is in none of them."""
    return files_in_order(folder)


def next_append(folder: str) -> int:
    """One more than the largest number of an append in the folder."""
    found = (re.match(rf"{PREFIX}(\d+)_", n) for n in _names(folder))
    return 1 + max((int(m[1]) for m in found if m), default=0)


@dataclass
class LogFile(InputPartition):
    ordinal: int
    path: str


class LogReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        return [LogFile(i, p) for i, p in enumerate(files_in_order(self.folder))] or [LogFile(0, "")]

    def read(self, partition):
        if not partition.path or not os.path.exists(partition.path):
            return
        with open(partition.path, "rb", buffering=1 << 20) as f:
            for n, (op, key, value) in enumerate(read_records(f, os.path.getsize(partition.path))):
                yield partition.ordinal, n, NAMES.get(op), key.decode("utf-8", "replace"), value


@dataclass
class Written(WriterCommitMessage):
    path: str
    final: str


class LogWriter(DataSourceWriter):
    """One file per task; a task's file appears when the job commits."""

    def __init__(self, folder: str, overwrite: bool, snapshot: str):
        self.folder, self.overwrite = local_path(folder), overwrite
        self.snapshot, self.single = snapshot in ("one", "parts"), snapshot == "one"
        self.number = snapshot_number(folder) + 1 if self.snapshot else next_append(folder)
        self.job = uuid.uuid4().hex[:8]

    def write(self, rows):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        os.makedirs(self.folder, exist_ok=True)
        parts = f"snapshot_{self.number:08d}_{part:06d}.wal"
        name = SNAPSHOT if self.single else parts if self.snapshot else f"{PREFIX}{self.number:012d}_{part:08d}_{self.job}{SUFFIX}"
        path = os.path.join(self.folder, f".{name}.{uuid.uuid4().hex}")
        with open(path, "wb") as f:
            for r in rows:
                f.write(encode(CODES[r.op], (r.key or "").encode(), bytes(r.value or b"")))
            f.flush()
            os.fsync(f.fileno())
        return Written(path, os.path.join(self.folder, name))

    def commit(self, messages):
        old = files_in_order(self.folder) if self.overwrite else []
        old += [os.path.join(self.folder, n) for n in _names(self.folder) if self.snapshot and (n == SNAPSHOT or SNAPSHOT_PART.fullmatch(n) or SNAPSHOT_DONE.fullmatch(n))]
        for m in messages:
            if m:
                os.replace(m.path, m.final)
        new = {m.final for m in messages if m}
        if self.snapshot and not self.single:  # only now does it count
            done = os.path.join(self.folder, f"snapshot_{self.number:08d}.ok")
            os.makedirs(self.folder, exist_ok=True)
            with open(done, "wb") as f:
                os.fsync(f.fileno())
            new.add(done)
        for p in set(old) - new:
            os.unlink(p)

    def abort(self, messages):
        for m in messages:
            if m and os.path.exists(m.path):
                os.unlink(m.path)


class LogSource(DataSource):
    """``format("keytide_wal")`` with a folder as path; option ``snapshot``
    writes a snapshot, as ``one`` file or in ``parts``."""

    @classmethod
    def name(cls):
        return "keytide_wal"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LogReader(self.options["path"])

    def writer(self, schema, overwrite):
        return LogWriter(self.options["path"], overwrite, self.options.get("snapshot", ""))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)


def read_ops(spark: SparkSession, folder: str) -> DataFrame:
    """The log in a folder as operations; seq is (file, record) in one number.
    Unknown operation codes are left out."""
    register(spark)
    rows = spark.read.format("keytide_wal").load(folder).filter("op is not null")
    ns = F.conv(F.hex("value"), 16, 10).try_cast("decimal(20,0)")
    exp = F.when((F.col("op") == "EXPIRE") & (F.octet_length("value") == 8), F.floor(ns / 1000).cast("bigint"))
    return rows.select((F.col("file_ord").cast("bigint") * (1 << 40) + F.col("rec_no")).alias("seq"), "op", "key", F.when(F.col("op") == "SET", F.decode("value", "UTF-8")).alias("value"), exp.alias("exp_us"))


def write_ops(ops: DataFrame, folder: str, snapshot: bool = False, mode: str = "append", files: int | None = None) -> None:
    """Write (seq, op, key, value, exp_us) as log files in order of seq; other
    operations, null keys and expiries without an instant are left out."""
    ops = state.known(ops)
    register(ops.sparkSession)
    nine = F.lpad(F.hex(F.col("exp_us") * 1000), 16, "0")
    value = F.when(F.col("op") == "SET", F.encode(F.coalesce("value", F.lit("")), "UTF-8")).when(F.col("op") == "EXPIRE", F.unhex(nine)).otherwise(F.unhex(F.lit("")))
    n = files or (1 if snapshot else 0) or int(ops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (ops.repartitionByRange(n, "seq") if n > 1 else ops.coalesce(1)).sortWithinPartitions("seq")
    rows = ordered.select(F.lit(0).alias("file_ord"), F.col("seq").alias("rec_no"), "op", "key", value.alias("value"))
    rows.write.format("keytide_wal").mode(mode).option("snapshot", ("one" if n == 1 else "parts") if snapshot else "").save(folder)


#: Bytes of log for which a snapshot gets a file.
SNAPSHOT_BYTES = 256 << 20


def size_bytes(folder: str) -> int:
    return sum(os.path.getsize(p) for p in files_in_order(folder))


def compact(spark: SparkSession, folder: str, as_of: int, drop_ttl: bool = False) -> None:
    """Replace a folder's log by a snapshot of its state (and, unless dropped,
    the expiries); files written meanwhile stay."""
    before = rotate(folder)
    kept = state.compact(read_ops(spark, folder), 1 << 62, as_of, drop_ttl)
    ordered = kept.withColumn("seq", F.col("seq") * 2 + F.col("sub")).select("seq", "op", "key", "value", "exp_us")
    write_ops(ordered, folder, snapshot=True, files=-(-max(1, size_bytes(folder)) // SNAPSHOT_BYTES))
    for p in before:
        if os.path.basename(p).startswith(PREFIX):
            os.unlink(p)


def compact_if_large(spark: SparkSession, folder: str, as_of: int, limit: int = 64 << 20) -> bool:
    if size_bytes(folder) <= limit:
        return False
    compact(spark, folder, as_of)
    return True
