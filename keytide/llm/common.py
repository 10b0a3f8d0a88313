"""What several operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows that a broadcast side may have; each caller states the row's width.
BROADCAST_ROWS = 1_000_000

#: A key counts as hot when it holds more than this share of all rows, so
#: there are never more than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1e-4
HOT_LEAST = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII takes the short way through lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster.  Only where that is unset,
    as in local tests, a folder under the warehouse is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_keytide_work"
    return base.rstrip("/")


def stash(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage, survives lost executors, and computes the rows
    once.  The files stay as long as the caller's cluster keeps the folder;
    ``unstash`` removes those an operator has finished with.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path  # noqa: SLF001
    return out


def stash_by(df: DataFrame, key: str, name: str = "t") -> DataFrame:
    """Like ``stash``, bucketed by ``key`` so that a later grouping by it reads
    the files where they are.  The table goes to the warehouse, which a cluster
    shares as well; ``unstash`` drops it."""
    spark = df.sparkSession
    table_name = f"keytide_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).format("parquet").saveAsTable(table_name)
    out = spark.table(table_name)
    out._stash_table = table_name  # noqa: SLF001
    return out


def unstash(*frames: DataFrame | None) -> None:
    """Remove what ``stash`` and ``stash_by`` wrote."""
    for df in frames:
        if name := getattr(df, "_stash_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        path = getattr(df, "_stash_path", None)
        if path:
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside has its shuffle files removed as soon as it ends.  Else they
    stay until the driver happens to collect the plans, so those of many steps in a
    row lie on the disks together."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def hot_limit(total: int) -> int:
    return max(HOT_LEAST, int(total * HOT_SHARE))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` to their ``groups`` (one row a key) without a hot task.

    Groups with more than ``hot_limit(total)`` rows are at most
    ``total / hot_limit(total)`` <= 10,000, so they are broadcast; the rows of
    all other keys are shuffled, and no key of those is large.
    """
    limit = hot_limit(total)
    hot = F.broadcast(groups.filter(F.col(size) > limit))
    cold = groups.filter(F.col(size) <= limit)
    first = rows.join(hot, keys, "inner")
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how)
    return first.unionByName(rest)


def _by_ids(rows: DataFrame, ids: DataFrame, key: str, count: int, how: str) -> DataFrame:
    """``rows`` joined to distinct ``ids`` (``count`` rows, 8 to 40 bytes each),
    of which at most BROADCAST_ROWS are broadcast at once.

    More of them are taken in ranges, each against the rows of that range: the
    rows don't move, and a range reads only the row groups that have ids of it.
    """
    ids = ids.select(F.col(f"`{ids.columns[0]}`").alias(key))
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(ids), key, how)
    parts = -(-5 * count // (4 * BROADCAST_ROWS))
    kind, c = rows.schema[key].dataType, F.col(f"`{key}`")
    if isinstance(kind, T.NumericType):
        cuts = sorted(set(ids.select(c.cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 1 / (16 * parts))))
        at = c.cast("double") if isinstance(kind, T.FractionalType) else c
        cuts = [x if isinstance(kind, T.FractionalType) else int(x) for x in cuts]
        ranges = [(F.lit(True) if lo is None else at >= lo) & (F.lit(True) if hi is None else at < hi) for lo, hi in zip([None, *cuts], [*cuts, None])]
    else:
        ranges = [F.pmod(F.xxhash64(c), F.lit(parts)) == i for i in range(parts)]
    out = None
    for r in ranges:
        one = rows.filter(r).join(F.broadcast(ids.filter(r)), key, how)
        out = one if out is None else out.unionByName(one)
    return out


def without_ids(rows: DataFrame, gone: DataFrame, key: str, count: int) -> DataFrame:
    """``rows`` without those whose ``key`` is in the first column of ``gone``
    (``count`` distinct rows).  No row moves; rows with a null key stay."""
    if count == 0:
        return rows
    names, c = [F.col(f"`{n}`") for n in rows.columns], F.col(f"`{key}`")
    if count <= BROADCAST_ROWS:  # an anti join keeps null keys
        return _by_ids(rows, gone, key, count, "left_anti").select(*names)
    return _by_ids(rows.filter(c.isNotNull()), gone, key, count, "left_anti").select(*names).unionByName(rows.filter(c.isNull()))


def with_ids(rows: DataFrame, ids: DataFrame, key: str, count: int) -> DataFrame:
    """``rows`` whose ``key`` is in the first column of ``ids`` (``count`` distinct rows)."""
    if count == 0:
        return rows.limit(0)
    return _by_ids(rows, ids, key, count, "left_semi").select(*[F.col(f"`{n}`") for n in rows.columns])


#: Rows and bytes of whole texts that an operator works on at once, about.
TEXT_ROWS = 2000
TEXT_BYTES = 1 << 20
#: Where whole slices are worked on as arrays and not as Python strings.
ARRAY_BYTES = 4 << 20


def text_slices(batches: Iterator[pa.RecordBatch], at: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most TEXT_ROWS rows, each closed by the row
    that brings the texts in column ``at`` to TEXT_BYTES (or ``most``)."""
    most = TEXT_BYTES if most is None else most
    for batch in batches:
        texts = batch.column(at)
        if isinstance(texts, pa.ListArray):
            size = pc.multiply(pc.list_value_length(texts), texts.type.value_type.bit_width // 8)
        else:
            size = pc.binary_length(texts)
        ends = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            last = min(int(np.searchsorted(ends, done + most)), first + TEXT_ROWS - 1, batch.num_rows - 1)
            yield batch.slice(first, last + 1 - first)
            first = last + 1
    pa.default_memory_pool().release_unused()  # the worker lives on for other tasks


def clean_names(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns, so that other columns of the input can't clash."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])
