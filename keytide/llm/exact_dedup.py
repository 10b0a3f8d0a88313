"""Exact deduplication: two Bloom passes, then only possible repeats move.

Pass 1 gives each row a slot of a blocked Bloom filter: a 64-bit word and two
bits in it.  Slots seen twice are set in the filter.  Pass 2 probes it: a row
whose slot isn't set has a hash that no other row has and passes straight
through; the others shuffle on their digest and are grouped.  A false positive
only costs that row's shuffle.

Both passes work on (id, digest), which one read of the texts gives.  Texts
themselves never move for their digest: ``deduplicate`` drops rows where they
lie, by their ids.  Slots are counted as rows of 16 bytes and not as bitmaps: a
task's share of the filter is so sparse that its bitmaps would be larger.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bits of filter a row gets, and how large the set words may be to be broadcast.
BITS_PER_ROW = 16
BROADCAST_BYTES = 32 << 20
_BYTES_PER_WORD = 24  # a row of the filter as it is broadcast


def _digest(text):
    return F.sha2(common.ascii_lower(F.coalesce(text, F.lit(""))), 256)


def _slots(rows: DataFrame, words: int) -> DataFrame:
    h = F.xxhash64("digest")
    first, second = F.shiftrightunsigned(h, 6).bitwiseAND(63), h.bitwiseAND(63)
    one = F.lit(1).cast("long")
    return rows.withColumn("word", F.pmod(F.shiftrightunsigned(h, 12), F.lit(words))).withColumn(
        "mask", F.call_function("shiftleft", one, first.cast("int")).bitwiseOR(F.call_function("shiftleft", one, second.cast("int")))
    )


def repeat_filter(rows: DataFrame, total: int) -> tuple[DataFrame, int]:
    """Pass 1 over (…, digest): the filter as (word, bits), and its words."""
    words = max(1, -(-total * BITS_PER_ROW // 64))
    twice = _slots(rows, words).groupBy("word", "mask").agg(F.count("*").alias("n")).filter("n > 1")
    return twice.groupBy("word").agg(F.bit_or("mask").alias("bits")), words


def split_by_filter(rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Pass 2 over (…, digest): rows that may repeat, and rows that surely don't.

    The set words are counted before they are broadcast; beyond BROADCAST_BYTES
    the digests, and nothing wider, are joined to them by a shuffle.
    """
    bits, words = repeat_filter(rows, total)
    bits = common.stash(bits, "bloom")
    bits = F.broadcast(bits) if bits.count() * _BYTES_PER_WORD <= BROADCAST_BYTES else bits.hint("shuffle_hash")
    probed = _slots(rows, words).join(bits, "word", "left")
    hit = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    names = rows.columns
    return probed.filter(hit).select(*names), probed.filter(~hit).select(*names)


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(rows that may repeat, with their group's best row and size; rows that don't; number of all)."""
    narrow = common.clean_names(docs, {"doc_id": id_col, "text": text_col})
    rows = common.stash(narrow.select("doc_id", _digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("uid")), "digests")
    total = rows.count()
    maybe, alone = split_by_filter(rows, total)
    groups = maybe.groupBy("digest").agg(F.max(F.struct("doc_id", "uid")).alias("best"), F.count("*").alias("n"))
    return common.join_groups(maybe, common.stash(groups, "groups"), ["digest"], "n", total), alone, total


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty.  Of equal texts the row with the largest id stays; null ids are
    smaller than all others.  Of repeated rows with that same id one stays.
    Other columns are ignored; an empty table gives an empty result.
    """
    grouped, alone, _ = _grouped(docs, id_col, text_col)
    return grouped.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("uid") == F.col("best.uid")).alias("kept"), F.col("digest").alias("text_sha256")
    ).unionByName(
        alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns unchanged.

    Texts are equal, and the row that stays is chosen, as in ``classify``.  Rows
    are dropped by their id where they lie.  Rows that an id can't name, because
    it is null or several rows have it, are matched by their digest instead, and
    only those with a repeated text move.  An empty table gives an empty result.
    """
    key = F.col(f"`{id_col}`")
    grouped, alone, total = _grouped(docs, id_col, text_col)
    grouped = common.stash(grouped.filter("n > 1"), "repeats")
    dropped = grouped.filter("uid <> best.uid")
    gone = common.stash(dropped.filter("doc_id is not null").select("doc_id").distinct(), "gone")
    # ids of dropped rows that other rows have as well
    twice = grouped.select("doc_id").unionByName(alone.select("doc_id")).join(gone, "doc_id", "left_semi").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    twice = common.stash(twice, "twice")
    several, nameless = twice.count(), dropped.filter("doc_id is null").limit(1).count()
    whole = common.without_ids(docs, gone, id_col, gone.count())
    if not several and not nameless:
        return whole
    odd = docs.filter(key.isNull()).unionByName(common.with_ids(docs, twice, id_col, several))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sealed = odd.select(row, key.alias("doc_id"), _digest(F.col(f"`{text_col}`")).alias("digest"))
    named = common.with_ids(grouped, twice, "doc_id", several).unionByName(grouped.filter("doc_id is null"))
    keep = named.groupBy("digest").agg(F.first("best.doc_id").alias("keep_id"), F.first("n").alias("n"))
    told = common.join_groups(sealed, common.stash(keep, "keep"), ["digest"], "n", total, "left")
    best = told.filter(F.col("n").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["digest"])
    return whole.filter(key.isNotNull()).unionByName(told.filter("n is null").unionByName(best).select("row.*"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
