"""SimHash near-duplicates: pigeonhole blocks, then verified Hamming distance.

Fingerprints with at most D differing bits, cut into B > D blocks, agree on at
least B - D blocks.  Every choice of B - D blocks is a key; fingerprints that
share a key are compared.  B grows with the number of distinct fingerprints
and changes the work only, never the result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import text_slices
from .components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Fingerprints of one key that a task compares with each other; keys with
#: more go another way, whose work is linear in their number.
BUCKET = 4096


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """64-bit SimHash of the k-word shingles of a whole text, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n, digest = max(1, len(words) - k + 1), xxhash.xxh64_intdigest
    starts, ends = starts[:n].tolist(), ends[min(k, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; the fingerprint as a signed long."""

    def work(batches):
        for b in text_slices(batches, 1):
            fp = np.array([fingerprint(t, k) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    rows = common.clean_names(docs, {"doc_id": id_col, "text": text_col})
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def block_masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """A mask, as a signed long, for every choice of blocks - distance blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(parts[i] for i in c) for c in combinations(range(blocks), blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def choose_blocks(n: int, distance: int = DISTANCE) -> int:
    """The fewest blocks at which a key has less than about one fingerprint by
    chance, up to distance + 4 (70 keys at a distance of 4)."""
    b = distance + 1
    while b < distance + 4 and n > 2 ** (64 * (b - distance) // b) / 4:
        b += 1
    return b


def _keys(fps: DataFrame, distance: int, blocks: int) -> DataFrame:
    masks = block_masks(blocks, distance)
    assert len(masks) == comb(blocks, distance)
    return fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.c", "k.key")


def _forest(fps: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges that connect all fingerprints which links within ``distance`` connect."""
    left, right, rest, queue = [], [], fps, []
    while len(rest) or queue:
        if not queue:
            queue.append(rest[0])
            rest = rest[1:]
        seed = queue.pop()
        if not len(rest):
            break
        near = np.bitwise_count(rest ^ seed) <= distance
        if near.any():
            found = rest[near]
            left.append(np.full(len(found), seed))
            right.append(found)
            queue.extend(found)
            rest = rest[~near]
    return left, right


def _link_buckets(members: DataFrame, distance: int) -> DataFrame:
    """Edges inside buckets of bounded size; members has c, key, fp."""

    def work(batches):
        held_key, held = None, []

        def close():
            left, right = _forest(np.concatenate(held).view(np.uint64), distance)
            if left:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            c, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((np.diff(c) != 0) | (np.diff(key) != 0)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(c))):
                now = (int(c[a]), int(key[a]))
                if now != held_key:
                    if held and (out := close()):
                        yield out
                    held_key, held = now, []
                held.append(fp[a:b].copy())
        if held and (out := close()):
            yield out

    return members.select("c", "key", "fp").repartition("c", "key").sortWithinPartitions("c", "key").mapInArrow(work, "a bigint, b bigint")


def _ball(fps: DataFrame, radius: int) -> DataFrame:
    """Edges between all fingerprints within 2 * radius bits, by midpoints:
    two such have a common point within ``radius`` bits of both, and each
    fingerprint is tied to the least one at each of its points."""
    flips = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(64), r)]
    near = np.array(flips, np.uint64)

    def work(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                f = batch.column(0).slice(k, 256).to_numpy(zero_copy_only=False).view(np.uint64)
                mid = (f[:, None] ^ near[None, :]).reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(f, len(near)).view(np.int64)), pa.array(mid)], ["fp", "mid"])

    points = fps.select("fp").mapInArrow(work, "fp bigint, mid bigint")
    least = points.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").select("mid", "b")
    return points.join(least, "mid").select(F.col("fp").alias("a"), "b").filter("a <> b").distinct()


def links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(node, root): components of distinct fingerprints (column fp) under
    links of at most ``distance`` bits.  Fingerprints without links are absent.

    Keys with two members are settled by the aggregation that counts them, and
    keys with up to ``bucket`` members in one task each.  Members of larger
    keys are tied through midpoints instead: first at half the distance, which
    settles most such keys, then for those left at the whole distance.
    """
    n = fps.count()
    keyed = _keys(fps, distance, choose_blocks(n, distance))
    sizes = common.stash(keyed.groupBy("c", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "buckets")
    pairs = sizes.filter("n = 2").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
    members = common.stash(keyed.join(sizes.filter("n > 2").select("c", "key", "n"), ["c", "key"]), "members")
    edges = common.stash(pairs.unionByName(_link_buckets(members.filter(F.col("n") <= bucket), distance)).distinct(), "links")
    crowded = members.filter(F.col("n") > bucket)
    if crowded.limit(1).count():
        half = distance // 4
        edges = common.stash(edges.unionByName(_ball(crowded.select("fp").distinct(), half)), "links") if half else edges
        roots = components(edges)
        labelled = crowded.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        open_keys = labelled.groupBy("c", "key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("c", "key")
        open_fps = crowded.join(open_keys, ["c", "key"]).select("fp").distinct()
        edges = edges.unionByName(_ball(open_fps, -(-distance // 2)).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2 * -(-distance // 2)))
    return components(edges)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id, uid.

    component_id is the least doc_id that links reach, its own included.  Null
    and empty texts have fingerprint zero and link like any other.  Null ids
    are never a component's id unless it has no other.  Repeated rows each
    get a row; columns of other names are ignored; an empty table gives none.
    """
    if distance % 2:
        raise ValueError("the distance must be even")
    rows = common.stash(fingerprints(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "fps")
    fps = common.stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.min("uid").alias("uid0")), "distinct")
    total = rows.count()
    roots = common.stash(links(fps.select("fp"), distance).withColumnRenamed("node", "fp"), "roots")
    tied = fps.join(roots, "fp")
    ids = tied.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    named = common.join_groups(tied.select("fp", "n", "root"), common.stash(ids, "ids"), ["root"], "size", total).select("fp", "n", "component_id")
    named = named.unionByName(fps.join(roots, "fp", "left_anti").select("fp", "n", F.col("least").alias("component_id")))
    out = common.join_groups(rows, common.stash(named, "named"), ["fp"], "n", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "uid")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of least id of each component, columns unchanged.

    Rows with null id stay: nothing names them.  Rows that repeat an id stay
    or go together.
    """
    found = classify(docs, id_col, text_col)
    gone = common.stash(found.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return common.without_ids(docs, gone, id_col, gone.count())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents")).drop("uid")
