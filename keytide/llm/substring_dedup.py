"""Substring deduplication: paragraphs that collide in MinHash bands, and runs of words.

Paragraphs are the lines of WIDTH words or more.  Each has BANDS bands of ROWS
MinHashes over its runs of SHINGLE words.  Different paragraphs with a band in
common are compared inside their bucket by the exact Jaccard similarity of their
shingles, and links of SIMILARITY or more make components of paragraphs.  Of a
component that occurs in several documents the first occurrence stays and all
others are to be removed.  Two paragraphs of similarity 0.8 have a band in common
with probability 0.9998, of 0.9 with 0.9999999.

A repeated passage seldom fills a line, so every run of WIDTH words takes part as
well, and so does the whole of a shorter text of SHINGLE words or more.  A run's
band is one MinHash over its runs of SEED words, at the place of the least (an
anchor): equal runs have the same MinHash at the same place.  Runs whose anchors
several documents share collide, and are verified by a hash over all of their
words.  Equal ones form one class, of which the first occurrence stays, too;
further ones in the same document go.  Documents are clustered by components of
the links from removed to kept paragraphs and runs.

Near passages inside lines: of two passages of 51 words or more whose 5-word
shingles have a Jaccard similarity of 0.8, some WIDTH words in a row are equal.  A
change costs either side at least 4 shingles, so e changes inside need 36 e
shingles, and leave at least WIDTH words in a row.  What differs between two runs
is removed with them where the whole span still has that similarity, counted
exactly, to the span that stays.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import text_slices
from .components import components
from .lm_score import _mix

SHINGLE = 5
SEED = 12
SPAN = 13
WIDTH = SEED + SPAN - 1
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
#: Paragraphs and shingles of a bucket that are compared at once, about; a larger
#: bucket is cut into tiles, and each pair of tiles is compared on its own.
TILE, TILE_SHINGLES = 2048, 1 << 20
#: Documents that one broadcast row may stand for, see ``removals``.
BUCKET = 2048
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.random.default_rng(3).integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=400_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 11)


@lru_cache(maxsize=1)
def _word_chars() -> np.ndarray:
    """Of every code point, whether words have it."""
    out = np.zeros(0x110000, bool)
    for m in re.finditer(r"\w+", "".join(map(chr, range(len(out))))):
        out[m.start() : m.end()] = True
    return out


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words, how many each line has, how many lines each text has);
    words are runs of \\w in the lower-cased text."""
    code = np.frombuffer("\n".join([t or "" for t in texts]).lower().encode("utf-32-le", "surrogatepass"), "<u4")
    word = _word_chars()[code]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    first, size = edge[::2], edge[1::2] - edge[::2]
    begin = np.cumsum(size) - size
    h = np.zeros(0, np.uint64)
    if len(first):
        place = np.arange(1, int(size.sum()) + 1) - np.repeat(begin, size)
        h = _mix(np.add.reduceat(_mix(code[word] + place.astype(np.uint64) * GOLDEN), begin) + size.astype(np.uint64))
    ends = np.append(np.flatnonzero(code == ord("\n")), len(code))
    return h, np.diff(np.searchsorted(first, ends), prepend=0), np.array([(t or "").count("\n") + 1 for t in texts])


def shingles(h: np.ndarray) -> np.ndarray:
    """The hash of every run of SHINGLE words of these."""
    n = max(0, len(h) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = _mix(out * GOLDEN + h[i : i + n] + np.uint64(1))
    return out


def shingle_hashes(ws: list[str]) -> np.ndarray:
    return shingles(np.fromiter(map(_word_hash, ws), np.uint64, len(ws)))


class _Slice:
    """The words of some texts in a row: ``first`` word and ``size`` of each text,
    and the hashes ``sh`` of all shingles, which mean nothing across an end."""

    def __init__(self, texts: list[str | None]):
        h, self.in_line, n_lines = word_hashes(texts)
        self.line_text = np.repeat(np.arange(len(texts)), n_lines)
        self.size = np.bincount(self.line_text, self.in_line, len(texts)).astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.text = np.repeat(np.arange(len(texts)), self.size)  # of each word
        self.sh = shingles(h)

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, first words, hashes) of the texts that are shorter than a run."""
        found = [np.flatnonzero(self.size == n) for n in range(SHINGLE, WIDTH)]
        h = [run_hashes(self.sh, self.first[t], n) for n, t in enumerate(found, SHINGLE)]
        rows = np.concatenate(found)
        return rows, np.zeros(len(rows), np.int64), np.concatenate(h)

    def runs(self, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, places in them, hashes) of the runs ``at`` and of ``whole``."""
        rows = self.text[at]
        return tuple(map(np.concatenate, zip((rows, at - self.first[rows], h), self.whole())))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, places, hashes) of all anchors; a text shorter than a run has
        one, the hash of the whole."""
        n = max(0, len(self.text) - SEED + 1)
        h = run_hashes(self.sh, np.arange(n), SEED)
        at = least(h, SPAN)
        left = (self.first + self.size)[self.text] - np.arange(len(self.text))
        at = at[left[: len(at)] >= WIDTH]
        at = at[np.append(True, at[1:] != at[:-1])[: len(at)]]  # they only grow
        return self.runs(at, h[at])

    def around(self, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, places, hashes) of all paragraphs around the anchors ``at`` of the
        texts ``row``, and of all texts that are shorter than a run."""
        low = self.first[row][:, None]
        near = low + at[:, None] - np.arange(SPAN)
        held = np.zeros(len(self.text), bool)
        held[near[(near >= low) & (near <= low + self.size[row][:, None] - WIDTH)]] = True
        at = np.flatnonzero(held)
        return self.runs(at, run_hashes(self.sh, at, WIDTH))


def run_hashes(sh: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` words from ``at``, over all of its words."""
    out = np.zeros(len(at), np.uint64)
    for i in sorted({*range(0, width - SHINGLE + 1, SHINGLE), width - SHINGLE}):
        out = _mix(out * GOLDEN + sh[at + i])
    return out


def least(h: np.ndarray, span: int) -> np.ndarray:
    """Of every ``span`` hashes in a row, the place of the first least one."""
    at, have = np.arange(len(h)), 1
    while have < span:
        step = min(have, span - have)
        a, b = at[: max(0, len(at) - step)], at[step:]
        at = np.where(h[b] < h[a], b, a)
        have += step
    return at


def bands(sh: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes over all words, keys of the bands) of the paragraphs of ``size``
    words, WIDTH or more, from ``at``; in order and apart from each other."""
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros((0, BANDS), np.uint64)
    cut = np.stack([at, at + size - SHINGLE + 1], axis=1).reshape(-1)
    sh = np.append(sh, np.uint64(0))  # the last may end with all
    place = np.arange(len(sh)) - np.repeat(np.append(0, cut), np.diff(np.concatenate([[0], cut, [len(sh)]])))
    h = _mix(np.add.reduceat(_mix(sh + place.astype(np.uint64) * GOLDEN), cut)[::2] + size.astype(np.uint64))
    keys = np.zeros((len(at), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(at), b + 1, np.uint64)
        for factor in FACTORS[b]:
            key = _mix(key * GOLDEN + np.minimum.reduceat(sh * factor, cut)[::2])
        keys[:, b] = key
    return h, keys


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _rows(b: pa.RecordBatch, keep: int, found: tuple[np.ndarray, np.ndarray, np.ndarray], names: list[str]) -> pa.RecordBatch:
    """The first ``keep`` columns of ``b`` with the (row, position, hash) of ``found``."""
    rows, pos, h = found
    return pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(rows)) for i in range(keep)), pa.array(pos.astype(np.int32)), _signed(h)], names)


def _seeds(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, h, size, bands) of all anchors, without the last two, and
    of all lines that are paragraphs."""

    def work(batches):
        for b in text_slices(batches, 2):
            s = _Slice(b.column(2).to_pylist())
            seeds = _rows(b, 2, s.anchors(), ["doc_id", "th", "pos", "h"])
            none = [pa.nulls(seeds.num_rows, t) for t in (pa.int32(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*seeds.columns, *none], [*seeds.schema.names, "size", "bands"])
            long = s.in_line >= WIDTH
            size, first, row = s.in_line[long], (np.cumsum(s.in_line) - s.in_line)[long], s.line_text[long]
            h, keys = bands(s.sh, first, size)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * BANDS, pa.int32()), _signed(keys.reshape(-1)))
            lines = _rows(b, 2, (row, first - s.first[row], h), ["doc_id", "th", "pos", "h"])
            yield pa.RecordBatch.from_arrays([*lines.columns, pa.array(size.astype(np.int32)), listed], [*lines.schema.names, "size", "bands"])

    return docs.mapInArrow(work, "doc_id bigint, th bigint, pos int, h bigint, size int, bands array<bigint>")


def _windows(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, h) of all paragraphs of (doc_id, text, at)."""

    def work(batches):
        for b in text_slices(batches, 1):
            row = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy(zero_copy_only=False))
            found = _Slice(b.column(1).to_pylist()).around(row, b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            yield _rows(b, 1, found, ["doc_id", "pos", "h"])

    return docs.mapInArrow(work, "doc_id bigint, pos int, h bigint")


def jaccard_forest(names: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Edges that connect all sets which pairs of at least ``similarity`` connect."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        hit = 0 if size.min() < similarity * size.max() - 1e-9 else len(np.intersect1d(*sets, assume_unique=True))
        return [(int(names[0]), int(names[1]))] if hit >= similarity * (size.sum() - hit) - 1e-9 else []
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), size)[np.argsort(item, kind="stable")]
    ends, until = np.append(0, np.cumsum(size)), np.append(0, np.cumsum(np.bincount(item)))
    alive = np.ones(len(sets), bool)
    edges, queue = [], []
    for start in range(len(sets)):
        if not alive[start]:
            continue
        alive[start] = False
        queue.append(start)
        while queue:
            seed = queue.pop()
            if not alive.any():
                return edges
            held = [holders[until[i] : until[i + 1]] for i in item[ends[seed] : ends[seed + 1]]]
            hit = np.bincount(np.concatenate(held), minlength=len(sets))
            near = np.flatnonzero(alive & (hit >= similarity * (size[seed] + size - hit) - 1e-9))
            edges += [(int(names[seed]), int(names[k])) for k in near]
            alive[near] = False
            queue += near.tolist()
    return edges


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, sh): the distinct shingles of the paragraphs ``wanted`` (doc_id, th, pos, size, h)."""
    lists = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "size", "h")).alias("found"))

    def work(batches):
        for b in text_slices(batches, 0):
            hs, sets = [], []
            texts = _Slice(b.column(0).to_pylist())
            for first, found in zip(texts.first.tolist(), b.column(1).to_pylist()):
                hs += [f["h"] for f in found]
                sets += [np.unique(texts.sh[first + f["pos"] : first + f["pos"] + f["size"] - SHINGLE + 1]) for f in found]
            ends = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(np.concatenate(sets)))], ["h", "sh"])

    rows = docs.join(lists, ["doc_id", "th"]).select("text", "found")
    return rows.mapInArrow(work, "h bigint, sh array<bigint>").dropDuplicates(["h"])


def _verify(members: DataFrame) -> DataFrame:
    """Links (a, b) inside the buckets of (key, tiles, h, sh)."""
    many = F.col("tiles") > 1
    tile = F.when(many, F.pmod(F.xxhash64("h"), F.col("tiles"))).otherwise(0).cast("int")
    other = F.when(many, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(F.lit(0)))
    dealt = members.withColumn("t", tile).withColumn("u", F.explode(other))
    dealt = dealt.select("key", F.least("t", "u").alias("t"), F.greatest("t", "u").alias("u"), "h", "sh")

    def work(batches):
        now, names, sets = None, [], []

        def close():
            edges = jaccard_forest(np.array(names), sets) if len(names) > 1 else []
            return [pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])] if edges else []

        for b in batches:
            flat, ends = b.column(4).flatten().to_numpy(), np.cumsum([0, *b.column(4).value_lengths().to_pylist()])
            for i, row in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)))):
                if row[:3] != now:
                    yield from close()
                    now, names, sets = row[:3], [], []
                names.append(row[3])
                sets.append(flat[ends[i] : ends[i + 1]].copy())
        yield from close()

    return dealt.repartition("key", "t", "u").sortWithinPartitions("key", "t", "u").mapInArrow(work, "a bigint, b bigint").distinct()


def _near(docs: DataFrame, found: DataFrame, tile: int) -> DataFrame:
    """The lines of ``found`` (doc_id, th, pos, h, size, bands) that another
    document has in other words, as paragraphs of WIDTH words in the columns of
    ``removals``."""
    classes = found.groupBy("h").agg(F.min(F.struct("doc_id", "th", "pos", "size")).alias("at"), F.first("bands").alias("bands"))
    classes = common.stash(classes, "paragraphs")
    dealt = classes.select(F.explode("bands").alias("key"), "h", F.col("at.size").alias("size"))
    buckets = dealt.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total")).filter("n > 1")
    tiles = F.ceil(2 * F.greatest(F.col("n") / tile, F.col("total") / TILE_SHINGLES))
    buckets = buckets.select("key", "n", F.when((F.col("n") > tile) | (F.col("total") > TILE_SHINGLES), tiles).otherwise(1).cast("int").alias("tiles"))
    buckets = common.stash(buckets, "buckets")
    members = common.join_groups(dealt.drop("size"), buckets, ["key"], "n", BANDS * classes.count())
    members = common.stash(members.select("key", "tiles", "h"), "members")
    sets = common.stash(_sets(docs, classes.select("h", "at.*").join(members.select("h").distinct(), "h")), "sets")
    common.unstash(classes, buckets)
    roots = components(_verify(members.join(sets, "h").select("key", "tiles", "h", "sh")))
    common.unstash(members, sets)
    named = found.select("doc_id", "pos", "size", "h").join(roots.withColumnRenamed("node", "h"), "h").select("doc_id", "pos", "size", F.col("root").alias("cluster"))
    named = common.stash(named, "near")
    groups = named.groupBy("cluster").agg(F.min(F.struct("doc_id", "pos")).alias("keep"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("last > keep.doc_id")
    repeated = common.join_groups(named, groups.select("cluster", "keep", "n"), ["cluster"], "n", named.count())
    last = F.col("pos") + F.col("size") - WIDTH
    parts = F.explode(F.array_union(F.sequence("pos", last, F.lit(WIDTH)), F.array(last)))
    removed = F.struct("doc_id", "pos") != F.col("keep")
    out = repeated.select("doc_id", parts.alias("pos"), "cluster", F.col("keep.doc_id").alias("keep_id"), F.lit(None).cast("int").alias("keep_pos"), removed.alias("removed"))
    out = common.stash(out, "near")
    common.unstash(named)
    return out


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, tile: int = TILE) -> DataFrame:
    """The runs that occur in several documents, and those that cover paragraphs
    which several have nearly alike: (doc_id, pos, cluster, keep_id, keep_pos,
    removed).  pos is the first of WIDTH words, keep_id and keep_pos are the
    occurrence that stays, and removed says that this isn't that occurrence nor
    overlaps it.  For near paragraphs keep_pos is null.

    Texts that are in more than ``bucket`` documents get their anchors by a
    broadcast, at most one row for each ``bucket`` documents.  What is written on
    the way is removed as soon as the next table is.
    """
    rows = common.clean_names(docs, {"doc_id": id_col, "text": text_col}).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    written = common.stash(_seeds(rows), "seeds")
    near = _near(rows, written.filter("size is not null"), tile)
    seeds = written.filter("size is null").select("doc_id", "th", "pos", "h")
    shared = seeds.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).filter("low < high").select("h", "n")
    shared = common.stash(shared, "shared")
    hits = common.join_groups(seeds.select("th", "pos", "h"), shared, ["h"], "n", seeds.count())
    at = hits.groupBy("th", "pos").agg(F.count("*").alias("n")).groupBy("th").agg(F.collect_list("pos").alias("at"), F.max("n").alias("n"))
    at = common.stash(at, "anchors")
    common.unstash(written, shared)
    often, seldom = F.broadcast(at.filter(F.col("n") > bucket)), at.filter(F.col("n") <= bucket)
    texts = rows.join(often, "th").select("doc_id", "text", "at").unionByName(rows.join(seldom, "th").select("doc_id", "text", "at"))
    windows = common.stash(_windows(texts), "windows")
    common.unstash(at)
    classes = windows.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("keep"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("last > keep.doc_id")
    groups = common.stash(classes.select("h", "keep", "n"), "classes")
    repeated = common.join_groups(windows, groups, ["h"], "n", windows.count())
    kept = (F.col("doc_id") == F.col("keep.doc_id")) & (F.col("pos") < F.col("keep.pos") + WIDTH)
    out = repeated.select("doc_id", "pos", F.col("h").alias("cluster"), F.col("keep.doc_id").alias("keep_id"), F.col("keep.pos").alias("keep_pos"), (~kept).alias("removed"))
    out = common.stash(out.unionByName(near), "repeated")
    common.unstash(windows, groups, near)
    return out


def cover(pos: np.ndarray) -> list[int]:
    """The fewest of the sorted paragraphs ``pos`` that have all words of them."""
    out: list[int] = []
    for i, p in enumerate(pos):
        last = i + 1 == len(pos)
        if not out or p > out[-1] + WIDTH or last or (pos[i + 1] > out[-1] + WIDTH and p > out[-1]):
            out.append(int(p))
    return out


def bridges(pos: np.ndarray, keep: np.ndarray, keep_pos: np.ndarray) -> list[int]:
    """Paragraphs over what differs between two runs of paragraphs that stay in
    one document, where the span of both has SIMILARITY to the span there."""
    new = np.flatnonzero((np.diff(pos) != 1) | (np.diff(keep) != 0) | (np.diff(keep_pos) != 1)) + 1
    first, last = np.append(0, new), np.append(new, len(pos)) - 1
    size = last - first + WIDTH - SHINGLE + 1  # shingles in a run
    out = []
    for a, b, n, m in zip(first[1:], last[:-1], size[:-1], size[1:]):
        gap, other = pos[a] - pos[b] - WIDTH, keep_pos[a] - keep_pos[b] - WIDTH
        if keep[a] == keep[b] and 0 < gap and -WIDTH < other and (n + m) >= SIMILARITY * (n + m + max(0, gap + SHINGLE - 1) + max(0, other + SHINGLE - 1)):
            out += range(int(pos[b]) + WIDTH, int(pos[a]), WIDTH)
    return out


def _per_document(repeated: DataFrame) -> DataFrame:
    """doc_id, n_repeated, n_removed, removed_at, keep_ids."""

    def work(batches):
        for b in batches:
            counts, gone, ids = [], [], []
            ends = np.cumsum([0, *b.column(1).value_lengths().to_pylist()])
            found = b.column(1).flatten()
            cols = [(pc.fill_null(found.field(i), -1) if i == 2 else found.field(i)).to_numpy(zero_copy_only=False) for i in range(4)]
            for s, e in zip(ends, ends[1:]):
                pos, keep, keep_pos, removed = (c[s:e] for c in cols)
                near = keep_pos < 0
                near_pos, near_keep, near_gone = pos[near], keep[near], removed[near].astype(bool)
                pos, keep, keep_pos, removed = pos[~near], keep[~near], keep_pos[~near], removed[~near]
                pos, at = np.unique(pos, return_index=True)
                keep, keep_pos, removed = keep[at], keep_pos[at], removed[at].astype(bool)
                counts.append(len(cover(np.union1d(pos, near_pos))))
                more = bridges(pos[removed], keep[removed], keep_pos[removed]) if removed.any() else []
                gone.append(cover(np.unique(np.concatenate([pos[removed], np.array(more, pos.dtype), near_pos[near_gone]]))))
                ids.append(np.union1d(keep[removed], near_keep[near_gone]).tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array([len(g) for g in gone], pa.int64()), pa.array(gone, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int64()))],
                ["doc_id", "n_repeated", "n_removed", "removed_at", "keep_ids"],
            )

    lists = repeated.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "keep_id", "keep_pos", "removed")).alias("found"))
    return lists.mapInArrow(work, "doc_id bigint, n_repeated bigint, n_removed bigint, removed_at array<int>, keep_ids array<bigint>")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, repeated, n_repeated, n_removed,
    removed_at array<int> (first words of the paragraphs to remove), keep_ids
    array<bigint> (documents whose occurrence stays instead), component_id.

    Of paragraphs that overlap, n_repeated and removed_at have the fewest that
    hold all their words; n_removed is the length of removed_at.
    component_id is the least id among documents tied by repeated paragraphs.
    Null texts and those of under SHINGLE words have no paragraph; texts of under
    WIDTH words are one, others are covered whole.  What repeats in one document
    only isn't repeated; rows with a null id take part in nothing; rows that
    repeat an id are one document.  Ids are cast to long; columns of other names
    are ignored; an empty table gives an empty result.
    """
    ids = common.clean_names(docs, {"doc_id": id_col}).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    with common.shuffles_removed(docs.sparkSession):
        repeated = removals(docs.filter(F.col(f"`{id_col}`").isNotNull()), id_col, text_col, bucket, tile)
        ties = components(repeated.select(F.col("doc_id").alias("a"), F.col("keep_id").alias("b")).filter("a <> b").distinct())
    per = _per_document(repeated)
    out = ids.join(per, "doc_id", "left").join(ties.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select(
        "doc_id", F.col("n_repeated").isNotNull().alias("repeated"), F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("removed_at", F.array().cast("array<int>")).alias("removed_at"), F.coalesce("keep_ids", F.array().cast("array<bigint>")).alias("keep_ids"), F.coalesce("root", "doc_id").alias("component_id"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"))
