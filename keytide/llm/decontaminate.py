"""Benchmark decontamination: BM25 over test items with block-max WAND.

The index is over the benchmark's items.  Every document is cut into passages
of two strides that overlap by one, a stride being at least as long as the
longest item, so any copied item lies whole in some passage.  Each passage is
a query.  Item scores are divided by the score of the item for its own text,
so one threshold serves all items.

Retrieval follows block-max WAND on batches: items are sorted so that alike
ones share a block, each term keeps its largest weight per block, and a block
is opened for a passage only if the maxima of the passage's terms in it reach
the threshold; a coarser level of super-blocks is tested first.  Many passages
are searched at once, so no pivot moves along sorted lists: the bounds of all
blocks come from one sum.  Inside opened blocks scores are exact.  Everything at
or over the threshold is then verified: word shingles of the item as a whole in
the passage, with the shares of its question and of its answer beside it.

Items of like length go to shards of bounded size, each an index of its own,
that are broadcast; so there may be any number of items of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .common import text_slices
from .lm_score import _mix
from .substring_dedup import GOLDEN, _word_hash

K1, B = 1.2, 0.75
THRESHOLD = 0.5
SHINGLE = 5
OVERLAP = 0.8
MIN_STRIDE = 64
BLOCK = 4
SUPER = 8  # blocks in a super-block
#: Bytes of items' texts that make a shard, and shards that a worker keeps in memory.
SHARD_BYTES = 8 << 20
RESIDENT = 4
WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(ws: list[str], k: int = SHINGLE) -> set[tuple[str, ...]]:
    """k-word shingles; of fewer words the whole sequence, of none nothing."""
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's answer is its last sentence that isn't its only one and has
    words; the question is what stands before."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if words(p)]
    return (words(" ".join(parts[:-1])), words(parts[-1])) if len(parts) > 1 else (words(text), [])


def run_hashes(ws: list[str], k: int) -> np.ndarray:
    """The hash of every run of ``k`` words."""
    h = np.fromiter(map(_word_hash, ws), np.uint64, len(ws))
    n = len(ws) - k + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(k if n > 0 else 0):
        out = _mix(out * GOLDEN + h[i : i + n] + np.uint64(1))
    return out


@dataclass
class Part:
    """The distinct shingles of an item or a part of it: runs of ``k`` words."""

    k: int
    hashes: np.ndarray

    @classmethod
    def of(cls, ws: list[str]) -> Part | None:
        k = min(SHINGLE, len(ws))
        return cls(k, np.unique(run_hashes(ws, k))) if ws else None

    def share(self, ws: list[str]) -> float:
        """How much of it is among the runs of ``ws``."""
        return float(np.isin(self.hashes, run_hashes(ws, self.k)).mean())


@dataclass
class Item:
    item_id: object
    whole: Part
    question: Part | None
    answer: Part | None


class Index:
    """The inverted index: per term its items, weights and block maxima."""

    def __init__(self, items: list[tuple[object, str]]):
        rows = [(i, words(t), t) for i, t in items]
        rows = [r for r in rows if r[1]]
        df: dict[str, int] = {}
        for _, ws, _ in rows:
            for w in set(ws):
                df[w] = df.get(w, 0) + 1
        # alike items share their rarest shared word, so sort by it
        rows.sort(key=lambda r: (min(((df[w], w) for w in set(r[1]) if df[w] > 1), default=(0, "")), str(r[0])))
        self.items = [Item(i, Part.of(ws), *map(Part.of, question_answer(t))) for i, ws, t in rows]
        self.vocab = {w: k for k, w in enumerate(sorted(df))}
        n, self.longest = len(rows), max((len(ws) for _, ws, _ in rows), default=0)
        mean = sum(len(ws) for _, ws, _ in rows) / max(1, n)
        post: list[list[tuple[int, float]]] = [[] for _ in self.vocab]
        for k, (_, ws, _) in enumerate(rows):
            tf: dict[str, int] = {}
            for w in ws:
                tf[w] = tf.get(w, 0) + 1
            weight = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(ws) / mean)) for w, c in tf.items()}
            own = sum(weight.values())
            for w, x in weight.items():
                post[self.vocab[w]].append((k, x / own))
        self.offsets = np.cumsum([0, *map(len, post)])
        self.docs = np.array([d for p in post for d, _ in p], np.int32)
        self.weights = np.array([x for p in post for _, x in p], np.float32)
        self.n_blocks = -(-n // BLOCK)
        self.n_super = -(-self.n_blocks // SUPER)
        # block maxima per posting list, sparse: (term, block) -> max
        self.term_of = np.repeat(np.arange(len(post)), np.diff(self.offsets))
        self.block_offsets, self.blocks, self.block_max = self._maxima(BLOCK)
        self.super_offsets, self.supers, self.super_max = self._maxima(BLOCK * SUPER)

    def _maxima(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        block = self.docs // width
        key = self.term_of.astype(np.int64) * (1 << 32) | block
        firsts = np.flatnonzero(np.append(True, np.diff(key) != 0)) if len(key) else np.zeros(0, np.int64)
        top = np.maximum.reduceat(self.weights, firsts) if len(key) else np.zeros(0, np.float32)
        return np.searchsorted(self.term_of[firsts], np.arange(len(self.vocab) + 1)), block[firsts], top

    @staticmethod
    def _spread(terms: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, place) for all places of each entry's list."""
        size = offsets[terms + 1] - offsets[terms]
        entry = np.repeat(np.arange(len(terms)), size)
        return entry, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(offsets[terms], size)

    def _bound(self, passage, terms, offsets, ids, top, width, floor) -> np.ndarray:
        """Keys passage * width + id whose maxima add up to ``floor``."""
        entry, place = self._spread(terms, offsets)
        key = passage[entry].astype(np.int64) * width + ids[place]
        return _sums_from(key, top[place], floor)[0]

    def search(self, passage: np.ndarray, terms: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all scores of at least ``threshold``.

        ``passage`` and ``terms`` are parallel: the distinct terms of each.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        if not len(terms):
            return none
        slack = threshold - 1e-4
        live = self._bound(passage, terms, self.super_offsets, self.supers, self.super_max, self.n_super, slack)
        if not len(live):
            return none
        keep = np.isin(passage, np.unique(live // self.n_super))
        passage, terms = passage[keep], terms[keep]
        entry, place = self._spread(terms, self.block_offsets)
        inside = _in_sorted(passage[entry].astype(np.int64) * self.n_super + self.blocks[place] // SUPER, live)
        entry, place = entry[inside], place[inside]
        open_blocks = _sums_from(passage[entry].astype(np.int64) * self.n_blocks + self.blocks[place], self.block_max[place], slack)[0]
        if not len(open_blocks):
            return none
        keep = np.isin(passage, np.unique(open_blocks // self.n_blocks))
        passage, terms = passage[keep], terms[keep]
        entry, place = self._spread(terms, self.offsets)
        inside = _in_sorted(passage[entry].astype(np.int64) * self.n_blocks + self.docs[place] // BLOCK, open_blocks)
        entry, place = entry[inside], place[inside]
        key, score = _sums_from(passage[entry].astype(np.int64) * len(self.items) + self.docs[place], self.weights[place], slack)
        return key // len(self.items), key % len(self.items), score


def _sums_from(key: np.ndarray, value: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their sums, where these reach ``floor``."""
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order].astype(np.float64)
    firsts = np.flatnonzero(np.append(True, np.diff(key) != 0)) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(value, firsts) if len(key) else value
    ok = sums >= floor
    return key[firsts][ok], sums[ok]


def _in_sorted(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[at] == x


class Searcher:
    """Finds the items that are in documents."""

    def __init__(self, items: list[tuple[object, str]], threshold: float = THRESHOLD, overlap: float = OVERLAP):
        self.index = Index(items)
        self.stride = max(MIN_STRIDE, self.index.longest)
        self.threshold, self.overlap = threshold, overlap

    def passages(self, ws: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """(passage, term) pairs, distinct, and each passage's (document, first word)."""
        get, stride = self.index.vocab.get, self.stride
        where: list[tuple[int, int]] = []
        at, ids = [], []
        for d, w in enumerate(ws):
            t = np.fromiter((get(x, -1) for x in w), np.int64, len(w))
            n = max(1, -(-len(w) // stride) - 1) if len(w) else 0
            place = np.flatnonzero(t >= 0)
            t, first = t[place], len(where)
            slot = place // stride
            last = np.minimum(slot, n - 1)
            at += [first + last, first + slot[(slot > 0) & (slot - 1 < n) & (slot - 1 != last)] - 1]
            ids += [t, t[(slot > 0) & (slot - 1 < n) & (slot - 1 != last)]]
            where += [(d, k * stride) for k in range(n)]
        if not where:
            z = np.zeros(0, np.int64)
            return z, z, where
        key = np.unique(np.concatenate(at) * len(self.index.vocab) + np.concatenate(ids)) if self.index.vocab else np.zeros(0, np.int64)
        return key // max(1, len(self.index.vocab)), key % max(1, len(self.index.vocab)), where

    def find(self, texts: list[str | None]) -> list[list[dict]]:
        """Per text the items in it: item_id, score, overlap, question, answer;
        best passage each.  Items that share an id are items of their own."""
        ws = [words(t) for t in texts]
        passage, term, where = self.passages(ws)
        out: list[dict[int, dict]] = [{} for _ in texts]
        for p, k, score in zip(*(x.tolist() for x in self.index.search(passage, term, self.threshold))):
            d, first = where[p]
            got = self.verify(self.index.items[k], ws[d][first : first + 2 * self.stride])
            if got is not None and got["overlap"] > out[d].get(k, {"overlap": -1})["overlap"]:
                out[d][k] = {"item_id": self.index.items[k].item_id, "score": float(score), **got}
        return [list(x.values()) for x in out]

    def verify(self, item: Item, ws: list[str]) -> dict[str, float | None] | None:
        """The shares of the item's shingles in the passage, if that of the whole
        is high enough.  Its question and its answer have no veto: one word may
        be all of either."""
        whole = item.whole.share(ws)
        if whole < self.overlap:
            return None
        return {"overlap": whole, "question": item.question and item.question.share(ws), "answer": item.answer and item.answer.share(ws)}


def shards(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[object, str]]]:
    """The items with words, in lists of alike length and of about SHARD_BYTES."""
    held: dict[int, tuple[list, int]] = {}
    for r in common.clean_names(benchmark, {"item_id": id_col, "text": text_col}).filter("text is not null").toLocalIterator():
        n = len(words(r.text))
        if not n:
            continue
        kind = (max(n, MIN_STRIDE).bit_length() + 1) // 2
        rows, size = held.get(kind, ([], 0))
        rows.append((r.item_id, r.text))
        held[kind] = rows, size + len(r.text)
        if held[kind][1] >= SHARD_BYTES:
            yield held.pop(kind)[0]
    yield from (rows for rows, _ in held.values())


class Finder:
    """Searches the shards, which executors get as broadcasts, one after another."""

    def __init__(self, benchmark: DataFrame, threshold: float, overlap: float, id_col: str = "item_id", text_col: str = "text"):
        context = benchmark.sparkSession.sparkContext
        self.shards = [context.broadcast(Searcher(rows, threshold, overlap)) for rows in shards(benchmark, id_col, text_col)]

    def find(self, texts: list[str | None]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        for shard in self.shards:
            for mine, found in zip(out, shard.value.find(texts)):
                mine += found
            if len(self.shards) > RESIDENT:
                del shard._value  # it is read again from the executor's disk
        return [sorted(x, key=lambda r: (str(r["item_id"]), -r["overlap"])) for x in out]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """One row per input row: doc_id, n_items, items array<struct<item_id, score,
    overlap, question, answer>>, contaminated.

    Null and empty texts hold no item, null and empty items are in none; an
    empty benchmark is in no document.  Item ids may be of any plain type, null
    or shared: each row of the benchmark is an item.  Repeated rows are judged
    alike; other columns are ignored; an empty table gives an empty result.  No
    row moves between tasks.
    """
    found = Finder(benchmark, threshold, overlap)
    rows = common.clean_names(docs, {"doc_id": id_col, "text": text_col})
    item_type, kind = benchmark.schema["item_id"].dataType, rows.schema["doc_id"].dataType.simpleString()
    numbers = [(n, pa.float64()) for n in ("score", "overlap", "question", "answer")]
    items = pa.list_(pa.struct([("item_id", to_arrow_type(item_type)), *numbers]))

    def work(batches):
        for b in text_slices(batches, 1):
            hits = found.find(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, items)], ["doc_id", "items"])

    out = rows.mapInArrow(work, f"doc_id {kind}, items array<struct<item_id:{item_type.simpleString()},score:double,overlap:double,question:double,answer:double>>")
    return out.select("doc_id", F.size("items").alias("n_items"), "items", (F.size("items") > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold an item, columns unchanged; nothing is
    shuffled.  Nulls, empty texts and tables, and repeats as in ``contaminated``."""
    found, at = Finder(benchmark, THRESHOLD, OVERLAP), docs.columns.index(text_col)

    def work(batches):
        for b in text_slices(batches, at):
            yield b.filter(pa.array([not x for x in found.find(b.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
