"""Language-model scores by stupid backoff, trained on all other documents.

Count tables of all n-grams up to ORDER are partitioned by hash and joined to
the n-grams of each document, whose logs are summed.  A document's own counts
are taken off, so it is scored by a model of the rest of the corpus.

The relations are those of the plain plan, but their rows are packed: a row of
(part, n, block, run, counts) holds the n-grams of a block of documents that
fall to one partition of the count table, sorted by their 64-bit hash, counted
before they move.  A partition adds up the runs of all blocks and gives each
the totals back, in its order; they are joined to the blocks, which don't move.
Neither a frequent n-gram nor a frequent text makes a large group: a block
sends any n-gram once.

Words and pairs go first.  Of longer n-grams a document sends only those whose
first and last n-1 words both occur in other documents: no others can, so the
rest have no count outside their document, and nothing is left out.

For word i of a document, with history as far as the document has it:
    c(h w) / c(h) if c(h w) > 0, else ALPHA times the score with a history
    shorter by one word; without history max(c(w), 1) / max(N, 1)
where all counts and N leave out the document itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import text_slices

ORDER = 3
ALPHA = 0.4
#: A block is closed after the slice of texts that brings it to so many words.
BLOCK_WORDS = 1 << 21
#: Entries of a partition of the count table, about.
PART_ENTRIES = 2_000_000

#: N-grams of a block whose counts are told to its places at once.
SETTLED = 1 << 17

BLOCKS = "block bigint, n_words bigint, doc_ids array<bigint>, sizes array<int>, words binary, vocab binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def number_words(texts: pa.Array, vocab: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words as ``tokens`` has them, how many each text has);
    words that ``vocab`` doesn't have are added to it."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    first = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False) + 1)  # where the next text begins
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), pa.scalar("\n", pa.large_string()))[0].as_buffer()
    data = np.frombuffer(joined, np.uint8)
    data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    blank = BLANK[data]
    at = np.flatnonzero(~blank & np.append(True, blank[:-1])[: len(data)])
    ends = np.searchsorted(at, first)
    if not len(at):
        return np.zeros(0, np.uint32), ends
    # a run is a word and the white space behind it
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    begin = np.frombuffer(runs.dictionary.buffers()[1], np.int64, len(runs.dictionary) + 1)
    raw = runs.dictionary.buffers()[2].to_pybytes()
    behind = np.add.reduceat(BLANK[np.frombuffer(raw, np.uint8)], begin[:-1], dtype=np.int64)
    add = vocab.setdefault
    number = np.array([add(raw[a:b], len(vocab)) for a, b in zip(begin.tolist(), (begin[1:] - behind).tolist())], np.uint32)
    return number[runs.indices.to_numpy()], np.diff(ends, prepend=0)


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents packed into blocks: word numbers and the hashes of its words."""
    rows = common.clean_names(docs, {"doc_id": id_col, "text": text_col})
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def work(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        ids, sizes, held, vocab, count = [], [], [], {}, 0

        def close():
            nonlocal ids, sizes, held, vocab, count, seq
            words = np.concatenate(held)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in vocab), np.uint64, len(vocab))
            often = np.argsort(-np.bincount(words, minlength=len(vocab)), kind="stable")  # low numbers for frequent words pack well
            number = np.empty(len(vocab), np.uint32)
            number[often] = np.arange(len(vocab), dtype=np.uint32)
            words, hashes = number[words], hashes[often]
            pack = zstandard.ZstdCompressor(level=3).compress
            planes = np.ascontiguousarray(words.astype("<u4").view(np.uint8).reshape(-1, 4).T)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | seq], pa.int64()), pa.array([count], pa.int64()), pa.array([sum(ids, [])], pa.list_(pa.int64())), pa.array([np.concatenate(sizes)], pa.list_(pa.int32())),
                    pa.array([pack(planes.tobytes())], pa.binary()), pa.array([hashes.tobytes()], pa.binary()),
                ],
                ["block", "n_words", "doc_ids", "sizes", "words", "vocab"],
            )
            ids, sizes, held, vocab, count, seq = [], [], [], {}, 0, seq + 1
            return out

        for b in text_slices(batches, 1, min(common.ARRAY_BYTES, 8 * BLOCK_WORDS)):
            numbers, size = number_words(b.column(1), vocab)
            ids.append(b.column(0).to_pylist())
            sizes.append(size)
            held.append(numbers)
            count += len(numbers)
            if count >= BLOCK_WORDS:
                yield close()
        if ids:
            yield close()

    return rows.mapInArrow(work, BLOCKS)


def _grams(sizes: np.ndarray, words: bytes, vocab: bytes, order: int) -> Iterator[np.ndarray]:
    """For n = 1, 2, ... the hash of the n-gram that ends at each word, zero
    where the document has no n words yet."""
    raw = zstandard.ZstdDecompressor().decompress(words) if words else b""
    at = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).reshape(-1).view("<u4")
    h = np.frombuffer(vocab, np.uint64)[at]
    del raw, at
    starts = np.cumsum(sizes) - sizes
    now = np.zeros(len(h), np.uint64)
    for n in range(order):
        before = np.zeros(len(h), np.uint64)
        if n:
            before[1:] = now[:-1]
        now = _mix(before * np.uint64(0x9E3779B97F4A7C15) + h + np.uint64(n + 1))
        for k in range(n):
            now[starts[sizes > k] + k] = 0
        del before
        yield now


def _pack_run(run: np.ndarray) -> bytes:
    """A sorted run of distinct hashes as differences of as many bytes as the
    largest one needs."""
    gap = np.diff(run, prepend=np.uint64(0))
    width = max(1, (int(gap.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(gap.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _read_run(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, raw[0])
    gap = np.zeros((len(flat), 8), np.uint8)
    gap[:, : raw[0]] = flat
    return np.cumsum(gap.reshape(-1).view("<u8"), dtype=np.uint64)


def _squeeze(x: np.ndarray) -> bytes:
    """Non-negative integers as planes of bytes, packed where that is shorter."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    packed = zstandard.ZstdCompressor(level=1).compress(planes) if len(planes) > 32 else planes
    return bytes([width + 8]) + packed if len(packed) < len(planes) else bytes([width]) + planes


def _unsqueeze(raw: bytes) -> np.ndarray:
    width, planes = (raw[0] & 7) or 8, raw[1:]
    if raw[0] > 8:
        planes = zstandard.ZstdDecompressor().decompress(planes)
    planes = np.frombuffer(planes, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8").astype(np.int64)


class _Block:
    """The n-grams of a block, and how often other documents have them."""

    def __init__(self, sizes: np.ndarray, words: bytes, vocab: bytes, order: int):
        self.sizes = np.array(sizes, np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.grams = _grams(self.sizes, words, vocab, order)
        self.before: np.ndarray | None = None  # counts outside of the document, one n lower

    def next(self, n: int) -> np.ndarray:
        """Hashes of the n-grams (n from 0) that go to the count table; zero for others."""
        self.has = next(self.grams)
        if n < 2:
            return self.has
        hopeful = self.before > 0
        hopeful[1:] &= hopeful[:-1].copy()
        return np.where(hopeful, self.has, np.uint64(0))

    def settle(self, sent: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Counts of each place's n-gram in other documents, -1 where it has none,
        from the ``total`` of each distinct one in the order of their hashes."""
        order = np.flatnonzero(sent).astype(np.uint32)
        order = order[np.argsort(sent[order], kind="stable")]
        rest = np.where(self.has != 0, np.int64(0), np.int64(-1))
        if len(order):
            key, doc = sent[order], self.doc[order]
            new = np.append(True, key[1:] != key[:-1])
            own = np.append(True, doc[1:] != doc[:-1])
            own |= new  # stable: a document's places are together
            del key, doc
            # a slice at a time, each from the first place of an n-gram
            firsts = np.append(np.flatnonzero(new), len(order)).astype(np.uint32)
            del new
            for a in range(0, len(firsts) - 1, SETTLED):
                at = firsts[a : a + SETTLED + 1].astype(np.int64)
                mine = np.flatnonzero(np.append(own[at[0] : at[-1]], True))
                rest[order[at[0] : at[-1]]] = np.repeat(total[a : a + SETTLED], np.diff(at)) - np.repeat(np.diff(mine), np.diff(mine))
        self.before = rest
        return rest


def _run_rows(block: int, n: int, sent: np.ndarray, bits: int) -> list[dict]:
    """The distinct n-grams of a block and their counts, a row for each part."""
    keys, counts = np.unique(sent[sent != 0], return_counts=True)
    if not len(keys):
        return []
    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(keys)).tolist()
    return [{"part": int(part[x]), "n": n, "block": block, "run": _pack_run(keys[x:y]), "counts": _squeeze(counts[x:y])} for x, y in zip(cut, cut[1:])]


RUNS = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("block", pa.int64()), ("run", pa.binary()), ("counts", pa.binary())])
RUNS_SCHEMA = "part int, n int, block bigint, run binary, counts binary"


def _first_runs(packed: DataFrame, order: int, bits: int) -> DataFrame:
    """Runs of words and pairs of words."""

    def work(batches):
        for b in batches:
            for i in range(b.num_rows):
                block, sizes, words, vocab = (c[i].as_py() for c in b.columns)
                held = _Block(sizes, words, vocab, order)
                for n in range(min(2, order)):
                    yield pa.RecordBatch.from_pylist(_run_rows(block, n, held.next(n), bits), RUNS)

    return packed.select("block", "sizes", "words", "vocab").mapInArrow(work, RUNS_SCHEMA)


def _totals(group: pa.Table) -> pa.Table:
    """One partition of the count table: sums, told to every block that asked."""
    runs = [_read_run(r.as_buffer().to_pybytes()) for r in group["run"]]
    counts = np.concatenate([_unsqueeze(c.as_py()) for c in group["counts"]])
    _, at = np.unique(np.concatenate(runs), return_inverse=True)
    total = np.bincount(at, counts).astype(np.int64)[at]
    ends = np.cumsum(list(map(len, runs)))
    return pa.table({"part": group["part"], "n": group["n"], "block": group["block"], "totals": pa.array([_squeeze(total[a:b]) for a, b in zip([0, *ends], ends)], pa.binary())})


def _answers(told: pa.Table) -> dict[int, list[bytes]]:
    """By n the packed totals of a block's distinct n-grams, in the order of their hashes."""
    rows = sorted(zip(told["n"].to_pylist(), told["part"].to_pylist(), range(told.num_rows)))
    out: dict[int, list[bytes]] = {}
    for n, _, k in rows:
        out.setdefault(n, []).append(told["totals"][k].as_py())
    return out


def _take(got: dict[int, list[bytes]], n: int) -> np.ndarray:
    """The totals of the n-grams of n, which ``got`` then no longer holds."""
    return np.concatenate([NOTHING, *map(_unsqueeze, got.pop(n, []))])


NOTHING = np.zeros(0, np.int64)


def _next_runs(n: int, bits: int):
    """Runs of the n-grams (n from 0) of a block, by what is told of shorter ones."""

    def work(block: pa.Table, told: pa.Table) -> pa.Table:
        if not block.num_rows:
            return RUNS.empty_table()
        held, got = _Block(*(block[c][0].as_py() for c in ("sizes", "words", "vocab")), n + 1), _answers(told)
        for k in range(n):
            held.settle(held.next(k), _take(got, k))
        return pa.Table.from_pylist(_run_rows(block["block"][0].as_py(), n, held.next(n), bits), RUNS)

    return work


def _scorer(order: int, alpha: float, corpus: int):
    def score(block: pa.Table, told: pa.Table) -> pa.Table:
        held, got = _Block(*(block[c][0].as_py() for c in ("sizes", "words", "vocab")), order), _answers(told)
        for n in range(order):
            before = held.before
            rest = held.settle(held.next(n), _take(got, n))
            if n == 0:
                log = np.log(np.maximum(rest, 1)) - np.log(np.maximum(corpus - held.sizes, 1))[held.doc]
                continue
            seen = np.flatnonzero(rest > 0)
            log[rest == 0] += np.log(alpha)
            log[seen] = np.log(rest[seen]) - np.log(before[seen - 1])
        sums = np.bincount(held.doc, log, len(held.sizes))
        return pa.table({"doc_id": pa.array(block["doc_ids"][0].as_py(), pa.int64()), "n_words": pa.array(held.sizes), "log_score": pa.array(sums)})

    return score


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (long), n_words, log_score (sum of natural logs) of every row.

    Null and empty texts have no words and score 0.  Repeated rows count as
    documents of their own, so each is in the other's model.  Ids are cast to
    long and null ids kept.  Columns of other names are ignored; an empty table
    gives an empty result.  What is written on the way is removed.
    """
    packed = common.stash_by(blocks(docs, id_col, text_col), "block", "blocks")
    told = []

    def answer(runs: DataFrame) -> None:
        totals = runs.groupBy("part").applyInArrow(_totals, "part int, n int, block bigint, totals binary")
        told.append(common.stash(totals.select("part", "n", "block", "totals"), "totals"))

    def sides():
        known = told[0]
        for t in told[1:]:
            known = known.unionByName(t)
        return packed.select("block", "doc_ids", "sizes", "words", "vocab").groupBy("block").cogroup(known.groupBy("block"))

    try:
        with common.shuffles_removed(docs.sparkSession):
            words, kinds = packed.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum(F.octet_length("vocab") / 8), F.lit(0.0))).first()
            bits = max(0, int(np.ceil(np.log2(max(1.0, (words + kinds) / PART_ENTRIES)))))
            answer(_first_runs(packed, order, bits))
            for n in range(2, order):
                answer(sides().applyInArrow(_next_runs(n, bits), RUNS_SCHEMA))
            return common.stash(sides().applyInArrow(_scorer(order, alpha, int(words)), "doc_id bigint, n_words bigint, log_score double"), "scores")
    finally:
        common.unstash(*told, packed)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(common.table(spark, sf_dir, "documents"))
    return out.withColumn("log_score", F.round("log_score", 6))


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
t AS (SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT k, i, w AS w3, lag(w) OVER p AS w2, lag(w, 2) OVER p AS w1 FROM t WINDOW p AS (PARTITION BY k ORDER BY i)),
n AS (SELECT count(*) AS all_words FROM t),
c AS (SELECT *,
  count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY k, w3) AS c1,
  count(*) OVER (PARTITION BY w2, w3) - count(*) OVER (PARTITION BY k, w2, w3) AS c2,
  count(*) OVER (PARTITION BY w1, w2, w3) - count(*) OVER (PARTITION BY k, w1, w2, w3) AS c3,
  all_words - count(*) OVER (PARTITION BY k) AS others FROM g, n),
h AS (SELECT *, lag(c1) OVER p AS h1, lag(c2) OVER p AS h2 FROM c WINDOW p AS (PARTITION BY k ORDER BY i)),
s AS (SELECT k, CASE
  WHEN w1 IS NOT NULL AND c3 > 0 THEN ln(c3 / h2)
  WHEN w2 IS NOT NULL AND c2 > 0 THEN ln(c2 / h1) + CASE WHEN w1 IS NULL THEN 0 ELSE ln({ALPHA}) END
  ELSE ln(greatest(c1, 1) / greatest(others, 1)) + CASE WHEN w2 IS NULL THEN 0 WHEN w1 IS NULL THEN ln({ALPHA}) ELSE 2 * ln({ALPHA}) END END AS x FROM h)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(x, 0.0), 6) AS log_score
FROM d LEFT JOIN (SELECT k, sum(x) AS x FROM s GROUP BY k) USING (k)
"""
