"""Token ids in binary segments of patched frame-of-reference blocks.

A segment holds whole documents.  Its ids are cut into blocks of 128.  Of a
block the least id is subtracted, the rest is packed at the bit width that
most of them need (a percentile), and those that need more go to an exception
list.  An index holds where each block starts, so any document can be read by
itself.  All integers are little-endian.

    magic 'KTPF' | version u16 | block u16 | documents u32 | ids u64 | blocks u32 | exceptions u32
    document ids i64 each | document lengths u32 each
    per block: minimum u32, width u8, payload start u32, first exception u32
    payload of the blocks | exceptions: position in block u8, high part u32

Segments are the rows of a table that Spark's own writer commits, so a lost
executor leaves no half-written file and any store Spark knows will do.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import text_slices

BLOCK = 128
PERCENTILE = 90
#: A segment is closed after the document that brings it to so many ids.
SEGMENT_IDS = 1 << 18
#: Text pieces that a worker remembers.
MEMO_PIECES = 400_000
END_ID = 2
HEAD = struct.Struct("<4sHHIQII")
MAGIC = b"KTPF"


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def _kind(width: int) -> np.dtype:
    """The smallest type that holds ``width`` bits; higher ones are cut off."""
    return np.dtype("<u2" if width <= 16 else "<u4")


def pack_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[np.ndarray, ...]:
    """(minimum, width, payload start, first exception, payload, positions, highs)."""
    n = -(-len(ids) // BLOCK)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z, b"", z, z
    full = np.full(n * BLOCK, ids[-1], np.uint32)
    full[: len(ids)] = ids
    full = full.reshape(n, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    width = _bits(np.partition(rest, BLOCK * percentile // 100 - 1, axis=1)[:, BLOCK * percentile // 100 - 1])
    high = np.where(width[:, None] < 32, rest >> np.minimum(width, 31)[:, None].astype(np.uint32), 0)
    block, place = np.nonzero(high)
    highs = high[block, place]
    size = width * (BLOCK // 8)
    start = np.cumsum(size) - size
    payload = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            kind = _kind(w)
            bits = np.unpackbits(rest[rows].astype(kind, copy=False).view(np.uint8).reshape(len(rows), BLOCK, -1), axis=2, bitorder="little")
            packed = np.packbits(bits[:, :, :w].reshape(len(rows), -1), axis=1, bitorder="little")
            payload[start[rows][:, None] + np.arange(w * (BLOCK // 8))] = packed
    first = np.searchsorted(block, np.arange(n))
    return low, width, start, first, payload.tobytes(), place, highs


def encode_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    low, width, start, first, payload, place, highs = pack_blocks(ids)
    return b"".join(
        [
            HEAD.pack(MAGIC, 1, BLOCK, len(doc_ids), len(ids), len(low), len(place)),
            doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(),
            low.astype("<u4").tobytes(), width.astype("<u1").tobytes(), start.astype("<u4").tobytes(), first.astype("<u4").tobytes(),
            payload, place.astype("<u1").tobytes(), highs.astype("<u4").tobytes(),
        ]
    )


class Segment:
    """A parsed segment; ``read(a, b)`` unpacks only the blocks it needs."""

    def __init__(self, raw: bytes):
        magic, version, block, docs, self.n_ids, blocks, exceptions = HEAD.unpack_from(raw)
        if magic != MAGIC or version != 1 or block != BLOCK:
            raise ValueError("not a token segment of this version")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.lengths = take("<i8", docs), take("<u4", docs).astype(np.int64)
        self.low, self.width, self.start, self.first = (take(k, blocks).astype(np.int64) for k in ("<u4", "<u1", "<u4", "<u4"))
        self.payload = take("<u1", int((self.width * (BLOCK // 8)).sum()))
        self.place, self.highs = take("<u1", exceptions).astype(np.int64), take("<u4", exceptions).astype(np.int64)
        self.ends = np.cumsum(self.lengths)

    def read(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Ids a to b of the segment."""
        b = self.n_ids if b is None else b
        if a >= b:
            return np.zeros(0, np.uint32)
        lo, hi = a // BLOCK, -(-b // BLOCK)
        out = np.zeros((hi - lo, BLOCK), np.uint32)
        width = self.width[lo:hi]
        for w in np.unique(width):
            if w:
                rows = np.flatnonzero(width == w)
                raw = self.payload[self.start[lo:hi][rows][:, None] + np.arange(w * (BLOCK // 8))]
                kind = _kind(w)
                bits = np.zeros((len(rows), BLOCK, 8 * kind.itemsize), np.uint8)
                bits[:, :, :w] = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
                out[rows] = np.packbits(bits, axis=2, bitorder="little").reshape(len(rows), -1).view(kind)
        stop = self.first[hi] if hi < len(self.first) else len(self.place)
        sel = np.arange(self.first[lo], stop)
        block = np.searchsorted(self.first, sel, "right") - 1 - lo
        out[block, self.place[sel]] |= (self.highs[sel] << width[block]).astype(np.uint32)
        out += self.low[lo:hi, None].astype(np.uint32)
        return out.reshape(-1)[a - lo * BLOCK : b - lo * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.ends[k] - self.lengths[k]), int(self.ends[k]))


#: What a byte of a text is to the pieces: white space, a letter (ASCII, or half
#: of a Latin-1 letter), a digit, a mark.  All others make their word odd, and so
#: do the signs that special tokens and elided endings have.
SPACE, LETTER, DIGIT, MARK, ODD = range(5)


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, ODD, np.uint8)
    kind[33:127] = MARK
    kind[list(b" \t\n\r")] = SPACE
    kind[list(range(65, 91)) + list(range(97, 123))] = LETTER
    kind[48:58] = DIGIT
    kind[list(b"<>'")] = ODD
    return kind


KINDS = _byte_kinds()


def cut_pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes of the pieces, the bytes with Latin-1 letters in lower case).

    A piece is a run of letters, a run of marks, one digit, or a whole word that
    has an odd byte; white space belongs to the piece before it, or is one at
    the start.  So the pieces cover all bytes.
    """
    kind = KINDS[data]
    # a Latin-1 letter is 0xC3 and one more; x and : of arithmetic aren't letters
    lead = np.flatnonzero(data[:-1] == 0xC3)
    tail = data[lead + 1]
    lead = lead[(tail != 0x97) & (tail != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    blank = kind == SPACE
    after = np.append(True, blank[:-1])  # a byte after white space, or the first
    words = np.flatnonzero(after & ~blank)
    start = np.append(True, kind[1:] != kind[:-1]) | (kind == DIGIT)
    start &= ~blank
    upper = ((data >= 65) & (data <= 90)).astype(np.uint8)
    upper[lead + 1] = (data[lead + 1] >= 0x80) & (data[lead + 1] <= 0x9E)
    odd = np.flatnonzero(kind == ODD)
    if len(odd):
        hit = np.unique(np.searchsorted(words, odd, "right") - 1)
        ends = np.append(words, len(data))[hit + 1]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[words[hit] + 1] += 1
        np.subtract.at(inside, ends, 1)
        inner = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        start &= ~inner
        upper[inner] = 0
        upper[words[hit]] = 0
    start[0] = True
    return np.flatnonzero(start), data + (upper << 5)


class PieceEncoder:
    """Ids of a ``tokenizers`` file whose tokens never span white space, nor
    letters, digits and marks.

    A batch of texts is cut into pieces as one array of bytes; each distinct
    piece of it is looked up in a bounded memo, new ones are encoded by the
    library, and the ids are put together by Arrow.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        vocab = self.lib.get_vocab()
        self.is_end = np.zeros(1 + max(vocab.values()), bool)
        self.is_end[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.packed = np.dtype("<u2" if len(self.is_end) <= 1 << 16 else "<u4")
        self.memo: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}  # the memo before this one

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.packed).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        """Plain pieces go to the library many in one call, joined by spaces,
        and are told apart by the tokens that end a piece; odd ones, and all if
        the vocabulary doesn't mark these, go each by itself."""
        plain, odd = [], []
        for p in pieces:
            (odd if p.translate(None, ODD_BYTES) != p else plain).append(p)
        for k in range(0, len(plain), 512):
            some = plain[k : k + 512]
            ids = np.array(self.lib.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, self.packed)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(some):
                raw, cuts = ids.tobytes(), (self.packed.itemsize * ends).tolist()
                self.memo.update((p, raw[a:b]) for p, a, b in zip(some, [0, *cuts], cuts))
            else:
                odd += some
        self.memo.update(zip(odd, self._ids([p.decode() for p in odd])))

    def _recall(self, pieces: list[bytes]) -> list[bytes]:
        got = list(map(self.memo.get, pieces))
        if None not in got:
            return got
        new = {p for p, ids in zip(pieces, got) if ids is None}
        if len(self.memo) + len(new) > MEMO_PIECES:
            self.old, self.memo = self.memo, {b"": b""}
            new = {*pieces, b""}
        old = self.old
        self.memo.update((p, old[p]) for p in new if p in old)
        self._learn([p for p in new if p not in old])
        return list(map(self.memo.__getitem__, pieces))

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has); a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        if not size.sum():
            return np.zeros(0, self.packed), np.zeros(len(texts), np.int64)
        first = np.cumsum(size + 1) - size - 1
        # a line end after each text, so that no piece is of two
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), pa.scalar("\n", pa.large_string()))[0].as_buffer()
        at, data = cut_pieces(np.frombuffer(joined, np.uint8))
        offsets = np.append(at, len(data)).astype(np.int64)
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        begin = np.frombuffer(runs.dictionary.buffers()[1], np.int64, len(runs.dictionary) + 1)
        raw = runs.dictionary.buffers()[2].to_pybytes()
        blank = np.add.reduceat(KINDS[np.frombuffer(raw, np.uint8)] == SPACE, begin[:-1], dtype=np.int64)
        found = self._recall([raw[a:b] for a, b in zip(begin.tolist(), (begin[1:] - blank).tolist())])
        ids = pa.array(found, pa.large_binary()).take(runs.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1) // self.packed.itemsize
        # a text's pieces start with the first one at or after its first byte: before it is its line end
        from_ = ends[np.searchsorted(at, first)]
        flat = np.frombuffer(ids.buffers()[2], self.packed, int(ends[-1])) if ends[-1] else np.zeros(0, self.packed)
        return flat, np.diff(np.append(from_, ends[-1]))

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned integers of ``packed``."""
        flat, size = self.encode_flat(pa.array(texts, pa.large_string()))
        ends = np.cumsum(size)
        return [flat[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


#: Bytes that plain pieces don't have.
ODD_BYTES = bytes(np.flatnonzero((KINDS == ODD) & ~((np.arange(256) >= 0x80) & (np.arange(256) < 0xC0)) & (np.arange(256) != 0xC3)).tolist())


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return PieceEncoder(path)


def _no_id(kind: T.DataType) -> None:
    if not isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise TypeError("document ids must be integers")


def segments(docs: DataFrame, path: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments (part, seg, before, n_ids, n_docs, data) of all documents by ascending id.

    Null texts are empty; each document gets ``end_id`` appended.  Rows are
    dealt by ranges of the id and sorted; repeated ids are ordered by a hash of
    their text, by which they are dealt as well, and null ids, kept as -2^63 in
    the file, come first.  Parts are numbered in id order.  Documents stream
    through a task: it holds one segment.  Columns of other names are ignored;
    an empty table has no segments.
    """
    _no_id(docs.schema[id_col].dataType)
    rows = common.clean_names(docs, {"doc_id": id_col, "text": text_col}).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", F.xxhash64("text"), "uid"]  # equal rows have an order too, so that none makes a part hot
    dealt = rows.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("uid")

    def work(batches):
        from pyspark import TaskContext

        part, seg, before = TaskContext.get().partitionId(), 0, 0
        enc = encoder(path)
        more = end_id is not None
        names, sizes, held, count = [], [], [], 0

        def close():
            nonlocal names, sizes, held, count, seg, before
            docs, lengths = np.concatenate(names), np.concatenate(sizes)
            data = encode_segment(docs, lengths, np.concatenate(held))
            out = pa.RecordBatch.from_pylist([{"part": part, "seg": seg, "before": before, "n_ids": count, "n_docs": len(docs), "data": data}], SEGMENT_ARROW)
            names, sizes, held, count, seg, before = [], [], [], 0, seg + 1, before + count
            return out

        for b in text_slices(batches, 1, common.ARRAY_BYTES):
            name = b.column(0).to_numpy(zero_copy_only=False)
            ids, size = enc.encode_flat(b.column(1))
            size = size + more
            ends = np.cumsum(size)
            if more:
                own = np.ones(int(ends[-1]), bool)
                own[ends - 1] = False
                full = np.full(len(own), end_id, enc.packed)
                full[own] = ids
                ids = full
            first = 0
            while first < len(name):
                done = int(ends[first - 1]) if first else 0
                last = min(int(np.searchsorted(ends, done + SEGMENT_IDS - count)), len(name) - 1)
                names.append(name[first : last + 1])
                sizes.append(size[first : last + 1])
                held.append(ids[done : ends[last]])
                count += int(ends[last]) - done
                first = last + 1
                if count >= SEGMENT_IDS:
                    yield close()
        if names:
            yield close()

    return dealt.mapInArrow(work, SEGMENT_SCHEMA)


SEGMENT_SCHEMA = "part int, seg int, before bigint, n_ids bigint, n_docs bigint, data binary"
SEGMENT_ARROW = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("data", pa.binary())])


def write(docs: DataFrame, to: str, path: str, end_id: int | None = END_ID) -> None:
    segments(docs, path, end_id).write.parquet(to)


def read(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema(SEGMENT_SCHEMA).parquet(at)


def documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document in the files.

    ``start`` counts the ids of all documents before: a segment knows how many
    its part has before it, and the parts, of which there are as many as the
    writer had partitions, are added up.  The files themselves don't move.
    """
    from pyspark.sql import Window

    parts = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("base"))
    rows = files.join(F.broadcast(parts), "part").select((F.col("base") + F.col("before")).alias("first_id"), "data")

    def work(batches):
        for b in batches:
            for first, raw in zip(b.column(0).to_pylist(), b.column(1)):
                s = Segment(raw.as_buffer().to_pybytes())
                ids = s.read()
                begins = s.ends - s.lengths
                u4 = ids.astype("<u4", copy=False).tobytes()
                crc = [zlib.crc32(u4[4 * x : 4 * y]) for x, y in zip(begins.tolist(), s.ends.tolist())]
                null = s.doc_ids == np.iinfo(np.int64).min
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(s.doc_ids, mask=null), pa.array(first + begins), pa.array(s.lengths), pa.array(crc, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.append(0, s.ends), pa.int32()), pa.array(ids.astype(np.int32))),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return rows.mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = common.stash(segments(common.table(spark, sf_dir, "documents"), default_path()), "tokens")
    return documents(files).drop("ids")
