"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

The merge loop works on many words at once: their symbols lie in one flat
array, each round looks all adjacent pairs up in the sorted pair keys by
binary search, finds the lowest rank of each word, and merges there.  Pieces
of text already met by a worker are kept in a bounded memo.  Texts are cut into
pieces, and ids and bytes put together, by Arrow over whole batches.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import text_slices

#: Pieces of text that a worker remembers.
MEMO_PIECES = 150_000
#: Longer pieces (in bytes) aren't remembered.
MEMO_BYTES = 256
NO_RANK = np.iinfo(np.int64).max

#: Fixed value: the public pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a vocabulary file."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


class ByteBPE:
    """Encoder and decoder of a ``tokenizers`` file of the byte-level kind."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        kind = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE file")
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.of_byte = np.array([vocab[c] for c in letters], dtype=np.int64)
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.bytes_of.append(b"")  # for ids that aren't known
        self.decoded = pa.array(self.bytes_of, pa.large_binary())
        self.decimal = pa.array([b"%d," % i for i in range(len(self.bytes_of))], pa.large_binary())
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.narrow = len(self.bytes_of) <= 1 << 16
        self.packed = np.dtype("<u2" if self.narrow else "<u4")
        keys = left << (16 if self.narrow else 32) | right
        keys, first = np.unique(keys, return_index=True)  # a repeated pair keeps its lowest rank
        self.keys, self.rank, self.made = keys.astype(np.uint32 if self.narrow else np.int64), first.astype(np.int64), made[first]
        self.split = regex.compile(PATTERN)
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}  # the memo before this one

    def _ranks(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of the pairs that start at ``at``."""
        at = at[at < len(sym) - 1]
        pair = (sym[at] << 16 | sym[at + 1]).astype(np.uint32) if self.narrow else sym[at] << 32 | sym[at + 1]
        k = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        known = (self.keys[k] == pair) & (word[at] == word[at + 1])
        return np.where(known, self.rank[k], NO_RANK), self.made[k]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word, by merge rounds over all of them."""
        n = len(words)
        if not n:
            return []
        word = np.repeat(np.arange(n), np.fromiter(map(len, words), np.int64, n))
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        rank, made = (np.append(x, NO_RANK) for x in self._ranks(sym, word, np.arange(len(sym))))
        done_sym, done_word = [], []
        while len(sym):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
            idle = low == NO_RANK
            if idle.any():
                done_sym.append(sym[idle])
                done_word.append(word[idle])
                sym, word, rank, made, low = (x[~idle] for x in (sym, word, rank, made, low))
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == low)
            run = np.flatnonzero(np.append(True, np.diff(hit) != 1))
            order = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[order % 2 == 0]  # of overlapping hits (a a a) every second one, from the left
            sym[hit] = made[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            hit -= np.arange(len(hit))  # where the merged symbols are now
            new = np.zeros(len(sym), bool)  # only pairs that touch them are new
            new[hit] = True
            new[:-1] |= new[1:]
            if new[-1]:
                new[-1], rank[-1] = False, NO_RANK
            stale = np.flatnonzero(new)
            rank[stale], made[stale] = self._ranks(sym, word, stale)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        raw = sym[np.argsort(word, kind="stable")].astype(self.packed).tobytes()
        ends = (np.cumsum(np.bincount(word, minlength=n)) * self.packed.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        texts = [p.decode() for p in pieces]
        # letters alone are one token; the pattern needn't be asked
        tokens = [[t] if t.isalpha() or (t[:1] == " " and t[1:].isalpha()) else self.split.findall(t) for t in texts]
        words = list(set(chain.from_iterable(tokens)))
        ids = dict(zip(words, self.merge([w.encode() for w in words])))
        get = ids.__getitem__
        return {p: get(ts[0]) if len(ts) == 1 else b"".join(map(get, ts)) for p, ts in zip(pieces, tokens)}

    def _recall(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each of ``pieces``."""
        got = list(map(self.memo.get, pieces))
        if None not in got:
            return got
        new = {p for p, ids in zip(pieces, got) if ids is None}
        if len(self.memo) + len(new) > MEMO_PIECES:
            self.old, self.memo, new = self.memo, {}, set(pieces)
        found = {p: self.old[p] for p in new if p in self.old}
        found |= self._learn([p for p in new if p not in found])
        self.memo.update((p, ids) for p, ids in found.items() if len(p) <= MEMO_BYTES)
        memo = self.memo.get
        return [ids if (ids := memo(p)) is not None else found[p] for p in pieces]

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has) of texts without special tokens."""
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        if not size.sum():
            return np.zeros(0, self.packed), np.zeros(len(texts), np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), pa.scalar("", pa.large_string()))[0].as_buffer()
        first = np.cumsum(size) - size
        at = cut_pieces(np.frombuffer(joined, np.uint8), first[size > 0])
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(joined)).astype(np.int64)), joined]).dictionary_encode()
        begin = np.frombuffer(runs.dictionary.buffers()[1], np.int64, len(runs.dictionary) + 1).tolist()
        raw = runs.dictionary.buffers()[2].to_pybytes()
        ids = pa.array(self._recall([raw[a:b] for a, b in zip(begin, begin[1:])]), pa.large_binary()).take(runs.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1) // self.packed.itemsize
        return np.frombuffer(ids.buffers()[2], self.packed, int(ends[-1])), np.diff(np.append(ends[np.searchsorted(at, first)], ends[-1]))

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has); a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.cut or not any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.special):
            return self._plain(texts)
        parts, owner, special = [], [], []
        for k, t in enumerate(texts.to_pylist()):
            end = 0
            for m in self.cut.finditer(t):
                parts += [t[end : m.start()], ""]
                owner += [k, k]
                special += [-1, self.special[m.group()]]
                end = m.end()
            parts.append(t[end:])
            owner.append(k)
            special.append(-1)
        ids, size = self._plain(pa.array(parts, pa.large_string()))
        named = np.array(special)
        ends = np.cumsum(size + (named >= 0))
        out = np.empty(int(ends[-1]), self.packed)
        own = np.ones(len(out), bool)
        own[ends[named >= 0] - 1] = False
        out[own], out[~own] = ids, named[named >= 0]
        return out, np.bincount(owner, size + (named >= 0), len(texts)).astype(np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, size = self.encode_flat(pa.array(texts, pa.large_string()))
        ends = np.cumsum(size).tolist()
        return [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]

    def _taken(self, pool: pa.Array, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[int]]:
        """The entries of ``pool`` for ``ids`` in one string, and where each document ends in it."""
        ids = np.where((ids >= 0) & (ids < len(pool)), ids, len(pool) - 1)
        got = pool.take(pa.array(ids))
        stop = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1)
        return got.buffers()[2].to_pybytes()[: stop[-1]] if stop[-1] else b"", stop[ends].tolist()

    def decode_flat(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of many documents whose ids lie in one array; ``ends`` has
        where each ends.  Unknown ids give nothing, bytes that aren't UTF-8
        give U+FFFD."""
        raw, cuts = self._taken(self.decoded, ids, ends)
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *cuts], cuts)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_flat(np.array(ids, np.int64), np.array([len(ids)]))[0]

    def names_flat(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The decimal ids of each document, joined by commas."""
        raw, cuts = self._taken(self.decimal, ids, ends)
        return [raw[a : b - 1] if b > a else b"" for a, b in zip([0, *cuts], cuts)]


#: Bytes whose class the pattern shares with all others of their kind; 0 are
#: the bytes of wide letters and signs, and the apostrophe, which may begin a token.
SPACE, BLANK, LETTER, DIGIT, MARK = range(1, 6)


def _byte_kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[33:127] = MARK
    kind[[9, 10, 11, 12, 13, 28, 29, 30, 31]] = BLANK
    kind[32] = SPACE
    kind[[*range(65, 91), *range(97, 123)]] = LETTER
    kind[48:58] = DIGIT
    kind[39] = 0
    return kind


KINDS = _byte_kinds()


def cut_pieces(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of texts that begin at ``starts``.

    No token of the pattern has two of letters, digits and marks, nor a space
    after anything but white space, and none looks beyond such a place.  So a
    piece begins where two such kinds meet, at a space after no white space, and
    before and after a line end between two of those kinds; each can be split by
    itself.  Bytes of other letters and signs begin none.
    """
    kind = KINDS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # a Latin-1 letter is 0xC3 and one more, but for the signs x and :
    tail = data[lead + 1]
    lead = lead[(tail != 0x97) & (tail != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    plain = kind >= LETTER
    cut = np.zeros(len(data), bool)
    cut[1:] = plain[1:] & plain[:-1] & (kind[1:] != kind[:-1])
    lone = np.flatnonzero((kind[1:-1] == BLANK) & plain[:-2] & plain[2:]) + 1
    cut[lone] = cut[lone + 1] = True
    at = np.flatnonzero(kind == SPACE)
    at = at[at > 0]
    last = kind[at - 1]
    blank = (last == SPACE) | (last == BLANK)
    wide = np.flatnonzero(data[at - 1] >= 0x80)  # white space beyond ASCII, by its last two or three bytes
    a, b, c = (data[np.maximum(at[wide] - k, 0)] for k in (3, 2, 1))
    general = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    blank[wide] = ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | general | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    cut[at[~blank]] = True
    cut[starts] = True
    return np.flatnonzero(cut)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


def _lists(ids: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row and its whole text.

    Null texts are empty and have no ids.  Repeated rows are encoded alike, null
    ids are kept, columns of other names are ignored; an empty table gives an
    empty result.
    """

    def work(batches):
        bpe = tokenizer(path)
        for b in text_slices(batches, 1, common.ARRAY_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(*bpe.encode_flat(b.column(1)))], ["doc_id", "ids"])

    rows = common.clean_names(docs, {"doc_id": id_col, "text": text_col})
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) with ``text`` added: the ids read back.

    Null ids arrays are empty, unknown ids give nothing.  Repeated rows are read
    alike, columns of other names are ignored; an empty table gives an empty
    result.
    """

    def work(batches):
        bpe = tokenizer(path)
        for b in text_slices(batches, 1, common.ARRAY_BYTES):
            ids = b.column(1)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
            text = bpe.decode_flat(pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64), ends)
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(text, pa.string())], ["doc_id", "ids", "text"])

    rows = common.clean_names(encoded, {"doc_id": "doc_id", "ids": "ids"})
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: its whole text
    encoded, and the ids decoded again, in one pass.

    The digests are of the decimal ids joined by commas and of the decoded text
    in UTF-8.  Null texts are empty.  Repeated rows are treated alike, null ids
    are kept, columns of other names are ignored; an empty table gives an empty
    result.
    """

    def work(batches):
        bpe = tokenizer(path)
        for b in text_slices(batches, 1, common.ARRAY_BYTES):
            ids, size = bpe.encode_flat(b.column(1))
            ends = np.cumsum(size)
            ids = ids.astype(np.int64)
            named = [hashlib.sha256(x).hexdigest() for x in bpe.names_flat(ids, ends)]
            read = [hashlib.sha256(x.encode()).hexdigest() for x in bpe.decode_flat(ids, ends)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(named, pa.string()), pa.array(read, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = common.clean_names(docs, {"doc_id": id_col, "text": text_col})
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, ids, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256: what
    ``round_trip`` gives, of ids and texts at hand."""
    joined = F.regexp_replace(F.col("ids").cast("string"), r"[\[\] ]", "")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"), default_path())
