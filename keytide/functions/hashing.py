"""Hashes of the bytes of a key, as column expressions on the JVM.

CRC-16 (polynomial 0x1021, initial value 0, not reflected) gives a key's slot;
FNV-1a gives its shard.  64-bit FNV is kept in two limbs of 32 bits, as
products of whole longs overflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 16384
SHARDS = 256
FNV32_START, FNV32_PRIME = 2166136261, 16777619
FNV64_HIGH, FNV64_LOW, FNV64_PRIME_LOW = 3421674724, 2216829733, 435
MASK32 = 4294967295


def _fold(key: Column, start: Column, step) -> Column:
    """``step(state, byte)`` over the UTF-8 bytes of a key, which become an
    array of numbers once."""
    raw = F.encode(key, "UTF-8")
    codes = F.transform(F.split(F.decode(raw, "ISO-8859-1"), ""), lambda c: F.ascii(c).cast("bigint"))
    return F.when(F.length(raw) == 0, start).otherwise(F.aggregate(codes, start, step))


def _crc16_of_byte(b: int) -> int:
    """What one byte does to an empty CRC: eight steps of the polynomial."""
    x = b << 8
    for _ in range(8):
        x = (x << 1 ^ 0x1021 if x & 0x8000 else x << 1) & 0xFFFF
    return x


def crc16(key: Column) -> Column:
    table = F.array(*[F.lit(_crc16_of_byte(b)).cast("bigint") for b in range(256)])

    def step(acc, b):
        at = F.shiftright(acc, 8).bitwiseXOR(b).cast("int")
        return F.shiftleft(acc.bitwiseAND(F.lit(255)), 8).bitwiseXOR(table[at])

    return _fold(key, F.lit(0).cast("bigint"), step)


def slot(key: Column) -> Column:
    """Slot 0 .. 16383; braces in a key have no meaning."""
    return (crc16(key) % SLOTS).cast("int")


def crc32(value: Column) -> Column:
    return F.crc32(value)


def fnv32(key: Column) -> Column:
    return _fold(key, F.lit(FNV32_START).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * FNV32_PRIME).bitwiseAND(F.lit(MASK32)))


def fnv64_limbs(key: Column) -> Column:
    """struct<hi, lo> of the 64-bit FNV-1a hash."""
    start = F.struct(F.lit(FNV64_HIGH).cast("bigint").alias("hi"), F.lit(FNV64_LOW).cast("bigint").alias("lo"))

    def step(acc, b):
        lo = acc["lo"].bitwiseXOR(b)
        low = lo * FNV64_PRIME_LOW
        high = acc["hi"] * FNV64_PRIME_LOW + F.shiftright(low, 32) + lo * 256
        return F.struct(high.bitwiseAND(F.lit(MASK32)).alias("hi"), low.bitwiseAND(F.lit(MASK32)).alias("lo"))

    return _fold(key, start, step)


def fnv64(key: Column) -> Column:
    """The hash as decimal(20,0), unsigned."""
    limbs = fnv64_limbs(key)
    return (limbs["hi"].cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(20,0)") + limbs["lo"]).cast("decimal(20,0)")


def shard64(key: Column) -> Column:
    return (fnv64_limbs(key)["lo"] % SHARDS).cast("int")


def shard32(key: Column) -> Column:
    return (fnv32(key) % SHARDS).cast("int")
