import pytest
from pyspark.sql import functions as F

from keytide.functions import fraud, glob, hashing, stats

VECTORS = [
    ("", 0, 0, 0, 14695981039346656037, 37, 197),
    ("123456789", 12739, 12739, 3421780262, 492395637191921148, 252, 28),
    ("user:1001", 22096, 5712, 3899860853, 5312262665563488470, 214, 246),
    ("user:1", 27162, 10778, 2074460802, 17869608953374579947, 235, 203),
    ("tx:12345", 21839, 5455, 982071173, 15004212192160956604, 188, 188),
    ("foo", 44950, 12182, 2356372769, 15902901984413996407, 119, 215),
    ("{a}b", 49872, 720, 3980549721, 763082353157802946, 194, 2),
]


def test_hashes(spark):
    k = F.col("k")
    df = spark.createDataFrame([(v[0],) for v in VECTORS], "k string")
    rows = df.select("k", hashing.crc16(k), hashing.slot(k), hashing.crc32(k), hashing.fnv64(k), hashing.shard64(k), hashing.shard32(k)).collect()
    assert {tuple(int(x) if i else x for i, x in enumerate(r)) for r in rows} == set(VECTORS)


def test_hash_of_other_letters(spark):
    def fnv(b):
        h = 14695981039346656037
        for x in b:
            h = (h ^ x) * 1099511628211 % 2**64
        return h

    keys = ["é漢😀", "x" * 200, "\x00\x7f", " "]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", hashing.fnv64(F.col("k")).alias("h")).collect()
    assert {r.k: int(r.h) for r in got} == {k: fnv(k.encode()) for k in keys}


@pytest.mark.parametrize(
    ("pattern", "hits", "misses"),
    [
        ("tx:*", ["tx:1", "tx:"], ["tx:a/b", "atx:1", "tx:1\n/"]),
        ("*", ["", "ab", "a\nb"], ["a/b"]),
        ("user:?", ["user:é", "user:1"], ["user:", "user:12", "user:/"]),
        ("k[0-9]", ["k1"], ["ka", "k", "k11"]),
        ("k[^0-9]", ["ka", "k/"], ["k1"]),
        ("k[", [], ["k[", "k"]),
        ("k[]a]", [], ["ka", "k]"]),
        ("k[a-]", [], ["ka", "k-"]),
        (r"a\*b", ["a*b"], ["axb"]),
        ("a\\", [], ["a\\", "a"]),
        (r"[\]a]", ["]", "a"], ["b"]),
        ("a.c+$", ["a.c+$"], ["abc+$", "a.c+$\n"]),
        ("x[b-a]", [], ["xa", "xb"]),
    ],
)
def test_glob(spark, pattern, hits, misses):
    regex = glob.to_regex(pattern)
    df = spark.createDataFrame([(k,) for k in hits + misses], "k string")
    got = {r.k for r in df.filter(F.col("k").rlike(regex) & F.col("k").startswith(glob.literal_prefix(pattern))).collect()}
    assert got == set(hits)


FRAUD = [
    (1000, "US", 0, "OK"), (1001, "US", 10, "OK"), (5001, "US", 30, "OK"), (10001, "US", 50, "REVIEW"), (1000, "NK", 50, "REVIEW"), (1001, "IR", 60, "REVIEW"),
    (5001, "SY", 80, "BLOCKED"), (10001, "NK", 100, "BLOCKED"), (50000, "US", 50, "REVIEW"), (50001, "US", 100, "BLOCKED"),
]


def test_fraud_rules(spark):
    df = spark.createDataFrame([(a, c) for a, c, *_ in FRAUD], "a bigint, c string")
    s = fraud.score(F.col("a"), F.col("c"))
    assert {tuple(r) for r in df.select("a", "c", s, fraud.decision(s)).collect()} == set(FRAUD)


def test_fraud_payloads(spark):
    cases = {'{"amount": 9999}': (0, ""), '{"amount":12.9,"country":"NK"}': (12, "NK"), "": (0, ""), '{"country":"U': (0, "U"), '{"amount":5,"amount":7}': (5, ""), '{"amount":99999999999999999999}': (0, "")}
    rows = spark.createDataFrame([(v,) for v in cases], "v string").select("v", fraud.amount(F.col("v")).alias("a"), fraud.country(F.col("v")).alias("c")).collect()
    assert {r.v: (r.a, r.c) for r in rows} == cases


def test_index_percentiles(spark):
    df = spark.createDataFrame([("a", v) for v in (4, 2, 3, 1)] + [("b", 7), ("b", None)] + [("c", v % 10) for v in range(1000)], "g string, v bigint")
    got = {r.g: tuple(r)[1:] for r in stats.index_percentiles(df, "v", ["g"]).collect()}
    want = {}
    for g, vs in (("a", [1, 2, 3, 4]), ("b", [7]), ("c", sorted(v % 10 for v in range(1000)))):
        want[g] = (len(vs), *(vs[len(vs) * p // 100] for p in (50, 95, 99)))
    assert got == want and want["a"] == (4, 3, 4, 4)


def test_throughput(spark):
    df = spark.createDataFrame([("a", 0), ("a", 2_000_000), ("b", 5)], "g string, t bigint")
    assert {tuple(r) for r in stats.throughput(df, "t", ["g"]).collect()} == {("a", 2, 2_000_000, 1.0), ("b", 1, 0, None)}
