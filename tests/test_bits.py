import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import bits as B
from larkspur.functions import sketches as H


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_bitmaps(spark):
    v = F.lit("foobar")
    assert [one(spark, B.count_range(v, *r)) for r in ((0, 0), (1, 1), (-2, -1), (5, 30, "BIT"), (9, 12), (0, -1))] == [4, 6, 7, 17, 0, 26]
    assert one(spark, B.set_bit(F.lit(""), 7, 1)) == b"\x01" and one(spark, B.set_bit(F.lit("a"), 1, 0)) == b"\x21"
    assert one(spark, B.set_bit(F.lit(None).cast("string"), 9, 1)) == b"\x00\x40"
    assert one(spark, B.bit_op("AND", F.lit("foobar"), F.lit("abcdef"))) == bytes(x & y for x, y in zip(b"foobar", b"abcdef", strict=True))
    assert one(spark, B.bit_op("XOR", F.lit("abc"), F.lit("a"))) == b"\0bc" and one(spark, B.bit_op("OR", F.lit(""), F.lit("a"))) == b"a"
    assert one(spark, B.bit_op("NOT", F.lit("a"))) == b"\x9e" and one(spark, B.bit_op("AND", F.lit(""), F.lit(""))) == b""


def test_bit_fields(spark):
    v = F.unhex(F.lit("FF7F80"))
    assert [one(spark, B.field_get(v, k, at)) for k, at in (("u8", 0), ("i8", 0), ("u4", 6), ("i16", 8), ("u8", 20), ("i64", 0), ("u8", 90))] == [255, -1, 13, 32640, 0, -36169534507319296, 0]
    assert one(spark, B.field_set(F.lit(""), "u8", 4, F.lit(255))) == b"\x0f\xf0" and one(spark, B.field_set(v, "i8", 0, F.lit(-2))) == b"\xfe\x7f\x80"
    assert [one(spark, B.field_add(v, "u8", 0, F.lit(1), o)) for o in ("WRAP", "SAT", "FAIL")] == [0, 255, None]
    assert [one(spark, B.field_add(v, "i8", 8, F.lit(1), o)) for o in ("WRAP", "SAT", "FAIL")] == [-128, 127, None]
    with pytest.raises(ValueError):
        B.field_get(v, "u64", 0)


def test_lcs(spark):
    def longest(a, b):
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
        return n[-1][-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(12))) for _ in "ab")
        got = B.common(a, b)
        assert len(got) == longest(a, b)
        for whole in (a, b):
            rest = iter(whole)
            assert all(c in rest for c in got)
    d = spark.createDataFrame([("ohmytext", "mynewtext"), (None, "x"), ("", "x")], "a string, b string")
    assert [r.x for r in d.select(B.lcs("a", "b").alias("x")).collect()] == ["mytext", None, ""]


def test_sketches(spark):
    s = spark.range(5000).groupBy((F.col("id") % 4).alias("k")).agg(H.pf_add(F.col("id") % 3000).alias("s"))
    assert abs(s.agg(H.pf_count(H.pf_merge(F.col("s"))).alias("n")).first().n - 3000) < 60


def test_bits_of_long_values(spark):
    """The time of a value grows with its length, not with its square."""
    import time

    rng = random.Random(2)
    for _ in range(5):
        v, at, width = rng.randbytes(rng.randrange(12)), rng.randrange(70), rng.randrange(1, 64)
        to = rng.randrange(1 << width)
        whole = "".join(f"{x:08b}" for x in v).ljust((at + width + 7) // 8 * 8, "0")
        whole = whole[:at] + f"{to:0{width}b}" + whole[at + width :]
        want = bytes(int(whole[i : i + 8], 2) for i in range(0, len(whole), 8))
        lit = F.unhex(F.lit(v.hex()))
        assert one(spark, B.field_set(lit, f"u{width}", at, F.lit(to))) == want
        assert one(spark, B.from_bits(B.to_bits(lit))) == v and one(spark, B.from_bits(F.lit(whole[: at + width]))) is not None
    long = spark.range(200).select(F.repeat(F.lit("ab"), 2000).alias("v"))
    start = time.monotonic()
    got = long.select(B.set_bit(F.col("v"), 6, 0).alias("a"), B.bit_op("NOT", F.col("v")).alias("b"), B.from_bits(B.to_bits(F.col("v"))).alias("c")).collect()
    assert time.monotonic() - start < 30
    assert all(bytes(r.a) == b"a" + b"b" + b"ab" * 1999 and bytes(r.b) == b"\x9e\x9d" * 2000 and bytes(r.c) == b"ab" * 2000 for r in got)
