import numpy as np
import pandas as pd
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from termloom.functions import codecs as C


def lists(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "xs array<bigint>")


def test_vbyte_vector_and_round_trip(spark):
    xs = [1, 2, 127, 128, 16383, 16384, 534538, 0]
    row = lists(spark, [xs]).select(F.hex(C.vbyte_encode(F.col("xs"))).alias("h"), C.vbyte_decode(C.vbyte_encode(F.col("xs"))).alias("back")).first()
    assert row["h"] == "8182FF01807FFF01008020508A80" and row["back"] == xs
    powers = [v for k in range(8) for v in (128 ** k - 1, 128 ** k, 128 ** k + 1)]
    assert lists(spark, [powers, []]).select(C.vbyte_decode(C.vbyte_encode(F.col("xs"))).alias("b")).collect()[0]["b"] == powers


def test_deltas_and_sums(spark):
    row = lists(spark, [[3, 5, 10, 100]]).select(C.deltas(F.col("xs")).alias("d"), C.partial_sums(C.deltas(F.col("xs"))).alias("s")).first()
    assert row["d"] == [3, 2, 5, 90] and row["s"] == [3, 5, 10, 100]


def test_sizes(spark):
    g = F.col("xs")
    row = lists(spark, [[1, 7, 8, 127, 128, 70000]]).select(
        C.varint_size(g).alias("vi"), C.varnibble_size(g).alias("vn"), C.minbits_size(g).alias("mb"), C.dword_size(g).alias("dw"), C.varbits_size(g).alias("vb")).first()
    assert row["vi"] == 1 + 1 + 1 + 1 + 2 + 3 and row["vn"] == (1 + 1 + 2 + 3 + 3 + 6 + 1) // 2
    assert row["mb"] == 1 + (6 * 17 + 7) // 8 and row["dw"] == 24 and 1 <= row["vb"] <= 1 + 6 * 3


def test_golomb_vectors():
    assert C.golomb_bits(2038, 9) == "1110" + "111110110"
    assert C.golomb_values(C.unpack(C.pack(C.golomb_bits(2038, 9) + C.golomb_bits(1, 9))), 9, 2) == [2038, 1]


def test_universal_codes():
    assert [C.fibonacci_bits(n) for n in (1, 2, 3, 4)] == ["11", "011", "0011", "1011"]
    assert [C.omega_bits(n) for n in (1, 2, 3, 31)] == ["0", "100", "110", "10100111110"]
    assert [C.gamma_bits(n) for n in (9, 17, 63)] == ["0001001", "000010001", "00000111111"]
    for n in range(1, 2000):
        assert C.fibonacci_value(C.fibonacci_bits(n)) == n and C.omega_value(C.omega_bits(n)) == n
    assert C.to_base(255, 16) == "FF" and C.to_base(0, 62) == "0"


@given(st.lists(st.integers(0, 5000), max_size=60, unique=True), st.integers(0, 8))
def test_bitmap_and_golomb_round_trip(xs, bits):
    xs = sorted(xs)
    assert C.bitmap_runs_decode(C.bitmap_runs(xs)) == xs
    assert C.golomb_values(C.unpack(C.pack("".join(C.golomb_bits(x, bits) for x in xs))), bits, len(xs)) == xs


@given(st.lists(st.integers(0, 4), max_size=40))
def test_pair_grammar_round_trip(xs):
    assert C.pair_expand(*C.pair_grammar(xs)) == xs


def test_decode_ignores_an_open_value():
    assert list(C.vbyte_values(bytes([0x81, 0x05]))) == [1] and not len(C.vbyte_values(b""))
    assert C.partial_sums.func(pd.Series([None, [1, 2]])).tolist()[1].tolist() == [1, 3]


@given(st.lists(st.integers(0, 5000), max_size=60), st.integers(0, 8))
def test_numpy_golomb_equals_bit_strings(xs, bits):
    data = C.golomb_pack(np.array(xs, np.int64), bits)
    assert data == C.pack("".join(C.golomb_bits(x, bits) for x in xs))
    assert C.golomb_unpack(data, bits, len(xs)).tolist() == xs


def test_varint_bytes_and_round_trip(spark):
    xs = [0, 1, 127, 128, 300, 16384, 2 ** 62]
    row = lists(spark, [xs]).select(F.hex(C.varint_encode(F.col("xs"))).alias("h"), C.varint_decode(C.varint_encode(F.col("xs"))).alias("b")).first()
    assert row["h"].startswith("00017F8001AC02808001") and row["b"] == xs
    assert list(C.varint_values(bytes([1, 0x80]))) == [1] and not len(C.varint_values(b""))


def test_run_lengths(spark):
    rows = [("000001000000000000000000",), ("010",), ("",), ("1",), ("0000",), ("01x1\n",)]
    df = spark.createDataFrame(rows, "b string").withColumn("c", C.run_lengths_encode(F.col("b"), 2)).withColumn("d", C.run_lengths_decode(F.col("c"), 2))
    got = {r["b"]: (r["c"], r["d"]) for r in df.collect()}
    assert got["010"] == ("001001", "010") and got[""] == ("000", "") and got["1"] == ("000000", "1") and got["0000"] == ("1000", "0000")
    assert got[rows[0][0]] == ("1001" + "1111010", rows[0][0]) and got["01x1\n"][1] == "011"


def test_code_expressions_equal_plain_codes(spark):
    n = F.col("n")
    for r in spark.range(1, 400).select(F.col("id").alias("n")).select("n", C.gamma_code(n).alias("g"), C.omega_code(n).alias("o"), C.headless(n).alias("h"), C.ceil_log2(n).alias("c")).collect():
        assert (r["g"], r["o"], r["h"]) == (C.gamma_bits(r["n"]), C.omega_bits(r["n"]), bin(r["n"])[3:]) and 2 ** r["c"] >= r["n"] > 2 ** r["c"] // 2


@given(st.lists(st.integers(0, 300), max_size=80, unique=True), st.integers(1, 6))
def test_greedy_bitmaps_round_trip_and_take_no_fewer_values(xs, least):
    xs = sorted(xs)
    data = C.bitmap_runs(xs, least, greedy=True)
    assert C.bitmap_runs_sorted(data) == xs
    first, longest = ([len(r) for _, r in runs] for runs in (C._first_runs(xs, least), C._greedy_runs(xs, least)))
    assert max(longest, default=0) >= max(first, default=0)


def test_digit_codes(spark):
    df = spark.createDataFrame([(10,), (0,), (3,)], "n bigint").select("n", C.digit_code(F.col("n"), 2).alias("a"), C.digit_code(F.col("n"), 3).alias("b"))
    got = {r["n"]: (r["a"], r["b"]) for r in df.collect()}
    assert got[10] == ("01000111", "001011111") and got[0] == ("11", "111")
    assert all(C.digit_code_value(a, 2) == n and C.digit_code_value(b, 3) == n for n, (a, b) in got.items())
