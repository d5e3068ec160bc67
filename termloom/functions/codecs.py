"""Integer codecs for posting lists. Encoding and sizes are Spark expressions; block decoding and bit-stream codes are Arrow UDFs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Types as objects: a type's name can only be read with a running session, and this module is imported before.
_LONGS = T.ArrayType(T.LongType())


def deltas(xs: Column) -> Column:
    """First value, then differences of neighbours."""
    before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))))
    return F.slice(F.zip_with(xs, before, lambda x, b: x - b), 1, F.size(xs))


@F.pandas_udf(_LONGS)
def partial_sums(xs: pd.Series) -> pd.Series:
    """Running sums of each list. A fold over arrays copies its result at every step, so this one is an Arrow UDF."""
    return xs.map(lambda v: None if v is None else np.cumsum(v, dtype="int64"))


def vbyte_hex(x: Column) -> Column:
    """Groups of 7 bits, most significant first; the last byte of a value has its high bit set."""
    groups = [F.when(x >= F.lit(1 << (7 * k)), F.lpad(F.hex(F.shiftright(x, 7 * k).bitwiseAND(F.lit(127))), 2, "0")).otherwise("")
              for k in range(8, 0, -1)]
    return F.concat(*groups, F.hex(x.bitwiseAND(F.lit(127)) + 128))


def vbyte_encode(xs: Column) -> Column:
    return F.unhex(F.array_join(F.transform(xs.cast("array<bigint>"), vbyte_hex), ""))


@F.pandas_udf(_LONGS)
def vbyte_decode(data: pd.Series) -> pd.Series:
    """All values of a byte string; bytes after the last terminator are ignored. Vectorized over each block's bytes."""
    return data.map(lambda b: None if b is None else vbyte_values(b))


def vbyte_values(data: bytes) -> np.ndarray:
    octets = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    ends = np.flatnonzero(octets >= 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    octets = octets[:ends[-1] + 1]
    which = np.searchsorted(ends, np.arange(len(octets)))
    shifted = (octets & 127) << (7 * (ends[which] - np.arange(len(octets))))
    return np.add.reduceat(shifted, np.r_[0, ends[:-1] + 1])


def varint_hex(x: Column) -> Column:
    """Groups of 7 bits, least significant first; all but the last byte of a value have their high bit set."""
    out = []
    for k in range(9):
        rest = F.shiftright(x, 7 * k)
        byte = F.lpad(F.hex(rest.bitwiseAND(F.lit(127)) + F.when(rest >= 128, 128).otherwise(0)), 2, "0")
        out.append(byte if k == 0 else F.when(rest > 0, byte).otherwise(""))
    return F.concat(*out)


def varint_encode(xs: Column) -> Column:
    return F.unhex(F.array_join(F.transform(xs.cast("array<bigint>"), varint_hex), ""))


@F.pandas_udf(_LONGS)
def varint_decode(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else varint_values(b))


def varint_values(data: bytes) -> np.ndarray:
    """All values of a byte string; a last one without its end is ignored."""
    octets = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    ends = np.flatnonzero(octets < 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    octets = octets[:ends[-1] + 1]
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(octets)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((octets & 127) << (7 * place), starts)


def headless(n: Column) -> Column:
    """Binary digits without the leading one; n >= 1."""
    return F.substring(F.bin(n), 2, 64)


def ceil_log2(n: Column) -> Column:
    """Digits that tell n values apart; 0 for one."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def gamma_code(n: Column) -> Column:
    """Elias gamma as a bit string; n >= 1."""
    return F.concat(F.repeat(F.lit("0"), F.length(F.bin(n)) - 1), F.bin(n))


def omega_code(n: Column) -> Column:
    """Elias omega as a bit string; 1 <= n < 2**63, which takes four steps at most."""
    out, x = F.lit("0"), n.cast("bigint")
    for _ in range(5):
        out = F.when(x > 1, F.concat(F.bin(x), out)).otherwise(out)
        x = F.when(x > 1, F.length(F.bin(x)).cast("bigint") - 1).otherwise(F.lit(1).cast("bigint"))
    return out


def digit_code(n: Column, k: int) -> Column:
    """Digits in base 2**k - 1, k bits each, ended by k ones; n >= 0."""
    digits = F.transform(base_digits(n, (1 << k) - 1), lambda d: F.lpad(F.bin(d), k, "0"))
    return F.concat(F.when(n > 0, F.array_join(digits, "")).otherwise(""), F.lit("1" * k))


def digit_code_value(code: str, k: int) -> int:
    n = 0
    for i in range(0, len(code), k):
        d = int(code[i:i + k], 2)
        if d == (1 << k) - 1:
            break
        n = n * ((1 << k) - 1) + d
    return n


def run_lengths_encode(bits: Column, m: int) -> Column:
    """A bit string as its runs of zeroes: a one for every full 2**m zeroes, then a zero and the rest in m digits. Other characters are skipped;
    the last run is coded as if a one followed."""
    def run(zeroes: Column) -> Column:
        n = F.length(zeroes).cast("bigint")
        return F.concat(F.repeat(F.lit("1"), F.floor(n / (1 << m)).cast("int")), F.lit("0"), F.lpad(F.bin(n % (1 << m)), m, "0"))

    return F.array_join(F.transform(F.split(F.regexp_replace(bits, "[^01]", ""), "1", -1), run), "")


def run_lengths_decode(code: Column, m: int) -> Column:
    def run(token: Column) -> Column:
        full = F.length(token) - m - 1
        return F.repeat(F.lit("0"), (full * (1 << m) + F.conv(F.substring(token, -m, m), 2, 10).cast("int")).cast("int"))

    return F.array_join(F.transform(F.regexp_extract_all(code, F.lit(f"(1*0[01]{{{m}}})"), 1), run), "1")


def _total(xs: Column, of) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + of(x).cast("bigint"))


def _groups(x: Column, bits: int) -> Column:
    """How many groups of ``bits`` bits hold a value, one at least."""
    steps = range(1, 62 // bits + 1)
    return sum((F.when(x >= F.lit(1 << (bits * k)), 1).otherwise(0) for k in steps), F.lit(1))


def varint_size(xs: Column) -> Column:
    """Bytes with 7 bits and a flag each, least significant first (as many as for vbyte)."""
    return _total(xs, lambda x: _groups(x, 7))


def varnibble_size(xs: Column) -> Column:
    """Bytes of nibbles with 3 bits and a flag each."""
    return F.floor((_total(xs, lambda x: _groups(x, 3)) + 1) / 2)


@F.pandas_udf(T.LongType())
def varbits_size(xs: pd.Series) -> pd.Series:
    """One byte for the group width plus the bits of the best width from 1 to 16: groups of so many bits and a flag."""
    def size(v) -> int:
        _, digits = np.frexp(np.maximum(np.asarray(v, np.int64), 1).astype(float))
        bits, width = min((int((-(-digits // b)).sum()) * (b + 1), b) for b in range(1, 17))
        return 1 + (bits + width - 1) // 8

    return xs.map(size)


def minbits_size(xs: Column) -> Column:
    """One byte for the width plus every value in as many bits as the largest needs."""
    return F.lit(1) + F.floor((F.size(xs) * F.char_length(F.bin(F.array_max(xs))) + 7) / 8)


def dword_size(xs: Column) -> Column:
    return F.size(xs).cast("bigint") * 4


def smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


# --- Bit-stream codes, as plain Python over lists; the UDFs below apply them to Arrow batches. ---

def golomb_bits(n: int, bits: int) -> str:
    """Quotient by 2**bits in unary (ones, then a zero), remainder in ``bits`` bits."""
    return "1" * (n >> bits) + "0" + format(n & ((1 << bits) - 1), f"0{bits}b") if bits else "1" * n + "0"


def golomb_values(stream: str, bits: int, count: int) -> list[int]:
    out, at = [], 0
    for _ in range(count):
        end = stream.index("0", at)
        out.append((end - at) << bits | (int(stream[end + 1:end + 1 + bits], 2) if bits else 0))
        at = end + 1 + bits
    return out


def pack(stream: str) -> bytes:
    """Bits to bytes, most significant first, the last byte filled with zeroes."""
    n = -(-len(stream) // 8)
    return int(stream.ljust(n * 8, "0"), 2).to_bytes(n, "big") if n else b""


def unpack(data: bytes) -> str:
    return format(int.from_bytes(data, "big"), f"0{len(data) * 8}b") if data else ""


def golomb_pack(values: np.ndarray, bits: int) -> bytes:
    """``pack`` of the Golomb codes of all values, set by numpy."""
    values = np.asarray(values, np.int64)
    q = values >> bits
    ends = np.cumsum(q + 1 + bits)
    starts = ends - (q + 1 + bits)
    n = int(ends[-1]) if len(ends) else 0
    edge = np.zeros(n + 1, np.int8)  # ones begin at a code's start and end at its zero
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + q, -1)
    out = np.cumsum(edge[:n], dtype=np.int8).astype(np.uint8)
    for k in range(bits):
        out[starts + q + 1 + k] = values >> (bits - 1 - k) & 1
    return np.packbits(out).tobytes()


def golomb_unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` values of ``golomb_pack``. A code begins where the one before ends, so zeroes are stepped through once each."""
    stream = np.unpackbits(np.frombuffer(data, np.uint8))
    zeroes = np.flatnonzero(stream == 0)
    after = np.searchsorted(zeroes, zeroes + 1 + bits).tolist()  # the zero that ends the next code's quotient
    at, i = np.empty(count, np.int64), 0
    for k in range(count):
        at[k] = i
        i = after[i]
    stop = zeroes[at] if count else np.zeros(0, np.int64)
    starts = np.concatenate([[0], stop[:-1] + 1 + bits]) if count else stop
    rest = np.zeros(count, np.int64)
    for k in range(bits):
        rest = rest << 1 | stream[stop + 1 + k]
    return (stop - starts) << bits | rest


def fibonacci_bits(n: int) -> str:
    """Zeckendorf digits, smallest first, ended by a second one; n >= 1."""
    fibs = [1, 2]
    while fibs[-1] <= n:
        fibs.append(fibs[-1] + fibs[-2])
    digits, started = [], False
    for f in reversed(fibs):
        if f <= n:
            digits.append("1")
            n, started = n - f, True
        elif started:
            digits.append("0")
    return "".join(reversed(digits)) + "1"


def fibonacci_value(code: str) -> int:
    a, b, out = 1, 2, 0
    for d in code[:-1]:
        out, a, b = out + (a if d == "1" else 0), b, a + b
    return out


def gamma_bits(n: int) -> str:
    """Elias gamma; n >= 1."""
    return "0" * (n.bit_length() - 1) + format(n, "b")


def omega_bits(n: int) -> str:
    """Elias omega; n >= 1."""
    out = "0"
    while n > 1:
        out, n = format(n, "b") + out, n.bit_length() - 1
    return out


def omega_value(code: str) -> int:
    n, at = 1, 0
    while code[at] == "1":
        n, at = int(code[at:at + n + 1], 2), at + n + 1
    return n


def bitmap_runs(values: list[int], least: int = 4, greedy: bool = False) -> bytes:
    """Increasing values as varint gaps; a value followed by at least ``least`` others within 32 carries them as a bitmap (flag in the lowest bit).

    Runs are taken from the left as they come; with ``greedy`` the longest first, the leftmost among equals.
    """
    out, before = bytearray(), 0
    for first, rest in _greedy_runs(values, least) if greedy else _first_runs(values, least):
        gap = (first - before) << 1 | bool(rest)
        while gap > 127:
            out.append(gap & 127 | 128)
            gap >>= 7
        out.append(gap)
        if rest:
            out += sum(1 << (v - first - 1) for v in rest).to_bytes(4, "little")
        before = first
    return bytes(out)


def _first_runs(values: list[int], least: int) -> Iterator[tuple[int, list[int]]]:
    i = 0
    while i < len(values):
        j = i + 1
        while j < len(values) and values[j] - values[i] <= 32:
            j += 1
        dense = j - i - 1 >= least
        yield values[i], values[i + 1:j] if dense else []
        i = j if dense else i + 1


def _greedy_runs(values: list[int], least: int) -> list[tuple[int, list[int]]]:
    left, out = np.asarray(values, np.int64), []
    while len(left):
        ends = np.searchsorted(left, left + 32, side="right")
        i = int((ends - np.arange(len(left))).argmax())
        if ends[i] - i - 1 < least:
            break
        out.append((int(left[i]), left[i + 1:ends[i]].tolist()))
        left = np.delete(left, np.s_[i:ends[i]])
    return sorted([*out, *((int(v), []) for v in left)])


def bitmap_runs_decode(data: bytes) -> list[int]:
    out, at, before = [], 0, 0
    while at < len(data):
        gap = shift = 0
        while True:
            b, at = data[at], at + 1
            gap |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        before += gap >> 1
        out.append(before)
        if gap & 1:
            bits, at = int.from_bytes(data[at:at + 4], "little"), at + 4
            out += [before + k + 1 for k in range(32) if bits >> k & 1]
    return out


def pair_grammar(values: list[int]) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Replace the most frequent neighbouring pair by a new symbol until none occurs twice; smallest pair first among equals."""
    from collections import Counter

    seq, rules, new = list(values), {}, max(values, default=0) + 1
    while len(seq) > 1:
        (a, b), n = min(Counter(zip(seq, seq[1:])).items(), key=lambda kv: (-kv[1], kv[0]))
        if n < 2:
            break
        out, i = [], 0
        while i < len(seq):
            hit = i + 1 < len(seq) and seq[i] == a and seq[i + 1] == b
            out.append(new if hit else seq[i])
            i += 2 if hit else 1
        if len(out) == len(seq) - 1:  # overlapping runs such as a a a
            break
        rules[new], seq, new = (a, b), out, new + 1
    return seq, rules


def pair_expand(seq: list[int], rules: dict[int, tuple[int, int]]) -> list[int]:
    out, stack = [], list(reversed(seq))
    while stack:
        s = stack.pop()
        if s in rules:
            stack += reversed(rules[s])
        else:
            out.append(s)
    return out


def to_base(n: int, base: int, digits: str = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") -> str:
    out = ""
    while True:
        n, r = divmod(n, base)
        out = digits[r] + out
        if not n:
            return out


@F.pandas_udf(_LONGS)
def pair_round_trip(xs: pd.Series) -> pd.Series:
    """Each list through its pair grammar and back."""
    return xs.map(lambda v: pair_expand(*pair_grammar([int(x) for x in v])))


@F.pandas_udf(T.LongType())
def pair_size(xs: pd.Series) -> pd.Series:
    """Bytes of a list's pair grammar: sequence, then each rule's symbol and parts, as varints, and one for the count."""
    def size(v) -> int:
        seq, rules = pair_grammar([int(x) for x in v])
        out = [*seq, *(x for r, ab in rules.items() for x in (r, *ab))]
        return 1 + sum(max(1, -(-int(x).bit_length() // 7)) for x in out)

    return xs.map(size)


def base_digits(x: Column, base: int) -> Column:
    """A number's digits in a base, most significant first, for bases beyond those of ``conv``."""
    places = F.sequence(F.lit(0), F.when(x > 0, F.floor(F.log(x.cast("double")) / F.log(F.lit(float(base)))).cast("int")).otherwise(0) + 1)
    digits = F.transform(places, lambda i: F.floor(x / F.pow(F.lit(base), i)).cast("bigint") % base)
    trimmed = F.filter(F.transform(digits, lambda d, i: F.when((i == 0) | (x >= F.pow(F.lit(base), i)), d)), lambda d: d.isNotNull())
    return F.reverse(trimmed)


def code_sizes_udf(name: str):
    """A pandas UDF: bits that a list of values (1 or more) takes in the named code."""
    one = {"fibonacci": fibonacci_bits, "gamma": gamma_bits, "omega": omega_bits}.get(name)

    @F.pandas_udf(T.LongType())
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            if one:
                yield s.map(lambda xs: sum(len(one(int(x))) for x in xs))
            elif name == "bitmap":
                yield s.map(lambda xs: 8 * len(bitmap_runs([int(x) for x in xs])))
            else:
                raise ValueError(name)

    return size


def bitmap_round_trip(xs: Column, greedy: bool = False) -> Column:
    @F.pandas_udf(_LONGS)
    def there_and_back(s: pd.Series) -> pd.Series:
        return s.map(lambda v: bitmap_runs_sorted(bitmap_runs([int(x) for x in v], greedy=greedy)))

    return there_and_back(xs)


def bitmap_runs_sorted(data: bytes) -> list[int]:
    """The values in order: a greedy run may have plain values between its own."""
    return sorted(bitmap_runs_decode(data))


@F.pandas_udf(T.BinaryType())
def golomb_encode(xs: pd.Series, bits: pd.Series) -> pd.Series:
    return pd.Series([golomb_pack(v, int(b)) for v, b in zip(xs, bits)])


@F.pandas_udf(_LONGS)
def golomb_decode(data: pd.Series, bits: pd.Series, count: pd.Series) -> pd.Series:
    return pd.Series([golomb_unpack(d, int(b), int(n)) for d, b, n in zip(data, bits, count)])
