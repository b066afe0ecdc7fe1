"""Bitmaps and bit fields over binary values, and longest common subsequences.

A bitmap is read as text of 0 and 1, most significant bit of each byte first; bits past the end are 0.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: LCS refuses pairs with more cells than this.
MOST_CELLS = 16_000_000


def to_bits(value: Column) -> Column:
    digits = F.split(F.hex(F.coalesce(value, F.lit("")).cast("binary")), "")
    return F.array_join(F.transform(digits, lambda d: F.when(d == "", "").otherwise(F.lpad(F.conv(d, 16, 2), 4, "0"))), "")


def from_bits(bits: Column) -> Column:
    """Binary of a text of bits, filled with 0 to whole bytes."""
    full = F.rpad(bits, F.ceil(F.length(bits) / 8).cast("int") * 8, "0")
    # the groups are cut once: a lambda that named the text would make it again for each of them
    return F.unhex(F.array_join(F.transform(F.regexp_extract_all(full, F.lit("(....)"), F.lit(1)), lambda d: F.conv(d, 2, 16)), ""))


def count_range(value: Column, start: int, end: int, unit: str = "BYTE") -> Column:
    """BITCOUNT in an inclusive range of bytes or bits, negative places from the end."""
    bits, step = to_bits(value), 8 if unit == "BYTE" else 1
    n = (F.length(bits) / step).cast("int")
    a = F.greatest(n + start, F.lit(0)) if start < 0 else F.lit(start)
    b = n + end if end < 0 else F.least(F.lit(end), n - 1)
    part = F.substr(bits, a * step + 1, F.greatest(b - a + 1, F.lit(0)) * step)
    return F.length(F.replace(part, F.lit("0"), F.lit(""))).cast("long")


def set_bit(value: Column, at: int, bit: int) -> Column:
    """SETBIT: the value afterwards; GETBIT of the value before is what the command returns."""
    return _put(value, at, F.lit(str(bit)), 1)


def _put(value: Column, at: int, part: Column, width: int) -> Column:
    """The value with a text of bits at a place; only the half bytes it lies in are read and made again."""
    digits = F.hex(F.coalesce(value, F.lit("")).cast("binary"))
    digits = F.rpad(digits, F.greatest(F.length(digits), F.lit((at + width + 7) // 8 * 2)), "0")
    first, last, over = at // 4, (at + width - 1) // 4, (at + width) % 4
    nibble = lambda i: F.lpad(F.conv(F.substring(digits, i + 1, 1), 16, 2), 4, "0")
    bits = F.concat(F.substring(nibble(first), 1, at % 4), part, F.substring(nibble(last), over + 1, 4 - over) if over else F.lit(""))
    made = [F.conv(F.substring(bits, 4 * i + 1, 4), 2, 16) for i in range(last - first + 1)]
    return F.unhex(F.concat(F.substring(digits, 1, first), *made, F.substr(digits, F.lit(last + 2))))


def bit_op(op: str, first: Column, *rest: Column) -> Column:
    """BITOP AND, OR, XOR over values, shorter ones filled with 0; NOT of one."""
    if op == "NOT":
        return F.unhex(F.translate(F.hex(F.coalesce(first, F.lit("")).cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210"))
    test = {"AND": lambda x, y: x.bitwiseAND(y), "OR": lambda x, y: x.bitwiseOR(y), "XOR": lambda x, y: x.bitwiseXOR(y)}[op]
    values = [F.hex(F.coalesce(c, F.lit("")).cast("binary")) for c in (first, *rest)]
    n = F.greatest(*[F.length(v) for v in values]) if rest else F.length(values[0])
    digits = lambda v: F.transform(F.split(F.rpad(v, n, "0"), ""), lambda d: F.conv(d, 16, 10).cast("int"))
    out = digits(values[0])
    for v in values[1:]:
        out = F.zip_with(out, digits(v), test)
    return F.unhex(F.when(n > 0, F.array_join(F.transform(out, F.hex), "")).otherwise(F.lit("")))


def _big(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def _kind(kind: str) -> tuple[bool, int]:
    signed, width = kind[0] == "i", int(kind[1:])
    if kind[0] not in "iu" or not 1 <= width <= (64 if signed else 63):
        raise ValueError(f"no bit field type {kind}")
    return signed, width


def field_get(value: Column, kind: str, at: int) -> Column:
    """BITFIELD GET: kind i1 to i64 or u1 to u63, at a bit."""
    signed, width = _kind(kind)
    raw = F.conv(F.substring(F.rpad(F.substring(to_bits(value), at + 1, width), width, "0"), 1, width), 2, 10).cast("decimal(38,0)")
    out = F.when(raw >= _big(1 << (width - 1)), raw - _big(1 << width)).otherwise(raw) if signed else raw
    return out.cast("long")


def field_set(value: Column, kind: str, at: int, to: Column) -> Column:
    """BITFIELD SET: the value afterwards, `to` taken modulo the width."""
    _, width = _kind(kind)
    size = _big(1 << width)
    part = F.lpad(F.conv(F.pmod(to.cast("decimal(38,0)"), size).cast("decimal(20,0)").cast("string"), 10, 2), width, "0")
    return _put(value, at, part, width)


def field_add(value: Column, kind: str, at: int, by: Column, overflow: str = "WRAP") -> Column:
    """BITFIELD INCRBY: the number afterwards by WRAP, SAT or FAIL (null); `field_set` stores it."""
    signed, width = _kind(kind)
    low, high = (-(1 << (width - 1)), (1 << (width - 1)) - 1) if signed else (0, (1 << width) - 1)
    low, high, size = (_big(x) for x in (low, high, 1 << width))
    new = field_get(value, kind, at).cast("decimal(38,0)") + by.cast("decimal(38,0)")
    out = {"WRAP": F.pmod(new - low, size) + low, "SAT": F.least(F.greatest(new, low), high), "FAIL": F.when(new.between(low, high), new)}[overflow]
    return out.cast("long")


def common(a: str, b: str) -> str | None:
    """One longest common subsequence, none beyond MOST_CELLS as in the original limit; where both neighbours are as good, the one with a shorter b is followed.

    Rows of the table are kept as integers whose zero bits mark where the length grows: an eighth of a byte a cell.
    """
    if len(a) * len(b) > MOST_CELLS:
        return None
    full = (1 << len(b)) - 1
    where: dict[str, int] = {}
    for j, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << j
    rows = [full]
    for c in a:
        same = rows[-1] & where.get(c, 0)
        rows.append(((rows[-1] + same) | (rows[-1] - same)) & full)
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif length(i - 1, j) > length(i, j - 1):
            i -= 1
        else:
            j -= 1
    return "".join(reversed(out))


@F.pandas_udf(StringType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """LCS of two columns, null where either is; its LEN is the length of it."""
    return pd.Series([None if x is None or y is None else common(x, y) for x, y in zip(a, b, strict=True)], dtype=object)
