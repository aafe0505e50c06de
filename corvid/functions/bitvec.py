"""Bit-vector algebra on columns: values from 0 to 2**width - 1 as bigint, for widths up to 32.

Arithmetic wraps; shifts by the width or more give 0; division by 0 gives null. wide() covers any
width on decimal text through Python integers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S


def _mask(width: int) -> int:
    if not 1 <= width <= 32:
        raise ValueError("native widths are 1 to 32")
    return (1 << width) - 1


def trunc(e: Column, width: int) -> Column:
    return e.cast("bigint").bitwiseAND(F.lit(_mask(width)).cast("bigint"))


def signed(e: Column, width: int) -> Column:
    e = trunc(e, width)
    return F.when(e >= (1 << (width - 1)), e - (1 << width)).otherwise(e)


def bv_add(a: Column, b: Column, width: int) -> Column:
    return trunc(trunc(a, width) + trunc(b, width), width)


def bv_sub(a: Column, b: Column, width: int) -> Column:
    return trunc(trunc(a, width) - trunc(b, width), width)


def bv_mul(a: Column, b: Column, width: int) -> Column:
    """By halves of b, so that no product exceeds 2**48."""
    a, b = trunc(a, width), trunc(b, width)
    high = trunc(a * F.shiftright(b, 16), width)
    return trunc(a * b.bitwiseAND(F.lit(65535).cast("bigint")) + F.shiftleft(high.bitwiseAND(F.lit(65535).cast("bigint")), 16), width)


def bv_udiv(a: Column, b: Column, width: int) -> Column:
    a, b = trunc(a, width), trunc(b, width)
    return F.when(b != 0, F.floor(a / F.nullif(b, F.lit(0))).cast("bigint"))


def bv_urem(a: Column, b: Column, width: int) -> Column:
    return F.when(trunc(b, width) != 0, trunc(a, width) % F.nullif(trunc(b, width), F.lit(0)))


def bv_sdiv(a: Column, b: Column, width: int) -> Column:
    x, y = signed(a, width), signed(b, width)
    q = F.floor(F.abs(x) / F.nullif(F.abs(y), F.lit(0))).cast("bigint")
    return F.when(y != 0, trunc(F.when((x < 0) != (y < 0), -q).otherwise(q), width))


def bv_srem(a: Column, b: Column, width: int) -> Column:
    x, y = signed(a, width), signed(b, width)
    return F.when(y != 0, trunc(x % F.nullif(y, F.lit(0)), width))


def bv_and(a: Column, b: Column, width: int) -> Column:
    return trunc(a, width).bitwiseAND(trunc(b, width))


def bv_or(a: Column, b: Column, width: int) -> Column:
    return trunc(a, width).bitwiseOR(trunc(b, width))


def bv_xor(a: Column, b: Column, width: int) -> Column:
    return trunc(a, width).bitwiseXOR(trunc(b, width))


def bv_not(a: Column, width: int) -> Column:
    return trunc(F.bitwise_not(a.cast("bigint")), width)


def bv_neg(a: Column, width: int) -> Column:
    return trunc(-trunc(a, width), width)


def bv_shl(a: Column, s: Column, width: int) -> Column:
    s = trunc(s, width)
    return F.when(s >= width, F.lit(0).cast("bigint")).otherwise(trunc(trunc(a, width) * F.pow(F.lit(2), F.least(s, F.lit(width))).cast("bigint"), width))


def bv_lshr(a: Column, s: Column, width: int) -> Column:
    s = trunc(s, width)
    return F.when(s >= width, F.lit(0).cast("bigint")).otherwise(F.floor(trunc(a, width) / F.pow(F.lit(2), F.least(s, F.lit(width)))).cast("bigint"))


def bv_ashr(a: Column, s: Column, width: int) -> Column:
    s = trunc(s, width)
    return F.when(s >= width, F.lit(0).cast("bigint")).otherwise(trunc(F.floor(signed(a, width) / F.pow(F.lit(2), F.least(s, F.lit(width)))).cast("bigint"), width))


def bv_compare(op: str, a: Column, b: Column, width: int) -> Column:
    """op: eq, ne, or u/s with lt, le, gt, ge."""
    take = signed if op[0] == "s" else trunc
    x, y = take(a, width), take(b, width)
    return {"eq": x == y, "ne": x != y, "lt": x < y, "le": x <= y, "gt": x > y, "ge": x >= y}[op if op in ("eq", "ne") else op[1:]]


def bv_zext(e: Column, width: int, to: int) -> Column:
    return trunc(e, min(width, to))


def bv_sext(e: Column, width: int, to: int) -> Column:
    return trunc(signed(e, width), to)


def bv_extract(e: Column, offset: int, width: int) -> Column:
    return trunc(F.shiftright(e.cast("bigint"), offset), width)


def bv_concat(a: Column, b: Column, width_b: int, width: int) -> Column:
    return trunc(F.shiftleft(a.cast("bigint"), width_b).bitwiseOR(trunc(b, width_b)), width)


def bv_select(c: Column, t: Column, f: Column) -> Column:
    return F.when(c, t).otherwise(f)


def bv_is_zero(e: Column, width: int) -> Column:
    return trunc(e, width) == 0


def bv_implies(a: Column, b: Column) -> Column:
    return ~a | b


def bv_read(array: Column, overlay: Column, index: Column) -> Column:
    """A byte of an array under its newest overwrites (a map by index); null outside of both."""
    return F.coalesce(F.try_element_at(overlay, index), F.get(array, index.cast("int")))


def bv_read_bytes(array: Column, overlay: Column, index: Column, n: int, msb: bool = False) -> Column:
    """n bytes from index on as one value, least significant byte first unless msb."""
    total = None
    for k in range(n):
        part = F.shiftleft(bv_read(array, overlay, index + k).cast("bigint"), 8 * (n - 1 - k if msb else k))
        total = part if total is None else total.bitwiseOR(part)
    return total


@F.udf(S.StringType(), useArrow=True)
def wide(op: str, a: str, b: str, width: int) -> str:
    """add, sub, mul, and, or, xor, udiv or urem of any width on decimal text; null for division by 0."""
    x, y, m = int(a), int(b), (1 << width) - 1
    if op in ("udiv", "urem") and not y & m:
        return None
    x, y = x & m, y & m
    return str({"add": lambda: x + y, "sub": lambda: x - y, "mul": lambda: x * y, "and": lambda: x & y, "or": lambda: x | y, "xor": lambda: x ^ y, "udiv": lambda: x // y, "urem": lambda: x % y}[op]() & m)


def range_binary(op: str, a: tuple[Column, Column], b: tuple[Column, Column], width: int) -> tuple[Column, Column]:
    """(lo, hi) of add, sub, and or udiv over ranges; the whole range where a result may wrap."""
    top = _mask(width)
    (al, ah), (bl, bh) = a, b
    if op == "add":
        wraps = ah + bh > top
        return F.when(wraps, 0).otherwise(al + bl), F.when(wraps, top).otherwise(ah + bh)
    if op == "sub":
        wraps = al < bh
        return F.when(wraps, 0).otherwise(al - bh), F.when(wraps, top).otherwise(ah - bl)
    if op == "and":
        return F.lit(0), F.least(ah, bh)
    if op == "udiv":
        return F.when(bl == 0, 0).otherwise(F.floor(al / F.nullif(bh, F.lit(0)))), F.when(bl == 0, top).otherwise(F.floor(ah / F.nullif(bl, F.lit(0))))
    raise ValueError(op)
