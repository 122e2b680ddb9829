"""Column expressions shared by the operators.

All of them are built from JVM-side functions, so they stay inside whole-stage
code generation.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959963984540054  # fixed value: two-sided 95 % normal quantile


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- time ------------------------------------------------------------------------

def micros(c: Column | str) -> Column:
    """Epoch microseconds of a timestamp (with or without time zone)."""
    return F.unix_micros(col(c).cast("timestamp"))


def utc_day(us: Column) -> Column:
    """`YYYY-MM-DD` of epoch microseconds, independent of the session zone."""
    days = F.floor(us / F.lit(86_400_000_000.0)).cast("int")
    return F.date_format(F.date_add(F.to_date(F.lit("1970-01-01")), days), "yyyy-MM-dd")


# --- numbers ---------------------------------------------------------------------

def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def round_half_up(c: Column, digits: int) -> Column:
    """Half-away-from-zero rounding of the binary product for values >= 0."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def _safe(n: Column) -> Column:
    """Total as double, 1 instead of 0 so that no branch divides by zero."""
    return F.when(n > 0, n).otherwise(F.lit(1)).cast("double")


def _valid(count: Column, total: Column) -> Column:
    return (total > 0) & (count <= total)


def proportion(count: Column | str, total: Column | str) -> Column:
    """Observed rate; 0 when the total is 0 or smaller than the count."""
    k, n = col(count), col(total)
    return F.when(_valid(k, n), k.cast("double") / _safe(n)).otherwise(F.lit(0.0))


def _wilson(count: Column, total: Column, sign: int) -> Column:
    n, z2 = _safe(total), Z95 * Z95
    p = count.cast("double") / n
    denominator = F.lit(1.0) + F.lit(z2) / n
    centre = (p + F.lit(z2) / (n * 2.0)) / denominator
    spread = F.greatest((p * (F.lit(1.0) - p) + F.lit(z2) / (n * 4.0)) / n, F.lit(0.0))
    margin = F.lit(Z95) * F.sqrt(spread) / denominator
    bound = centre + margin * float(sign)
    return F.when(_valid(count, total), clamp01(bound)).otherwise(F.lit(0.0))


def wilson_lower(count: Column | str, total: Column | str) -> Column:
    return _wilson(col(count), col(total), -1)


def wilson_upper(count: Column | str, total: Column | str) -> Column:
    return _wilson(col(count), col(total), 1)


def wilson(count: Column | str, total: Column | str) -> Column:
    """Rate with its 95 % Wilson interval as a struct."""
    k, n = col(count), col(total)
    return F.struct(
        k.cast("long").alias("count"), n.cast("long").alias("total"),
        proportion(k, n).alias("rate"),
        wilson_lower(k, n).alias("lower95"), wilson_upper(k, n).alias("upper95"),
    )


def proportion_difference(left: Column, right: Column) -> Column:
    """Difference of two `wilson` structs with a conservative interval."""
    f = lambda s, name: s.getField(name)
    return F.struct(
        (f(left, "rate") - f(right, "rate")).alias("estimate"),
        F.greatest(F.lit(-1.0), f(left, "lower95") - f(right, "upper95")).alias("lower95"),
        F.least(F.lit(1.0), f(left, "upper95") - f(right, "lower95")).alias("upper95"),
    )


def rates(specs: dict[str, tuple[str, Column | str, Column | str]] | dict) -> list[Column]:
    """Flat `<name>_rate|_lower95|_upper95` columns for name -> (count, total)."""
    out = []
    for name, (k, n) in specs.items():
        k, n = col(k), col(n)
        out += [
            proportion(k, n).alias(f"{name}_rate"),
            wilson_lower(k, n).alias(f"{name}_lower95"),
            wilson_upper(k, n).alias(f"{name}_upper95"),
        ]
    return out


def same_rates(specs: dict) -> Column:
    """Whether the columns of `rates(specs)` are what the counts give (to 1e-9, NULL for NULL)."""
    ok = F.lit(True)
    for name, (k, n) in specs.items():
        for suffix, value in (("rate", proportion(col(k), col(n))), ("lower95", wilson_lower(col(k), col(n))),
                              ("upper95", wilson_upper(col(k), col(n)))):
            given = F.col(f"{name}_{suffix}")
            ok = ok & F.coalesce(F.abs(given - value) <= 1e-9, given.isNull() & value.isNull())
    return ok


# --- enums -----------------------------------------------------------------------

def optional_class(c: Column | str) -> Column:
    """An omitted optional class means `unknown`."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit("unknown"))


def in_or_absent(c: Column | str, values: Iterable[str]) -> Column:
    return F.coalesce(col(c), F.lit("")).isin("", *values)


def code(c: Column | str, values: Iterable[str]) -> Column:
    """Position of a value in an ordered vocabulary (0 for a foreign value)."""
    expr = F.lit(0)
    for i, v in reversed(list(enumerate(values))):
        expr = F.when(col(c) == v, F.lit(i)).otherwise(expr)
    return expr


def bit(c: Column | str, values: Iterable[str]) -> Column:
    """One-bit mask of a value in an ordered vocabulary (0 for a foreign value)."""
    expr = F.lit(0)
    for i, v in reversed(list(enumerate(values))):
        expr = F.when(col(c) == v, F.lit(1 << i)).otherwise(expr)
    return expr


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("long")


def present(*items: Column) -> Column:
    """Array of the non-null items, in the given order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Name of the first failing check, NULL when all hold. NULL counts as a failure."""
    expr = F.lit(None).cast("string")
    for ok, reason in reversed(checks):
        expr = F.when(F.coalesce(ok, F.lit(False)), expr).otherwise(F.lit(reason))
    return expr


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def items(df: DataFrame, array: Column, name: str) -> DataFrame:
    """One row per array item, as the only column.

    Outer explode plus a later null filter: a plain explode makes the optimizer push
    `size(array) > 0` down, which evaluates the expression behind the array twice.
    """
    return df.select(F.explode_outer(array).alias(name))


# --- bytes -----------------------------------------------------------------------

def base64url(c: Column) -> Column:
    """base64url without padding."""
    return F.translate(F.base64(c), "+/=\r\n", "-_")


def utf8(c: Column | str) -> Column:
    return col(c).cast("binary")


def concat_bytes(*cols: Column) -> Column:
    """Byte concatenation; all arguments are binary, and so is the result."""
    return F.concat(*cols)


def length_prefixed(c: Column | str) -> Column:
    """8-byte big-endian byte length followed by the UTF-8 bytes."""
    b = utf8(c)
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(b)), 16, "0")), b)


def _pads(key: bytes) -> tuple[bytes, bytes]:
    import hashlib

    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_with_pads(inner: Column, outer: Column, message: Column) -> Column:
    """HMAC-SHA256 from prepared pads; all arguments and the result are binary."""
    digest = F.unhex(F.sha2(concat_bytes(inner, message), 256))
    return F.unhex(F.sha2(concat_bytes(outer, digest), 256))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a binary column under one fixed key."""
    inner, outer = _pads(key)
    return hmac_with_pads(F.lit(bytearray(inner)), F.lit(bytearray(outer)), message)


def key_pads(key: bytes) -> tuple[bytes, bytes]:
    return _pads(key)


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))
