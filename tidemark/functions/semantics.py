"""IEEE scalar semantics on double columns: no error on zero, NaN for the unknown, three-valued conditions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
_EXACT = float(1 << 53)


def nan() -> Column:
    return F.lit(NAN)


def any_nan(*values: Column) -> Column:
    out = F.isnan(values[0])
    for x in values[1:]:
        out = out | F.isnan(x)
    return out


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)


def divide(a: Column, b: Column) -> Column:
    # a power keeps the zero's sign
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def _remainder(a: Column, b: Column) -> tuple[Column, Column]:
    """(remainder with the dividend's sign, whether it must be moved by one divisor)."""
    r = a % F.when(b == 0, F.lit(1.0)).otherwise(b)
    return r, (r != 0) & ~F.isnan(r) & ((r < 0) != (b < 0))


def modulo(a: Column, b: Column) -> Column:
    r, moved = _remainder(a, b)
    return F.when(b == 0, nan()).when(moved, r + b).otherwise(r)


def floor_divide(a: Column, b: Column) -> Column:
    r, moved = _remainder(a, b)
    q = (a - r) / F.when(b == 0, F.lit(1.0)).otherwise(b) - F.when(moved, F.lit(1.0)).otherwise(F.lit(0.0))
    down = floor(q)
    return F.when(b == 0, divide(a, b)).when(q - down > 0.5, down + 1).otherwise(down)


def power(a: Column, b: Column) -> Column:
    return F.when((a == 1) | ((a == -1) & (F.abs(b) == INF)), F.lit(1.0)).otherwise(F.pow(a, b))


def floor(x: Column) -> Column:
    return F.when(F.abs(x) < _EXACT, F.floor(F.when(F.abs(x) < _EXACT, x).otherwise(F.lit(0.0))).cast("double")).otherwise(x)


def ceil(x: Column) -> Column:
    return F.when(F.abs(x) < _EXACT, F.ceil(F.when(F.abs(x) < _EXACT, x).otherwise(F.lit(0.0))).cast("double")).otherwise(x)


def log(x: Column) -> Column:
    return F.when(x == 0, F.lit(-INF)).when(x < 0, nan()).otherwise(F.ln(x))


def log10(x: Column) -> Column:
    return F.when(x == 0, F.lit(-INF)).when(x < 0, nan()).otherwise(F.log10(x))


def minimum(a: Column, b: Column) -> Column:
    return F.when(any_nan(a, b), nan()).otherwise(F.least(a, b))


def maximum(a: Column, b: Column) -> Column:
    return F.when(any_nan(a, b), nan()).otherwise(F.greatest(a, b))


def clip(x: Column, lo: Column, hi: Column) -> Column:
    return minimum(maximum(x, lo), hi)


def sign(x: Column) -> Column:
    return F.when(F.isnan(x), nan()).otherwise(F.signum(x))


def truth(x: Column) -> Column:
    """NaN as null, anything but zero as true."""
    return F.when(F.isnan(x), F.lit(None).cast("boolean")).otherwise(x != 0)


def number(condition: Column) -> Column:
    """1, 0, and NaN for the unknown."""
    return F.when(condition.isNull(), nan()).when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def compare(parts: list[Column], tests: list[Callable[[Column, Column], Column]]) -> Column:
    """A chain of comparisons; NaN in any part makes the whole unknown."""
    met = F.lit(True)
    for a, b, test in zip(parts, parts[1:], tests, strict=False):
        met = met & test(a, b)
    return F.when(any_nan(*parts), nan()).when(met, F.lit(1.0)).otherwise(F.lit(0.0))


def conjunction(values: list[Column]) -> Column:
    met = truth(values[0])
    for x in values[1:]:
        met = met & truth(x)
    return number(met)


def disjunction(values: list[Column]) -> Column:
    met = truth(values[0])
    for x in values[1:]:
        met = met | truth(x)
    return number(met)


def negation(x: Column) -> Column:
    return number(~truth(x))


def where(condition: Column, yes: Column, no: Column) -> Column:
    """NaN where the condition is NaN."""
    return F.when(F.isnan(condition), nan()).when(condition != 0, yes).otherwise(no)


def is_nan(x: Column) -> Column:
    return F.when(F.isnan(x), F.lit(1.0)).otherwise(F.lit(0.0))
