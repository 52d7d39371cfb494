"""Scalar column helpers (F4-F6, F17, F22, F24 and output rounding)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE/FLOAT column for comparison against an oracle: first to 9 decimals,
    then to ``digits``, each as ``round(x * 10^k) / 10^k`` -- the same doubles as DuckDB's
    ``round(round(x, 9), d)``, even on binary near-ties where Spark's decimal-text
    ``round(x, d)`` can differ in the last digit."""
    snap, m = 1e9, float(10 ** digits)

    def r(c):
        # snap summation-order noise (~1e-13) first, then round: ties resolve the same way
        return F.round((F.round(c * snap) / snap) * m) / m
    return df.withColumns({f.name: r(F.col(f.name))
                           for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def select_existing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """project the columns of a fixed list that exist."""
    have = set(df.columns)
    return df.select(*[n for n in names if n in have])


def flag(col: Column | str, value) -> Column:
    """``col == value`` as 0/1 with NULL -> 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce((c == F.lit(value)).cast("int"), F.lit(0))


def threshold(prob: Column | str, t: float = 0.5) -> Column:
    """probability to 0/1 (``>=``)."""
    c = F.col(prob) if isinstance(prob, str) else prob
    return (c >= F.lit(t)).cast("int")


def clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def _scaled(x: Column, digits: int) -> tuple[Column, Column]:
    """(floor, which way) of x * 10^digits for x >= 0 below 2^52 / 10^digits: the sign of the exact product less floor + 1/2.

    The rounding error of the product comes from splitting both factors into halves of 26 bits (Dekker 1971), so a value next to
    a tie is not taken for one.
    """
    t = float(10 ** digits)
    split = float(2**27 + 1)
    hi = x * split - (x * split - x)
    lo = x - hi
    t_hi = t * split - (t * split - t)
    t_lo = t - t_hi
    p = x * t
    err = ((hi * t_hi - p) + hi * t_lo + lo * t_hi) + lo * t_lo
    whole = F.floor(p)
    return whole, ((p - whole) - 0.5) + err


def _rounded(x: Column, digits: int) -> Column:
    """x * 10^digits as a whole number, halves of the exact product to even."""
    whole, side = _scaled(x, digits)
    up = (side > 0) | ((side == 0) & (F.pmod(whole, F.lit(2)) == 1))
    return whole + up.cast("long")


def round_exact(x: Column, digits: int = 4) -> Column:
    """a double rounded on its exact binary value, halves to even; NULL, NaN and infinite values stay as they are."""
    a = F.abs(x)
    near = _rounded(a, digits).cast("double") / float(10 ** digits)
    return F.when(a < float(2**52 // 10**digits), F.when(x < 0, -near).otherwise(near)).otherwise(x)


def fixed_text(x: Column, digits: int = 2) -> Column:
    """A double as text with so many decimals, rounded on its exact binary value with halves to even."""
    a = F.abs(x)
    whole = F.floor(a)
    part = _rounded(a - whole, digits)
    carry = (part == 10 ** digits).cast("long")
    text = F.concat(F.when(x < 0, "-").otherwise(""), (whole + carry).cast("string"), F.lit("."),
                    F.lpad((part - carry * 10 ** digits).cast("string"), digits, "0"))
    return F.when(a < 2.0**62, text).otherwise(F.format_string(f"%.{digits}f", x))
