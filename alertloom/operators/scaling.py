"""Fitted scaling and score normalisation.

Fitting returns a handful of numbers per column (collected once, like a model); applying them is a
projection. Batch quantiles are exact order statistics from :func:`kth_values`, with linear
interpolation between ranks (the usual ``(n - 1) * p`` definition).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.operators.ordering import kth_values


def fit_standard_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """``{col: (mean, scale)}`` with the population std; a zero std scales by 1."""
    r = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
               *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        m = r[f"m_{i}"] if r[f"m_{i}"] is not None else 0.0
        s = r[f"s_{i}"]
        out[c] = (float(m), float(s) if s and s > 0 else 1.0)
    return out


def standard_scale(df: DataFrame, params: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})


def exact_quantiles(df: DataFrame, col: Column | str, probs: Sequence[float]) -> list[float | None]:
    """Linear-interpolated quantiles (``h = (n - 1) p``) from exact order statistics."""
    c = F.col(col) if isinstance(col, str) else col
    vals = df.select(c.cast("double").alias("_q")).where(F.col("_q").isNotNull())
    n = vals.count()
    if n == 0:
        return [None for _ in probs]
    ends = [(int(math.floor((n - 1) * p)), int(math.ceil((n - 1) * p))) for p in probs]
    ranks = sorted({r + 1 for pair in ends for r in pair})
    value = dict(zip(ranks, kth_values(vals, "_q", ranks)))
    out = []
    for p, (lo, hi) in zip(probs, ends):
        a, b = value[lo + 1], value[hi + 1]
        out.append(a + ((n - 1) * p - lo) * (b - a))
    return out


def percentile_sigmoid(df: DataFrame, col: str, out: str, quantiles: Sequence[float] | None = None,
                       min_scale: float = 0.1) -> tuple[DataFrame, tuple[float, float, float]]:
    """``1 / (1 + exp(-(s - p50) / max(p95 - p50, p50 - p5, 0.1)))``.

    ``quantiles`` = stored ``(p5, p50, p95)`` (stream / single-row mode); otherwise they are
    the batch's own quantiles -- a one-row batch then always yields 0.5 (reference quirk Q5)."""
    p5, p50, p95 = quantiles if quantiles is not None else exact_quantiles(df, col, (0.05, 0.5, 0.95))
    if p50 is None:
        return df.withColumn(out, F.lit(None).cast("double")), (p5, p50, p95)
    scale = max(p95 - p50, p50 - p5, min_scale)
    z = (F.col(col) - F.lit(p50)) / F.lit(scale)
    return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-z))), (p5, p50, p95)


def min_max(df: DataFrame, col: str, out: str, eps: float = 1e-8) -> DataFrame:
    """``(s - min) / (max - min + 1e-8)`` with the batch min and max."""
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    if r["lo"] is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    return df.withColumn(out, (F.col(col) - F.lit(float(r["lo"]))) / F.lit(float(r["hi"]) - float(r["lo"]) + eps))
