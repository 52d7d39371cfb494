"""Score bands as ``CASE`` chains; the band tables live in ``alertloom.config``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertloom.config import (CLASS_THRESHOLD, EVENT_SEVERITY_BANDS, NARRATIVE_BANDS,
                              WINDOW_SEVERITY_BANDS)


def band(score: Column | str, bands=WINDOW_SEVERITY_BANDS) -> Column:
    """Lower-bound bands (``score >= bound``), checked top-down; the ``None`` entry is the
    fallback. NULL scores fall through to the fallback, like a failed comparison."""
    c = F.col(score) if isinstance(score, str) else score
    expr = None
    fallback = None
    for bound, label in bands:
        if bound is None:
            fallback = F.lit(label)
            continue
        cond = c >= F.lit(bound)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(fallback) if expr is not None else fallback


def window_severity(score: Column | str) -> Column:
    """window severity (critical from 0.85)."""
    return band(score, WINDOW_SEVERITY_BANDS)


def event_severity(score: Column | str) -> Column:
    """event severity (critical from 0.9)."""
    return band(score, EVENT_SEVERITY_BANDS)


def narrative_band(score: Column | str) -> Column:
    """narrative wording with strict upper bounds (``score < bound``)."""
    c = F.col(score) if isinstance(score, str) else score
    expr = None
    fallback = None
    for bound, label in NARRATIVE_BANDS:
        if bound is None:
            fallback = F.lit(label)
            continue
        cond = c < F.lit(bound)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(fallback)


def classify(score: Column | str, threshold: float = CLASS_THRESHOLD) -> Column:
    """F16: ``ATTACK`` when the unrounded score is at least the threshold."""
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c >= F.lit(threshold), F.lit("ATTACK")).otherwise(F.lit("NORMAL"))
