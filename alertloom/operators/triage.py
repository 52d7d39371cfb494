"""Blending scores into ranked alerts and counting alerts.

All of it is a projection or a one-row aggregate over the scored table; the top-k is
``orderBy(...).limit(k)``, which Spark plans as a per-partition top-k merged on one task
(``TakeOrderedAndProject``): only ``k`` rows per partition travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.config import UNIFIED_WEIGHTS, WINDOW_SEVERITY_BANDS
from alertloom.functions.bands import band


def normalize_weights(weights: dict[str, float] | None, available: dict[str, bool]) -> dict[str, float]:
    """divide every weight by the sum of the weights of the available scorers.

    Works on a copy (the caller's dict is not changed). Weights of missing scorers are
    divided too; that is harmless because their score is 0."""
    w = dict(weights or UNIFIED_WEIGHTS)
    total = sum(w.get(k, 0.0) for k, ok in available.items() if ok)
    if total > 0:
        w = {k: v / total for k, v in w.items()}
    return w


def blend(df: DataFrame, weights: dict[str, float], baseline_col: str = "baseline_score",
          lgb_col: str = "lgb_score", if_col: str = "if_score", out_col: str = "anomaly_score",
          severity_col: str = "severity", bands=WINDOW_SEVERITY_BANDS) -> DataFrame:
    """F19 + F13: ``clip(wb*baseline + wl*lgb + wi*if, 0, 1)`` and its severity band; a score
    column that is absent counts as 0 (and is added as 0.0, as the reference does)."""
    add = {c: F.lit(0.0) for c in (baseline_col, lgb_col, if_col) if c not in df.columns}
    df = df.withColumns(add) if add else df
    s = (F.lit(float(weights.get("baseline", 0))) * F.col(baseline_col)
         + F.lit(float(weights.get("lgb", 0))) * F.col(lgb_col)
         + F.lit(float(weights.get("isolation", 0))) * F.col(if_col))
    score = F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))
    return df.withColumn(out_col, score).withColumn(severity_col, band(F.col(out_col), bands))


def top_alerts(scored: DataFrame, limit: int = 50, min_score: float = 0.5, score_col: str = "anomaly_score",
               tie_col: str | None = "window_start") -> DataFrame:
    """T2 + F3: rows with ``score >= min_score``, highest first, at most ``limit`` (a top-k report:
    the limit is the feature). Ties are ordered by ``tie_col`` so the result is deterministic."""
    order: list[Column] = [F.col(score_col).desc()]
    if tie_col and tie_col in scored.columns:
        order.append(F.col(tie_col).asc())
    return scored.where(F.col(score_col) >= F.lit(min_score)).orderBy(*order).limit(limit)


def alert_reduction(scored: DataFrame, baseline_threshold: float = 0.0, model_threshold: float = 0.5,
                    baseline_col: str = "baseline_score", score_col: str = "anomaly_score") -> DataFrame:
    """One row -- total, baseline alerts (``> thr``), model alerts (``>= thr``), reduction
    ``1 - model / max(total, 1)`` and alerts per 1000 rows."""
    agg = scored.agg(F.count(F.lit(1)).alias("total_events"),
                     F.count(F.when(F.col(baseline_col) > baseline_threshold, 1)).alias("baseline_alerts"),
                     F.count(F.when(F.col(score_col) >= model_threshold, 1)).alias("model_alerts"))
    denom = F.greatest(F.col("total_events"), F.lit(1)).cast("double")
    return agg.select("total_events", "baseline_alerts", "model_alerts",
                      (F.lit(1.0) - F.col("model_alerts") / denom).alias("alert_reduction_rate"),
                      (F.col("model_alerts") / denom * 1000).alias("alerts_per_1000"))


def reduction_from_counts(counts: DataFrame, baseline_col: str = "baseline_alerts",
                          model_col: str = "model_alerts", total_col: str = "total_events",
                          keep: tuple[str, ...] = ()) -> DataFrame:
    """The count-based definition (relative to baseline alerts, not to the total), beside the ``keep`` columns."""
    b, m, t = F.col(baseline_col), F.col(model_col), F.col(total_col)
    rate = m / F.greatest(t, F.lit(1)).cast("double")
    out = {"baseline_alerts": b, "model_alerts": m, "absolute_reduction": b - m,
           "relative_reduction": F.lit(1.0) - m / F.greatest(b, F.lit(1)).cast("double"),
           "alert_rate": rate, "alerts_per_1000": rate * 1000}
    return counts.select(*keep, *[c.alias(n) for n, c in out.items() if n not in keep])
