"""Reference statistics, per-row top-k explanations and narratives.

Everything after fitting is a projection with higher-order array functions: the top-k sort runs
inside each row (``array_sort`` with a comparator on |contribution|), percentiles come from a
``CASE`` over the fitted breakpoints (literals), the narrative is string functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.config import EXPLAIN_ABOVE, EXPLAIN_BELOW, EXPLAIN_PERCENTILES, EXPLAIN_SEGMENTS
from alertloom.functions.bands import narrative_band
from alertloom.functions.scalar import fixed_text


def fit_reference_stats(df: DataFrame, features: Sequence[str], approx: bool = False) -> DataFrame:
    """Per feature mean, sample std and the 10/25/50/75/90th percentiles (linear), long form.

    One aggregate over the (window-level) training table; ``approx=True`` uses
    ``percentile_approx`` for tables too large for exact per-column buffers."""
    pc = list(EXPLAIN_PERCENTILES)
    aggs = []
    for i, c in enumerate(features):
        x = F.col(c).cast("double")
        q = (F.percentile_approx(x, pc, 100_000) if approx else F.percentile(x, F.array(*[F.lit(p) for p in pc])))
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"), q.alias(f"q{i}")]
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                 *[F.col(f"q{i}")[j].alias(f"p{int(round(p * 100))}") for j, p in enumerate(pc)])
        for i, c in enumerate(features)])).alias("x")).select("x.*")


def collect_stats(stats: DataFrame) -> dict[str, list[float]]:
    """Fitted breakpoints to the driver: one small row per feature (bounded by the feature count)."""
    cols = [f"p{int(round(p * 100))}" for p in EXPLAIN_PERCENTILES]
    return {r["feature"]: [r[c] for c in cols] for r in stats.collect()}


def percentile_rank(value: Column, breaks: Sequence[float] | None) -> Column:
    """piecewise-linear position of ``value`` among five breakpoints; 5 below the first,
    95 above the last, 50 when the feature has no fitted breakpoints."""
    if not breaks or any(b is None for b in breaks):
        return F.lit(50.0)
    expr = F.when(value <= F.lit(breaks[0]), F.lit(EXPLAIN_BELOW))
    for (lo, hi), (start, end) in zip(zip(breaks[:-1], breaks[1:]), EXPLAIN_SEGMENTS):
        # end - (end - start) * (hi - v) / (hi - lo); equal breakpoints never reach this arm
        arm = (F.lit(end) - F.lit(end - start) * (F.lit(hi) - value) / F.lit(hi - lo)) if hi != lo else F.lit(end)
        expr = expr.when(value <= F.lit(hi), arm)
    return expr.otherwise(F.lit(EXPLAIN_ABOVE))


def explain_top_k(df: DataFrame, features: Sequence[str], contributions: Sequence[str],
                  stats: dict[str, list[float]] | None = None, top_k: int = 5,
                  out: str = "explanations") -> DataFrame:
    """T4 + F25 + F26: ``array<struct<feature, value, contribution, direction, percentile>>`` of the
    ``top_k`` largest |contribution| (ties: the earlier feature first)."""
    stats = stats or {}
    items = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(f).alias("feature"),
                               F.col(f).cast("double").alias("value"),
                               F.col(c).cast("double").alias("contribution"),
                               F.when(F.col(c) > 0, F.lit("increases")).otherwise(F.lit("decreases")).alias("direction"),
                               percentile_rank(F.col(f).cast("double"), stats.get(f)).alias("percentile"))
                      for i, (f, c) in enumerate(zip(features, contributions))])

    def cmp(a, b):
        x, y = F.abs(a["contribution"]), F.abs(b["contribution"])
        return F.when(x > y, -1).when(x < y, 1).when(a["idx"] < b["idx"], -1).when(a["idx"] > b["idx"], 1).otherwise(0)
    ranked = F.slice(F.array_sort(items, cmp), 1, top_k)
    return df.withColumn(out, F.transform(ranked, lambda e: e.dropFields("idx")))


def narrative(score: Column, explanations: Column) -> Column:
    """three-part narrative -- band and score; primary increasing driver with value and
    percentile; up to two other increasing drivers."""
    head = F.concat(F.lit("This event window has a "), narrative_band(score), F.lit(" anomaly score ("),
                    fixed_text(score), F.lit("). "))
    inc = F.filter(explanations, lambda e: e["direction"] == "increases")
    top = inc[0]
    primary = F.concat(F.lit("The primary driver is "), top["feature"], F.lit(" (value: "), fixed_text(top["value"]),
                       F.lit(", "), F.format_string("%.0f", F.bround(top["percentile"])),
                       F.lit("th percentile), which increases the anomaly score. "))
    others = F.concat(F.lit("Other contributing factors: "),
                      F.array_join(F.transform(F.slice(inc, 2, 2), lambda e: e["feature"]), ", "), F.lit("."))
    body = F.concat(F.when(F.size(inc) > 0, primary).otherwise(F.lit("")),
                    F.when(F.size(inc) > 1, others).otherwise(F.lit("")))
    return F.when(F.size(explanations) == 0, F.concat(head, F.lit("No significant feature contributions detected."))
                  ).otherwise(F.concat(head, body))


def explanation_json(score: Column, explanations: Column, with_narrative: bool = True) -> Column:
    """``{"score", "features": [...], "narrative"}`` as JSON text."""
    fields = [score.alias("score"), explanations.alias("features")]
    if with_narrative:
        fields.append(narrative(score, explanations).alias("narrative"))
    return F.to_json(F.struct(*fields))
