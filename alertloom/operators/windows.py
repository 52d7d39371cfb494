"""Multi-size tumbling-window features keyed by ``window_start``.

Physical shape (all sizes in one plan, every event read by narrow scans only):

* **A** -- events x sizes (``explode``) reduced by ``(size, window)`` in a code-generated hash
  aggregate: counts, byte sums/means/stds, auth and protocol counts, first/last timestamp. The
  partial aggregate runs map-side, so only one row per (task, size, window) is shuffled.
* **B** -- value counts ``(size, window, column, value) -> c`` (map-side combined), then per
  ``(size, window)``: distinct counts, Shannon entropy ``log2 N - sum(c log2 c) / N`` and exact
  duration percentiles ``percentile(v, p, frequency=c)`` over the pre-counted values. No
  ``count(DISTINCT)`` (its ``Expand`` multiplies rows) and no per-window value lists.
* **G** -- inter-arrival gaps. A one-second sub-bucket lies inside one window of every size,
  so the gaps inside a sub-bucket are size-independent: they are computed once, on timestamps
  only (``lag`` partitioned by sub-bucket, so a burst window is spread over many tasks); one
  more gap per non-empty sub-bucket links it to the previous sub-bucket of the same window.
* A, B and G each give one row per ``(size, window)``; their union is reduced by
  ``window_start`` with size-conditional ``max`` -- one shuffle of small rows that is also the
  full outer join of the per-size tables on exact ``window_start`` equality (J1).

Empty windows produce no row and events with a NULL timestamp drop out, as in the reference.
Output columns exist whenever their input columns exist (fixed schema for a lazy plan).
``quantiles='approx'`` swaps the exact duration percentiles for ``percentile_approx``
(bounded memory per window whatever its size).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.config import (BYTE_COLUMNS, CARDINALITY_COLUMNS, DEFAULT_WINDOWS, ENTROPY_COLUMNS,
                              PROTOCOL_SHARES, WindowSpec)
from alertloom.functions.timebucket import floor_micros, from_micros, to_micros

_US = 1_000_000


def _as_specs(windows: Sequence[WindowSpec | tuple[str, int]]) -> list[WindowSpec]:
    return [w if isinstance(w, WindowSpec) else WindowSpec(*w) for w in windows]


def _size_feature_names(s: str, present: set[str]) -> list[str]:
    out = [f"event_count_{s}"]
    out += [f"unique_{c}s_{s}" for c in CARDINALITY_COLUMNS if c in present]
    out += [f"{name}_{s}" for c, name in ENTROPY_COLUMNS if c in present]
    for b in BYTE_COLUMNS:
        if b in present:
            out += [f"{b}_mean_{s}", f"{b}_std_{s}", f"{b}_sum_{s}"]
    if "duration" in present:
        out += [f"conn_duration_p50_{s}", f"conn_duration_p95_{s}"]
    if "status" in present and "event_type" in present:
        out.append(f"failed_auth_ratio_{s}")
    out += [f"inter_arrival_mean_{s}", f"inter_arrival_cv_{s}"]
    if "protocol" in present:
        out += [f"{p}_ratio_{s}" for p in PROTOCOL_SHARES]
    return out


def feature_columns(columns: Sequence[str], windows: Sequence[WindowSpec | tuple[str, int]] = DEFAULT_WINDOWS,
                    ) -> list[str]:
    """Names produced by :func:`window_features` for an event table with ``columns``."""
    present = set(columns)
    return [n for w in _as_specs(windows) for n in _size_feature_names(w.name, present)]


def _sizes(specs: list[WindowSpec]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("zi"), F.lit(w.seconds).alias("zs"))
                               for i, w in enumerate(specs)]))


def gap_spread(ts: DataFrame, specs: list[WindowSpec], gap_resolution_us: int = _US) -> DataFrame:
    """(_zi, _ws, gsd): sample deviation, in seconds, of the gaps between successive events (``_us``) of each window.

    Gaps inside sub-buckets are taken once for all sizes, so a burst is spread over many tasks; one gap joins two sub-buckets.
    """
    ts = ts.select("_us", F.floor(F.col("_us") / F.lit(gap_resolution_us)).cast("long").alias("_sb"))
    inner = (ts.select("_sb", (F.col("_us") - F.lag("_us").over(Window.partitionBy("_sb").orderBy("_us")))
                       .alias("_gap"))
             .where(F.col("_gap").isNotNull())
             .select((F.col("_sb") * F.lit(gap_resolution_us)).alias("_sbus"), "_gap", _sizes(specs).alias("_z"))
             .select(F.col("_z.zi").alias("_zi"), floor_micros(F.col("_sbus"), F.col("_z.zs")).alias("_ws"), "_gap"))
    spans = (ts.groupBy("_sb").agg(F.min("_us").alias("_mn"), F.max("_us").alias("_mx"))
             .select("_sb", "_mn", "_mx", _sizes(specs).alias("_z"))
             .select("_sb", "_mn", "_mx", F.col("_z.zi").alias("_zi"),
                     floor_micros(F.col("_mn"), F.col("_z.zs")).alias("_ws")))
    across = (spans.select("_zi", "_ws", (F.col("_mn") - F.lag("_mx").over(
        Window.partitionBy("_zi", "_ws").orderBy("_sb"))).alias("_gap"))
        .where(F.col("_gap").isNotNull()))
    gaps = inner.unionByName(across)
    return gaps.groupBy("_zi", "_ws").agg(F.stddev_samp(F.col("_gap") / F.lit(float(_US))).alias("gsd"))


def window_features(events: DataFrame, windows: Sequence[WindowSpec | tuple[str, int]] = DEFAULT_WINDOWS,
                    timestamp_col: str = "timestamp", gap_resolution_us: int = _US,
                    quantiles: str = "exact", approx_accuracy: int = 10_000) -> DataFrame:
    """Per-window features for every size in ``windows``, one row per ``window_start``."""
    specs = _as_specs(windows)
    if not specs:
        raise ValueError("at least one window size is required")
    if quantiles not in ("exact", "approx"):
        raise ValueError("quantiles must be 'exact' or 'approx'")
    for w in specs:
        if (w.seconds * _US) % gap_resolution_us:
            raise ValueError(f"gap resolution {gap_resolution_us}us must divide window {w.name}")
    present = set(events.columns)
    cats = [c for c in CARDINALITY_COLUMNS if c in present]
    has_auth = "status" in present and "event_type" in present
    has_proto = "protocol" in present
    has_dur = "duration" in present
    exact_q = has_dur and quantiles == "exact"

    needed = {*cats, *[b for b in BYTE_COLUMNS if b in present], *(("duration",) if has_dur else ()),
              *(("event_type", "status") if has_auth else ())}
    # NaN counts as NULL, as sums, means and percentiles would be NaN otherwise.
    whole = {f.name for f in events.schema.fields if f.dataType.typeName() in ("double", "float")}
    clean = [F.nanvl(F.col(c), F.lit(None)).alias(c) if c in whole else F.col(c) for c in sorted(needed)]
    base = events.select(to_micros(timestamp_col).alias("_us"), *clean).where(F.col("_us").isNotNull())
    sized = (base.select("*", _sizes(specs).alias("_z"))
             .select("*", F.col("_z.zi").alias("_zi"), floor_micros(F.col("_us"), F.col("_z.zs")).alias("_ws"))
             .drop("_z"))

    # ---- A: numeric aggregates on raw rows (code-generated hash aggregate)
    a_aggs = [F.count(F.lit(1)).alias("n"), F.min("_us").alias("tmin"), F.max("_us").alias("tmax")]
    for b in BYTE_COLUMNS:
        if b in present:
            a_aggs += [F.count(b).alias(f"{b}_n"), F.avg(b).alias(f"{b}_mean"),
                       F.stddev_samp(b).alias(f"{b}_sd"), F.sum(b).alias(f"{b}_sum")]
    if has_dur and not exact_q:
        a_aggs += [F.percentile_approx("duration", 0.5, approx_accuracy).alias("q50"),
                   F.percentile_approx("duration", 0.95, approx_accuracy).alias("q95")]
    if has_auth:
        auth = F.col("event_type") == "auth"
        a_aggs += [F.count(F.when(auth, 1)).alias("n_auth"),
                   F.count(F.when(auth & (F.col("status") == "failed"), 1)).alias("n_fail")]
    if has_proto:
        a_aggs += [F.count(F.when(F.col("protocol") == p, 1)).alias(f"n_{p}") for p in PROTOCOL_SHARES]
    part_a = sized.groupBy("_zi", "_ws").agg(*a_aggs)

    # ---- B: value counts -> distinct counts, entropy, exact percentiles
    parts = [part_a]
    vals = [F.struct(F.lit(c).alias("n"), F.col(c).cast("string").alias("v"), F.lit(None).cast("double").alias("d"))
            for c in cats]
    if exact_q:
        vals.append(F.struct(F.lit("duration").alias("n"), F.lit(None).cast("string").alias("v"),
                             F.col("duration").alias("d")))
    if vals:
        counted = (sized.select("_zi", "_ws", F.explode(F.array(*vals)).alias("_x"))
                   .where(F.col("_x.v").isNotNull() | F.col("_x.d").isNotNull())
                   .groupBy("_zi", "_ws", F.col("_x.n").alias("cn"), F.col("_x.v").alias("cv"),
                            F.col("_x.d").alias("dv"))
                   .agg(F.count(F.lit(1)).alias("c")))
        b_aggs = []
        for c in cats:
            hit = F.col("cn") == c
            b_aggs.append(F.count(F.when(hit, 1)).alias(f"d_{c}"))
            if any(c == e for e, _ in ENTROPY_COLUMNS):
                b_aggs += [F.sum(F.when(hit, F.col("c"))).alias(f"en_{c}"),
                           F.sum(F.when(hit, F.col("c") * F.log2(F.col("c")))).alias(f"es_{c}")]
        if exact_q:
            b_aggs.append(F.percentile(F.col("dv"), F.array(F.lit(0.5), F.lit(0.95)),
                                       F.when(F.col("cn") == "duration", F.col("c")).otherwise(F.lit(0)))
                          .alias("dq"))
        part_b = counted.groupBy("_zi", "_ws").agg(*b_aggs)
        if exact_q:
            part_b = part_b.select("*", F.col("dq")[0].alias("q50"), F.col("dq")[1].alias("q95")).drop("dq")
        parts.append(part_b)

    parts.append(gap_spread(base.select("_us"), specs, gap_resolution_us))

    # ---- union of per-(size, window) rows, pivoted by window_start (the outer join J1)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    value_cols = [c for c in rows.columns if c not in ("_zi", "_ws")]
    # SQL-text expressions: one JVM parse each instead of a Py4J call per sub-expression
    pivot = [F.expr(f"max(CASE WHEN _zi = {i} THEN `{c}` END) AS `{c}__{i}`")
             for i in range(len(specs)) for c in value_cols]
    wide = rows.groupBy("_ws").agg(*pivot)
    finals = [from_micros(F.col("_ws")).alias("window_start")]
    for i, w in enumerate(specs):
        finals += [F.expr(e) for e in _size_finals(i, w.name, cats, present, has_auth, has_proto, has_dur)]
    return wide.select(*finals)


def _size_finals(i: int, s: str, cats, present, has_auth, has_proto, has_dur) -> list[str]:
    def c(name: str) -> str:
        return f"`{name}__{i}`"

    n = c("n")
    has = f"{n} > 0"
    out = [f"{n} AS `event_count_{s}`"]
    out += [f"CASE WHEN {has} THEN coalesce({c('d_' + k)}, 0) END AS `unique_{k}s_{s}`" for k in cats]
    for k, name in ENTROPY_COLUMNS:
        if k in cats:
            tot, acc = c(f"en_{k}"), c(f"es_{k}")
            out.append(f"CASE WHEN {has} THEN coalesce(log2({tot}) - {acc} / {tot}, 0.0D) END AS `{name}_{s}`")
    for b in BYTE_COLUMNS:
        if b in present:
            nb = c(f"{b}_n")
            out += [f"{c(b + '_mean')} AS `{b}_mean_{s}`",
                    f"CASE WHEN {nb} > 1 THEN {c(b + '_sd')} WHEN {nb} = 1 THEN 0.0D END AS `{b}_std_{s}`",
                    f"{c(b + '_sum')} AS `{b}_sum_{s}`"]
    if has_dur:
        out += [f"{c('q50')} AS `conn_duration_p50_{s}`", f"{c('q95')} AS `conn_duration_p95_{s}`"]
    if has_auth:
        out.append(f"CASE WHEN {has} THEN coalesce(try_divide(CAST({c('n_fail')} AS DOUBLE), {c('n_auth')}), 0.0D) "
                   f"END AS `failed_auth_ratio_{s}`")
    mean_gap = f"try_divide(CAST({c('tmax')} - {c('tmin')} AS DOUBLE) / {float(_US)!r}D, {n} - 1)"
    ok = f"{n} > 1 AND {mean_gap} > 0"
    out += [f"CASE WHEN {ok} THEN {mean_gap} END AS `inter_arrival_mean_{s}`",
            f"CASE WHEN {ok} THEN {c('gsd')} / {mean_gap} END AS `inter_arrival_cv_{s}`"]
    if has_proto:
        out += [f"CASE WHEN {has} THEN {c('n_' + p)} / {n} END AS `{p}_ratio_{s}`" for p in PROTOCOL_SHARES]
    return out
