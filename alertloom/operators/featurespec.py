"""Window features declared in YAML, compiled to one aggregate plan.

``compile_spec`` checks a specification against the event table's columns and types and gives a ``FeatureSpec``;
``apply_spec`` runs it for one window size. All declared aggregates share one hash aggregate over the events; distinct
counts, entropy and percentiles share one table of value counts; inter-arrival gaps and novelty come from their own
narrow branches. Entity features roll over the window table in overlapping chunks, formulas are projections. Filters
and formulas are Spark SQL expressions, parsed and type-checked by Spark itself.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.config import ROLLING_STD_DEFAULT, ROLLING_STD_FLOOR, WindowSpec
from alertloom.functions.timebucket import floor_micros, from_micros, to_micros
from alertloom.operators.rolling import with_global_chunks
from alertloom.operators.windows import gap_spread

#: Keys that a feature of each kind must have, and those that it may have besides.
WINDOW_KINDS = {
    "count": ((), ("filter",)), "cardinality": (("field",), ()), "entropy": (("field",), ()), "ratio": ((), ("filter", "numerator_filter", "denominator_filter")),
    "mean": (("field",), ("filter",)), "std": (("field",), ("filter",)), "sum": (("field",), ("filter",)), "percentile": (("field", "percentile"), ()),
    "coefficient_of_variation": (("field",), ()), "novelty_ratio": (("field",), ("lookback_windows",)),
}
ENTITY_KINDS = {"rolling_mean": (("field", "lookback_windows"), ()), "zscore": (("field", "lookback_windows"), ()), "delta": (("field", "lookback_windows"), ())}
NUMERIC = {"byte", "short", "integer", "long", "float", "double", "decimal"}


class SpecError(ValueError):
    """A specification that does not fit its kinds or the event table."""


@dataclass
class FeatureSpec:
    """Checked features: (name, kind, parameters), formulas as (name, SQL, whether it is a condition), and what was left out."""

    windows: list[WindowSpec]
    aggregates: list[tuple[str, str, dict]]
    entities: list[tuple[str, str, dict]]
    formulas: list[tuple[str, str, bool]]
    skipped: list[str] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [n for n, *_ in (*self.aggregates, *self.entities, *self.formulas)]


def load_spec(text: str) -> dict[str, Any]:
    """The YAML text of a specification as a dict."""
    import yaml

    made = yaml.safe_load(text)
    if not isinstance(made, dict):
        raise SpecError("a specification is a mapping")
    return made


def sql_condition(text: str, types: Mapping[str, str]) -> str:
    """A declared condition as Spark SQL: ``&`` and ``|`` join conditions, and a text column compared with a number is cast, values
    that are no numbers being NULL."""
    out = re.sub(r"&+", " AND ", re.sub(r"\|+", " OR ", text))

    def cast(m: re.Match) -> str:
        name = m.group(1)
        return f"try_cast({name} AS DOUBLE) {m.group(2)} {m.group(3)}" if types.get(name) == "string" else m.group(0)

    return re.sub(r"\b([A-Za-z_]\w*)\s*(>=|<=|==|!=|=|<|>)\s*(-?\d+(?:\.\d+)?)\b", cast, out)


def _type_of(table: DataFrame, sql: str, what: str) -> str:
    try:
        return table.select(F.expr(sql).alias("x")).schema["x"].dataType.typeName()
    except (AnalysisException, ParseException) as e:
        raise SpecError(f"{what}: {sql!r} does not fit the table: {str(e).splitlines()[0]}") from None


def _checked(f: Any, kinds: Mapping, group: str) -> tuple[str, str, dict]:
    if not isinstance(f, Mapping) or not isinstance(f.get("name"), str) or not re.fullmatch(r"[A-Za-z_]\w*", f["name"]):
        raise SpecError(f"{group}: every feature is a mapping with a name")
    name, kind = f["name"], f.get("type")
    if kind not in kinds:
        raise SpecError(f"{name}: unknown type {kind!r}; {group} has {sorted(kinds)}")
    must, may = kinds[kind]
    given = {k: v for k, v in f.items() if k not in ("name", "type", "description") and v is not None}
    if missing := [k for k in must if k not in given]:
        raise SpecError(f"{name}: {kind} needs {missing}")
    if unknown := [k for k in given if k not in (*must, *may)]:
        raise SpecError(f"{name}: {kind} does not know {unknown}")
    look = given.get("lookback_windows")
    if look is not None and (isinstance(look, bool) or not isinstance(look, int) or look < 1):
        raise SpecError(f"{name}: lookback_windows is a whole number from 1")
    if kind == "percentile" and not (isinstance(given["percentile"], (int, float)) and 0 <= given["percentile"] <= 100):
        raise SpecError(f"{name}: percentile is between 0 and 100")
    if kind == "ratio" and "filter" in given and "numerator_filter" in given:
        raise SpecError(f"{name}: filter is numerator_filter by another name")
    if kind == "ratio" and not {"filter", "numerator_filter"} & set(given):
        raise SpecError(f"{name}: ratio needs numerator_filter")
    return name, kind, given


def compile_spec(spec: Mapping[str, Any], events: DataFrame, missing: str = "raise", timestamp_col: str = "timestamp") -> FeatureSpec:
    """Check a specification against an event table.

    Unknown kinds, keys, types and names that are taken raise ``SpecError``. Columns that the table does not have raise too,
    unless ``missing`` is "skip": then features that need them, and features built on those, are left out and listed.
    """
    if missing not in ("raise", "skip"):
        raise SpecError("missing is raise or skip")
    types = {f.name: f.dataType.typeName() for f in events.schema.fields}
    groups = ("windows", "window_features", "entity_features", "protocol_features", "derived_features")
    listed = {g: spec.get(g) or [] for g in groups}
    windows = []
    for w in listed["windows"]:
        if not isinstance(w, Mapping) or not isinstance(w.get("duration_seconds"), int) or w["duration_seconds"] < 1:
            raise SpecError("a window has a name and duration_seconds, a whole number from 1")
        windows.append(WindowSpec(str(w["name"]), w["duration_seconds"]))
    out = FeatureSpec(windows, [], [], [])
    taken: set[str] = {"window_start"}

    def new(name: str) -> None:
        if name in taken:
            raise SpecError(f"{name}: two features of this name")
        taken.add(name)

    def lacks(name: str, columns: set[str], have) -> bool:
        gone = sorted(c for c in columns if c not in have)
        if gone and missing == "raise" and not set(gone) & set(out.skipped):
            raise SpecError(f"{name}: no column {gone}")
        if gone:
            out.skipped.append(name)
        return bool(gone)

    words = lambda sql: set(re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", "", sql))) - {"and", "or", "not", "AND", "OR", "NOT", "true", "false", "null", "in", "is", "IS", "IN", "NULL"}
    for f in (*listed["window_features"], *listed["protocol_features"]):
        name, kind, given = _checked(f, WINDOW_KINDS, "window_features")
        new(name)
        filters = {k: v for k, v in given.items() if k.endswith("filter")}
        needs = set().union(*(words(str(v)) for v in filters.values())) if filters else set()
        gap = kind == "coefficient_of_variation"
        if gap and given["field"] != "inter_arrival_time":
            raise SpecError(f"{name}: coefficient_of_variation is known for inter_arrival_time")
        if "field" in given and not gap:
            needs.add(given["field"])
        if lacks(name, needs | {timestamp_col}, types):
            continue
        if kind in ("mean", "std", "sum", "percentile") and types[given["field"]] not in NUMERIC:
            raise SpecError(f"{name}: {given['field']} is {types[given['field']]}, not a number")
        for k, v in filters.items():
            given[k] = sql_condition(str(v), types)
            if _type_of(events, given[k], f"{name} {k}") != "boolean":
                raise SpecError(f"{name}: {k} is no condition")
        out.aggregates.append((name, kind, given))
    made = {n for n, *_ in out.aggregates}
    for f in listed["entity_features"]:
        name, kind, given = _checked(f, ENTITY_KINDS, "entity_features")
        new(name)
        if not lacks(name, {given["field"]}, made):
            out.entities.append((name, kind, given))
    made |= {n for n, *_ in out.entities}
    for f in listed["derived_features"]:
        if not isinstance(f, Mapping) or not isinstance(f.get("name"), str) or not isinstance(f.get("formula"), str):
            raise SpecError("derived_features: every feature has a name and a formula")
        name = f["name"]
        new(name)
        sql = sql_condition(f["formula"], {})
        if lacks(name, words(sql), made):
            continue
        probe = events.sparkSession.createDataFrame([], ", ".join(f"`{n}` double" for n in sorted(made)))
        kind = _type_of(probe, sql, name)
        if kind not in NUMERIC | {"boolean"}:
            raise SpecError(f"{name}: {sql!r} is {kind}, no number or condition")
        out.formulas.append((name, sql, kind == "boolean"))
        made.add(name)
    return out


def _number(c: str, types: Mapping[str, str]) -> Column:
    """A numeric column as double, NaN as NULL."""
    x = F.col(c).cast("double")
    return F.nanvl(x, F.lit(None).cast("double")) if types[c] in ("double", "float") else x


def apply_spec(spec: FeatureSpec, events: DataFrame, window: WindowSpec | tuple[str, int], timestamp_col: str = "timestamp") -> DataFrame:
    """``window_start`` and the declared features, one row per window with an event.

    * ratio: rows that pass both filters by rows that pass the denominator's; 0 without such rows; the numerator counts within
      the denominator;
    * std: sample deviation, 0 for one value; coefficient_of_variation: deviation by mean of the gaps, NULL without two moments;
    * novelty_ratio: share of the window's distinct values that no earlier window had, or none of the ``lookback_windows`` before it;
    * rolling_mean, zscore: over the current and the ``lookback_windows - 1`` rows before, as the rolling baseline has them;
      delta: the row's value less that ``lookback_windows`` rows before, NULL where there is none.

    Events with a NULL timestamp drop out; NULL and NaN values are left out of their feature. Rows are ordered by window start.
    """
    w = window if isinstance(window, WindowSpec) else WindowSpec(*window)
    types = {f.name: f.dataType.typeName() for f in events.schema.fields}
    base = events.withColumn("_us", to_micros(timestamp_col)).where(F.col("_us").isNotNull()).withColumn("_ws", floor_micros(F.col("_us"), w.seconds))
    kinds = {k for _, k, _ in spec.aggregates}
    passes = lambda given, key: F.coalesce(F.expr(given[key]), F.lit(False)) if key in given else F.lit(True)

    aggs = [F.count(F.lit(1)).alias("_n"), F.min("_us").alias("_min"), F.max("_us").alias("_max")]
    for name, kind, g in spec.aggregates:
        ok = passes(g, "filter")
        if kind == "count":
            aggs.append(F.count(F.when(ok, 1)).alias(name))
        elif kind in ("mean", "sum"):
            aggs.append((F.avg if kind == "mean" else F.sum)(F.when(ok, _number(g["field"], types))).alias(name))
        elif kind == "std":
            x = F.when(ok, _number(g["field"], types))
            aggs.append(F.when(F.count(x) > 1, F.stddev_samp(x)).when(F.count(x) == 1, F.lit(0.0)).alias(name))
        elif kind == "ratio":
            inside, top = passes(g, "denominator_filter"), passes(g, "numerator_filter" if "numerator_filter" in g else "filter")
            aggs.append(F.coalesce(F.try_divide(F.count(F.when(inside & top, 1)).cast("double"), F.count(F.when(inside, 1))), F.lit(0.0)).alias(name))
    table = base.groupBy("_ws").agg(*aggs)

    counted = [(n, k, g) for n, k, g in spec.aggregates if k in ("cardinality", "entropy", "percentile")]
    if counted:
        text = sorted({g["field"] for _, k, g in counted if k != "percentile"})
        numbers = sorted({g["field"] for _, k, g in counted if k == "percentile"})
        none = F.lit(None)
        values = [F.struct(F.lit(f"t.{c}").alias("f"), F.col(c).cast("string").alias("s"), none.cast("double").alias("d")) for c in text]
        values += [F.struct(F.lit(f"n.{c}").alias("f"), none.cast("string").alias("s"), _number(c, types).alias("d")) for c in numbers]
        rows = base.select("_ws", F.explode(F.array(*values)).alias("x")).select("_ws", "x.*").where(F.col("s").isNotNull() | F.col("d").isNotNull())
        rows = rows.groupBy("_ws", "f", "s", "d").agg(F.count(F.lit(1)).alias("c"))
        aggs = []
        for name, kind, g in counted:
            hit = F.col("f") == ("n." if kind == "percentile" else "t.") + g["field"]
            c = F.when(hit, F.col("c"))
            if kind == "cardinality":
                aggs.append(F.count(c).alias(name))
            elif kind == "entropy":
                aggs.append(F.coalesce(F.log2(F.sum(c)) - F.sum(c * F.log2("c")) / F.sum(c), F.lit(0.0)).alias(name))
            else:
                aggs.append(F.percentile(F.when(hit, F.col("d")), F.lit(g["percentile"] / 100), F.when(hit, F.col("c")).otherwise(F.lit(0))).alias(name))
        table = table.join(rows.groupBy("_ws").agg(*aggs), "_ws", "left")
        table = table.withColumns({n: F.coalesce(n, F.lit(0)) for n, k, _ in counted if k != "percentile"})
    if "coefficient_of_variation" in kinds:
        gaps = gap_spread(base.select("_us"), [w]).select("_ws", "gsd")
        mean = F.try_divide((F.col("_max") - F.col("_min")) / 1e6, F.col("_n") - 1)
        table = table.join(gaps, "_ws", "left")
        table = table.withColumns({n: F.when(mean > 0, F.col("gsd") / mean) for n, k, _ in spec.aggregates if k == "coefficient_of_variation"})
    for name, kind, g in spec.aggregates:
        if kind == "novelty_ratio":
            seen = base.select("_ws", F.col(g["field"]).alias("_v")).where(F.col("_v").isNotNull()).distinct()
            gap = F.col("_ws") - F.lag("_ws").over(Window.partitionBy("_v").orderBy("_ws"))  # windows of a value, one row each
            far = F.lit(False) if "lookback_windows" not in g else gap > g["lookback_windows"] * w.seconds * 1_000_000
            share = seen.withColumn("_new", gap.isNull() | far).groupBy("_ws").agg((F.count(F.when(F.col("_new"), 1)) / F.count(F.lit(1))).alias(name))
            table = table.join(share, "_ws", "left")
    table = table.select(from_micros(F.col("_ws")).alias("window_start"), *[n for n, *_ in spec.aggregates])
    table = _roll(spec.entities, table)
    for name, sql, condition in spec.formulas:
        table = table.withColumn(name, F.expr(sql).cast("int") if condition else F.expr(sql))
    return table.select("window_start", *spec.names)


def _roll(entities: Sequence[tuple[str, str, dict]], table: DataFrame) -> DataFrame:
    """Rolling means, z-scores and deltas over the window table, in chunks that overlap by the longest lookback."""
    if not entities:
        return table
    longest = max(g["lookback_windows"] for _, _, g in entities)
    framed = with_global_chunks(table, "window_start", longest, max(4096, 2 * longest))
    order = Window.partitionBy("_chunk").orderBy("_rn")
    cols: dict[str, Column] = {}
    for name, kind, g in entities:
        x, n = F.col(g["field"]).cast("double"), g["lookback_windows"]
        frame = order.rowsBetween(-(n - 1), 0)
        if kind == "delta":
            cols[name] = x - F.lag(x, n).over(order)
        elif kind == "rolling_mean":
            cols[name] = F.avg(x).over(frame)
        else:
            spread = F.coalesce(F.stddev_samp(x).over(frame), F.lit(ROLLING_STD_DEFAULT))
            cols[name] = (x - F.avg(x).over(frame)) / F.greatest(spread, F.lit(ROLLING_STD_FLOOR))
    return framed.withColumns(cols).where(~F.col("_copy")).drop("_rn", "_chunk", "_copy")
