"""Declarative rule scoring compiled into Column expressions (no UDF).

Rule semantics (per row):

* a condition compares a feature with a constant: ``> >= < <= == !=``; a NULL (or NaN) value
  fails it; an unknown operator is ignored (the condition passes);
* a rule whose field is missing from the table never fires; a rule without conditions always
  fires; a rule fires when all its conditions hold;
* ``baseline_score = min(sum of fired boosts, 1)``; ``triggered_rules`` lists fired names in
  rule order; ``severity`` is the fired severity with the largest weight (ties: the first
  fired rule; unweighted severities never win; nothing fired -> ``none``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.config import DEFAULT_RULES, Condition, Rule, RuleSet

_OPS = {
    ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v, "==": lambda c, v: c == v, "!=": lambda c, v: c != v,
}


def _value(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        c = F.nanvl(c, F.lit(None).cast("double"))
    return c


def condition_column(df: DataFrame, cond: Condition) -> Column:
    op = _OPS.get(cond.operator)
    if op is None:
        return F.lit(True)
    return F.coalesce(op(_value(df, cond.field), F.lit(cond.value)), F.lit(False))


def rule_column(df: DataFrame, rule: Rule) -> Column:
    if any(c.field not in df.columns for c in rule.conditions):
        return F.lit(False)
    hit = F.lit(True)
    for cond in rule.conditions:
        hit = hit & condition_column(df, cond)
    return hit


def score_rules(df: DataFrame, rules: RuleSet = DEFAULT_RULES, severity_col: str = "severity") -> DataFrame:
    """Add ``baseline_score``, ``triggered_rules``, ``<severity_col>`` and ``rule_count``."""
    hits = [(r, rule_column(df, r)) for r in rules.rules]
    if not hits:
        return df.withColumns({"baseline_score": F.lit(0.0), "triggered_rules": F.array().cast("array<string>"),
                               severity_col: F.lit("none"), "rule_count": F.lit(0)})
    boost = sum((F.when(h, F.lit(float(r.score_boost))).otherwise(F.lit(0.0)) for r, h in hits), F.lit(0.0))
    names = F.filter(F.array(*[F.when(h, F.lit(r.name)) for r, h in hits]), lambda x: x.isNotNull())
    count = sum((h.cast("int") for _, h in hits), F.lit(0))
    weights = {r.name: float(rules.severity_weights.get(r.severity, 0.0)) for r, _ in hits}
    best = F.greatest(*[F.when(h, F.lit(weights[r.name])) for r, h in hits], F.lit(0.0))
    sev = F.coalesce(*[F.when(h & (F.lit(weights[r.name]) == best) & (best > 0), F.lit(r.severity))
                       for r, h in hits], F.lit("none"))
    return df.withColumns({"baseline_score": F.least(boost, F.lit(1.0)), "triggered_rules": names,
                           severity_col: sev, "rule_count": count.cast("int")})


def explain_rules(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """``rule_explanations`` = fired rules with their conditions, thresholds and actual
    values (conditions on missing fields are left out, as in the reference)."""
    entries = []
    for r in rules.rules:
        conds = [F.struct(F.lit(c.field).alias("field"), F.lit(c.operator).alias("operator"),
                          F.lit(float(c.value)).alias("threshold"),
                          F.col(c.field).cast("double").alias("actual_value"))
                 for c in r.conditions if c.field in df.columns]
        cond_arr = F.array(*conds) if conds else F.array().cast(
            "array<struct<field:string,operator:string,threshold:double,actual_value:double>>")
        entries.append(F.when(rule_column(df, r), F.struct(
            F.lit(r.name).alias("rule_name"), F.lit(r.description).alias("description"),
            F.lit(r.severity).alias("severity"), F.lit(float(r.score_boost)).alias("score_boost"),
            cond_arr.alias("conditions"))))
    if not entries:
        return df.withColumn("rule_explanations", F.array())
    return df.withColumn("rule_explanations", F.filter(F.array(*entries), lambda x: x.isNotNull()))


def rules_from_dict(config: dict) -> RuleSet:
    """A parsed rules YAML (``rules``, ``severity_weights``, ``scoring``) -> RuleSet."""
    rules = [Rule(r["name"], r.get("description", ""),
                  tuple(Condition(c["field"], c["operator"], c["value"]) for c in r.get("conditions", [])),
                  r["severity"], float(r["score_boost"])) for r in config.get("rules", []) or []]
    scoring = config.get("scoring", {}) or {}
    return RuleSet(rules, dict(config.get("severity_weights", {}) or {}),
                   scoring.get("alert_threshold", 0.6), scoring.get("critical_threshold", 0.85))


def load_rules_yaml(path: str) -> RuleSet:
    """Read a rules YAML file on the driver (configuration, not data)."""
    import yaml
    with open(path) as fh:
        return rules_from_dict(yaml.safe_load(fh) or {})
