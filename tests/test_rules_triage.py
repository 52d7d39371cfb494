import pytest
from pyspark.sql import functions as F

from alertloom.config import DEFAULT_RULES, Condition, Rule, RuleSet
from alertloom.functions.bands import classify, event_severity, narrative_band, window_severity
from alertloom.operators.rules import explain_rules, rules_from_dict, score_rules
from alertloom.operators.triage import alert_reduction, blend, normalize_weights, reduction_from_counts, top_alerts


def test_default_rules_three_rows(spark):
    df = spark.createDataFrame([(10, 5, 1e3), (100, 50, 5e4), (500, 200, 1e6)],
                               "event_count_1min long, unique_dst_ports_1min long, bytes_out_mean_1min double")
    out = score_rules(df, DEFAULT_RULES).collect()
    assert all(0.0 <= r["baseline_score"] <= 1.0 for r in out)
    assert all(r["triggered_rules"] == [] and r["severity"] == "none" for r in out)   # missing fields never fire


def test_rule_semantics(spark):
    rules = RuleSet([
        Rule("a", "", (Condition("x", ">", 1.0),), "medium", 0.4),
        Rule("b", "", (Condition("x", "~", 0.0), Condition("y", "<", 5)), "high", 0.5),   # unknown op passes
        Rule("c", "", (), "low", 0.3),                                                    # no conditions
        Rule("d", "", (Condition("missing", ">", 0),), "critical", 0.9),                  # missing field
        Rule("e", "", (Condition("x", "!=", 0.0),), "weird", 0.1),                        # unweighted severity
        Rule("f", "", (Condition("x", ">=", 2.0),), "high", 0.2),                         # equal weight to b
    ], {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.2})
    df = spark.createDataFrame([(2.0, 1), (None, 10), (float("nan"), 1)], "x double, y long")
    out = score_rules(df, rules).collect()
    assert out[0]["triggered_rules"] == ["a", "b", "c", "e", "f"]
    assert out[0]["baseline_score"] == 1.0 and out[0]["severity"] == "high" and out[0]["rule_count"] == 5
    assert out[1]["triggered_rules"] == ["c"] and out[1]["severity"] == "low"       # NULL fails a condition
    assert out[2]["triggered_rules"] == ["b", "c"]                                  # NaN treated as missing
    ex = explain_rules(df, rules).collect()[0]["rule_explanations"]
    assert [e["rule_name"] for e in ex] == ["a", "b", "c", "e", "f"]
    assert ex[0]["conditions"][0]["actual_value"] == 2.0


def test_equal_weights_first_rule_wins(spark):
    rules = RuleSet([Rule("p", "", (), "medium", 0.1), Rule("q", "", (), "other", 0.1)],
                    {"medium": 0.5, "other": 0.5})
    out = score_rules(spark.range(1), rules).collect()[0]
    assert out["severity"] == "medium"


def test_rules_from_yaml_dict():
    rs = rules_from_dict({"rules": [{"name": "r", "description": "d", "severity": "high", "score_boost": 0.3,
                                     "conditions": [{"field": "f", "operator": ">", "value": 3}]}],
                          "severity_weights": {"high": 0.8}, "scoring": {"alert_threshold": 0.7}})
    assert rs.rules[0].conditions[0].field == "f" and rs.alert_threshold == 0.7


def test_weights_and_blend(spark):
    caller = {"baseline": 0.2, "lgb": 0.5, "isolation": 0.3}
    w = normalize_weights(caller, {"baseline": True, "lgb": False, "isolation": True})
    assert caller["baseline"] == 0.2 and w["baseline"] == pytest.approx(0.4)
    df = spark.createDataFrame([(1.0, 1.0), (0.1, 0.0)], "baseline_score double, if_score double")
    out = blend(df, {"baseline": 1.0, "lgb": 0.0, "isolation": 1.0}).collect()
    assert out[0]["anomaly_score"] == 1.0 and out[0]["severity"] == "critical" and out[0]["lgb_score"] == 0.0
    assert out[1]["severity"] == "info"


def test_bands(spark):
    df = spark.createDataFrame([(0.9,), (0.85,), (0.7,), (0.5,), (0.3,), (0.29,), (None,)], "s double")
    out = df.select(window_severity("s").alias("w"), event_severity("s").alias("e"),
                    narrative_band("s").alias("n"), classify("s").alias("c")).collect()
    assert [r["w"] for r in out] == ["critical", "critical", "high", "medium", "low", "info", "info"]
    assert [r["e"] for r in out][:2] == ["critical", "high"]
    assert [r["n"] for r in out][:6] == ["critical", "critical", "high", "elevated", "moderate", "low"]
    assert [r["c"] for r in out][:5] == ["ATTACK", "ATTACK", "ATTACK", "ATTACK", "NORMAL"]


def test_top_alerts_and_reduction(spark):
    df = spark.createDataFrame([(i, i / 10.0, 0.1 if i % 2 else 0.0) for i in range(10)],
                               "window_start long, anomaly_score double, baseline_score double")
    top = [r["window_start"] for r in top_alerts(df, limit=3, min_score=0.5).collect()]
    assert top == [9, 8, 7]
    red = alert_reduction(df).collect()[0]
    assert red["total_events"] == 10 and red["baseline_alerts"] == 5 and red["model_alerts"] == 5
    assert red["alert_reduction_rate"] == 0.5 and red["alerts_per_1000"] == 500.0
    cnt = reduction_from_counts(spark.createDataFrame([(0, 3, 0)], "baseline_alerts long, model_alerts long, "
                                                                  "total_events long")).collect()[0]
    assert cnt["relative_reduction"] == -2.0 and cnt["alert_rate"] == 3.0   # max(.,1) guards
