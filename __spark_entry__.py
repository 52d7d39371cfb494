"""

Every query reads the given tables at ``sf_dir`` (the security-event projection of ``events``
from FIXTURES.md §4) and runs the library's operators on
the whole table. DOUBLE outputs are rounded to 6 decimals on both sides for the comparison.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

import oracles as O  # noqa: E402
from alertloom.config import DEFAULT_RULES, DEFAULT_WINDOWS, LARGE_WINDOWS, Condition, Rule, RuleSet, WindowSpec  # noqa: E402
from alertloom.functions.scalar import round_doubles  # noqa: E402
from alertloom.operators.novelty import novelty_features  # noqa: E402
from alertloom.operators.rolling import rolling_baseline  # noqa: E402
from alertloom.operators.windows import window_features  # noqa: E402
from alertloom.plans.features import feature_table  # noqa: E402
from alertloom.sources.events import events_from_table, load_events, metric_input  # noqa: E402
from alertloom.config import YAML_RULES  # noqa: E402
from alertloom.functions.bands import classify, event_severity, narrative_band, window_severity  # noqa: E402
from alertloom.operators import evaluate as EV  # noqa: E402
from alertloom.operators.rules import explain_rules, score_rules  # noqa: E402
from alertloom.operators.triage import (alert_reduction, blend, normalize_weights,  # noqa: E402
                                        reduction_from_counts, top_alerts)
from alertloom.session import checkpoint_dir, cut_lineage, spread  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from alertloom.operators import profile as PR  # noqa: E402
from alertloom.operators import sampling as SA  # noqa: E402
from alertloom.operators.encoding import event_level_features  # noqa: E402
from alertloom.operators.explain import collect_stats, explain_top_k, fit_reference_stats  # noqa: E402
from alertloom.operators.labels import attach_labels, window_labels  # noqa: E402
from alertloom.operators.scaling import fit_standard_scaler, min_max, percentile_sigmoid, standard_scale  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_events(spark, sf_dir)


# ---------------------------------------------------------------- feature table (M15 parts)

def q_window_features(spark, sf_dir):
    """A1-A10 + J1 for 1/5/15-minute windows."""
    return round_doubles(window_features(_events(spark, sf_dir), DEFAULT_WINDOWS))


def q_window_features_large(spark, sf_dir):
    """A1-A10 + J1 for 1h/6h/1d windows (dense windows: entropy, percentiles, CV exercised)."""
    return round_doubles(window_features(_events(spark, sf_dir), LARGE_WINDOWS))


def q_rolling_baseline(spark, sf_dir):
    """W1-W4 on the joined window table."""
    wf = window_features(_events(spark, sf_dir), DEFAULT_WINDOWS)
    counts = [c for c in wf.columns if c.startswith("event_count_")]
    rolled = rolling_baseline(wf.select("window_start", *counts))
    return round_doubles(rolled)


def q_novelty(spark, sf_dir):
    """A13 first-seen novelty of destination IPs and ports per 1-minute window."""
    return round_doubles(novelty_features(_events(spark, sf_dir)))


def q_feature_table(spark, sf_dir):
    """The full filled and clipped feature table (1/5/15 minutes)."""
    return round_doubles(feature_table(_events(spark, sf_dir), DEFAULT_WINDOWS))


# ---------------------------------------------------------------- rules and triage

def _rule_view(scored: DataFrame) -> DataFrame:
    return scored.select("window_start", "baseline_score",
                         F.array_join("triggered_rules", ",").alias("triggered_rules"),
                         F.col("severity").alias("rule_severity"), "rule_count")


def q_rule_scores(spark, sf_dir):
    """A21 with the three default rules over the feature table."""
    ft = feature_table(_events(spark, sf_dir), DEFAULT_WINDOWS)
    return round_doubles(_rule_view(score_rules(ft, DEFAULT_RULES)))


def q_rule_scores_yaml(spark, sf_dir):
    """A21 with the seven rules of the thresholds file (one reads a column no feature makes)."""
    ft = feature_table(_events(spark, sf_dir), DEFAULT_WINDOWS)
    return round_doubles(_rule_view(score_rules(ft, YAML_RULES)))


def q_rule_explanations(spark, sf_dir):
    """Fired rules with each condition's threshold and actual value, one row per condition."""
    ft = feature_table(_events(spark, sf_dir), DEFAULT_WINDOWS)
    ex = explain_rules(ft, DEFAULT_RULES).select("window_start", F.explode("rule_explanations").alias("r"))
    out = ex.select("window_start", "r.rule_name", "r.severity", "r.score_boost",
                    F.explode("r.conditions").alias("c"))
    return round_doubles(out.select("window_start", "rule_name", "severity", "score_boost", "c.field",
                                    "c.operator", "c.threshold", "c.actual_value"))


def _unified_rules_only(spark, sf_dir):
    """M8 with only the rule scorer available (weights renormalised, model scores 0)."""
    ft = feature_table(_events(spark, sf_dir), DEFAULT_WINDOWS)
    weights = normalize_weights(None, {"baseline": True, "lgb": False, "isolation": False})
    scored = score_rules(ft, DEFAULT_RULES, severity_col="rule_severity")
    return blend(scored, weights)


def q_unified_rules_only(spark, sf_dir):
    """Blended score and severity band when only rules are available."""
    u = _unified_rules_only(spark, sf_dir)
    return round_doubles(u.select("window_start", "baseline_score",
                                  F.array_join("triggered_rules", ",").alias("triggered_rules"),
                                  "rule_severity", "lgb_score", "if_score", "anomaly_score", "severity"))


def _top(u, limit, min_score):
    t = top_alerts(u, limit=limit, min_score=min_score)
    return round_doubles(t.select("window_start", "anomaly_score", "severity",
                                  F.array_join("triggered_rules", ",").alias("triggered_rules")))


def q_top_alerts(spark, sf_dir):
    """T2 + F3: alerts with score >= 0.5, highest first, at most 50."""
    return _top(_unified_rules_only(spark, sf_dir), 50, 0.5)


def q_top_alerts_all_scores(spark, sf_dir):
    """T2 with min_score 0: the 50 highest-scoring windows (ties by window start)."""
    return _top(_unified_rules_only(spark, sf_dir), 50, 0.0)


def q_alert_reduction(spark, sf_dir):
    """A23 over the scored windows, plus the A24 count-based ratios."""
    red = alert_reduction(_unified_rules_only(spark, sf_dir), 0.0, 0.5)
    return round_doubles(reduction_from_counts(red, keep=tuple(red.columns)))


# ---------------------------------------------------------------- metrics

def _metrics(spark, sf_dir):
    return metric_input(spark.read.parquet(f"{sf_dir}/events.parquet"))


def q_confusion(spark, sf_dir):
    """A25 confusion counts and ratios at threshold 0.5."""
    return round_doubles(EV.confusion_metrics(_metrics(spark, sf_dir)))


def q_confusion_low_threshold(spark, sf_dir):
    """A25 at threshold 0.1 (more predicted positives)."""
    return round_doubles(EV.confusion_metrics(_metrics(spark, sf_dir), threshold=0.1))


def q_roc_auc(spark, sf_dir):
    """W9 ROC-AUC with tied scores."""
    return round_doubles(EV.roc_auc(_metrics(spark, sf_dir)))


def q_average_precision(spark, sf_dir):
    """W10 average precision (step sum)."""
    return round_doubles(EV.average_precision(_metrics(spark, sf_dir)))


def _fpr(target):
    def q(spark, sf_dir):
        return round_doubles(EV.fpr_at_recall(_metrics(spark, sf_dir), target))
    q.__doc__ = f"W7 FPR at {target:.0%} recall (rows by score desc, id asc)."
    return q


def q_fpr_curve(spark, sf_dir):
    """W8 FPR at 95 % recall from the precision-recall curve thresholds."""
    return round_doubles(EV.fpr_at_recall_curve(_metrics(spark, sf_dir), 0.95))


def q_detection_latency(spark, sf_dir):
    """W6 detection latency in rows over events in time order, threshold 0.5."""
    return round_doubles(EV.detection_latency(_metrics(spark, sf_dir), threshold=0.5))


def q_detection_latency_low(spark, sf_dir):
    """W6 at threshold 0.2 (more detections)."""
    return round_doubles(EV.detection_latency(_metrics(spark, sf_dir), threshold=0.2))


def q_severity_bands(spark, sf_dir):
    """window/event severity, narrative band and class of each score."""
    m = _metrics(spark, sf_dir)
    return round_doubles(m.select("id", "y_score", window_severity("y_score").alias("window_severity"),
                                  event_severity("y_score").alias("event_severity"),
                                  narrative_band("y_score").alias("narrative_band"),
                                  classify("y_score").alias("classification")))


# ---------------------------------------------------------------- profiles, labels, sampling

def q_class_balance(spark, sf_dir):
    """Rows and share per label, imbalance ratio."""
    return round_doubles(PR.class_balance(_events(spark, sf_dir), "label"))


def q_category_means(spark, sf_dir):
    """Feature means per protocol."""
    feats = ["src_port", "dst_port", "bytes_in", "bytes_out", "duration", "label"]
    return round_doubles(PR.category_means(_events(spark, sf_dir), "protocol", feats))


def q_label_correlation(spark, sf_dir):
    """Correlation of each numeric event column with the label, ranked by |r|."""
    ev = _events(spark, sf_dir)
    feats = ["event_id", "src_port", "dst_port", "bytes_in", "bytes_out", "duration"]
    return round_doubles(PR.label_correlation(ev, "label", feats))


def q_null_profile(spark, sf_dir):
    """NULL counts of the joined window table (before the fill)."""
    return PR.null_profile(window_features(_events(spark, sf_dir), DEFAULT_WINDOWS))


def q_window_labels(spark, sf_dir):
    """A11 + J3: window label (any attack in the 60 s window) joined onto the window table."""
    ev = _events(spark, sf_dir)
    wf = window_features(ev, DEFAULT_WINDOWS).select("window_start", "event_count_1min")
    return attach_labels(wf, window_labels(ev, 60))


def _ids(spark, sf_dir):
    return _events(spark, sf_dir).withColumnRenamed("event_id", "id")


def q_stratified_split(spark, sf_dir):
    """Stratified 80/20 split by seeded id hash; rows per (label, split)."""
    sp = SA.stratified_split(_ids(spark, sf_dir), "label", 0.2, "id")
    return sp.groupBy("label", "split").agg(F.count(F.lit(1)).alias("count"))


def q_stratified_sample(spark, sf_dir):
    """Stratified sample of exactly 1000 rows; rows per label."""
    smp = SA.stratified_sample(_ids(spark, sf_dir), 1000, "label", "id")
    return smp.groupBy("label").agg(F.count(F.lit(1)).alias("count"))


def q_class_weight(spark, sf_dir):
    """Weight column negatives/positives for the positive class; rows per (label, weight)."""
    df, _ = SA.class_weight(_events(spark, sf_dir), "label")
    return round_doubles(df.groupBy("label", "weight").agg(F.count(F.lit(1)).alias("count")))


def q_temporal_split(spark, sf_dir):
    """The latest 20 % of events (by time) as test; rows per split."""
    sp = SA.temporal_split(_events(spark, sf_dir), "timestamp", 0.2)
    return sp.groupBy("split").agg(F.count(F.lit(1)).alias("count"))


# ---------------------------------------------------------------- encoding, scaling, explanations

def q_event_level_features(spark, sf_dir):
    """S2 + F5 + F6 + F7: numeric event columns, protocol one-hot and status flag."""
    ev = _events(spark, sf_dir).drop("dst_port")
    return round_doubles(event_level_features(ev, keep=("event_id",)))


def q_standard_scaling(spark, sf_dir):
    """Standard scaling (population std) of the byte and duration columns."""
    ev = _events(spark, sf_dir)
    cols = ["bytes_in", "bytes_out", "duration"]
    scaled = standard_scale(ev, fit_standard_scaler(ev, cols), suffix="_scaled")
    return round_doubles(scaled.select("event_id", *[f"{c}_scaled" for c in cols]))


def q_percentile_sigmoid(spark, sf_dir):
    """batch percentile-centred sigmoid of the scores."""
    out, _ = percentile_sigmoid(_metrics(spark, sf_dir), "y_score", "normalized_score")
    return round_doubles(out.select("id", "normalized_score"))


def q_min_max(spark, sf_dir):
    """batch min-max normalisation of the scores."""
    return round_doubles(min_max(_metrics(spark, sf_dir), "y_score", "minmax_score").select("id", "minmax_score"))


def q_reference_stats(spark, sf_dir):
    """Mean, std and 10/25/50/75/90th percentiles of feature-table columns."""
    ft = feature_table(_events(spark, sf_dir), DEFAULT_WINDOWS)
    return round_doubles(fit_reference_stats(ft, O.EXPLAIN_FEATURES))


def q_explanations(spark, sf_dir):
    """T4 + F25 + F26: per window the 3 features with the largest |standardized deviation| (the
    contribution given to the explainer), their direction and percentile position."""
    feats = O.EXPLAIN_FEATURES
    # values snapped to 9 decimals so that engine-level ulp noise cannot move a value across a
    # breakpoint it equals (the oracle snaps the same way)
    ft = feature_table(_events(spark, sf_dir), DEFAULT_WINDOWS).select(
        "window_start", *[(F.round(F.col(f).cast("double") * 1e9) / 1e9).alias(f) for f in feats])
    stats_df = fit_reference_stats(ft, feats)
    stats = collect_stats(stats_df)
    ms = {r["feature"]: (r["mean"], r["std"]) for r in stats_df.select("feature", "mean", "std").collect()}
    contrib = ft.select("window_start", *feats, *[
        F.coalesce(F.try_divide(F.col(f).cast("double") - F.lit(ms[f][0]), F.lit(ms[f][1])), F.lit(0.0))
        .alias(f"c_{f}") for f in feats])
    ex = explain_top_k(contrib, feats, [f"c_{f}" for f in feats], stats, top_k=3)
    flat = ex.select("window_start", F.posexplode("explanations").alias("pos", "e"))
    return round_doubles(flat.select("window_start", (F.col("pos") + 1).cast("int").alias("rank"), "e.feature",
                                     "e.value", "e.contribution", "e.direction", "e.percentile"))


# ---------------------------------------------------------------- supervised model (rows-only check)

_MODEL_FEATURES = ("src_port", "bytes_in", "bytes_out", "duration", "proto_dns", "proto_http", "proto_https", "proto_smtp",
                   "proto_ssh")


def _model_rows(spark, sf_dir):
    """Event-level features without the columns that give the label away (dst_port, status, event_type)."""
    ev = _events(spark, sf_dir).select("event_id", "label", "src_port", "bytes_in", "bytes_out", "duration", "protocol")
    return event_level_features(ev, ("dns", "http", "https", "smtp", "ssh"), keep=("event_id", "label"))


def q_supervised_event_model(spark, sf_dir):
    """M1 + M2 + P1 + P3 + A25/W9: boosted trees of the default setting on event-level features; stratified 80/20
    split, 15 % of the training rows for early stopping and isotonic calibration; metrics of the test rows."""
    from alertloom.operators import supervised as SU
    rows = _model_rows(spark, sf_dir)
    rows = cut_lineage(spread(rows, rows.count()))  # the split goes over them many times, and a file may have one partition
    sp = SA.train_validation_test(rows, "label", id_col="event_id")
    part = lambda name: sp.where(F.col("split") == name)
    model = SU.fit_supervised(part("train"), _MODEL_FEATURES, "label", "gbt", validation=part("validation"))
    scored = cut_lineage(SU.predict_proba(model, part("test"), "y_score").select(F.col("label").alias("y_true"), "y_score"))
    auc = EV.roc_auc(scored)
    return round_doubles(EV.confusion_metrics(scored).select("*", *[F.lit(v).alias(c) for c, v in auc.first().asDict().items()]))


def q_contribution_invariants(spark, sf_dir):
    """M3: contributions of all events under boosted trees of the default setting; rows, and rows whose base and
    contributions do not add up to the model's own margin."""
    from pyspark.ml.functions import vector_to_array

    from alertloom.operators import supervised as SU
    rows = _model_rows(spark, sf_dir)
    model = SU.fit_supervised(rows, _MODEL_FEATURES, "label", "gbt", calibrate=False)
    con = SU.contributions(model, rows, keep=("event_id",))
    own = model.model.transform(con).withColumn("p", vector_to_array("probability")[1])
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    off = F.abs(F.lit(1.0) / (F.lit(1.0) + F.exp(total * -2.0)) - F.col("p")) > 1e-9
    return own.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(off, 1)).alias("n_off"))


def q_isolation_invariants(spark, sf_dir):
    """M4 + M6 (without LOF) + M7: isolation forest of 100 trees over all events; rows, ids, rows with a score out
    of (0, 1), and rows whose score is not 2^(-mean depth / c(256))."""
    from alertloom.operators import outliers as OU
    rows = _model_rows(spark, sf_dir)
    forest = OU.fit_isolation_forest(rows, _MODEL_FEATURES, id_col="event_id")
    s = OU.isolation_scores(forest, rows, ["event_id"], depth_stats=True)
    c = float(OU.avg_path_length([forest.sample_size])[0])
    off = F.abs(F.pow(F.lit(2.0), -F.col("avg_isolation_depth") / c) - F.col("if_raw")) > 1e-9
    return s.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("event_id").alias("n_ids"),
                 F.count(F.when(~F.col("if_raw").between(0.0, 1.0), 1)).alias("n_out_of_range"), F.count(F.when(off, 1)).alias("n_off"))


def q_top_anomalies(spark, sf_dir):
    """T3 + M6: the 50 events with the highest isolation score: their number, their ids, and the events outside
    them with a higher score than the least of them."""
    from alertloom.operators import outliers as OU
    rows = cut_lineage(_model_rows(spark, sf_dir))
    forest = OU.fit_isolation_forest(rows, _MODEL_FEATURES, id_col="event_id")
    scored = cut_lineage(OU.score_outliers(forest, rows, ["event_id"]))
    top = OU.top_anomalies(scored, 50)
    least = top.agg(F.min("if_score")).first()[0]
    higher = scored.where(F.col("if_score") > least).join(F.broadcast(top.select("event_id")), "event_id", "left_anti")
    return top.agg(F.count(F.lit(1)).alias("n_top"), F.countDistinct("event_id").alias("n_ids"),
                   F.lit(higher.count()).alias("n_missed"))


# ---------------------------------------------------------------- neighbours, streams, declared features

def q_knn_embeddings(spark, sf_dir):
    """The 20 nearest other vectors of every distinct vector."""
    from alertloom.operators import neighbors as NB
    points = NB.distinct_points(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", "vec_id")
    return round_doubles(NB.knn_join(points, None, 20).select(F.col("pid").alias("vec_id"), "rank", F.col("nid").alias("neighbor_id"), "distance"))


def q_lof_embeddings(spark, sf_dir):
    """M5: local outlier factor of every vector among all, 20 neighbours."""
    from alertloom.operators import neighbors as NB
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return round_doubles(NB.training_factors(NB.fit_lof(e, "embedding", 20, id_col="vec_id"), e, "vec_id"))


# ---------------------------------------------------------------- unified scores, comparison, categories, flow tables

EVENT_RULES = RuleSet([Rule("large_in", "Much data received", (Condition("bytes_in", ">", 2000),), "high", 0.3),
                       Rule("large_out", "Much data sent over a long time", (Condition("bytes_out", ">", 20000), Condition("duration", ">=", 2)), "critical", 0.5),
                       Rule("low_port", "Low source port", (Condition("src_port", "<", 5000),), "medium", 0.4)],
                      {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.2})


def _unified_events(spark, sf_dir):
    """M8 over all events: rules that fire, and two given score columns, blended with all three weights."""
    from alertloom.operators.unified import UnifiedScorer
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    given = ev.select("event_id", (F.col("value") / 600.0).alias("lgb_score"), (F.get_json_object("props", "$.k").cast("int") / 100.0).alias("if_score"))
    rows = _events(spark, sf_dir).select("event_id", "bytes_in", "bytes_out", "duration", "src_port").join(given, "event_id")
    return UnifiedScorer(EVENT_RULES).score(rows, given=("lgb_score", "if_score"))


def q_unified_event_scores(spark, sf_dir):
    """Rules, two score columns, blended score and severity of every event."""
    u = _unified_events(spark, sf_dir)
    return round_doubles(u.select("event_id", "baseline_score", F.array_join("triggered_rules", ",").alias("triggered_rules"), "rule_severity", "rule_count",
                                  "lgb_score", "if_score", "anomaly_score", "severity"))


def q_unified_event_alerts(spark, sf_dir):
    """T2 + F3: the 50 events of the highest blended score of at least 0.5, ties by id."""
    return round_doubles(top_alerts(_unified_events(spark, sf_dir), 50, 0.5, tie_col="event_id").select("event_id", "anomaly_score"))


def q_unified_event_models(spark, sf_dir):
    """M8 with models: rules, logistic regression and an isolation forest fitted on the training split, scores of all events."""
    from alertloom.operators.unified import fit_unified
    rows = cut_lineage(_model_rows(spark, sf_dir))
    train = SA.train_validation_test(rows, "label", id_col="event_id").where("split = 'train'").drop("split")
    scorer = fit_unified(train, _MODEL_FEATURES, rules=EVENT_RULES, kind="lr")
    return round_doubles(scorer.score(rows).select("event_id", "baseline_score", "lgb_score", "if_score", "anomaly_score", "severity"))


def _predictions(spark, sf_dir):
    """Scores of three models, written in one table: (model, y_true, y_score)."""
    m = metric_input(spark.read.parquet(f"{sf_dir}/events.parquet"))
    scores = {"linear": F.col("y_score"), "root": F.sqrt("y_score"), "turned": F.lit(1.0) - F.col("y_score")}
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), v.alias("y_score")) for k, v in scores.items()])).alias("p")
    return m.select("y_true", made).select("p.model", "y_true", "p.y_score")


def q_grouped_metrics(spark, sf_dir):
    """Confusion metrics of three models' predictions, a row per model."""
    from alertloom.operators.selection import grouped_metrics
    return round_doubles(grouped_metrics(_predictions(spark, sf_dir), threshold=0.3))


def q_best_models(spark, sf_dir):
    """The models of the best F1 and recall and of the least false positive rate."""
    from alertloom.operators.selection import best_models, grouped_metrics
    return best_models(grouped_metrics(_predictions(spark, sf_dir), threshold=0.3), ("f1", "recall"), ("fpr",))


def _categories(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    guess = F.when(k % 5 == 0, "error").when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, "other").otherwise(F.col("event_type"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("a"), guess.alias("b"))


def q_category_confusion(spark, sf_dir):
    """Confusion matrix of predicted event types."""
    from alertloom.operators.multiclass import confusion_matrix
    return confusion_matrix(_categories(spark, sf_dir), "a", "b")


def q_category_metrics(spark, sf_dir):
    """Support, precision, recall and F1 of each class of predicted event types."""
    from alertloom.operators.multiclass import class_metrics, confusion_matrix
    return round_doubles(class_metrics(confusion_matrix(_categories(spark, sf_dir), "a", "b")))


def _flow_file(spark, sf_dir):
    """A flow table written as CSV from the events; its path."""
    from alertloom.sources.flows import write_csv
    k, v = F.get_json_object("props", "$.k").cast("int"), F.col("value")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("id"), F.when(k % 10 != 0, v / 50.0).alias("dur"), k.alias("Spkts"), (k * 2).alias("Dpkts"), (v * (k + 1)).alias("sbytes"),
        (v * 10.0).alias("dbytes"), F.when(k % 3 == 0, "tcp").when(k % 3 == 1, "udp").alias("proto"),
        F.when(k % 4 == 0, "FIN").when(k % 4 == 1, "INT").otherwise("CON").alias("state"),
        F.when((F.col("event_type") == "error") & (k >= 50), 1).otherwise(0).alias("Label"))
    return write_csv(rows, checkpoint_dir(spark))


def q_flow_features(spark, sf_dir):
    """S5 + S6: features and label of a flow CSV, told by its header."""
    from alertloom.sources.flows import load_table
    return round_doubles(load_table(spark, _flow_file(spark, sf_dir)))


def q_flow_renamed(spark, sf_dir):
    """S3: a flow CSV under the event schema's names."""
    from alertloom.sources.flows import read_flow_csv, renamed_flows
    return round_doubles(renamed_flows(read_flow_csv(spark, _flow_file(spark, sf_dir))))


STREAM_WINDOW, STREAM_DELAY = WindowSpec("1h", 3600), "10 minutes"


def _event_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern, as a stream's path that is none must be a folder.
    return events_from_table(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"))


def q_stream_window_features(spark, sf_dir):
    """X1 + X2 + X3: hourly features of the event stream, all windows that the watermark has passed."""
    from alertloom.streaming.windows import run_to_end, stream_window_features
    return round_doubles(run_to_end(stream_window_features(_event_stream(spark, sf_dir), STREAM_WINDOW, STREAM_DELAY), "windows"))


def _stream_folder(spark, name):
    import uuid
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_stream_novelty(spark, sf_dir):
    """First-seen novelty of the event stream, all windows that the watermark has passed."""
    from alertloom.streaming.stateful import stream_novelty
    return round_doubles(stream_novelty(_event_stream(spark, sf_dir), _stream_folder(spark, "novelty"), STREAM_DELAY))


#: A feature of every declared kind.
DECLARED_FEATURES = """
windows: [{name: 1h, duration_seconds: 3600}]
window_features:
  - {name: event_count, type: count}
  - {name: failed_count, type: count, filter: "status == 'failed'"}
  - {name: unique_dst_ips, type: cardinality, field: dst_ip}
  - {name: unique_dst_ports, type: cardinality, field: dst_port}
  - {name: port_entropy, type: entropy, field: dst_port}
  - {name: failed_auth_ratio, type: ratio, numerator_filter: "status == 'failed'", denominator_filter: "event_type == 'auth'"}
  - {name: bytes_in_mean, type: mean, field: bytes_in}
  - {name: bytes_in_std, type: std, field: bytes_in}
  - {name: bytes_out_sum, type: sum, field: bytes_out}
  - {name: duration_p50, type: percentile, field: duration, percentile: 50}
  - {name: duration_p95, type: percentile, field: duration, percentile: 95}
  - {name: inter_arrival_cv, type: coefficient_of_variation, field: inter_arrival_time}
  - {name: new_dst_ip_ratio, type: novelty_ratio, field: dst_ip}
  - {name: returning_dst_ip_ratio, type: novelty_ratio, field: dst_ip, lookback_windows: 10}
protocol_features:
  - {name: dns_ratio, type: ratio, filter: "protocol == 'dns'"}
  - {name: slow_dns_ratio, type: ratio, numerator_filter: "protocol == 'dns' and duration >= 5", denominator_filter: "protocol == 'dns'"}
entity_features:
  - {name: event_rate, type: rolling_mean, field: event_count, lookback_windows: 24}
  - {name: event_zscore, type: zscore, field: event_count, lookback_windows: 48}
  - {name: port_diversity_change, type: delta, field: unique_dst_ports, lookback_windows: 5}
derived_features:
  - {name: bytes_ratio, formula: "bytes_out_sum / (bytes_in_mean + 1)"}
  - {name: spread_indicator, formula: "(unique_dst_ips > 10) & (event_count < 40)"}
"""


def q_declared_features(spark, sf_dir):
    """A16 + W11: hourly features of a declared specification."""
    from alertloom.operators import featurespec as FS
    ev = _events(spark, sf_dir)
    spec = FS.compile_spec(FS.load_spec(DECLARED_FEATURES), ev)
    return round_doubles(FS.apply_spec(spec, ev, spec.windows[0]))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "window_features": q_window_features,
    "window_features_large": q_window_features_large,
    "rolling_baseline": q_rolling_baseline,
    "novelty": q_novelty,
    "feature_table": q_feature_table,
    "rule_scores": q_rule_scores,
    "rule_scores_yaml": q_rule_scores_yaml,
    "rule_explanations": q_rule_explanations,
    "unified_rules_only": q_unified_rules_only,
    "top_alerts": q_top_alerts,
    "top_alerts_all_scores": q_top_alerts_all_scores,
    "alert_reduction": q_alert_reduction,
    "confusion": q_confusion,
    "confusion_low_threshold": q_confusion_low_threshold,
    "roc_auc": q_roc_auc,
    "average_precision": q_average_precision,
    "fpr_at_90_recall": _fpr(0.90),
    "fpr_at_95_recall": _fpr(0.95),
    "fpr_at_99_recall": _fpr(0.99),
    "fpr_at_95_recall_curve": q_fpr_curve,
    "detection_latency": q_detection_latency,
    "detection_latency_low": q_detection_latency_low,
    "severity_bands": q_severity_bands,
    "class_balance": q_class_balance,
    "category_means": q_category_means,
    "label_correlation": q_label_correlation,
    "null_profile": q_null_profile,
    "window_labels": q_window_labels,
    "stratified_split": q_stratified_split,
    "stratified_sample": q_stratified_sample,
    "class_weight": q_class_weight,
    "temporal_split": q_temporal_split,
    "event_level_features": q_event_level_features,
    "standard_scaling": q_standard_scaling,
    "percentile_sigmoid": q_percentile_sigmoid,
    "min_max": q_min_max,
    "reference_stats": q_reference_stats,
    "explanations": q_explanations,
    "supervised_event_model": q_supervised_event_model,
    "contribution_invariants": q_contribution_invariants,
    "isolation_invariants": q_isolation_invariants,
    "top_anomalies": q_top_anomalies,
    "knn_embeddings": q_knn_embeddings,
    "lof_embeddings": q_lof_embeddings,
    "stream_window_features": q_stream_window_features,
    "stream_novelty": q_stream_novelty,
    "declared_features": q_declared_features,
    "unified_event_scores": q_unified_event_scores,
    "unified_event_alerts": q_unified_event_alerts,
    "unified_event_models": q_unified_event_models,
    "grouped_metrics": q_grouped_metrics,
    "best_models": q_best_models,
    "category_confusion": q_category_confusion,
    "category_metrics": q_category_metrics,
    "flow_features": q_flow_features,
    "flow_renamed": q_flow_renamed,
}

_ORACLES: dict[str, Callable[[], str]] = {
    "window_features": lambda: O.window_features_sql(DEFAULT_WINDOWS),
    "window_features_large": lambda: O.window_features_sql(LARGE_WINDOWS),
    "rolling_baseline": lambda: O.rolling_sql(DEFAULT_WINDOWS),
    "novelty": O.novelty_sql,
    "feature_table": lambda: O.feature_table_sql(DEFAULT_WINDOWS),
    "rule_scores": lambda: O.rules_sql(DEFAULT_RULES),
    "rule_scores_yaml": lambda: O.rules_sql(YAML_RULES),
    "rule_explanations": lambda: O.rule_explanations_sql(DEFAULT_RULES),
    "unified_rules_only": O.unified_rules_only_sql,
    "top_alerts": lambda: O.top_alerts_sql(50, 0.5),
    "top_alerts_all_scores": lambda: O.top_alerts_sql(50, 0.0),
    "alert_reduction": O.alert_reduction_sql,
    "confusion": lambda: O.confusion_sql(0.5),
    "confusion_low_threshold": lambda: O.confusion_sql(0.1),
    "roc_auc": O.roc_auc_sql,
    "average_precision": O.average_precision_sql,
    "fpr_at_90_recall": lambda: O.fpr_at_recall_sql(0.90),
    "fpr_at_95_recall": lambda: O.fpr_at_recall_sql(0.95),
    "fpr_at_99_recall": lambda: O.fpr_at_recall_sql(0.99),
    "fpr_at_95_recall_curve": lambda: O.fpr_curve_sql(0.95),
    "detection_latency": lambda: O.detection_latency_sql(0.5),
    "detection_latency_low": lambda: O.detection_latency_sql(0.2),
    "severity_bands": O.bands_sql,
    "class_balance": O.class_balance_sql,
    "category_means": O.category_means_sql,
    "label_correlation": O.label_correlation_sql,
    "null_profile": O.null_profile_sql,
    "window_labels": O.window_labels_sql,
    "stratified_split": lambda: O.split_counts_sql(0.2),
    "stratified_sample": lambda: O.sample_counts_sql(1000),
    "class_weight": O.class_weight_sql,
    "temporal_split": lambda: O.temporal_split_sql(0.2),
    "event_level_features": O.event_level_sql,
    "standard_scaling": O.standard_scaling_sql,
    "percentile_sigmoid": O.percentile_sigmoid_sql,
    "min_max": O.min_max_sql,
    "reference_stats": O.reference_stats_sql,
    "explanations": O.explanations_sql,
    "contribution_invariants": lambda: "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_off FROM events",
    "isolation_invariants": lambda: "SELECT count(*) AS n_rows, count(DISTINCT event_id) AS n_ids, CAST(0 AS BIGINT) AS "
                                    "n_out_of_range, CAST(0 AS BIGINT) AS n_off FROM events",
    "top_anomalies": lambda: "SELECT least(count(*), 50) AS n_top, least(count(DISTINCT event_id), 50) AS n_ids, "
                             "CAST(0 AS BIGINT) AS n_missed FROM events",
    "knn_embeddings": O.knn_sql,
    "lof_embeddings": O.lof_sql,
    "stream_window_features": lambda: O.stream_windows_sql(STREAM_WINDOW, STREAM_DELAY),
    "stream_novelty": lambda: O.stream_novelty_sql(STREAM_DELAY),
    "declared_features": O.declared_features_sql,
    "unified_event_scores": O.unified_events_sql,
    "unified_event_alerts": lambda: O.unified_event_alerts_sql(50, 0.5),
    "grouped_metrics": O.grouped_metrics_sql,
    "best_models": O.best_models_sql,
    "category_confusion": O.category_confusion_sql,
    "category_metrics": O.category_metrics_sql,
    "flow_features": O.flow_features_sql,
    "flow_renamed": O.flow_renamed_sql,
}

# Training-data operators and their pipeline: registered if they and what they need are there.
try:
    from alertloom.llm.queries import ORACLES as _LLM_ORACLES
    from alertloom.llm.queries import QUERIES as _LLM_QUERIES
except ImportError:
    _LLM_QUERIES = _LLM_ORACLES = {}
_QUERIES.update(_LLM_QUERIES)
_ORACLES.update({name: (lambda sql=sql: sql) for name, sql in _LLM_ORACLES.items()})
try:
    import corpus_pipeline
except ImportError:
    corpus_pipeline = None
if corpus_pipeline:
    _QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        _ORACLES["pipeline"] = lambda: corpus_pipeline.ORACLE_SQL


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the feature table of the sf0.001 events."""
    return q_feature_table(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: f() for k, f in _ORACLES.items()}
