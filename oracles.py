"""DuckDB oracle SQL for the registered queries (``__spark_entry__.oracle_sql``).

Written independently of the Spark code: plain set-based SQL over the pre-registered views,
with sequential constructs (lag, running sums, ROWS frames) where the definition is sequential.
Every DOUBLE output is rounded to 6 decimals, as the Spark side does.
"""

from __future__ import annotations

from alertloom.config import (CARDINALITY_COLUMNS, DEFAULT_RULES, DEFAULT_WINDOWS, LARGE_WINDOWS,
                              PROTOCOL_SHARES, RuleSet, WindowSpec)
from alertloom.sources.events import EVENTS_DUCKDB_CTE

R = 6


def _r(expr: str) -> str:
    # round to 9 decimals first (summation-order noise), then to R: same doubles as the Spark side
    return f"round(round({expr}, 9), {R})"


# --------------------------------------------------------------------------------------
# window features (A1-A10 + J1)
# --------------------------------------------------------------------------------------

def _per_size_sql(w: WindowSpec) -> str:
    us = w.seconds * 1_000_000
    cats = "\n      UNION ALL ".join(
        f"SELECT ws, '{c}' AS cn, CAST(\"{c}\" AS VARCHAR) AS v FROM b{w.name} WHERE \"{c}\" IS NOT NULL"
        for c in CARDINALITY_COLUMNS)
    return f"""
b{w.name} AS (SELECT *, us - (us % {us}) AS ws FROM b),
g{w.name} AS (SELECT ws, stddev_samp(gap) AS gstd FROM (
      SELECT ws, (us - lag(us) OVER (PARTITION BY ws ORDER BY us)) / 1e6 AS gap FROM b{w.name}) GROUP BY ws),
v{w.name} AS (SELECT ws, cn, v, count(*) AS c FROM (
      {cats}) GROUP BY ALL),
c{w.name} AS (SELECT ws,
      {", ".join(f"count(*) FILTER (WHERE cn = '{c}') AS d_{c}" for c in CARDINALITY_COLUMNS)},
      log2(sum(c) FILTER (WHERE cn = 'dst_port')) - sum(c * log2(c)) FILTER (WHERE cn = 'dst_port')
          / sum(c) FILTER (WHERE cn = 'dst_port') AS ent_port,
      log2(sum(c) FILTER (WHERE cn = 'src_ip')) - sum(c * log2(c)) FILTER (WHERE cn = 'src_ip')
          / sum(c) FILTER (WHERE cn = 'src_ip') AS ent_src
    FROM v{w.name} GROUP BY ws),
a{w.name} AS (SELECT ws, count(*) AS n, min(us) AS tmin, max(us) AS tmax,
      avg(bytes_in) AS bi_mean, CASE WHEN count(bytes_in) > 1 THEN stddev_samp(bytes_in)
                                     WHEN count(bytes_in) = 1 THEN 0.0 END AS bi_std, sum(bytes_in) AS bi_sum,
      avg(bytes_out) AS bo_mean, CASE WHEN count(bytes_out) > 1 THEN stddev_samp(bytes_out)
                                      WHEN count(bytes_out) = 1 THEN 0.0 END AS bo_std, sum(bytes_out) AS bo_sum,
      quantile_cont(duration, 0.5) AS p50, quantile_cont(duration, 0.95) AS p95,
      count(*) FILTER (WHERE event_type = 'auth') AS n_auth,
      count(*) FILTER (WHERE event_type = 'auth' AND status = 'failed') AS n_fail,
      {", ".join(f"count(*) FILTER (WHERE protocol = '{p}') AS pr_{p}" for p in PROTOCOL_SHARES)}
    FROM b{w.name} GROUP BY ws),
f{w.name} AS (SELECT a.ws,
      a.n AS event_count_{w.name},
      {", ".join(f"coalesce(c.d_{c}, 0) AS unique_{c}s_{w.name}" for c in CARDINALITY_COLUMNS)},
      coalesce(c.ent_port, 0.0) AS port_entropy_{w.name}, coalesce(c.ent_src, 0.0) AS src_ip_entropy_{w.name},
      bi_mean AS bytes_in_mean_{w.name}, bi_std AS bytes_in_std_{w.name}, bi_sum AS bytes_in_sum_{w.name},
      bo_mean AS bytes_out_mean_{w.name}, bo_std AS bytes_out_std_{w.name}, bo_sum AS bytes_out_sum_{w.name},
      p50 AS conn_duration_p50_{w.name}, p95 AS conn_duration_p95_{w.name},
      CASE WHEN n_auth > 0 THEN n_fail / n_auth ELSE 0.0 END AS failed_auth_ratio_{w.name},
      CASE WHEN n > 1 AND (tmax - tmin) > 0 THEN (tmax - tmin) / 1e6 / (n - 1) END AS inter_arrival_mean_{w.name},
      CASE WHEN n > 1 AND (tmax - tmin) > 0 THEN g.gstd / ((tmax - tmin) / 1e6 / (n - 1)) END
          AS inter_arrival_cv_{w.name},
      {", ".join(f"pr_{p} / n AS {p}_ratio_{w.name}" for p in PROTOCOL_SHARES)}
    FROM a{w.name} a LEFT JOIN c{w.name} c USING (ws) LEFT JOIN g{w.name} g USING (ws))"""


def window_feature_names(windows) -> list[tuple[str, str]]:
    """(name, kind) with kind 'i' for integers and 'd' for doubles."""
    out = []
    for w in windows:
        s = w.name
        out.append((f"event_count_{s}", "i"))
        out += [(f"unique_{c}s_{s}", "i") for c in CARDINALITY_COLUMNS]
        out += [(f"port_entropy_{s}", "d"), (f"src_ip_entropy_{s}", "d")]
        for b in ("bytes_in", "bytes_out"):
            out += [(f"{b}_mean_{s}", "d"), (f"{b}_std_{s}", "d"), (f"{b}_sum_{s}", "d")]
        out += [(f"conn_duration_p50_{s}", "d"), (f"conn_duration_p95_{s}", "d"),
                (f"failed_auth_ratio_{s}", "d"), (f"inter_arrival_mean_{s}", "d"),
                (f"inter_arrival_cv_{s}", "d")]
        out += [(f"{p}_ratio_{s}", "d") for p in PROTOCOL_SHARES]
    return out


def window_ctes(windows) -> str:
    """CTEs ending in ``wf(ws, <features>)``: the outer-joined per-size tables."""
    parts = [EVENTS_DUCKDB_CTE.strip(),
             'b AS (SELECT *, epoch_us("timestamp") AS us FROM ev WHERE "timestamp" IS NOT NULL)']
    parts += [_per_size_sql(w).strip() for w in windows]
    keys = " UNION ".join(f"SELECT ws FROM f{w.name}" for w in windows)
    cols = []
    for w in windows:
        cols += [f"f{w.name}.{n}" for n, _ in window_feature_names([w])]
    joins = " ".join(f"LEFT JOIN f{w.name} USING (ws)" for w in windows)
    parts.append(f"wf AS (SELECT k.ws, {', '.join(cols)} FROM ({keys}) k {joins})")
    return "WITH " + ",\n".join(parts)


def _final_select(names: list[tuple[str, str]], src: str = "wf") -> str:
    cols = [_r(n) + f" AS {n}" if k == "d" else n for n, k in names]
    return f"SELECT make_timestamp(ws) AS window_start, {', '.join(cols)} FROM {src}"


def window_features_sql(windows=DEFAULT_WINDOWS) -> str:
    return window_ctes(windows) + "\n" + _final_select(window_feature_names(windows))


# --------------------------------------------------------------------------------------
# rolling baseline (W1-W4), novelty (A13), derived + fill + clip
# --------------------------------------------------------------------------------------

def _rolling_cols(windows, lookback: int = 60) -> tuple[str, list[tuple[str, str]]]:
    exprs, names = [], []
    frame = f"OVER (ORDER BY ws ROWS BETWEEN {lookback - 1} PRECEDING AND CURRENT ROW)"
    for w in windows:
        c = f"event_count_{w.name}"
        mean = f"avg({c}) {frame}"
        std = f"coalesce(stddev_samp({c}) {frame}, 1.0)"
        exprs += [f"{mean} AS baseline_mean_{w.name}", f"{std} AS baseline_std_{w.name}",
                  f"({c} - {mean}) / greatest({std}, 0.1) AS baseline_deviation_{w.name}",
                  f"coalesce({c} / lag({c}) OVER (ORDER BY ws) - 1, 0.0) AS rate_change_{w.name}"]
        names += [(f"baseline_mean_{w.name}", "d"), (f"baseline_std_{w.name}", "d"),
                  (f"baseline_deviation_{w.name}", "d"), (f"rate_change_{w.name}", "d")]
    return ", ".join(exprs), names


def rolling_sql(windows=DEFAULT_WINDOWS) -> str:
    exprs, names = _rolling_cols(windows)
    counts = [(f"event_count_{w.name}", "i") for w in windows]
    return (window_ctes(windows) + f",\nrb AS (SELECT ws, {', '.join(n for n, _ in counts)}, {exprs} FROM wf)\n"
            + _final_select(counts + names, "rb"))


NOVELTY_CTE = """
ne AS (SELECT DISTINCT us - (us % 60000000) AS ws, 'dst_ip' AS et, dst_ip AS ent FROM b WHERE dst_ip IS NOT NULL
       UNION SELECT DISTINCT us - (us % 60000000), 'dst_port', CAST(dst_port AS VARCHAR) FROM b WHERE dst_port IS NOT NULL),
nf AS (SELECT et, ent, min(ws) AS first_ws FROM ne GROUP BY ALL),
nt AS (SELECT ne.ws, ne.et, count(*) AS tot, count(*) FILTER (WHERE nf.first_ws = ne.ws) AS nnew
       FROM ne JOIN nf USING (et, ent) GROUP BY ALL),
nov AS (SELECT ws,
       max(CASE WHEN et = 'dst_ip' THEN nnew / tot END) AS new_dst_ip_ratio_1min,
       max(CASE WHEN et = 'dst_ip' THEN nnew END) AS new_dst_ip_count_1min,
       max(CASE WHEN et = 'dst_port' THEN nnew / tot END) AS new_dst_port_ratio_1min,
       max(CASE WHEN et = 'dst_port' THEN nnew END) AS new_dst_port_count_1min
       FROM nt GROUP BY ws)"""

NOVELTY_NAMES = [("new_dst_ip_ratio_1min", "d"), ("new_dst_ip_count_1min", "i"),
                 ("new_dst_port_ratio_1min", "d"), ("new_dst_port_count_1min", "i")]


def novelty_sql() -> str:
    return ("WITH " + EVENTS_DUCKDB_CTE.strip() + ",\n"
            + 'b AS (SELECT *, epoch_us("timestamp") AS us FROM ev WHERE "timestamp" IS NOT NULL),'
            + NOVELTY_CTE + "\n" + _final_select(NOVELTY_NAMES, "nov"))


def feature_table_names(windows=DEFAULT_WINDOWS) -> list[tuple[str, str]]:
    names = window_feature_names(windows) + _rolling_cols(windows)[1] + NOVELTY_NAMES
    sfx = {w.name for w in windows}
    names += [(f"bytes_ratio_{s}", "d") for s in ("1min", "5min", "15min") if s in sfx]
    names += [(f"port_scan_indicator_{s}", "n") for s in ("1min", "5min") if s in sfx]
    names += [(f"high_entropy_{s}", "n") for s in ("1min", "5min") if s in sfx]
    return names


def feature_table_ctes(windows=DEFAULT_WINDOWS) -> str:
    """CTEs ending in ``ft``: the full filled and clipped feature table."""
    exprs, _ = _rolling_cols(windows)
    sfx = {w.name for w in windows}
    derived = []
    derived += [f"bytes_out_mean_{s} / (bytes_in_mean_{s} + 1) AS bytes_ratio_{s}"
                for s in ("1min", "5min", "15min") if s in sfx]
    derived += [f"CAST(coalesce(unique_dst_ports_{s} > 50 AND unique_dst_ips_{s} < 5, false) AS INTEGER)"
                f" AS port_scan_indicator_{s}" for s in ("1min", "5min") if s in sfx]
    derived += [f"CAST(coalesce(port_entropy_{s} > 4.0, false) AS INTEGER) AS high_entropy_{s}"
                for s in ("1min", "5min") if s in sfx]
    names = feature_table_names(windows)
    filled = []
    for n, _ in names:
        e = f"coalesce({n}, 0)"
        if "ratio" in n.lower():
            e = f"least(greatest({e}, 0), 1)"
        filled.append(f"{e} AS {n}")
    return (window_ctes(windows) + ",\n" + NOVELTY_CTE.strip() + ",\n"
            + f"rb AS (SELECT wf.*, {exprs} FROM wf),\n"
            + "rn AS (SELECT rb.*, nov.* EXCLUDE (ws) FROM rb LEFT JOIN nov USING (ws)),\n"
            + f"rd AS (SELECT rn.*, {', '.join(derived)} FROM rn),\n"
            + f"ft AS (SELECT ws, {', '.join(filled)} FROM rd)")


def feature_table_sql(windows=DEFAULT_WINDOWS) -> str:
    return feature_table_ctes(windows) + "\n" + _final_select(feature_table_names(windows), "ft")


# --------------------------------------------------------------------------------------
# rules (A21, A22), bands (F13), alert triage
# --------------------------------------------------------------------------------------

def _cond_sql(c) -> str:
    if c.operator not in (">", ">=", "<", "<=", "==", "!="):
        return "true"
    op = {"==": "=", "!=": "<>"}.get(c.operator, c.operator)
    return f"coalesce({c.field} {op} {float(c.value)!r}, false)"


def _rule_sql(rule, available: set[str]) -> str:
    if any(c.field not in available for c in rule.conditions):
        return "false"
    if not rule.conditions:
        return "true"
    return " AND ".join(_cond_sql(c) for c in rule.conditions)


def rule_columns_sql(rules: RuleSet, available: set[str]) -> str:
    """Projection list adding baseline_score, triggered_rules (as text), rule_severity, rule_count."""
    hits = [(r, f"({_rule_sql(r, available)})") for r in rules.rules]
    score = " + ".join(f"CASE WHEN {h} THEN {r.score_boost!r} ELSE 0.0 END" for r, h in hits) or "0.0"
    trig = ("array_to_string(list_filter([" + ", ".join(f"CASE WHEN {h} THEN '{r.name}' END" for r, h in hits)
            + "], lambda x: x IS NOT NULL), ',')") if hits else "''"
    cnt = " + ".join(f"CASE WHEN {h} THEN 1 ELSE 0 END" for _, h in hits) or "0"
    # max severity: strictly greater weight wins, so among equal weights the first rule wins
    sev = "'none'"
    best = "0.0"
    weights = rules.severity_weights
    for r, h in hits:
        wgt = float(weights.get(r.severity, 0))
        sev = f"CASE WHEN {h} AND {wgt!r} > ({best}) THEN '{r.severity}' ELSE {sev} END"
        best = f"CASE WHEN {h} AND {wgt!r} > ({best}) THEN {wgt!r} ELSE {best} END"
    return (f"{_r('least(' + score + ', 1.0)')} AS baseline_score, {trig} AS triggered_rules, "
            f"{sev} AS rule_severity, CAST({cnt} AS INTEGER) AS rule_count")


def rule_scores_sql(rules: RuleSet = DEFAULT_RULES, windows=DEFAULT_WINDOWS) -> str:
    available = {n for n, _ in feature_table_names(windows)}
    return (feature_table_ctes(windows) + "\n"
            + f"SELECT make_timestamp(ws) AS window_start, {rule_columns_sql(rules, available)} FROM ft")


def severity_sql(expr: str, bands) -> str:
    parts = []
    for bound, label in bands:
        if bound is None:
            parts.append(f"ELSE '{label}'")
        else:
            parts.append(f"WHEN {expr} >= {bound!r} THEN '{label}'")
    return "CASE " + " ".join(parts) + " END"


def rule_columns_sql2(rules: RuleSet, available: set[str]) -> str:
    """Like :func:`rule_columns_sql`, max severity by the largest fired weight (first of equals)."""
    hits = [(r, f"({_rule_sql(r, available)})") for r in rules.rules]
    score = " + ".join(f"CASE WHEN {h} THEN {r.score_boost!r} ELSE 0.0 END" for r, h in hits) or "0.0"
    trig = ("array_to_string(list_filter([" + ", ".join(f"CASE WHEN {h} THEN '{r.name}' END" for r, h in hits)
            + "], lambda x: x IS NOT NULL), ',')") if hits else "''"
    cnt = " + ".join(f"CASE WHEN {h} THEN 1 ELSE 0 END" for _, h in hits) or "0"
    wts = {r.name: float(rules.severity_weights.get(r.severity, 0)) for r, _ in hits}
    best = "greatest(" + ", ".join([f"CASE WHEN {h} THEN {wts[r.name]!r} END" for r, h in hits] + ["0.0"]) + ")"
    sev = ("coalesce(" + ", ".join(f"CASE WHEN {h} AND {wts[r.name]!r} = {best} AND {best} > 0 THEN '{r.severity}' END"
                                   for r, h in hits) + ", 'none')")
    return (f"{_r('least(' + score + ', 1.0)')} AS baseline_score, {trig} AS triggered_rules, "
            f"{sev} AS rule_severity, CAST({cnt} AS INTEGER) AS rule_count")


def rules_sql(rules: RuleSet, windows=DEFAULT_WINDOWS) -> str:
    available = {n for n, _ in feature_table_names(windows)}
    return (feature_table_ctes(windows) + "\n"
            + f"SELECT make_timestamp(ws) AS window_start, {rule_columns_sql2(rules, available)} FROM ft")


def rule_explanations_sql(rules: RuleSet, windows=DEFAULT_WINDOWS) -> str:
    available = {n for n, _ in feature_table_names(windows)}
    rows = []
    for r in rules.rules:
        hit = _rule_sql(r, available)
        for c in r.conditions:
            if c.field not in available:
                continue
            rows.append(f"SELECT make_timestamp(ws) AS window_start, '{r.name}' AS rule_name, "
                        f"'{r.severity}' AS severity, {float(r.score_boost)!r} AS score_boost, '{c.field}' AS field, "
                        f"'{c.operator}' AS operator, {float(c.value)!r} AS threshold, "
                        f"{_r(f'CAST({c.field} AS DOUBLE)')} AS actual_value FROM ft WHERE {hit}")
    return feature_table_ctes(windows) + "\n" + "\nUNION ALL\n".join(rows)


def _unified_rules_only_cte(rules: RuleSet, windows=DEFAULT_WINDOWS, bands=None) -> str:
    from alertloom.config import WINDOW_SEVERITY_BANDS
    available = {n for n, _ in feature_table_names(windows)}
    # only the rule scorer is available: weights are divided by the baseline weight
    wb = 0.2 / 0.2
    return (feature_table_ctes(windows) + ",\n"
            + f"rs AS (SELECT ws, {rule_columns_sql2(rules, available)} FROM ft),\n"
            + f"us AS (SELECT ws, baseline_score, triggered_rules, rule_severity, 0.0 AS lgb_score, 0.0 AS if_score, "
            + f"least(greatest({wb!r} * baseline_score, 0.0), 1.0) AS anomaly_score FROM rs),\n"
            + f"sc AS (SELECT *, {severity_sql('anomaly_score', bands or WINDOW_SEVERITY_BANDS)} AS severity FROM us)")


def unified_rules_only_sql(rules: RuleSet = DEFAULT_RULES) -> str:
    return (_unified_rules_only_cte(rules) + "\nSELECT make_timestamp(ws) AS window_start, baseline_score, "
            "triggered_rules, rule_severity, lgb_score, if_score, round(round(anomaly_score, 9), 6) AS anomaly_score, severity FROM sc")


def top_alerts_sql(limit: int = 50, min_score: float = 0.5, rules: RuleSet = DEFAULT_RULES) -> str:
    return (_unified_rules_only_cte(rules) + "\nSELECT make_timestamp(ws) AS window_start, "
            "round(round(anomaly_score, 9), 6) AS anomaly_score, severity, triggered_rules FROM sc "
            f"WHERE anomaly_score >= {min_score!r} ORDER BY anomaly_score DESC, ws ASC LIMIT {limit}")


def alert_reduction_sql(baseline_threshold: float = 0.0, model_threshold: float = 0.5,
                        rules: RuleSet = DEFAULT_RULES) -> str:
    return (_unified_rules_only_cte(rules) + ",\n"
            + f"c AS (SELECT count(*) AS total_events, count(*) FILTER (WHERE baseline_score > {baseline_threshold!r})"
            + f" AS baseline_alerts, count(*) FILTER (WHERE anomaly_score >= {model_threshold!r}) AS model_alerts FROM sc)\n"
            + "SELECT total_events, baseline_alerts, model_alerts, "
            + "round(round(1.0 - model_alerts / greatest(total_events, 1), 9), 6) AS alert_reduction_rate, "
            + "round(round(model_alerts / greatest(total_events, 1) * 1000, 9), 6) AS alerts_per_1000, "
            + "baseline_alerts - model_alerts AS absolute_reduction, "
            + "round(round(1.0 - model_alerts / greatest(baseline_alerts, 1), 9), 6) AS relative_reduction, "
            + "round(round(model_alerts / greatest(total_events, 1), 9), 6) AS alert_rate FROM c")


# --------------------------------------------------------------------------------------
# metrics (A25, W6-W10) on the labelled-score fixture
# --------------------------------------------------------------------------------------

def _metrics_with(body: str) -> str:
    from alertloom.sources.events import METRICS_DUCKDB_CTE
    return "WITH " + METRICS_DUCKDB_CTE.strip() + ",\n" + body


def confusion_sql(threshold: float = 0.5) -> str:
    return _metrics_with(f"""
c AS (SELECT count(*) FILTER (WHERE y_true = 1 AND y_score >= {threshold!r}) AS tp,
             count(*) FILTER (WHERE y_true = 0 AND y_score >= {threshold!r}) AS fp,
             count(*) FILTER (WHERE y_true = 0 AND y_score < {threshold!r}) AS tn,
             count(*) FILTER (WHERE y_true = 1 AND y_score < {threshold!r}) AS fn FROM m)
SELECT tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives,
  round(round(CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0.0 END, 9), 6) AS accuracy,
  round(round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 9), 6) AS precision,
  round(round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 9), 6) AS recall,
  round(round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 9), 6) AS f1,
  round(round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 9), 6) AS fpr
FROM c""")


def roc_auc_sql() -> str:
    # pairwise definition: P(score_pos > score_neg) + 0.5 P(tie)
    return _metrics_with("""
pn AS (SELECT p.y_score AS sp, q.y_score AS sn FROM m p JOIN m q ON p.y_true = 1 AND q.y_true = 0),
t AS (SELECT sum(y_true) AS P, count(*) - sum(y_true) AS N FROM m)
SELECT round(round(CASE WHEN t.P > 0 AND t.N > 0 THEN
  (SELECT sum(CASE WHEN sp > sn THEN 1.0 WHEN sp = sn THEN 0.5 ELSE 0.0 END) FROM pn) / (t.P * t.N) ELSE 0.0 END, 9), 6)
  AS roc_auc FROM t""")


def average_precision_sql() -> str:
    return _metrics_with("""
h AS (SELECT y_score AS s, sum(y_true) AS p, count(*) - sum(y_true) AS n FROM m GROUP BY 1),
r AS (SELECT p, sum(p) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(n) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp, sum(p) OVER () AS PT FROM h)
SELECT round(round(CASE WHEN max(PT) > 0 THEN sum(p * tp / (tp + fp)) / max(PT) ELSE 0.0 END, 9), 6) AS pr_auc FROM r""")


def fpr_at_recall_sql(target: float) -> str:
    return _metrics_with(f"""
o AS (SELECT row_number() OVER (ORDER BY y_score DESC, id ASC) AS rn,
             sum(y_true) OVER (ORDER BY y_score DESC, id ASC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(1 - y_true) OVER (ORDER BY y_score DESC, id ASC ROWS UNBOUNDED PRECEDING) AS fp FROM m),
t AS (SELECT sum(y_true) AS P, count(*) - sum(y_true) AS N,
             CAST(floor({target!r}::DOUBLE * sum(y_true)) AS BIGINT) AS tt FROM m)
SELECT round(round(CASE WHEN P = 0 OR N = 0 THEN 0.0
  ELSE (SELECT fp FROM o WHERE tp >= t.tt ORDER BY rn LIMIT 1) / N END, 9), 6) AS fpr FROM t""")


def fpr_curve_sql(target: float = 0.95) -> str:
    return _metrics_with(f"""
h AS (SELECT y_score AS s, sum(y_true) AS p FROM m GROUP BY 1),
r AS (SELECT s, sum(p) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp_ge FROM h),
t AS (SELECT sum(y_true) AS P, count(*) - sum(y_true) AS N, min(y_score) FILTER (WHERE y_true = 1) AS minpos FROM m),
th AS (SELECT coalesce((SELECT min(s) FROM r WHERE s >= t.minpos AND tp_ge / t.P <= {target!r}::DOUBLE), 0.5) AS thr,
              t.N FROM t)
SELECT round(round((SELECT count(*) FROM m WHERE y_true <> 1 AND y_score >= th.thr) / th.N, 9), 6) AS fpr,
       round(round(th.thr, 9), 6) AS threshold FROM th""")


def detection_latency_sql(threshold: float = 0.5) -> str:
    return _metrics_with(f"""
o AS (SELECT y_true AS y, CASE WHEN y_score >= {threshold!r} THEN 1 ELSE 0 END AS pr,
             row_number() OVER (ORDER BY ts, id) - 1 AS rn FROM m),
l AS (SELECT *, lag(y) OVER (ORDER BY rn) AS prev FROM o),
st AS (SELECT *, CASE WHEN y = 1 AND coalesce(prev, 0) <> 1 THEN 1 ELSE 0 END AS start FROM l),
ep AS (SELECT *, sum(start) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS epi FROM st),
pe AS (SELECT epi, min(rn) FILTER (WHERE start = 1) AS s, min(rn) FILTER (WHERE pr = 1) AS d
       FROM ep WHERE (y = 1 OR prev = 1) AND epi > 0 GROUP BY epi),
a AS (SELECT count(*) AS total, count(d) AS det, avg(d - s) AS mn, quantile_cont(d - s, 0.5) AS md,
             quantile_cont(d - s, 0.95) AS p95 FROM pe)
SELECT round(round(CASE WHEN det > 0 THEN mn ELSE 0.0 END, 9), 6) AS mean_latency_windows,
       round(round(CASE WHEN det > 0 THEN md ELSE 0.0 END, 9), 6) AS median_latency_windows,
       round(round(CASE WHEN det > 0 THEN p95 ELSE 0.0 END, 9), 6) AS p95_latency_windows,
       round(round(CASE WHEN det > 0 THEN det / total ELSE 0.0 END, 9), 6) AS detection_rate,
       det AS attacks_detected, total AS attacks_total FROM a""")


def bands_sql() -> str:
    from alertloom.config import EVENT_SEVERITY_BANDS, WINDOW_SEVERITY_BANDS
    return _metrics_with(f"""
b AS (SELECT id, y_score FROM m)
SELECT id, y_score, {severity_sql('y_score', WINDOW_SEVERITY_BANDS)} AS window_severity,
  {severity_sql('y_score', EVENT_SEVERITY_BANDS)} AS event_severity,
  CASE WHEN y_score < 0.3 THEN 'low' WHEN y_score < 0.5 THEN 'moderate' WHEN y_score < 0.7 THEN 'elevated'
       WHEN y_score < 0.85 THEN 'high' ELSE 'critical' END AS narrative_band,
  CASE WHEN y_score >= 0.5 THEN 'ATTACK' ELSE 'NORMAL' END AS classification
FROM b""")


# --------------------------------------------------------------------------------------
# profiles (A12, A15, A17, A18), labels (A11, J3), sampling counts
# --------------------------------------------------------------------------------------

def _ev_with(body: str) -> str:
    return "WITH " + EVENTS_DUCKDB_CTE.strip() + ",\n" + body


def class_balance_sql() -> str:
    return _ev_with("""
c AS (SELECT label, count(*) AS count FROM ev GROUP BY label)
SELECT label, count, round(round(count / sum(count) OVER (), 9), 6) AS share,
  round(round(sum(CASE WHEN label = 1 THEN 0 ELSE count END) OVER ()
        / nullif(sum(CASE WHEN label = 1 THEN count ELSE 0 END) OVER (), 0), 9), 6) AS imbalance_ratio
FROM c""")


def category_means_sql() -> str:
    cols = ["src_port", "dst_port", "bytes_in", "bytes_out", "duration", "label"]
    return _ev_with("x AS (SELECT 1)\nSELECT protocol, " + ", ".join(
        f"round(round(avg({c}), 9), 6) AS {c}_mean" for c in cols) + " FROM ev GROUP BY protocol")


def label_correlation_sql() -> str:
    cols = ["event_id", "src_port", "dst_port", "bytes_in", "bytes_out", "duration"]
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), CAST(label AS DOUBLE)) AS correlation"
                              f" FROM ev" for c in cols)
    return _ev_with(f"""
r AS ({rows})
SELECT feature, round(round(correlation, 9), 6) AS correlation,
  CAST(row_number() OVER (ORDER BY round(abs(correlation), 9) DESC NULLS LAST, feature) AS INTEGER) AS rank
FROM r""")


def null_profile_sql(windows=DEFAULT_WINDOWS) -> str:
    names = ["window_start"] + [n for n, _ in window_feature_names(windows)]
    parts = []
    for n in names:
        src = "ws" if n == "window_start" else n
        kind = "categorical" if n == "window_start" else "numeric"
        parts.append(f"SELECT '{n}' AS column, '{kind}' AS kind, count(*) - count({src}) AS null_count, "
                     f"count(*) AS rows FROM wf")
    return window_ctes(windows) + "\n" + "\nUNION ALL ".join(parts)


def window_labels_sql(windows=DEFAULT_WINDOWS) -> str:
    return (window_ctes(windows) + ",\n"
            + "lb AS (SELECT us - (us % 60000000) AS ws, max(CASE WHEN label > 0 THEN 1 ELSE 0 END) AS label "
              "FROM b GROUP BY 1)\n"
            + "SELECT make_timestamp(wf.ws) AS window_start, wf.event_count_1min, coalesce(lb.label, 0) AS label "
              "FROM wf LEFT JOIN lb USING (ws)")


def split_counts_sql(test_size: float = 0.2) -> str:
    return _ev_with(f"""
c AS (SELECT label, count(*) AS n FROM ev GROUP BY label)
SELECT label, 'test' AS split, CAST(ceil({test_size!r}::DOUBLE * n) AS BIGINT) AS count FROM c
UNION ALL SELECT label, 'train', n - CAST(ceil({test_size!r}::DOUBLE * n) AS BIGINT) FROM c""")


def sample_counts_sql(n: int) -> str:
    return _ev_with(f"""
c AS (SELECT label, count(*) AS k FROM ev GROUP BY label),
t AS (SELECT sum(k) AS total FROM c),
q AS (SELECT label, least({n}, total) * k / total AS raw, floor(least({n}, total) * k / total) AS fl, total FROM c, t),
r AS (SELECT label, fl, row_number() OVER (ORDER BY raw - fl DESC, CAST(label AS VARCHAR)) AS rk,
             least({n}, total) - sum(fl) OVER () AS rest FROM q)
SELECT label, CAST(fl + CASE WHEN rk <= rest THEN 1 ELSE 0 END AS BIGINT) AS count FROM r""")


def class_weight_sql() -> str:
    return _ev_with("""
w AS (SELECT count(*) FILTER (WHERE label <> 1) / greatest(count(*) FILTER (WHERE label = 1), 1) AS w FROM ev)
SELECT label, round(round(CASE WHEN label = 1 THEN w.w ELSE 1.0 END, 9), 6) AS weight, count(*) AS count
FROM ev, w GROUP BY label, w.w""")


def temporal_split_sql(test_size: float = 0.2) -> str:
    return _ev_with(f"""
o AS (SELECT "timestamp" AS t, row_number() OVER (ORDER BY "timestamp") AS rn, count(*) OVER () AS n FROM ev),
cut AS (SELECT t FROM o WHERE rn = greatest(1, CAST(ceil((1 - {test_size!r}::DOUBLE) * n) AS BIGINT)))
SELECT CASE WHEN ev."timestamp" > cut.t THEN 'test' ELSE 'train' END AS split, count(*) AS count
FROM ev, cut GROUP BY 1""")


# --------------------------------------------------------------------------------------
# encoding (F7, S2), scaling (A20, F23, F24), reference statistics
# --------------------------------------------------------------------------------------

def event_level_sql() -> str:
    nums = ", ".join(f"round(round(coalesce(CAST({c} AS DOUBLE), 0.0), 9), 6) AS {c}" for c in ("src_port", "bytes_in", "bytes_out", "duration"))
    # The five protocols of the event projection (FIXTURES.md, section 4).
    protos = ", ".join(f"CAST(coalesce(protocol = '{p}', false) AS INTEGER) AS proto_{p}" for p in ("dns", "http", "https", "smtp", "ssh"))
    return (f"WITH {EVENTS_DUCKDB_CTE.strip()} SELECT event_id, {nums}, CAST(coalesce(status = 'failed', false) AS INTEGER) AS status_failed, "
            f"{protos} FROM ev")


def standard_scaling_sql() -> str:
    cols = ["bytes_in", "bytes_out", "duration"]
    sel = ", ".join(f"round(round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 "
                    f"THEN stddev_pop({c}) OVER () ELSE 1.0 END, 9), 6) AS {c}_scaled" for c in cols)
    return _ev_with(f"x AS (SELECT 1)\nSELECT event_id, {sel} FROM ev")


def percentile_sigmoid_sql() -> str:
    return _metrics_with("""
q AS (SELECT quantile_cont(y_score, 0.05) AS p5, quantile_cont(y_score, 0.5) AS p50,
             quantile_cont(y_score, 0.95) AS p95 FROM m)
SELECT id, round(round(1.0 / (1.0 + exp(-(y_score - p50) / greatest(p95 - p50, p50 - p5, 0.1))), 9), 6)
  AS normalized_score FROM m, q""")


def min_max_sql() -> str:
    return _metrics_with("""
q AS (SELECT min(y_score) AS lo, max(y_score) AS hi FROM m)
SELECT id, round(round((y_score - lo) / (hi - lo + 1e-8), 9), 6) AS minmax_score FROM m, q""")


EXPLAIN_FEATURES = ["event_count_1min", "unique_dst_ports_1min", "port_entropy_1min", "bytes_out_mean_1min",
                    "conn_duration_p95_1min", "failed_auth_ratio_1min", "baseline_deviation_1min",
                    "bytes_ratio_5min", "event_count_15min", "new_dst_ip_ratio_1min"]


def _snapped_ft(features) -> str:
    return "fs AS (SELECT ws, " + ", ".join(f"round(CAST({f} AS DOUBLE), 9) AS {f}" for f in features) + " FROM ft)"


def reference_stats_sql(features=EXPLAIN_FEATURES) -> str:
    parts = []
    for f in features:
        x = f"CAST({f} AS DOUBLE)"
        qs = ", ".join(f"round(round(quantile_cont({x}, {p}), 9), 6) AS p{int(round(p * 100))}"
                       for p in (0.1, 0.25, 0.5, 0.75, 0.9))
        parts.append(f"SELECT '{f}' AS feature, round(round(avg({x}), 9), 6) AS mean, "
                     f"round(round(stddev_samp({x}), 9), 6) AS std, {qs} FROM fs")
    return feature_table_ctes() + ",\n" + _snapped_ft(features) + "\n" + "\nUNION ALL ".join(parts)


def explanations_sql(features=EXPLAIN_FEATURES, top_k: int = 3) -> str:
    """Top-k features by |standardized deviation| per window, with percentile position."""
    stats = []
    for f in features:
        x = f"CAST({f} AS DOUBLE)"
        stats.append(f"SELECT {features.index(f)} AS idx, '{f}' AS feature, avg({x}) AS mu, stddev_samp({x}) AS sd, "
                     + ", ".join(f"quantile_cont({x}, {p}) AS q{j}" for j, p in enumerate((0.1, 0.25, 0.5, 0.75, 0.9)))
                     + " FROM fs")
    longs = " UNION ALL ".join(f"SELECT ws, {i} AS idx, CAST({f} AS DOUBLE) AS v FROM fs" for i, f in enumerate(features))
    pct = ("CASE WHEN v <= q0 THEN 5.0 "
           "WHEN v <= q1 THEN 25.0 - 15.0 * (q1 - v) / (q1 - q0) "
           "WHEN v <= q2 THEN 50.0 - 25.0 * (q2 - v) / (q2 - q1) "
           "WHEN v <= q3 THEN 75.0 - 25.0 * (q3 - v) / (q3 - q2) "
           "WHEN v <= q4 THEN 90.0 - 15.0 * (q4 - v) / (q4 - q3) ELSE 95.0 END")
    return (feature_table_ctes() + ",\n" + _snapped_ft(features) + ",\n"
            + f"st AS ({' UNION ALL '.join(stats)}),\n"
            + f"lv AS ({longs}),\n"
            + "ct AS (SELECT lv.ws, lv.idx, st.feature, lv.v, coalesce((lv.v - st.mu) / nullif(st.sd, 0), 0.0)"
              " AS contribution, "
              f"{pct} AS percentile FROM lv JOIN st USING (idx)),\n"
            + "rk AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY abs(contribution) DESC, idx) AS rank FROM ct)\n"
            + "SELECT make_timestamp(ws) AS window_start, CAST(rank AS INTEGER) AS rank, feature, "
              "round(round(v, 9), 6) AS value, round(round(contribution, 9), 6) AS contribution, "
              "CASE WHEN contribution > 0 THEN 'increases' ELSE 'decreases' END AS direction, "
              f"round(round(percentile, 9), 6) AS percentile FROM rk WHERE rank <= {top_k}")


# --------------------------------------------------------------------------------------
# neighbours, streams, declared features
# --------------------------------------------------------------------------------------

_NEIGHBORS = """
p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
d AS (SELECT a.vec_id, b.vec_id AS nid, list_distance(a.v, b.v) AS dist FROM p a JOIN p b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nid) AS rank FROM d QUALIFY rank <= 20)"""


def knn_sql() -> str:
    return f"WITH {_NEIGHBORS} SELECT vec_id, CAST(rank AS INTEGER) AS rank, nid AS neighbor_id, {_r('dist')} AS distance FROM k"


def lof_sql() -> str:
    return f"""WITH {_NEIGHBORS},
kd AS (SELECT vec_id, max(dist) AS kd FROM k GROUP BY vec_id),
l AS (SELECT k.vec_id, 1 / (avg(greatest(kd.kd, k.dist)) + 1e-10) AS lrd FROM k JOIN kd ON kd.vec_id = k.nid GROUP BY k.vec_id)
SELECT k.vec_id, {_r('avg(n.lrd) / any_value(o.lrd)')} AS lof FROM k JOIN l n ON n.vec_id = k.nid JOIN l o ON o.vec_id = k.vec_id GROUP BY k.vec_id"""


def _finished(sql: str, seconds: int, delay: str) -> str:
    """Windows that the watermark has passed when all events are read."""
    return f"SELECT * FROM ({sql}) WHERE window_start + INTERVAL {seconds} SECOND <= (SELECT max(ts) FROM events) - INTERVAL '{delay}'"


def stream_windows_sql(window: WindowSpec, delay: str) -> str:
    return _finished(window_features_sql([window]), window.seconds, delay)


def stream_novelty_sql(delay: str) -> str:
    return _finished(novelty_sql(), 60, delay)


def declared_features_sql() -> str:
    us = 3_600_000_000
    cols = {
        "event_count": "a.event_count", "failed_count": "a.failed_count", "unique_dst_ips": "a.unique_dst_ips", "unique_dst_ports": "a.unique_dst_ports",
        "port_entropy": "a.port_entropy", "failed_auth_ratio": "a.failed_auth_ratio", "bytes_in_mean": "a.bytes_in_mean", "bytes_in_std": "a.bytes_in_std",
        "bytes_out_sum": "a.bytes_out_sum", "duration_p50": "a.duration_p50", "duration_p95": "a.duration_p95",
        "inter_arrival_cv": "CASE WHEN a.span > 0 THEN g.gsd / (a.span / (a.event_count - 1)) END", "new_dst_ip_ratio": "n.new_ratio", "returning_dst_ip_ratio": "n.back_ratio",
        "dns_ratio": "a.dns_ratio", "slow_dns_ratio": "a.slow_dns_ratio", "event_rate": "avg(a.event_count) OVER (ORDER BY a.ws ROWS 23 PRECEDING)",
        "event_zscore": "(a.event_count - avg(a.event_count) OVER (ORDER BY a.ws ROWS 47 PRECEDING)) / greatest(coalesce(stddev_samp(a.event_count) OVER (ORDER BY a.ws ROWS 47 PRECEDING), 1.0), 0.1)",
        "port_diversity_change": "CAST(a.unique_dst_ports - lag(a.unique_dst_ports, 5) OVER (ORDER BY a.ws) AS DOUBLE)",
        "bytes_ratio": "a.bytes_out_sum / (a.bytes_in_mean + 1)", "spread_indicator": "CAST(a.unique_dst_ips > 10 AND a.event_count < 40 AS INTEGER)"}
    whole = ("event_count", "failed_count", "unique_dst_ips", "unique_dst_ports", "spread_indicator")
    out = ", ".join(f"{x if c in whole else _r(x)} AS {c}" for c, x in cols.items())
    return f"""WITH {EVENTS_DUCKDB_CTE},
b AS (SELECT *, epoch_us("timestamp") AS us, epoch_us("timestamp") - epoch_us("timestamp") % {us} AS ws FROM ev),
a AS (SELECT ws, count(*) AS event_count, count(*) FILTER (WHERE status = 'failed') AS failed_count, count(DISTINCT dst_ip) AS unique_dst_ips,
   count(DISTINCT dst_port) AS unique_dst_ports, entropy(dst_port) AS port_entropy,
   coalesce(count(*) FILTER (WHERE event_type = 'auth' AND status = 'failed') / nullif(count(*) FILTER (WHERE event_type = 'auth'), 0), 0) AS failed_auth_ratio,
   avg(bytes_in) AS bytes_in_mean, CASE WHEN count(bytes_in) > 1 THEN stddev_samp(bytes_in) WHEN count(bytes_in) = 1 THEN 0 END AS bytes_in_std, sum(bytes_out) AS bytes_out_sum,
   quantile_cont(duration, 0.5) AS duration_p50, quantile_cont(duration, 0.95) AS duration_p95, (max(us) - min(us)) / 1e6 AS span,
   count(*) FILTER (WHERE protocol = 'dns') / count(*) AS dns_ratio,
   coalesce(count(*) FILTER (WHERE protocol = 'dns' AND duration >= 5) / nullif(count(*) FILTER (WHERE protocol = 'dns'), 0), 0) AS slow_dns_ratio FROM b GROUP BY ws),
g AS (SELECT ws, stddev_samp(gap) AS gsd FROM (SELECT ws, (us - lag(us) OVER (PARTITION BY ws ORDER BY us)) / 1e6 AS gap FROM b) GROUP BY ws),
n AS (SELECT ws, count(*) FILTER (WHERE prev IS NULL) / count(*) AS new_ratio, count(*) FILTER (WHERE prev IS NULL OR ws - prev > 10 * {us}) / count(*) AS back_ratio
   FROM (SELECT ws, lag(ws) OVER (PARTITION BY dst_ip ORDER BY ws) AS prev FROM (SELECT DISTINCT ws, dst_ip FROM b WHERE dst_ip IS NOT NULL)) GROUP BY ws)
SELECT make_timestamp(a.ws) AS window_start, {out} FROM a JOIN g USING (ws) JOIN n USING (ws)"""


# --------------------------------------------------------------------------------------
# unified scores of events, grouped metrics, categories, flow tables
# --------------------------------------------------------------------------------------

_UNIFIED_EVENTS = """
r AS (SELECT event_id, "timestamp", bytes_in > 2000 AS r1, bytes_out > 20000 AND duration >= 2 AS r2, src_port < 5000 AS r3,
        e0.value / 600.0::DOUBLE AS lgb_score, e0.k / 100.0::DOUBLE AS if_score FROM ev JOIN e0 USING (event_id)),
s AS (SELECT *, least((CASE WHEN r1 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN r2 THEN 0.5::DOUBLE ELSE 0 END) + CASE WHEN r3 THEN 0.4::DOUBLE ELSE 0 END, 1.0)
        AS baseline_score FROM r),
u AS (SELECT *, least(greatest((0.2::DOUBLE * baseline_score + 0.5::DOUBLE * lgb_score) + 0.3::DOUBLE * if_score, 0.0), 1.0) AS anomaly_score FROM s)
"""


def unified_events_sql() -> str:
    from alertloom.config import WINDOW_SEVERITY_BANDS
    return _ev_with(_UNIFIED_EVENTS.strip() + f"""
SELECT event_id, round(round(baseline_score, 9), 6) AS baseline_score, concat_ws(',', CASE WHEN r1 THEN 'large_in' END, CASE WHEN r2 THEN 'large_out' END,
         CASE WHEN r3 THEN 'low_port' END) AS triggered_rules,
  CASE WHEN r2 THEN 'critical' WHEN r1 THEN 'high' WHEN r3 THEN 'medium' ELSE 'none' END AS rule_severity,
  CAST(r1 AS INTEGER) + CAST(r2 AS INTEGER) + CAST(r3 AS INTEGER) AS rule_count,
  round(round(lgb_score, 9), 6) AS lgb_score, round(round(if_score, 9), 6) AS if_score, round(round(anomaly_score, 9), 6) AS anomaly_score,
  {severity_sql('anomaly_score', WINDOW_SEVERITY_BANDS)} AS severity FROM u""")


def unified_event_alerts_sql(limit: int, least: float) -> str:
    return _ev_with(_UNIFIED_EVENTS.strip() + f"""
SELECT event_id, round(round(anomaly_score, 9), 6) AS anomaly_score FROM u WHERE anomaly_score >= {least!r}
ORDER BY u.anomaly_score DESC, event_id LIMIT {limit}""")


_GROUPED = """
p AS (SELECT 'linear' AS model, y_true, y_score FROM m UNION ALL SELECT 'root' AS model, y_true, sqrt(y_score) FROM m
      UNION ALL SELECT 'turned' AS model, y_true, 1.0::DOUBLE - y_score FROM m),
c AS (SELECT model, count(*) FILTER (WHERE y_true = 1 AND y_score >= 0.3) AS tp, count(*) FILTER (WHERE y_true = 0 AND y_score >= 0.3) AS fp,
        count(*) FILTER (WHERE y_true = 0 AND y_score < 0.3) AS tn, count(*) FILTER (WHERE y_true = 1 AND y_score < 0.3) AS fn FROM p GROUP BY model),
g AS (SELECT model, tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives, (tp + tn) / (tp + tn + fp + fn) AS accuracy,
        CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
        CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END AS fpr FROM c)
"""


def grouped_metrics_sql() -> str:
    rates = ", ".join(f"round(round({c}, 9), 6) AS {c}" for c in ("accuracy", "precision", "recall", "f1", "fpr"))
    return _metrics_with(_GROUPED.strip() + f"\nSELECT model, true_positives, false_positives, true_negatives, false_negatives, {rates} FROM g")


def best_models_sql() -> str:
    pick = lambda c, way: f"(SELECT model FROM g ORDER BY {c} {way}, model LIMIT 1)"
    return _metrics_with(_GROUPED.strip() + f"\nSELECT {pick('f1', 'DESC')} AS best_f1, {pick('recall', 'DESC')} AS best_recall, {pick('fpr', 'ASC')} AS least_fpr")


_CATEGORIES = """
p AS (SELECT et AS a, CASE WHEN k % 5 = 0 THEN 'error' WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN 'other' ELSE et END AS b FROM e0)
"""


def category_confusion_sql() -> str:
    return _ev_with(_CATEGORIES.strip() + "\nSELECT a AS actual, b AS predicted, count(*) AS n FROM p GROUP BY a, b")


def category_metrics_sql() -> str:
    return _ev_with(_CATEGORIES.strip() + """,
k AS (SELECT a AS class FROM p UNION SELECT b FROM p),
c AS (SELECT k.class, count(*) FILTER (WHERE a IS NOT DISTINCT FROM k.class) AS support, count(*) FILTER (WHERE b IS NOT DISTINCT FROM k.class) AS predicted,
        count(*) FILTER (WHERE a IS NOT DISTINCT FROM k.class AND b IS NOT DISTINCT FROM k.class) AS hits FROM k, p GROUP BY k.class)
SELECT class, support, predicted, hits, round(round(CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END, 9), 6) AS precision,
  round(round(CASE WHEN support > 0 THEN hits / support ELSE 0.0 END, 9), 6) AS recall, round(round(2 * hits / (support + predicted), 9), 6) AS f1 FROM c""")


_FLOWS = """
f AS (SELECT event_id AS id, CASE WHEN k % 10 = 0 THEN NULL ELSE value / 50.0::DOUBLE END AS dur, CAST(k AS DOUBLE) AS spkts, CAST(k * 2 AS DOUBLE) AS dpkts,
        value * (k + 1) AS sbytes, value * 10.0::DOUBLE AS dbytes, CASE k % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' END AS proto,
        CASE k % 4 WHEN 0 THEN 'FIN' WHEN 1 THEN 'INT' ELSE 'CON' END AS state, CASE WHEN et = 'error' AND k >= 50 THEN 1 ELSE 0 END AS label FROM e0)
"""


def flow_features_sql() -> str:
    nums = ", ".join(f"round(round(coalesce({c}, 0.0), 9), 6) AS {c}" for c in ("dur", "spkts", "dpkts", "sbytes", "dbytes"))
    flags = ", ".join(f"CAST(coalesce({c} = '{v}', false) AS INTEGER) AS {c}_{v}" for c, v in
                      (("proto", "tcp"), ("proto", "udp"), ("state", "CON"), ("state", "FIN"), ("state", "INT")))
    return _ev_with(_FLOWS.strip() + f"\nSELECT {nums}, {flags}, CAST(label AS INTEGER) AS label FROM f")


def flow_renamed_sql() -> str:
    return _ev_with(_FLOWS.strip() + "\nSELECT CAST(id AS DOUBLE) AS id, round(round(dur, 9), 6) AS duration, spkts, dpkts, round(round(sbytes, 9), 6) AS "
                        "bytes_out, round(round(dbytes, 9), 6) AS bytes_in, CAST(label AS INTEGER) AS is_attack FROM f")
