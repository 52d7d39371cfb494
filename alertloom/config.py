"""Configuration objects and the fixed values the results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class WindowSpec:
    """A tumbling window: output suffix and length in seconds (epoch aligned)."""
    name: str
    seconds: int


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: float


@dataclass(frozen=True)
class Rule:
    name: str
    description: str
    conditions: tuple[Condition, ...]
    severity: str
    score_boost: float


@dataclass
class RuleSet:
    rules: list[Rule] = field(default_factory=list)
    severity_weights: dict[str, float] = field(default_factory=dict)
    alert_threshold: float = 0.6
    critical_threshold: float = 0.85


# ---------------------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results)
# ---------------------------------------------------------------------------------------

DEFAULT_WINDOWS = (WindowSpec("1min", 60), WindowSpec("5min", 300), WindowSpec("15min", 900))
LARGE_WINDOWS = (WindowSpec("1h", 3600), WindowSpec("6h", 21600), WindowSpec("1d", 86400))

# categorical columns counted per window, and the two with an entropy feature
CARDINALITY_COLUMNS = ("src_ip", "dst_ip", "dst_port", "user", "protocol")
ENTROPY_COLUMNS = (("dst_port", "port_entropy"), ("src_ip", "src_ip_entropy"))
BYTE_COLUMNS = ("bytes_in", "bytes_out")
PROTOCOL_SHARES = ("http", "https", "dns", "ssh", "smtp")

ROLLING_LOOKBACK = 60          # rows of the joined window table
ROLLING_STD_FLOOR = 0.1        # divisor floor of the z-score
ROLLING_STD_DEFAULT = 1.0      # std when fewer than two values
NOVELTY_SECONDS = 60           # novelty is computed on 1-minute windows
NOVELTY_ENTITIES = ("dst_ip", "dst_port")

BYTE_RATIO_SUFFIXES = ("1min", "5min", "15min")
PORT_SCAN_SUFFIXES = ("1min", "5min")
PORT_SCAN_MIN_PORTS = 50       # unique_dst_ports > 50
PORT_SCAN_MAX_IPS = 5          # unique_dst_ips < 5
HIGH_ENTROPY_SUFFIXES = ("1min", "5min")
HIGH_ENTROPY_THRESHOLD = 4.0

SEVERITY_WEIGHTS = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.2}

DEFAULT_RULES = RuleSet(
    rules=[
        Rule("high_event_volume", "Unusually high event count",
             (Condition("baseline_deviation_1min", ">", 3.0),), "medium", 0.2),
        Rule("port_scan", "Potential port scanning",
             (Condition("unique_dst_ports_1min", ">", 50), Condition("unique_dst_ips_1min", "<", 5)),
             "high", 0.3),
        Rule("high_port_entropy", "High port distribution entropy",
             (Condition("port_entropy_1min", ">", 5.0),), "medium", 0.15),
    ],
    severity_weights=dict(SEVERITY_WEIGHTS),
    alert_threshold=0.6,
    critical_threshold=0.85,
)

# Score bands: (lower bound inclusive, label), checked top-down; the last label is the fallback.
WINDOW_SEVERITY_BANDS = ((0.85, "critical"), (0.7, "high"), (0.5, "medium"), (0.3, "low"), (None, "info"))
EVENT_SEVERITY_BANDS = ((0.9, "critical"), (0.7, "high"), (0.5, "medium"), (0.3, "low"), (None, "info"))
# Narrative bands use strict upper bounds: < .3 low, < .5 moderate, < .7 elevated, < .85 high, else critical.
NARRATIVE_BANDS = ((0.3, "low"), (0.5, "moderate"), (0.7, "elevated"), (0.85, "high"), (None, "critical"))
CLASS_THRESHOLD = 0.5          # ATTACK if score >= 0.5

UNIFIED_WEIGHTS = {"baseline": 0.2, "lgb": 0.5, "isolation": 0.3}

# Explainer: reference percentiles and the piecewise-linear map of a value onto a percentile:
# 5 at or below p10; between consecutive breakpoints linear from the start to the end level;
# 95 above p90.
EXPLAIN_PERCENTILES = (0.10, 0.25, 0.50, 0.75, 0.90)
EXPLAIN_BELOW = 5.0
EXPLAIN_SEGMENTS = ((10.0, 25.0), (25.0, 50.0), (50.0, 75.0), (75.0, 90.0))
EXPLAIN_ABOVE = 95.0

FPR_RECALL_TARGETS = (0.90, 0.95, 0.99)

# Supervised defaults (boosted trees): 500 rounds, depth 6, rate 0.05, 0.8 row/column sampling, lineage cut every 10 rounds
GBT_DEFAULTS = {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8,
                "featureSubsetStrategy": "0.8", "seed": 42, "checkpointInterval": 10}
# Rounds without gain on the validation rows after which boosting stops
GBT_PATIENCE = 50
# Unsupervised defaults: 100 trees, contamination 0.1, LOF with 20 neighbours
ISOLATION_TREES = 100
ISOLATION_SAMPLE = 256
CONTAMINATION = 0.1
LOF_NEIGHBORS = 20
SPLIT_SEED = 42

# Flow table: numeric columns in the order of the public data set's header, categories, and the raw-header rename map
FLOW_NUMERIC_COLUMNS = (
    "dur", "spkts", "dpkts", "sbytes", "dbytes", "rate", "sttl", "dttl", "sload", "dload",
    "sloss", "dloss", "sinpkt", "dinpkt", "sjit", "djit", "swin", "stcpb", "dtcpb", "dwin",
    "tcprtt", "synack", "ackdat", "smean", "dmean", "trans_depth", "response_body_len",
    "ct_srv_src", "ct_state_ttl", "ct_dst_ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm",
    "ct_dst_src_ltm", "is_ftp_login", "ct_ftp_cmd", "ct_flw_http_mthd", "ct_src_ltm",
    "ct_srv_dst", "is_sm_ips_ports",
)
FLOW_CATEGORICAL_COLUMNS = ("proto", "service", "state")
FLOW_RENAME = {
    "srcip": "src_ip", "dstip": "dst_ip", "sport": "src_port", "dsport": "dst_port",
    "proto": "protocol", "dur": "duration", "sbytes": "bytes_out", "dbytes": "bytes_in",
    "sttl": "src_ttl", "dttl": "dst_ttl", "attack_cat": "attack_category", "label": "is_attack",
}

# The seven rules of the shipped thresholds file (fixed values). The dns rule reads a column
# that no feature produces, so it can never fire.
YAML_RULES = RuleSet(
    rules=[
        Rule("high_port_scan", "Potential port scanning activity",
             (Condition("unique_dst_ports_1min", ">", 100), Condition("unique_dst_ips_1min", "<", 10)), "high", 0.3),
        Rule("brute_force_attempt", "Multiple failed auth attempts",
             (Condition("failed_auth_ratio_1min", ">", 0.8), Condition("event_count_1min", ">", 20)), "high", 0.4),
        Rule("data_exfil_suspect", "Unusual outbound data volume",
             (Condition("bytes_out_mean_5min", ">", 1000000), Condition("bytes_ratio_5min", ">", 10)),
             "critical", 0.5),
        Rule("dns_tunnel_suspect", "High DNS query rate",
             (Condition("dns_query_count_1min", ">", 500),), "medium", 0.2),
        Rule("beaconing_detected", "Regular periodic connections",
             (Condition("inter_arrival_cv_5min", "<", 0.1), Condition("event_count_5min", ">", 50)), "high", 0.35),
        Rule("new_destination_burst", "Burst of never-before-seen destinations",
             (Condition("new_dst_ip_ratio_1min", ">", 0.8), Condition("unique_dst_ips_1min", ">", 20)),
             "medium", 0.25),
        Rule("anomalous_volume", "Traffic volume significantly above baseline",
             (Condition("baseline_deviation_15min", ">", 3.0),), "medium", 0.2),
    ],
    severity_weights=dict(SEVERITY_WEIGHTS),
    alert_threshold=0.6,
    critical_threshold=0.85,
)
