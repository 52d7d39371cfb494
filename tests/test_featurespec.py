import math
import statistics
from collections import Counter, defaultdict

import pytest

from alertloom.operators import featurespec as FS
from tests.test_streaming import SCHEMA, events

SPEC = """
windows: [{name: 5min, duration_seconds: 300}]
window_features:
  - {name: event_count, type: count}
  - {name: failed, type: count, filter: "status == 'failed'"}
  - {name: unique_dst_ips, type: cardinality, field: dst_ip}
  - {name: port_entropy, type: entropy, field: dst_port}
  - {name: failed_auth_ratio, type: ratio, numerator_filter: "status == 'failed'", denominator_filter: "event_type == 'auth'"}
  - {name: bytes_in_mean, type: mean, field: bytes_in}
  - {name: bytes_out_std, type: std, field: bytes_out}
  - {name: p50, type: percentile, field: duration, percentile: 50}
  - {name: cv, type: coefficient_of_variation, field: inter_arrival_time}
  - {name: new_dst, type: novelty_ratio, field: dst_ip}
  - {name: back_dst, type: novelty_ratio, field: dst_ip, lookback_windows: 1}
  - {name: outbound, type: ratio, numerator_filter: "direction == 'outbound'", denominator_filter: null}
entity_features:
  - {name: rate, type: rolling_mean, field: event_count, lookback_windows: 3}
  - {name: z, type: zscore, field: event_count, lookback_windows: 4}
  - {name: change, type: delta, field: unique_dst_ips, lookback_windows: 2}
  - {name: out_change, type: delta, field: outbound, lookback_windows: 2}
protocol_features:
  - {name: dns, type: ratio, filter: "protocol == 'dns'"}
  - {name: errors, type: ratio, numerator_filter: "protocol == 'http' and status >= 400", denominator_filter: "protocol == 'http'"}
derived_features:
  - {name: per_event, formula: "bytes_in_mean / (event_count + 1)"}
  - {name: scan, formula: "(unique_dst_ips > 20) & (event_count < 200)"}
"""


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[int(r[0].timestamp()) // 300 * 300].append(r)
    out, before, last = [], set(), {}
    for i, (ws, rs) in enumerate(sorted(by.items())):
        num = lambda j: [r[j] for r in rs if r[j] is not None and not math.isnan(r[j])]
        ports, ips = Counter(r[3] for r in rs if r[3] is not None), {r[2] for r in rs}
        total = sum(ports.values())
        auth = [r for r in rs if r[9] == "auth"]
        t = sorted(r[0] for r in rs)
        gaps = [(b - a).total_seconds() for a, b in zip(t, t[1:])]
        o = {"event_count": len(rs), "failed": sum(r[10] == "failed" for r in rs), "unique_dst_ips": len(ips), "port_entropy": -sum(c / total * math.log2(c / total) for c in ports.values()) if total else 0,
             "failed_auth_ratio": sum(r[10] == "failed" for r in auth) / len(auth) if auth else 0, "bytes_in_mean": statistics.mean(num(6)) if num(6) else None,
             "bytes_out_std": statistics.stdev(num(7)) if len(rs) > 1 else 0.0, "p50": statistics.median(num(8)) if num(8) else None,
             "cv": statistics.stdev(gaps) / statistics.mean(gaps) if len(gaps) > 1 and sum(gaps) else None, "new_dst": len(ips - before) / len(ips),
             "back_dst": sum(x not in last or last[x] < ws - 300 for x in ips) / len(ips), "dns": sum(r[4] == "dns" for r in rs) / len(rs), "errors": 0.0}
        before |= ips
        last.update(dict.fromkeys(ips, ws))
        out.append(o)
        n = [x["event_count"] for x in out]
        o["rate"], f = statistics.mean(n[-3:]), n[-4:]
        o["z"] = (n[-1] - statistics.mean(f)) / max(statistics.stdev(f) if len(f) > 1 else 1.0, 0.1)
        o["change"] = o["unique_dst_ips"] - out[i - 2]["unique_dst_ips"] if i >= 2 else None
        o["per_event"] = None if o["bytes_in_mean"] is None else o["bytes_in_mean"] / (len(rs) + 1)
        o["scan"] = int(len(ips) > 20 and len(rs) < 200)
    return out


def test_every_kind_against_plain_python(spark):
    rows = events(5, 500, 0, 4000) + events(6, 3, 4200, 1000)
    df = spark.createDataFrame(rows, SCHEMA)
    spec = FS.compile_spec(FS.load_spec(SPEC), df, missing="skip")
    assert spec.skipped == ["outbound", "out_change"] and [(w.name, w.seconds) for w in spec.windows] == [("5min", 300)]
    got = [r.asDict() for r in FS.apply_spec(spec, df, spec.windows[0]).orderBy("window_start").collect()]
    want = brute(rows)
    assert len(got) == len(want) and set(got[0]) == {"window_start", *want[0]}
    for g, o in zip(got, want):
        for k, x in o.items():
            assert (x is None and g[k] is None) or g[k] == pytest.approx(x, rel=1e-9, abs=1e-9), (k, g[k], x)
    assert FS.apply_spec(spec, df.limit(0), spec.windows[0]).collect() == []


@pytest.mark.parametrize("bad, says", [
    ("window_features: [{name: a, type: median, field: bytes_in}]", "unknown type"), ("window_features: [{name: a, type: mean}]", "needs"),
    ("window_features: [{name: a, type: mean, field: status}]", "not a number"), ("window_features: [{name: a, type: mean, field: nope}]", "no column"),
    ("window_features: [{name: a, type: count, field: status}]", "does not know"), ("window_features: [{name: a, type: count, filter: 'bytes_in + 1'}]", "no condition"),
    ("window_features: [{name: a, type: count, filter: 'status === ('}]", "does not fit"), ("window_features: [{name: a, type: count}, {name: a, type: count}]", "two features"),
    ("window_features: [{name: a, type: percentile, field: bytes_in, percentile: 101}]", "between"), ("entity_features: [{name: a, type: delta, field: b, lookback_windows: 2}]", "no column"),
    ("window_features: [{name: n, type: count}]\nentity_features: [{name: a, type: delta, field: n, lookback_windows: 0}]", "from 1"),
    ("window_features: [{name: n, type: count}]\nderived_features: [{name: a, formula: 'n + '}]", "does not fit"), ("windows: [{name: x, duration_seconds: 0}]", "whole number"),
])
def test_wrong_specifications_raise(spark, bad, says):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(FS.SpecError, match=says):
        FS.compile_spec(FS.load_spec(bad), df)
