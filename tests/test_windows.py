import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.config import WindowSpec
from alertloom.operators.windows import feature_columns, window_features
from tests.conftest import ev_frame

W1 = [WindowSpec("1min", 60)]
W15 = [WindowSpec("1min", 60), WindowSpec("5min", 300)]


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_two_sizes_give_both_suffixes(spark):
    rows = [{"timestamp": f"2024-01-01 12:{i * 2 // 60:02d}:{i * 2 % 60:02d}", "src_ip": f"10.0.0.{i % 3}",
             "dst_ip": f"10.1.0.{i % 2}", "dst_port": [80, 443, 22, 53][i % 4], "protocol": ["tcp", "udp"][i % 2],
             "bytes_in": 100.0 + i, "bytes_out": 50.0 + i} for i in range(100)]
    df = ev_frame(spark, rows, ["timestamp", "src_ip", "dst_ip", "dst_port", "protocol", "bytes_in", "bytes_out"])
    out = window_features(df, W15)
    assert any(c.endswith("_1min") for c in out.columns) and any(c.endswith("_5min") for c in out.columns)
    got = {r["window_start"].minute: r["event_count_1min"] for r in out.collect()}
    assert got[0] == 30 and got[1] == 30 and got[3] == 10
    assert set(out.columns) == {"window_start", *feature_columns(df.columns, W15)}


def test_one_event_window(spark):
    df = ev_frame(spark, [{"timestamp": "2024-01-01 00:00:10", "dst_port": 80, "bytes_in": 5.0, "bytes_out": 1.0,
                           "duration": 0.5, "protocol": "dns", "event_type": "connection", "status": "success"}])
    r = one(window_features(df, W1))
    assert r["event_count_1min"] == 1
    assert r["bytes_in_std_1min"] == 0.0 and r["bytes_in_mean_1min"] == 5.0
    assert r["inter_arrival_mean_1min"] is None and r["inter_arrival_cv_1min"] is None
    assert r["port_entropy_1min"] == 0.0
    assert r["failed_auth_ratio_1min"] == 0.0      # no auth events
    assert r["dns_ratio_1min"] == 1.0 and r["http_ratio_1min"] == 0.0
    assert r["conn_duration_p50_1min"] == 0.5


def test_two_events_single_gap(spark):
    df = ev_frame(spark, [{"timestamp": "2024-01-01 00:00:10"}, {"timestamp": "2024-01-01 00:00:40"}],
                  ["timestamp"])
    r = one(window_features(df, W1))
    assert r["inter_arrival_mean_1min"] == 30.0
    assert r["inter_arrival_cv_1min"] is None      # std of one gap is undefined


def test_equal_timestamps_have_no_gap_features(spark):
    df = ev_frame(spark, [{"timestamp": "2024-01-01 00:00:10"}] * 3, ["timestamp"])
    r = one(window_features(df, W1))
    assert r["event_count_1min"] == 3
    assert r["inter_arrival_mean_1min"] is None and r["inter_arrival_cv_1min"] is None


def test_entropy_and_cardinality(spark):
    ports = [80, 80, 443, 22, None]
    df = ev_frame(spark, [{"timestamp": f"2024-01-01 00:00:{i:02d}", "dst_port": p} for i, p in enumerate(ports)],
                  ["timestamp", "dst_port"])
    r = one(window_features(df, W1))
    assert r["unique_dst_ports_1min"] == 3
    assert r["port_entropy_1min"] == pytest.approx(1.5)


def test_null_bytes_window(spark):
    df = ev_frame(spark, [{"timestamp": "2024-01-01 00:00:01", "bytes_in": None, "bytes_out": None},
                          {"timestamp": "2024-01-01 00:00:02", "bytes_in": None, "bytes_out": None}],
                  ["timestamp", "bytes_in", "bytes_out"])
    r = one(window_features(df, W1))
    assert r["bytes_in_mean_1min"] is None and r["bytes_in_std_1min"] is None and r["bytes_in_sum_1min"] is None


def test_failed_auth_ratio(spark):
    rows = [{"timestamp": "2024-01-01 00:00:01", "event_type": "auth", "status": "failed"},
            {"timestamp": "2024-01-01 00:00:02", "event_type": "auth", "status": "success"},
            {"timestamp": "2024-01-01 00:00:03", "event_type": "auth", "status": "failed"},
            {"timestamp": "2024-01-01 00:00:04", "event_type": "connection", "status": "failed"}]
    r = one(window_features(ev_frame(spark, rows, ["timestamp", "event_type", "status"]), W1))
    assert r["failed_auth_ratio_1min"] == pytest.approx(2 / 3)


def test_outer_join_on_exact_start(spark):
    # 00:00:30 opens 1min@00:00 and 5min@00:00; 00:06:10 opens 1min@00:06 and 5min@00:05 (no 1-min row there)
    df = ev_frame(spark, [{"timestamp": "2024-01-01 00:00:30"}, {"timestamp": "2024-01-01 00:06:10"}], ["timestamp"])
    rows = {r["window_start"].strftime("%H:%M"): r for r in window_features(df, W15).collect()}
    assert set(rows) == {"00:00", "00:05", "00:06"}
    assert rows["00:05"]["event_count_1min"] is None and rows["00:05"]["event_count_5min"] == 1
    assert rows["00:06"]["event_count_5min"] is None and rows["00:06"]["event_count_1min"] == 1


def test_null_timestamp_dropped_and_empty_input(spark):
    df = ev_frame(spark, [{"timestamp": None}, {"timestamp": "2024-01-01 00:00:01"}], ["timestamp"])
    assert window_features(df, W1).count() == 1
    assert window_features(df.where(F.lit(False)), W1).count() == 0


def test_gap_statistics_match_brute_force(spark):
    rnd = random.Random(7)
    import datetime as _dt
    dt0 = _dt.datetime(1970, 1, 1)
    base = 1_704_067_200
    secs = sorted(rnd.uniform(0, 600) for _ in range(300)) + [120.0] * 5  # ties and sub-second gaps
    rows = [{"timestamp": (dt0 + __import__("datetime").timedelta(seconds=base + s)).isoformat()} for s in secs]
    df = ev_frame(spark, rows, ["timestamp"])
    got = {r["window_start"]: r for r in window_features(df, [WindowSpec("5min", 300)]).collect()}
    import datetime as dt
    ts = sorted(dt.datetime.fromisoformat(r["timestamp"]) for r in rows)
    for ws, r in got.items():
        inw = [t for t in ts if ws <= t < ws + dt.timedelta(seconds=300)]
        gaps = np.diff([t.timestamp() for t in inw])
        assert r["event_count_5min"] == len(inw)
        assert r["inter_arrival_mean_5min"] == pytest.approx(gaps.mean(), rel=1e-9)
        assert r["inter_arrival_cv_5min"] == pytest.approx(gaps.std(ddof=1) / gaps.mean(), rel=1e-6)


def test_gap_resolution_must_divide(spark):
    df = ev_frame(spark, [{"timestamp": "2024-01-01 00:00:01"}], ["timestamp"])
    with pytest.raises(ValueError):
        window_features(df, [WindowSpec("odd", 90)], gap_resolution_us=60_000_000)
