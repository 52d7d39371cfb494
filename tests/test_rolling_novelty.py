import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alertloom.operators.derived import derived_features, fill_and_clip
from alertloom.operators.novelty import novelty_features, update_memory
from alertloom.operators.rolling import rolling_baseline
from tests.conftest import ev_frame


def test_rolling_matches_pandas_across_chunks(spark):
    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        a = rnd.choice([None, rnd.randint(1, 9)])
        b = rnd.choice([None, None, rnd.randint(1, 5)])
        rows.append((start + dt.timedelta(minutes=i * 7), a, b))   # spans several day buckets
    sdf = spark.createDataFrame(rows, "window_start timestamp_ntz, event_count_1min long, event_count_5min long")
    got = (rolling_baseline(sdf, lookback=6, chunk_rows=10).orderBy("window_start").toPandas())
    pdf = pd.DataFrame(rows, columns=["window_start", "event_count_1min", "event_count_5min"]).astype(
        {"event_count_1min": "float64", "event_count_5min": "float64"})
    for c in ("1min", "5min"):
        x = pdf[f"event_count_{c}"]
        mean = x.rolling(6, min_periods=1).mean()
        std = x.rolling(6, min_periods=2).std().fillna(1.0)
        dev = (x - mean) / std.clip(lower=0.1)
        rate = x.pct_change(fill_method=None).fillna(0)
        np.testing.assert_allclose(got[f"baseline_mean_{c}"].astype(float), mean, rtol=1e-9, equal_nan=True)
        np.testing.assert_allclose(got[f"baseline_std_{c}"].astype(float), std, rtol=1e-9)
        np.testing.assert_allclose(got[f"baseline_deviation_{c}"].astype(float), dev, rtol=1e-9, equal_nan=True)
        np.testing.assert_allclose(got[f"rate_change_{c}"].astype(float), rate, rtol=1e-9)
    assert len(got) == 400


def test_constant_counts_use_std_floor(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, i), 5) for i in range(5)]
    sdf = spark.createDataFrame(rows, "window_start timestamp_ntz, event_count_1min long")
    got = rolling_baseline(sdf).orderBy("window_start").collect()
    assert got[0]["baseline_std_1min"] == 1.0          # fewer than two values
    assert got[3]["baseline_std_1min"] == 0.0 and got[3]["baseline_deviation_1min"] == 0.0


def test_novelty_first_seen_and_memory(spark):
    rows = [{"timestamp": "2024-01-01 00:00:05", "dst_ip": "a", "dst_port": 80},
            {"timestamp": "2024-01-01 00:00:06", "dst_ip": "a", "dst_port": 80},   # seen twice in one window
            {"timestamp": "2024-01-01 00:01:05", "dst_ip": "a", "dst_port": 443},
            {"timestamp": "2024-01-01 00:01:07", "dst_ip": "b", "dst_port": None},
            {"timestamp": "2024-01-01 00:02:00", "dst_ip": None, "dst_port": None}]
    df = ev_frame(spark, rows, ["timestamp", "dst_ip", "dst_port"])
    got = {r["window_start"].minute: r for r in novelty_features(df).collect()}
    assert got[0]["new_dst_ip_count_1min"] == 1 and got[0]["new_dst_ip_ratio_1min"] == 1.0
    assert got[1]["new_dst_ip_count_1min"] == 1 and got[1]["new_dst_ip_ratio_1min"] == 0.5
    assert got[1]["new_dst_port_count_1min"] == 1 and got[1]["new_dst_port_ratio_1min"] == 1.0
    assert 2 not in got                                  # no entity values in that window
    mem = update_memory(None, df)
    again = {r["window_start"].minute: r for r in novelty_features(df, memory=mem).collect()}
    assert all(r["new_dst_ip_count_1min"] in (0, None) for r in again.values())   # seen in an earlier call
    assert {r["entity"] for r in mem.where(F.col("entity_type") == "dst_ip").collect()} == {"a", "b"}


def test_derived_fill_and_clip(spark):
    df = spark.createDataFrame(
        [(1.0, 9.0, 60, 2, 4.5, 3.0, None), (None, 2.0, None, None, None, 0.2, 0.5)],
        "bytes_in_mean_1min double, bytes_out_mean_1min double, unique_dst_ports_1min long, "
        "unique_dst_ips_1min long, port_entropy_1min double, conn_duration_p50_1min double, "
        "failed_auth_ratio_1min double")
    out = fill_and_clip(derived_features(df)).collect()
    assert out[0]["bytes_ratio_1min"] == 1.0               # 4.5 clipped (name contains 'ratio')
    assert out[0]["port_scan_indicator_1min"] == 1 and out[0]["high_entropy_1min"] == 1
    assert out[0]["conn_duration_p50_1min"] == 1.0         # 'du-ratio-n' is clipped too (reference quirk)
    assert out[1]["bytes_ratio_1min"] == 0.0 and out[1]["port_scan_indicator_1min"] == 0
    assert out[1]["unique_dst_ports_1min"] == 0 and out[1]["failed_auth_ratio_1min"] == 0.5
    shares = fill_and_clip(derived_features(df), clip="shares").collect()
    assert shares[0]["conn_duration_p50_1min"] == 3.0 and shares[0]["bytes_ratio_1min"] == 4.5
