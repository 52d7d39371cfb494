import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.operators import sampling as SA
from alertloom.operators.encoding import event_vector
from alertloom.operators.explain import explain_top_k, narrative, percentile_rank
from alertloom.operators.profile import class_balance, null_profile
from alertloom.operators.scaling import exact_quantiles, percentile_sigmoid


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(11)
    vals = [rnd.random() * 100 for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = exact_quantiles(df, "v", (0.05, 0.5, 0.95))
    np.testing.assert_allclose(got, np.percentile(vals, [5, 50, 95]), rtol=1e-12)


def test_single_row_sigmoid_is_half(spark):
    out, _ = percentile_sigmoid(spark.createDataFrame([(3.0,)], "s double"), "s", "n")
    assert out.first()["n"] == 0.5


def test_stratified_quotas(spark):
    df = spark.createDataFrame([(i, 1 if i % 10 == 0 else 0) for i in range(1000)], "id long, label int")
    sp = SA.stratified_split(df, "label", 0.2, "id")
    got = {(r["label"], r["split"]): r["c"] for r in sp.groupBy("label", "split").agg(F.count("*").alias("c")).collect()}
    assert got[(1, "test")] == 20 and got[(0, "test")] == 180
    smp = SA.stratified_sample(df, 101, "label", "id")
    assert smp.count() == 101


def test_profiles(spark):
    df = spark.createDataFrame([(1, None), (0, 2.0), (0, 3.0)], "label int, x double")
    cb = {r["label"]: r for r in class_balance(df).collect()}
    assert cb[1]["count"] == 1 and cb[0]["imbalance_ratio"] == 2.0
    nulls = {r["column"]: r["null_count"] for r in null_profile(df).collect()}
    assert nulls == {"label": 0, "x": 1}


def test_percentile_rank_and_explanations(spark):
    df = spark.createDataFrame([(0.0, 1.5, 10.0, 0.5, -2.0, 0.1)], "a double, b double, c double, ca double, cb double, cc double")
    r = df.select(percentile_rank(F.col("b"), [1.0, 2.0, 3.0, 4.0, 5.0]).alias("p")).first()["p"]
    assert r == pytest.approx(25.0 - 15.0 * 0.5)
    ex = explain_top_k(df, ["a", "b", "c"], ["ca", "cb", "cc"], {}, top_k=2)
    row = ex.select("explanations", narrative(F.lit(0.72), F.col("explanations")).alias("n")).first()
    assert [e["feature"] for e in row["explanations"]] == ["b", "a"]
    assert row["explanations"][0]["direction"] == "decreases" and row["explanations"][0]["percentile"] == 50.0
    assert row["n"].startswith("This event window has a high anomaly score (0.72). The primary driver is a ")


def test_event_vector_unknown_protocol(spark):
    ev = spark.createDataFrame([(1, "HTTPS", 443, None, "failed"), (2, "gopher", 70, 5.0, "success")],
                               "event_id long, protocol string, dst_port int, bytes_out double, status string")
    out = {r["event_id"]: r for r in event_vector(ev, ["dst_port", "bytes_out", "proto_https", "status_failed"]).collect()}
    assert out[1]["proto_https"] == 1.0 and out[1]["bytes_out"] == 0.0 and out[1]["status_failed"] == 1.0
    assert out[2]["proto_https"] == 0.0 and out[2]["status_failed"] == 0.0
