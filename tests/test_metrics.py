import datetime as dt
import random

import numpy as np
import pytest

from alertloom.operators import evaluate as EV
from alertloom.operators.ordering import kth_smallest


def _frame(spark, ys, ss, ids=None):
    ids = ids or list(range(len(ys)))
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=i), y, s) for i, y, s in zip(ids, ys, ss)]
    return spark.createDataFrame(rows, "id long, ts timestamp_ntz, y_true int, y_score double")


def _auc_pairs(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _ap(ys, ss):
    order = sorted(set(ss), reverse=True)
    P = sum(ys)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for y, s in zip(ys, ss) if s >= t and y == 1)
        fp = sum(1 for y, s in zip(ys, ss) if s >= t and y == 0)
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


def _fpr_walk(ys, ss, ids, target):
    P = sum(ys)
    N = len(ys) - P
    if P == 0 or N == 0:
        return 0.0
    order = sorted(range(len(ys)), key=lambda i: (-ss[i], ids[i]))
    t = int(target * P)
    tp = fp = 0
    for i in order:
        if ys[i]:
            tp += 1
        else:
            fp += 1
        if tp >= t:
            break
    return fp / N


@pytest.mark.parametrize("seed", [1, 2])
def test_auc_ap_fpr_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    ys = [1 if rnd.random() < 0.3 else 0 for _ in range(300)]
    ss = [round(rnd.random() * (0.6 + 0.4 * y), 2) for y in ys]     # coarse scores -> ties
    df = _frame(spark, ys, ss)
    assert EV.roc_auc(df).first()["roc_auc"] == pytest.approx(_auc_pairs(ys, ss))
    assert EV.average_precision(df).first()["pr_auc"] == pytest.approx(_ap(ys, ss))
    for t in (0.5, 0.9, 0.95, 0.99):
        assert EV.fpr_at_recall(df, t).first()["fpr"] == pytest.approx(_fpr_walk(ys, ss, list(range(300)), t))


def test_one_class_metrics_are_zero(spark):
    df = _frame(spark, [0, 0, 0], [0.1, 0.2, 0.3])
    assert EV.roc_auc(df).first()["roc_auc"] == 0.0
    assert EV.average_precision(df).first()["pr_auc"] == 0.0
    assert EV.fpr_at_recall(df, 0.9).first()["fpr"] == 0.0
    c = EV.confusion_metrics(df).first()
    assert c["precision"] == 0.0 and c["recall"] == 0.0 and c["f1"] == 0.0


def test_confusion(spark):
    df = _frame(spark, [1, 1, 0, 0, 1], [0.9, 0.4, 0.6, 0.1, 0.5])
    c = EV.confusion_metrics(df).first()
    assert (c["true_positives"], c["false_positives"], c["true_negatives"], c["false_negatives"]) == (2, 1, 1, 1)
    assert c["f1"] == pytest.approx(2 / 3) and c["fpr"] == 0.5


def test_detection_latency_counts_row_after_episode(spark):
    ys = [0, 1, 1, 0, 0, 1, 0, 1, 1, 1, 0]
    ps = [0, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0]   # ep1 detected on the normal row after it; ep2 missed; ep3 at +2
    df = _frame(spark, ys, [float(p) for p in ps])
    r = EV.detection_latency(df, chunk_rows=4).first()
    assert r["attacks_total"] == 3 and r["attacks_detected"] == 2
    assert r["mean_latency_windows"] == pytest.approx(2.0) and r["detection_rate"] == pytest.approx(2 / 3)


def test_fpr_curve(spark):
    ys = [1, 1, 1, 1, 0, 0, 0, 1, 0, 1]
    ss = [0.9, 0.8, 0.7, 0.6, 0.65, 0.3, 0.2, 0.55, 0.75, 0.95]
    df = _frame(spark, ys, ss)
    r = EV.fpr_at_recall_curve(df, 0.95).first()
    # recall at threshold 0.6 = 5/6 <= 0.95 and 0.6 is the smallest such threshold above 0.55
    assert r["threshold"] == 0.6 and r["fpr"] == pytest.approx(2 / 4)


def test_kth_smallest_refines(spark):
    rnd = random.Random(5)
    vals = [rnd.randint(0, 10_000) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    s = sorted(vals)
    for k in (1, 17, 2500, 5000):
        assert kth_smallest(df, "v", k, pivots=15) == s[k - 1]
    assert kth_smallest(df, "v", 5001) is None


def test_kth_smallest_of_other_types(spark):
    big = [2**62 + i for i in (5, 3, 3, 4, 9)]  # equal as doubles
    names = ["b", "a", "é", "a", "c"]
    times = [dt.datetime(2024, 1, 1, 0, 0, i) for i in (3, 1, 2, 2, 0)]
    df = spark.createDataFrame(list(zip(big, names, times)), "v long, s string, t timestamp_ntz")
    for col, vals in (("v", big), ("s", names), ("t", times)):
        assert kth_smallest(df, col, 3, pivots=2) == sorted(vals)[2]
