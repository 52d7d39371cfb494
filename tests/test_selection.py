import json

import pytest
from pyspark.sql import functions as F

from alertloom.operators import selection as S


@pytest.fixture(scope="module")
def parts(spark):
    rows = spark.range(400).select("id", F.randn(1).alias("a"), F.randn(2).alias("b")).withColumn("label", (F.col("a") + F.col("b") > 0.3).cast("int"))
    return rows.where("id % 3 > 0"), rows.where("id % 3 = 0")


def test_a_broken_model_leaves_the_others(parts):
    train, test = parts

    def broken(train, validation):
        raise RuntimeError("no memory\nmore")

    models = {"logistic": {"kind": "lr"}, "broken": broken, "unknown": {"kind": "none"},
              "constant": lambda train, validation: lambda rows: rows.withColumn("y_score", F.lit(0.7))}
    out = S.compare_models(train, test, ("a", "b"), models)
    got = {r.model: r for r in out.collect()}
    assert {m: r.status for m, r in got.items()} == {"logistic": "ok", "broken": "failed", "unknown": "failed", "constant": "ok"}
    assert got["broken"].error == "RuntimeError: no memory" and got["broken"].roc_auc is None and got["unknown"].error.startswith("ValueError")
    positives, n = test.where("label = 1").count(), test.count()
    assert (got["constant"].true_positives, got["constant"].false_positives, got["constant"].roc_auc) == (positives, n - positives, 0.5)
    assert got["logistic"].roc_auc > 0.95
    best = S.best_models(out).first()
    assert best.best_roc_auc == best.best_pr_auc == "logistic" and best.least_fit_seconds == "constant"
    assert S.compare_models(train, test, ("a", "b"), {}).count() == 0


def test_best_models_ties_and_missing(spark):
    m = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None), ("d", float("nan"))], "model string, f1 double")
    assert S.best_models(m, ("f1",), ("f1",)).first() == ("a", "a")
    assert S.best_models(m.where("f1 IS NULL"), ("f1",), ()).first() == (None,)


def test_search_is_repeatable(parts):
    train, val = parts
    space = {**S.SEARCH_SPACES["lr"], "maxIter": ("choice", [5, 50, -1])}
    run = lambda n, p: S.random_search(train, val, ("a", "b"), kind="lr", space=space, trials=n, seed=3, parallelism=p)
    first, again = run(4, 1), run(6, 3)
    key = lambda df: {r.trial: (r.params, r.status, r.roc_auc) for r in df.collect()}
    a, b = key(first), key(again)
    assert {t: b[t] for t in a} == a and len(b) == 6
    for p, status, auc in b.values():
        drawn = json.loads(p)
        assert (status == "failed") == (drawn["maxIter"] == -1) == (auc is None)
        assert 1e-8 <= drawn["regParam"] <= 10 and 0 <= drawn["elasticNetParam"] <= 1
    ok = {t: v for t, v in b.items() if v[1] == "ok"}
    assert S.best_params(again) == json.loads(ok[max(ok, key=lambda t: (ok[t][2], -t))][0])
    with pytest.raises(ValueError):
        S.draw_params({"x": ("normal", 0, 1)}, 0, 0)
