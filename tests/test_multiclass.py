from collections import Counter

import pytest
from pyspark.sql import functions as F

from alertloom.operators import multiclass as M


def test_learns_three_classes(spark):
    rows = spark.range(300).select("id", F.rand(1).alias("x"), F.rand(2).alias("y"))
    rows = rows.withColumn("kind", F.when(F.col("x") > 0.6, "a").when(F.col("y") > 0.5, "b").otherwise("c"))
    train = rows.unionByName(rows.limit(5).withColumn("kind", F.lit(None).cast("string")))
    model = M.fit_category(train, ("x", "y"), "kind", {"numTrees": 10})
    assert sorted(model.classes) == ["a", "b", "c"]
    out = M.predict_category(model, rows.withColumn("x", F.when(F.col("id") > 0, F.col("x"))))
    assert out.columns == ["id", "x", "y", "kind", "category_pred"] and out.where("x IS NULL").count() == 1
    assert M.macro_metrics(M.class_metrics(M.confusion_matrix(out, "kind", "category_pred"))).first().accuracy > 0.9
    with pytest.raises(ValueError):
        M.fit_category(rows.where("kind = 'a'"), ("x", "y"), "kind")


def test_metrics_against_plain_python(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("b", None), (None, "a"), (None, None), ("c", "d"), ("a", "a")]
    matrix = M.confusion_matrix(spark.createDataFrame(pairs, "t string, p string"), "t", "p")
    assert {(r.actual, r.predicted): r.n for r in matrix.collect()} == Counter(pairs)
    got = {r["class"]: r for r in M.class_metrics(matrix).collect()}
    assert set(got) == {"a", "b", "c", "d", None}
    for k, r in got.items():
        hits, sup, pre = pairs.count((k, k)), sum(t == k for t, _ in pairs), sum(p == k for _, p in pairs)
        assert (r.hits, r.support, r.predicted) == (hits, sup, pre)
        assert (r.precision, r.recall, r.f1) == pytest.approx((hits / pre if pre else 0, hits / sup if sup else 0, 2 * hits / (sup + pre)))
    macro = M.macro_metrics(M.class_metrics(matrix)).first()
    assert macro.accuracy == 0.5 and macro.macro_f1 == pytest.approx(sum(r.f1 for r in got.values()) / 5) and macro.n_classes == 5
    empty = M.macro_metrics(M.class_metrics(matrix.limit(0))).first()
    assert (empty.n_classes, empty.accuracy, empty.macro_f1) == (0, 0.0, 0.0)
