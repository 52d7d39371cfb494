"""Isolation forest, shared order statistics and sparse one-hot vectors."""

import math

import pytest
from pyspark.sql import functions as F

from alertloom.operators.encoding import one_hot_vector
from alertloom.operators.ordering import kth_values
from alertloom.operators.outliers import fit_isolation_forest, isolation_scores, score_outliers, top_anomalies


def test_every_tree_is_built_from_equal_rows(spark):
    df = spark.range(2000).select("id", F.lit(1.0).alias("x"))
    forest = fit_isolation_forest(df, ["x"], 20, id_col="id")
    assert forest.feature.shape[0] == 20


def test_missing_trees_are_an_error(spark):
    df = spark.range(2000).select(F.lit(7).alias("id"), F.rand(1).alias("x"))
    with pytest.raises(ValueError, match="not unique"):
        fit_isolation_forest(df, ["x"], 20, id_col="id")


def test_scores_keep_rows_with_equal_and_null_keys(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.lit(1)).alias("key"),
                                  F.when(F.col("id") == 17, 50.0).otherwise(F.rand(3)).alias("x"))
    forest = fit_isolation_forest(df, ["x"], 25, id_col="id")
    out = score_outliers(forest, df, ["id", "key"])
    assert out.count() == 1000 and out.where("key is null").count() == 334
    assert top_anomalies(out, 1, id_col="id").first()["id"] == 17
    assert isolation_scores(forest, df.limit(0), ["id"]).count() == 0


def test_ranks_share_rounds_and_stay_exact(spark):
    df = spark.range(5000).select((F.pmod(F.col("id") * 7919, F.lit(997)) / 10.0).alias("v")).unionByName(
        spark.range(3).select(F.lit(None).cast("double").alias("v")))
    s = sorted(r.v for r in df.where("v is not null").collect())
    ranks = [1, 2, 250, 251, 2500, 4750, 5000, 5001, 0, 250]
    assert kth_values(df, "v", ranks, pivots=5) == [s[k - 1] if 1 <= k <= 5000 else None for k in ranks]
    assert kth_values(df.limit(0), "v", [1]) == [None]
    assert math.isnan(kth_values(spark.sql("select explode(array(double('NaN'), 1D, 2D)) v"), "v", [3])[0])


def test_one_hot_vector_takes_any_vocabulary(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") > 0, F.col("id").cast("string")).alias("c"))
    rows = one_hot_vector(df, "c", "oh").collect()
    assert len({int(r.oh.indices[0]) for r in rows}) == 3000 and all(r.oh.size == 3000 for r in rows)


def test_path_lengths_and_scores_are_made_once(spark):
    import numpy as np

    from alertloom.operators import outliers

    df = spark.range(900).select("id", F.rand(1).alias("x"), (F.rand(2) > 0.9).cast("int").alias("y"))
    forest = fit_isolation_forest(df, ["x", "y"], 12, 64, scale=False, id_col="id")
    x = np.array([[r.x, r.y] for r in df.collect()] + [[np.nan, 0.0], [-9.0, 5.0]])
    nodes = {k: getattr(forest, k) for k in outliers._NODE_ARRAYS}
    got = outliers._path_lengths(nodes, x)

    def walk(t, row):
        node = 0
        while forest.feature[t, node] >= 0:
            node = (forest.left if row[forest.feature[t, node]] < forest.threshold[t, node] else forest.right)[t, node]
        return forest.depth[t, node] + outliers.avg_path_length([forest.size[t, node]])[0]

    assert got.tolist() == [[walk(t, row) for t in range(12)] for row in x]
    # The quantiles take passes over the scores, so the walk must not be part of their input.
    scored = score_outliers(forest, df, ["id"])
    assert "MapInPandas" not in scored._jdf.queryExecution().toString() and scored.count() == 900
