import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.config import Condition, Rule, RuleSet
from alertloom.operators import outliers, supervised, unified

RULES = RuleSet([Rule("big", "", (Condition("a", ">", 1.0),), "high", 0.4), Rule("both", "", (Condition("a", ">", 0.0), Condition("b", "<", 0.0)), "low", 0.3)],
                {"high": 0.8, "low": 0.2})


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (300, 2))
    y = (x.sum(axis=1) > 0.5).astype(int)
    data = [(i, float(a), float(b), int(k), "t") for i, ((a, b), k) in enumerate(zip(x, y))] + [(300, None, 1.0, 1, None)]
    return spark.createDataFrame(data, "event_id long, a double, b double, label int, severity string").repartition(3)


@pytest.fixture(scope="module")
def scorer(rows):
    return unified.fit_unified(rows, ("a", "b"), rules=RULES, params={"maxIter": 5}, n_trees=20, sample_size=64)


def as_rows(df):
    return {r["event_id"]: r for r in df.collect()}


def test_scores_are_the_parts(rows, scorer):
    got = as_rows(scorer.score(rows, top_k=2))
    lgb = as_rows(supervised.predict_proba(scorer.supervised, rows, "p"))
    raw = as_rows(outliers.isolation_scores(scorer.forest, rows, ["event_id"]))
    con = as_rows(supervised.contributions(scorer.supervised, rows, ("event_id",)))
    p5, p50, p95 = scorer.forest.quantiles
    assert p5 < p50 < p95 and len(got) == 301
    for r in rows.collect():
        g, a, b = got[r.event_id], r.a, r.b
        base = 0.4 * (a is not None and a > 1) + 0.3 * (a is not None and a > 0 and b < 0)
        iso = 1 / (1 + np.exp(-(raw[r.event_id].if_raw - p50) / max(p95 - p50, p50 - p5, 0.1)))
        assert (g.a, g.b, g.label) == (a, b, r.label)
        assert g.baseline_score == pytest.approx(base) and g.lgb_score == pytest.approx(lgb[r.event_id].p) and g.if_score == pytest.approx(iso)
        assert g.anomaly_score == pytest.approx(0.2 * base + 0.5 * g.lgb_score + 0.3 * iso)
        assert [x.contribution for x in g.lgb_top_features] == pytest.approx(sorted(con[r.event_id].contributions, key=abs, reverse=True))


def test_one_window_a_bundle_and_a_stream_score_alike(spark, rows, scorer, tmp_path):
    cols = ("event_id", "lgb_score", "if_score", "anomaly_score", "severity")
    want = as_rows(scorer.score(rows).select(*cols))
    one = scorer.score_window(rows, 7, "event_id").select(*cols).collect()
    assert one == [want[7]]
    scorer.save(str(tmp_path / "bundle"))
    again = unified.UnifiedScorer.load(str(tmp_path / "bundle"))
    assert again.rules == scorer.rules and again.stats == scorer.stats and as_rows(again.score(rows).select(*cols)) == want
    rows.write.parquet(str(tmp_path / "in"))
    stream = again.score(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).select(*cols)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    assert query.awaitTermination(90) and as_rows(spark.read.parquet(str(tmp_path / "out"))) == want


def test_missing_scorers_and_refusals(spark, rows, scorer, tmp_path):
    only = unified.UnifiedScorer(RULES)
    got = as_rows(only.score(rows))
    assert all(g.anomaly_score == pytest.approx(g.baseline_score) and g.lgb_score == g.if_score == 0 for g in got.values())
    only.save(str(tmp_path / "b"))
    assert unified.UnifiedScorer.load(str(tmp_path / "b")).forest is None
    given = as_rows(only.score(rows.withColumn("lgb_score", F.lit(0.5)), given=("lgb_score",)))
    assert all(g.anomaly_score == pytest.approx((0.2 * g.baseline_score + 0.25) / 0.7) for g in given.values())
    assert scorer.score(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        scorer.score(rows, given=("lgb_score",))
    loose = unified.UnifiedScorer(RULES, forest=outliers.Forest(**{**vars(scorer.forest), "quantiles": None}))
    rows.write.parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        loose.score(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))


def test_training_rows_are_made_once(spark):
    from pyspark.sql import functions as F

    from alertloom.operators.unified import fit_unified

    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def half(x):
        made.add(1)
        return x / 2

    rows = spark.range(400).select(F.col("id").alias("event_id"), (F.col("id") % 2).cast("int").alias("label"),
                                   half((F.col("id") * 7 % 101).cast("double")).alias("a"), (F.col("id") % 13).cast("double").alias("b"))
    fit_unified(rows, ("a", "b"), kind="lr", n_trees=5, sample_size=32)
    assert made.value == 400
