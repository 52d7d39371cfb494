import pytest

import __spark_entry__ as E
from alertloom.config import GBT_DEFAULTS
from alertloom.operators import supervised


@pytest.mark.parametrize("query", [E.q_supervised_event_model, E.q_contribution_invariants])
def test_boosted_trees_run_the_default_setting(spark, monkeypatch, query):
    given = []

    class Seen(Exception):
        pass

    def see(kind, params=None, *args, **kwargs):
        given.append((kind, {**GBT_DEFAULTS, **(params or {})}))
        raise Seen

    monkeypatch.setattr(supervised, "make_classifier", see)
    with pytest.raises(Seen):
        query(spark, "/root/testdata/sf0.001")
    assert given == [("gbt", GBT_DEFAULTS)] and GBT_DEFAULTS["maxIter"] == 500 and GBT_DEFAULTS["checkpointInterval"] > 0


@pytest.mark.parametrize("losses, patience, want", [([], 3, (0, False)), ([3, 2, 1], 2, (3, False)), ([3, 2, 2, 2], 2, (2, True)), ([3, 1, 2, 2, 0], 3, (5, False)),
                                                    ([3, 1, 2, 2, 2, 0], 3, (2, True)), ([1, 1, 1], 2, (1, True))])
def test_best_round(losses, patience, want):
    assert supervised.best_round(losses, patience) == want


def test_patience_keeps_the_best_prefix(spark, tmp_path):
    import numpy as np
    r = np.random.default_rng(0)
    x = r.normal(0, 1, (500, 3))
    y = (x[:, 0] + 0.5 * r.normal(0, 1, 500) > 0).astype(int)
    rows = spark.createDataFrame([(*map(float, v), int(k)) for v, k in zip(x, y)], "a double, b double, c double, label int").repartition(2)
    train, val = rows.where("abs(hash(a, b)) % 4 > 0"), rows.where("abs(hash(a, b)) % 4 = 0")
    fit = lambda **kw: supervised.fit_supervised(train, ("a", "b", "c"), params={"maxIter": 24, "stepSize": 0.5, "maxDepth": 4}, validation=val, **kw)
    whole, staged = fit(patience=100, first_rounds=24), fit(patience=4, first_rounds=6)
    losses = whole.meta["validation_losses"]
    best, _ = supervised.best_round(losses, 4)
    assert len(losses) == 24 and 1 < best < 20 and staged.meta["rounds"] == best and staged.meta["rounds_tried"] < 24
    assert staged.meta["validation_losses"] == pytest.approx(losses[: staged.meta["rounds_tried"]])
    assert staged.classifier.getNumTrees == best and whole.meta["rounds"] == int(np.argmin(losses)) + 1 == whole.classifier.getNumTrees
    supervised.save_supervised(staged, str(tmp_path / "m"))
    again = supervised.load_supervised(str(tmp_path / "m"))
    assert again.meta["rounds"] == best
    same = [supervised.predict_proba(m, val, "p").select("a", "p").orderBy("a").collect() for m in (staged, again)]
    assert same[0] == same[1]


def test_rows_are_spread_and_the_prefix_is_not_fitted_again(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    from alertloom.session import spread
    assert spread(spark.range(0, 100, 1, 1), 100).rdd.getNumPartitions() == 1
    assert spread(spark.range(0, 90_000, 1, 1), 90_000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    fits, own = [], GBTClassifier._fit

    def fit(self, df):
        fits.append(self.getMaxIter())
        return own(self, df)

    monkeypatch.setattr(GBTClassifier, "_fit", fit)
    rows = spark.range(600).selectExpr("cast(id * 37 % 101 as double) a", "cast(id % 7 as double) b", "cast(id * 37 % 101 + id * 11 % 60 > 80 as int) label")
    train, val = rows.where("b < 5"), rows.where("b >= 5")
    model = supervised.fit_supervised(train, ("a", "b"), params={"maxIter": 16, "stepSize": 0.5, "maxDepth": 4}, validation=val, patience=3, first_rounds=4)
    assert len(fits) <= 2 and set(fits) <= {4, 16} and model.classifier.getNumTrees == model.meta["rounds"]


def test_walk_equals_the_trees(spark):
    import numpy as np

    from pyspark.ml.functions import vector_to_array
    rows = spark.range(500).selectExpr("id", "cast(id * 37 % 101 as double) a", "cast(id % 7 as double) b", "cast(id * 37 % 101 + id * 11 % 60 > 80 as int) label")
    model = supervised.fit_supervised(rows, ("a", "b"), params={"maxIter": 8, "maxDepth": 4})
    con = supervised.contributions(model, rows, keep=("id",))
    own = model.model.transform(con).select("margin", "base", "contributions", vector_to_array("probability")[1].alias("p")).collect()
    assert len(own) == 500
    for r in own:
        assert r.margin == pytest.approx(r.base + sum(r.contributions)) and 1 / (1 + np.exp(-2 * r.margin)) == pytest.approx(r.p, abs=1e-9)


def test_trees_are_those_of_mllib_without_its_fit(spark, monkeypatch):
    import re

    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    rows = spark.range(0, 3000, 1, 2).selectExpr("id", "cast(id * 37 % 1009 as double) a", "cast(id % 7 as double) b", "cast(id * 11 % 59 as double) c",
                                                 "cast(id * 37 % 1009 + pmod(hash(id), 1000) > 1000 as int) label")
    params = {"maxIter": 7, "maxDepth": 3, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.5", "stepSize": 0.3}
    clf = GBTClassifier(labelCol="label_d", seed=42, **params)
    own = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"), clf]).fit(rows.selectExpr("*", "cast(label as double) label_d").coalesce(1))
    monkeypatch.setattr(supervised, "PACKED_ROWS", 0)
    monkeypatch.setattr(GBTClassifier, "_fit", lambda *_: pytest.fail("a job and an object per row and level"))
    model = supervised.fit_supervised(rows.coalesce(1), ("a", "b", "c"), params=params, balance=False)
    shown = lambda m: [re.sub(r"uid=\w+", "", re.sub(r"-?\d+\.\d+(E-?\d+)?", lambda x: f"{float(x[0]):.6g}", t.toDebugString)) for t in m.trees]
    assert shown(model.classifier) == shown(own.stages[-1]) and model.classifier.treeWeights == own.stages[-1].treeWeights
    assert model.classifier.featureImportances.toArray() == pytest.approx(own.stages[-1].featureImportances.toArray())


def test_draws_are_those_of_spark(spark):
    import numpy as np

    from alertloom.operators import boosting
    own = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(-5)
    tables, s = boosting.draw_tables(), boosting.xorshift_start(-5)
    (a, s), n = boosting.draws(s, tables, 0.8), 300
    assert [own.nextDouble() < 0.8 for _ in range(n)] == a[:n].tolist()
    at = boosting.xorshift_start(-5)
    for _ in range(2 * boosting.DRAWN):
        at = boosting.xorshift_step(at)
    assert s == at and 0.79 < np.mean(a) < 0.81


def test_rows_of_a_cell_count_each_for_itself(spark):
    import numpy as np

    from alertloom.operators import boosting
    rows = spark.range(0, 900, 1, 1).selectExpr("cast(id % 3 as double) a", "cast(id % 2 as double) b", "cast(id % 5 = 0 as double) label_d", "id % 9 = 0 _val")
    held, kept = (boosting.packed(rows, ("a", "b"), [np.array([0.5, 1.5]), np.array([0.5])]).where(f"{x} held").collect() for x in ("", "not"))
    assert len(held) == len(kept) == 1 and len(kept[0].sign) == 12 and len(held[0].cell) // 4 == 100 and len(kept[0].cell) // 4 == 800
    assert boosting.bundles([33, 1, 1, 1, 40]) == [[1, 2, 3], [0], [4]]


def test_labels_beyond_two_classes_raise(spark, monkeypatch):
    monkeypatch.setattr(supervised, "PACKED_ROWS", 0)
    for bad in ("cast(id % 3 as int)", "if(id = 4, null, 1)"):
        with pytest.raises(ValueError, match="labels 0 and 1"):
            supervised.fit_supervised(spark.range(9).selectExpr("cast(id as double) a", f"{bad} label"), ("a",), params={"maxIter": 1})


def test_ranks_draw_their_pivots_without_a_shuffle_of_all_rows(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from alertloom.operators.ordering import kth_values
    monkeypatch.setattr(DataFrame, "groupBy", (lambda own: lambda df, *c: pytest.fail("all rows by value") if [str(x) for x in c] == ["_k"] else own(df, *c))(DataFrame.groupBy))
    df = spark.range(2000).selectExpr("id * 7919 % 2003 v").unionAll(spark.range(500).selectExpr("5 v")).unionAll(spark.range(3).selectExpr("null v"))
    want = sorted(r.v for r in df.collect() if r.v is not None)
    assert kth_values(df, "v", [1, 7, 300, 1250, 2500, 2501], pivots=5) == [want[k - 1] for k in (1, 7, 300, 1250, 2500)] + [None]


def test_packed_rows_stop_where_the_staged_fit_does(spark, monkeypatch):
    rows = spark.range(0, 600, 1, 1).selectExpr("cast(id * 37 % 101 as double) a", "cast(id % 7 as double) b", "cast(id * 37 % 101 + pmod(hash(id), 100) > 100 as int) label")
    train, val = rows.where("b < 5"), rows.where("b >= 5")
    fit = lambda: supervised.fit_supervised(train, ("a", "b"), params={"maxIter": 12, "stepSize": 0.5, "maxDepth": 3}, validation=val, patience=3, first_rounds=12)
    own = fit()
    monkeypatch.setattr(supervised, "PACKED_ROWS", 0)
    packed = fit()
    assert packed.meta["validation_losses"] == pytest.approx(own.meta["validation_losses"]) and packed.meta["rounds"] == own.meta["rounds"] == packed.classifier.getNumTrees
