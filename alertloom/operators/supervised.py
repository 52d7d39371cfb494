"""Supervised scorers on MLlib, calibration and per-row contributions.

* M1 -- the boosted-tree slot is MLlib ``GBTClassifier`` (depth 6, step 0.05, 0.8 row and
  feature sampling, its trees trained by ``boosting``, early stop after rounds without gain on the validation rows); ``rf`` and ``lr`` fill the
  other ensemble slots. Class balancing is an explicit ``weightCol`` (negatives / positives).
* M2 -- isotonic calibration (``IsotonicRegression``: linear interpolation, clamped ends), fitted
  on the validation rows and saved with the model.
* M3 -- per-row feature contributions of the boosted trees by path attribution: the trees'
  node table is read from the saved model (bounded by trees x nodes, broadcast once) and every
  Arrow batch walks all trees with numpy. ``base + sum(contributions) = margin`` exactly.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.config import GBT_DEFAULTS, GBT_PATIENCE
from alertloom.operators.boosting import fit_boosted_trees
from alertloom.session import checkpoint_dir, cut_lineage, spread

# From so many rows on, boosting's trainer is the faster one: a job of Python tasks takes longer to start than MLlib's.
PACKED_ROWS = 100_000


def make_classifier(kind: str, params: dict | None = None, weight_col: str | None = "weight"):
    p = dict(params or {})
    common = {"featuresCol": "features", "labelCol": "label_d"}
    if weight_col:
        common["weightCol"] = weight_col
    if kind == "gbt":
        return GBTClassifier(**{**GBT_DEFAULTS, **p, **common})
    if kind == "rf":
        return RandomForestClassifier(**{"numTrees": 200, "maxDepth": 6, "seed": 42, **p, **common})
    if kind == "lr":
        return LogisticRegression(**{"maxIter": 100, "regParam": 0.01, **p, **common})
    raise ValueError(f"unknown model kind {kind!r}")


@dataclass
class SupervisedModel:
    kind: str
    features: list[str]
    model: PipelineModel
    calibrator: IsotonicRegressionModel | None = None
    positive_weight: float = 1.0
    meta: dict = field(default_factory=dict)

    @property
    def classifier(self):
        return self.model.stages[-1]


def _prepare(df: DataFrame, features: Sequence[str], label: str | None) -> DataFrame:
    cols = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}
    out = df.withColumns(cols)
    if label:
        out = out.withColumn("label_d", F.col(label).cast("double"))
    return out


def best_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """(best round, whether to stop): the first round of least loss before ``patience`` rounds bring nothing better."""
    best, at = float("inf"), 0
    for i, loss in enumerate(losses, 1):
        if loss < best:
            best, at = loss, i
        elif i - at >= patience:
            return at, True
    return at, False


def _fit_staged(clf, train: DataFrame, validation: DataFrame, patience: int, first: int):
    """Boosted trees with early stopping by patience: (model, {rounds, rounds_tried, validation_losses}).

    MLlib's own validation stops as soon as one round gains less than 1 %, which small steps never do. Here so many rounds are
    trained, and the loss after every round is measured on all validation rows; when ``patience`` rounds have brought nothing, or
    the setting's rounds are used up, the best prefix of the ensemble is kept. If not, all rounds are trained in a second fit, as
    MLlib cannot go on from a model. Training is seeded and its rows are written first, so more rounds have the same first trees
    and a prefix needs no fit of its own. ``rounds_tried`` are the rounds up to the stop.
    """
    train, validation = cut_lineage(train), cut_lineage(validation)
    most = clf.getMaxIter()
    for rounds in sorted({min(first, most), most}):
        model = clf.copy({clf.maxIter: rounds}).fit(train)
        losses = list(model.evaluateEachIteration(validation))
        best, stop = best_round(losses, patience)
        if stop:
            break
    tried = best + patience if stop else rounds
    return _first_trees(model, best), {"rounds": best, "rounds_tried": tried, "validation_losses": losses[:tried]}


def _first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The ensemble of the first ``n`` trees."""
    if n == model.getNumTrees:
        return model
    sc, own = SparkSession.getActiveSession().sparkContext, model._java_obj
    trees = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = sc._gateway.new_array(sc._jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = own.trees()[i], float(own.treeWeights()[i])
    cut = GBTClassificationModel(sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(own.uid(), trees, weights, own.numFeatures(), own.numClasses()))
    cut._resetUid(model.uid)
    return model._copyValues(cut)


def fit_supervised(train: DataFrame, features: Sequence[str], label: str = "label", kind: str = "gbt",
                   params: dict | None = None, balance: bool = True, validation: DataFrame | None = None,
                   calibrate: bool = True, patience: int = GBT_PATIENCE, first_rounds: int = 2 * GBT_PATIENCE) -> SupervisedModel:
    """M1 (+P3, M2): fit on ``train``; when ``validation`` is given it drives early stopping
    (boosted trees, after ``patience`` rounds without gain) and the isotonic calibration.
    Without a validation row all rounds are trained.

    From ``PACKED_ROWS`` rows on, boosted trees are trained by :func:`boosting.fit_boosted_trees`, which looks at the loss after every
    round, ends at the stop and needs no ``first_rounds``; fewer rows by MLlib itself. The trees are the same up to the rounding of sums."""
    feats = list(features)
    checkpoint_dir(train.sparkSession)  # without a folder checkpointInterval has no effect
    data = _prepare(train, feats, label).withColumn("_val", F.lit(False))
    if validation is not None:
        data = data.unionByName(_prepare(validation, feats, label).withColumn("_val", F.lit(True)))
    w = 1.0
    r = data.agg(F.count(F.when(~F.col("_val") & (F.col("label_d") == 1), 1)).alias("p"),
                 F.count(F.when(~F.col("_val") & (F.col("label_d") != 1), 1)).alias("n"), F.count(F.when(F.col("_val"), 1)).alias("held"),
                 F.count(F.lit(1)).alias("rows")).first()
    if balance:
        w = r["n"] / max(r["p"], 1)
    clf = make_classifier(kind, params, "weight")
    assembler = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep")
    meta: dict = {}
    if kind == "gbt" and r["rows"] >= PACKED_ROWS:
        data = cut_lineage(spread(data, r["rows"]).select(*feats, "label_d", "_val"))
        last, losses = fit_boosted_trees(clf, data, feats, float(w), r["rows"] - r["held"], r["p"], r["held"], lambda x: best_round(x, patience))
        if losses:
            meta = {"rounds": last.getNumTrees, "rounds_tried": len(losses), "validation_losses": losses}
        model = PipelineModel([assembler, last])
    else:
        if kind == "gbt":
            data = spread(data, r["rows"])  # some jobs a round go over these rows
        data = data.withColumn("weight", F.when(F.col("label_d") == 1, F.lit(float(w))).otherwise(F.lit(1.0)))
        if kind == "gbt" and r["held"]:
            narrow = cut_lineage(assembler.transform(data).select("features", "label_d", "weight", "_val"))
            last, meta = _fit_staged(clf, narrow.where(~F.col("_val")), narrow.where("_val"), patience, first_rounds)
            model = PipelineModel([assembler, last])
        else:
            model = Pipeline(stages=[assembler, clf]).fit(data.where(~F.col("_val")))
    sm = SupervisedModel(kind, feats, model, None, w, meta)
    if calibrate and validation is not None:
        raw = _raw_probability(sm, _prepare(validation, feats, label))
        sm.calibrator = IsotonicRegression(featuresCol="_p", labelCol="label_d", predictionCol="_cal").fit(
            raw.select(F.col("_p"), F.col("label_d")))
    return sm


def _raw_probability(model: SupervisedModel, prepared: DataFrame) -> DataFrame:
    out = model.model.transform(prepared)
    return out.withColumn("_p", vector_to_array(F.col("probability"))[1]).drop(
        "features", "rawPrediction", "probability", "prediction")


def predict_proba(model: SupervisedModel, df: DataFrame, out: str = "lgb_score") -> DataFrame:
    """Probability of class 1 (calibrated when a calibrator exists); keeps all input columns."""
    prepared = _prepare(df, model.features, None).select(
        *[F.col(c) for c in df.columns if c not in model.features], *model.features)
    raw = _raw_probability(model, prepared)
    if model.calibrator is not None:
        raw = model.calibrator.transform(raw.withColumn("_p", F.col("_p"))).withColumn("_p", F.col("_cal")).drop("_cal")
    return raw.withColumnRenamed("_p", out)


def predict(model: SupervisedModel, df: DataFrame, threshold: float = 0.5, out: str = "prediction") -> DataFrame:
    """``probability >= threshold`` as 0/1."""
    return predict_proba(model, df, "_prob").withColumn(out, (F.col("_prob") >= threshold).cast("int")).drop("_prob")


def feature_importance(model: SupervisedModel) -> DataFrame:
    """T5: importance per feature, largest first (MLlib importances are normalised to sum 1;
    for ``lr`` the absolute coefficients)."""
    spark = SparkSession.getActiveSession()
    clf = model.classifier
    vals = (clf.featureImportances.toArray() if hasattr(clf, "featureImportances")
            else np.abs(clf.coefficients.toArray()))
    rows = [(f, float(v)) for f, v in zip(model.features, vals)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


# ------------------------------------------------------------------------------ persistence

def save_supervised(model: SupervisedModel, path: str) -> None:
    model.model.write().overwrite().save(f"{path}/pipeline")
    if model.calibrator is not None:
        model.calibrator.write().overwrite().save(f"{path}/calibrator")
    spark = SparkSession.getActiveSession()
    meta = {"kind": model.kind, "features": model.features, "positive_weight": model.positive_weight,
            "calibrated": model.calibrator is not None, **model.meta}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_supervised(path: str) -> SupervisedModel:
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
    cal = IsotonicRegressionModel.load(f"{path}/calibrator") if meta.get("calibrated") else None
    known = ("kind", "features", "positive_weight", "calibrated")
    return SupervisedModel(meta["kind"], meta["features"], PipelineModel.load(f"{path}/pipeline"), cal,
                           meta.get("positive_weight", 1.0), {k: v for k, v in meta.items() if k not in known})


# ------------------------------------------------------------------------------ contributions (M3)

@dataclass
class TreeTable:
    """Flat arrays of every tree's nodes (indexed by node id within the tree)."""
    weights: np.ndarray
    feature: list[np.ndarray]
    threshold: list[np.ndarray]
    left: list[np.ndarray]
    right: list[np.ndarray]
    value: list[np.ndarray]


def tree_table(model: SupervisedModel) -> TreeTable:
    """Read the boosted trees' node table from the saved model (one row per node)."""
    if model.kind != "gbt":
        raise ValueError("contributions are defined for the boosted-tree model")
    spark = SparkSession.getActiveSession()
    path = f"{checkpoint_dir(spark)}/alertloom-trees-{uuid.uuid4().hex}"
    model.classifier.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        "nodeData.split.featureIndex", F.try_element_at(F.col("nodeData.split.leftCategoriesOrThreshold"), F.lit(1)).alias("thr")
    ).toPandas()          # bounded: trees x (2^(depth+1) - 1) nodes
    weights = np.asarray(model.classifier.treeWeights, dtype=float)
    tab = TreeTable(weights, [], [], [], [], [])
    for t in range(len(weights)):
        g = nodes[nodes.treeID == t].sort_values("id")
        n = int(g["id"].max()) + 1
        feat = np.full(n, -1, dtype=np.int64)
        thr = np.zeros(n)
        left = np.full(n, -1, dtype=np.int64)
        right = np.full(n, -1, dtype=np.int64)
        val = np.zeros(n)
        ids = g["id"].to_numpy()
        feat[ids] = np.where(g["leftChild"].to_numpy() >= 0, g["featureIndex"].to_numpy(), -1)
        thr[ids] = g["thr"].fillna(0.0).to_numpy()
        left[ids] = g["leftChild"].to_numpy()
        right[ids] = g["rightChild"].to_numpy()
        val[ids] = g["prediction"].to_numpy()
        for lst, arr in ((tab.feature, feat), (tab.threshold, thr), (tab.left, left), (tab.right, right),
                         (tab.value, val)):
            lst.append(arr)
    return tab


def _root(tab: TreeTable, t: int) -> int:
    # the root is the node no other node points to
    kids = set(tab.left[t][tab.left[t] >= 0]) | set(tab.right[t][tab.right[t] >= 0])
    return next(i for i in range(len(tab.value[t])) if i not in kids)


def walk_trees(tables, x: np.ndarray) -> np.ndarray:
    """Contributions (rows x features) of plain node arrays: each step down a tree moves its value to the split's feature.

    Leaves lead back to themselves and move nothing, so all rows take the same number of steps.
    """
    made = []
    for w, feature, threshold, left, right, value, root in zip(*tables):
        leaf, own = feature < 0, np.arange(len(feature))
        kids = np.stack([np.where(leaf, own, right), np.where(leaf, own, left)], axis=1)
        moves = np.where(leaf[:, None], 0.0, w * (value[kids] - value[:, None]))
        steps, level = 0, np.array([root])
        while (level := level[~leaf[level]]).size:
            steps, level = steps + 1, kids[level].ravel()
        made.append((np.where(leaf, 0, feature), threshold, kids.ravel(), moves.ravel(), steps, root))
    contrib = np.zeros(x.shape)
    for start in range(0, len(x), 4096):  # small enough to stay in the cache
        part = np.ascontiguousarray(x[start : start + 4096])
        m, d = part.shape
        flat, rows, out = part.ravel(), np.arange(m) * d, contrib[start : start + m].reshape(-1)
        for feature, threshold, kids, moves, steps, root in made:
            node = np.full(m, root, dtype=np.int64)
            for _ in range(steps):
                at = rows + feature.take(node)
                child = 2 * node + (flat.take(at) <= threshold.take(node))
                out[at] += moves.take(child)
                node = kids.take(child)
    return contrib


def contribution_column(model: SupervisedModel) -> Column:
    """M3 as a column: array<double> of the boosted trees' contributions, one per feature, beside any other columns."""
    tab = tree_table(model)
    roots = [_root(tab, t) for t in range(len(tab.weights))]
    spark = SparkSession.getActiveSession()
    bc = spark.sparkContext.broadcast((tab.weights, tab.feature, tab.threshold, tab.left, tab.right, tab.value, roots))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def walk(x: pd.Series) -> pd.Series:
        return pd.Series(list(walk_trees(bc.value, np.stack(x.to_numpy()).astype(float))))

    return walk(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in model.features]))


def contributions(model: SupervisedModel, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """M3: ``keep`` columns + features + ``contributions array<double>`` (margin units, one per
    feature), ``base`` and ``margin`` (``probability = 1 / (1 + exp(-2 margin))``)."""
    tab = tree_table(model)
    roots = [_root(tab, t) for t in range(len(tab.weights))]
    spark = df.sparkSession
    # Plain arrays: workers unpickle a broadcast without this package.
    bc = spark.sparkContext.broadcast((tab.weights, tab.feature, tab.threshold, tab.left, tab.right, tab.value, roots))
    feats = list(model.features)
    base = float(sum(w * tab.value[t][roots[t]] for t, w in enumerate(tab.weights)))
    keep = [c for c in keep if c not in feats]
    schema = T.StructType([df.schema[c] for c in keep]
                          + [T.StructField(f, T.DoubleType()) for f in feats]
                          + [T.StructField("contributions", T.ArrayType(T.DoubleType())),
                             T.StructField("base", T.DoubleType()), T.StructField("margin", T.DoubleType())])

    def walk(batches):
        for pdf in batches:
            contrib = walk_trees(bc.value, pdf[feats].to_numpy(dtype=float))
            out = pdf[keep + feats].copy()
            out["contributions"] = list(contrib)
            out["base"] = base
            out["margin"] = base + contrib.sum(axis=1)
            yield out

    prepared = spread(_prepare(df, feats, None).select(*keep, *feats), df.count())
    return prepared.mapInPandas(walk, schema)
