"""A class of many by boosted or random trees, confusion matrix, per-class and macro metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.config import SPLIT_SEED


@dataclass
class CategoryModel:
    features: list[str]
    classes: list[str]
    model: PipelineModel


def _features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({f"_f{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(names)})


def fit_category(train: DataFrame, features: Sequence[str], label: str, params: dict | None = None) -> CategoryModel:
    """Random forest over the classes of ``label``, numbered by falling frequency, ties by name; NULL classes teach nothing.

    NULL features count as 0. Only the class names reach the driver. Fewer than two classes raise.
    """
    rows = _features(train.where(F.col(label).isNotNull()), features).withColumn("_class", F.col(label).cast("string"))
    indexer = StringIndexer(inputCol="_class", outputCol="_index").fit(rows)
    classes = list(indexer.labels)
    if len(classes) < 2:
        raise ValueError(f"{label} has {len(classes)} classes, at least 2 are needed")
    forest = RandomForestClassifier(**{"numTrees": 200, "maxDepth": 6, "seed": SPLIT_SEED, **(params or {})}, featuresCol="_features", labelCol="_index",
                                    predictionCol="_predicted", probabilityCol="_probability", rawPredictionCol="_raw")
    assembler = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="_features", handleInvalid="keep")
    model = Pipeline(stages=[assembler, forest]).fit(indexer.transform(rows))
    return CategoryModel(list(features), classes, model)


def predict_category(model: CategoryModel, df: DataFrame, out: str = "category_pred") -> DataFrame:
    """The rows, all columns, with the class that has the largest probability."""
    scored = model.model.transform(_features(df, model.features))
    name = F.get(F.array(*[F.lit(c) for c in model.classes]), F.col("_predicted").cast("int"))
    return scored.select(*[F.col(c) for c in df.columns if c != out], name.alias(out))


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) of the pairs that occur; NULL is a class like others."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """A row per class that occurs on either side: support, predicted, hits, precision, recall, f1 (0 where undefined).

    Works on the confusion matrix, so its size depends on the classes, not on the rows.
    """
    hit = F.when(F.col("actual").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(F.lit(0).cast("long"))
    none = F.lit(0).cast("long")
    sides = F.array(F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), none.alias("predicted"), hit.alias("hits")),
                    F.struct(F.col("predicted").alias("class"), none.alias("support"), F.col("n").alias("predicted"), none.alias("hits")))
    sums = (matrix.select(F.explode(sides).alias("x")).groupBy(F.col("x.class").alias("class"))
            .agg(*[F.sum(f"x.{c}").alias(c) for c in ("support", "predicted", "hits")]))
    tp, sup, pre = (F.col(c).cast("double") for c in ("hits", "support", "predicted"))
    return sums.select("*", _share(tp, pre).alias("precision"), _share(tp, sup).alias("recall"), _share(2 * tp, sup + pre).alias("f1"))


def macro_metrics(classes: DataFrame) -> DataFrame:
    """One row from :func:`class_metrics`: accuracy, unweighted means over the classes, and f1 weighted by support."""
    total = F.sum("support").cast("double")
    return classes.agg(F.count(F.lit(1)).alias("n_classes"), F.coalesce(_share(F.sum("hits").cast("double"), total), F.lit(0.0)).alias("accuracy"),
                       *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
                       F.coalesce(_share(F.sum(F.col("f1") * F.col("support")), total), F.lit(0.0)).alias("weighted_f1"))
