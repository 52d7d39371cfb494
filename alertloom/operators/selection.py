"""Comparison of models with isolated failures, and seeded random search of parameters.

Fits run side by side, each a Spark job of its own on the same written rows, so a cluster is kept busy by small fits; what
reaches the driver is one row of metrics a model. A model that fails is a row that says why, and the others go on.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.config import SPLIT_SEED
from alertloom.operators.evaluate import average_precision, confusion_metrics, roc_auc
from alertloom.operators.supervised import fit_supervised, predict_proba
from alertloom.session import checkpoint_dir, cut_lineage

_COUNTS = ("true_positives", "false_positives", "true_negatives", "false_negatives")
_RATES = ("accuracy", "precision", "recall", "f1", "fpr", "roc_auc", "pr_auc")
_METRICS = ", ".join([f"{c} long" for c in _COUNTS] + [f"{c} double" for c in _RATES])

#: Ranges searched for each kind of model: (kind of draw, least, most), both included.
SEARCH_SPACES = {
    "gbt": {"maxDepth": ("int", 3, 12), "stepSize": ("log", 0.01, 0.3), "subsamplingRate": ("float", 0.5, 1.0), "minInstancesPerNode": ("int", 5, 100)},
    "rf": {"numTrees": ("int", 50, 300), "maxDepth": ("int", 3, 12), "subsamplingRate": ("float", 0.5, 1.0), "minInstancesPerNode": ("int", 1, 100)},
    "lr": {"regParam": ("log", 1e-8, 10.0), "elasticNetParam": ("float", 0.0, 1.0)},
}


def _side_by_side(df: DataFrame, work: Callable, items: Sequence, parallelism: int) -> list:
    with ThreadPool(max(1, min(parallelism, len(items) or 1))) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(work), items, chunksize=1)


def _metrics(scored: DataFrame, threshold: float) -> dict:
    """All metrics of (y_true, y_score), as plain numbers."""
    out = confusion_metrics(scored, threshold=threshold).first().asDict()
    return {**out, **roc_auc(scored).first().asDict(), **average_precision(scored).first().asDict()}


def compare_models(train: DataFrame, test: DataFrame, features: Sequence[str], models: Mapping[str, Mapping | Callable], label: str = "label",
                   validation: DataFrame | None = None, threshold: float = 0.5, parallelism: int = 4) -> DataFrame:
    """A row per model: model, status (``ok`` or ``failed``), error, fit_seconds, confusion counts, rates, ROC-AUC and PR-AUC.

    A model is a mapping (``kind`` and ``params`` of :func:`fit_supervised`) or a function of (train, validation) that returns a
    function from rows to rows with ``y_score``. A failed model has NULL metrics and its error's type and first line. Names are
    unique by being keys; an empty table of test rows gives metrics of 0; no models give no rows.
    """
    train, test = cut_lineage(train), cut_lineage(test)
    validation = cut_lineage(validation) if validation is not None else None

    def run(item):
        name, model = item
        began = time.monotonic()
        try:
            if callable(model):
                score = model(train, validation)
            else:
                fitted = fit_supervised(train, features, label, model["kind"], model.get("params"), validation=validation)
                score = lambda rows: predict_proba(fitted, rows, "y_score")
            took = time.monotonic() - began
            scored = cut_lineage(score(test).select(F.col(label).cast("int").alias("y_true"), F.col("y_score").cast("double")))
            got = _metrics(scored, threshold)
            return (name, "ok", None, took, *[got[c] for c in (*_COUNTS, *_RATES)])
        except Exception as e:  # one model's failure is its row
            text = (str(e).strip().splitlines() or [""])[0]
            return (name, "failed", f"{type(e).__name__}: {text}", time.monotonic() - began, *[None] * (len(_COUNTS) + len(_RATES)))

    checkpoint_dir(train.sparkSession)
    rows = _side_by_side(train, run, list(models.items()), parallelism)
    return train.sparkSession.createDataFrame(rows, f"model string, status string, error string, fit_seconds double, {_METRICS}")


def grouped_metrics(predictions: DataFrame, group: str = "model", label: str = "y_true", score: str = "y_score", threshold: float = 0.5) -> DataFrame:
    """Confusion metrics of written predictions, a row per group, in one aggregate."""
    return confusion_metrics(predictions, label, score, threshold, group_by=(group,))


def _first_by(order: Column, name: str) -> Column:
    """The name of the row that comes first by ``order``, ties by name; rows where it is NULL don't count."""
    return F.min(F.when(order.isNotNull(), F.struct(order.alias("o"), F.col(name).alias("name"))))["name"]


def best_models(metrics: DataFrame, most: Sequence[str] = ("pr_auc", "roc_auc"), least: Sequence[str] = ("fit_seconds",), name: str = "model") -> DataFrame:
    """One row: ``best_<metric>`` names the model with the largest value, ``least_<metric>`` with the smallest.

    Ties go to the smaller name; NULL and NaN values, those of failed models, never win; without any value the name is NULL. The
    time of failed models doesn't count.
    """
    rows = metrics.where("status = 'ok'") if "status" in metrics.columns else metrics
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return rows.agg(*[_first_by(-value(c), name).alias(f"best_{c}") for c in most], *[_first_by(value(c), name).alias(f"least_{c}") for c in least])


def draw_params(space: Mapping[str, tuple], seed: int, trial: int) -> dict:
    """The parameters of a trial: they depend on the seed, the trial's number and the space alone."""
    rng = np.random.default_rng([seed, trial])
    out = {}
    for name in sorted(space):
        kind, *given = space[name]
        if kind == "int":
            out[name] = int(rng.integers(given[0], given[1] + 1))
        elif kind == "float":
            out[name] = float(rng.uniform(*given))
        elif kind == "log":
            out[name] = float(min(given[1], max(given[0], math.exp(rng.uniform(math.log(given[0]), math.log(given[1]))))))
        elif kind == "choice":
            out[name] = given[0][int(rng.integers(len(given[0])))]
        else:
            raise ValueError(f"unknown kind of range {kind!r} of {name}")
    return out


def random_search(train: DataFrame, validation: DataFrame, features: Sequence[str], label: str = "label", kind: str = "gbt",
                  space: Mapping[str, tuple] | None = None, fixed: Mapping | None = None, trials: int = 20, seed: int = SPLIT_SEED,
                  parallelism: int = 4) -> DataFrame:
    """A row per trial: trial, params (JSON), status, error, roc_auc on the validation rows, fit_seconds.

    Trials are drawn independently of each other, so their number and order of running change none of them. ``fixed`` holds for
    all trials. A trial that fails is a row with its error.
    """
    space = SEARCH_SPACES[kind] if space is None else space
    train, validation = cut_lineage(train), cut_lineage(validation)
    drawn = [draw_params(space, seed, i) for i in range(trials)]

    def run(i: int):
        began = time.monotonic()
        shown = json.dumps(drawn[i], sort_keys=True)
        try:
            fitted = fit_supervised(train, features, label, kind, {**(fixed or {}), **drawn[i]}, validation=validation, calibrate=False)
            scored = predict_proba(fitted, validation, "y_score").select(F.col(label).cast("int").alias("y_true"), "y_score")
            return (i, shown, "ok", None, roc_auc(cut_lineage(scored)).first()["roc_auc"], time.monotonic() - began)
        except Exception as e:  # one trial's failure is its row
            text = (str(e).strip().splitlines() or [""])[0]
            return (i, shown, "failed", f"{type(e).__name__}: {text}", None, time.monotonic() - began)

    rows = _side_by_side(train, run, range(trials), parallelism)
    return train.sparkSession.createDataFrame(rows, "trial int, params string, status string, error string, roc_auc double, fit_seconds double")


def best_params(found: DataFrame) -> dict | None:
    """Parameters of the trial with the largest ROC-AUC, ties to the smaller trial; None if all failed."""
    row = found.where("status = 'ok'").orderBy(F.desc("roc_auc"), "trial").first()
    return json.loads(row["params"]) if row else None
