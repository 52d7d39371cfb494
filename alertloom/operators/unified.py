"""Rules, a supervised model and an isolation forest blended in one lazy chain, and their bundle.

Scoring adds columns to the rows: the rules are expressions, the supervised model is MLlib's transform, the forest and the
contributions are Arrow batches of the features alone, so rows never move and no join is needed. With the quantiles of the
training rows stored in the forest nothing depends on the batch: one window (M9), a table (M8) and a stream (X5) get the
same scores.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.config import DEFAULT_RULES, ISOLATION_SAMPLE, ISOLATION_TREES, SPLIT_SEED, Condition, Rule, RuleSet
from alertloom.operators.explain import collect_stats, explain_top_k, fit_reference_stats
from alertloom.operators.outliers import _NODE_ARRAYS, Forest, _path_lengths, avg_path_length, fit_isolation_forest
from alertloom.operators.rules import score_rules
from alertloom.operators.scaling import exact_quantiles, percentile_sigmoid
from alertloom.operators.supervised import (SupervisedModel, contribution_column, fit_supervised, load_supervised, predict_proba,
                                            save_supervised)
from alertloom.operators.triage import blend, normalize_weights
from alertloom.session import cut_lineage

#: Format of the saved bundle.
VERSION = 1
#: Score columns of the models, by the name of their weight.
_SCORES = {"lgb": "lgb_score", "isolation": "if_score"}


def isolation_column(forest: Forest) -> Column:
    """The forest's raw score 2^(-E[h]/c(psi)) as a column; NULL features count as 0."""
    spark = SparkSession.getActiveSession()
    bc = spark.sparkContext.broadcast({k: getattr(forest, k) for k in _NODE_ARRAYS})
    c = float(avg_path_length(np.array([forest.sample_size]))[0]) or 1.0

    @F.pandas_udf("double")
    def raw(x: pd.Series) -> pd.Series:
        return pd.Series(np.power(2.0, -_path_lengths(bc.value, np.stack(x.to_numpy()).astype(float)).mean(axis=1) / c))

    values = []
    for f in forest.features:
        x = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        mean, std = (forest.scaler or {}).get(f, (0.0, 1.0))
        values.append((x - F.lit(mean)) / F.lit(std))
    return raw(F.array(*values))


@dataclass
class UnifiedScorer:
    """Rules (always), and a supervised model and a forest if there are any; ``stats`` place explained values among the training rows'."""
    rules: RuleSet = field(default_factory=lambda: DEFAULT_RULES)
    supervised: SupervisedModel | None = None
    forest: Forest | None = None
    weights: dict[str, float] | None = None
    stats: dict[str, list[float]] = field(default_factory=dict)

    def score(self, df: DataFrame, top_k: int = 0, given: Sequence[str] = ()) -> DataFrame:
        """M8: the rows, all columns, with the rules' columns, ``lgb_score``, ``if_score``, ``anomaly_score`` and ``severity``.

        Weights of missing scorers go to the others. ``given`` names score columns that the rows bring themselves; other columns
        of these names are replaced. ``top_k`` > 0 adds ``lgb_top_features``, the largest contributions of boosted trees. Features
        that are NULL count as 0 for the models and fail the rules' conditions. A forest without stored quantiles takes those of
        the batch, which a stream doesn't have: that raises. An empty table gives no rows.
        """
        made = {"lgb": self.supervised, "isolation": self.forest}
        doubled = [_SCORES[k] for k, model in made.items() if model is not None and _SCORES[k] in given]
        if doubled or not set(given) <= set(_SCORES.values()):
            raise ValueError(f"score columns given that a model makes or that are unknown: {doubled or sorted(given)}")
        if df.isStreaming and self.forest is not None and self.forest.quantiles is None:
            raise ValueError("a stream needs a forest with stored quantiles")
        drop = [c for c in (*_SCORES.values(), "anomaly_score", "severity", "lgb_top_features") if c not in given]
        scored = score_rules(df.drop(*drop), self.rules, severity_col="rule_severity")
        features = list(dict.fromkeys(f for model in made.values() if model is not None for f in model.features))
        held = scored.select(F.struct(*scored.columns).alias("_row"), *[F.col(f).cast("double").alias(f) for f in features])
        out = [F.col(f"_row.`{c}`").alias(c) for c in scored.columns]
        if self.supervised is not None:
            if top_k:
                held = held.withColumn("_contributions", contribution_column(self.supervised))
            held = predict_proba(self.supervised, held, "lgb_score")
            out.append(F.col("lgb_score"))
            if top_k:
                names = self.supervised.features
                parts = held.withColumns({f"_contribution_{i}": F.col("_contributions")[i] for i in range(len(names))})
                held = explain_top_k(parts, names, [f"_contribution_{i}" for i in range(len(names))], self.stats, top_k, "lgb_top_features")
                out.append(F.col("lgb_top_features"))
        if self.forest is not None:
            held, _ = percentile_sigmoid(held.withColumn("_if_raw", isolation_column(self.forest)), "_if_raw", "if_score", self.forest.quantiles)
            out.append(F.col("if_score"))
        available = {"baseline": True} | {k: model is not None or _SCORES[k] in given for k, model in made.items()}
        return blend(held.select(*out), normalize_weights(self.weights, available))

    def score_window(self, df: DataFrame, window, time_col: str = "window_start") -> DataFrame:
        """M9: the scores of one window; the same as in the whole table if the forest has stored quantiles."""
        return self.score(df.where(F.col(time_col) == F.lit(window)))

    def save(self, path: str) -> None:
        """The bundle, parts that are there in folders of their own; the description is written last."""
        spark = SparkSession.getActiveSession()
        meta: dict = {"version": VERSION, "rules": asdict(self.rules), "weights": self.weights, "stats": self.stats,
                      "supervised": self.supervised is not None, "forest": None}
        if self.supervised is not None:
            save_supervised(self.supervised, f"{path}/supervised")
        if self.forest is not None:
            f = self.forest
            trees, width = f.feature.shape
            at = np.indices((trees, width)).reshape(2, -1)
            nodes = pd.DataFrame({"tree": at[0], "node": at[1], **{k: getattr(f, k).ravel() for k in _NODE_ARRAYS}})
            spark.createDataFrame(nodes).coalesce(1).write.mode("overwrite").parquet(f"{path}/forest")  # trees x nodes
            meta["forest"] = {"features": f.features, "scaler": f.scaler, "sample_size": f.sample_size, "quantiles": f.quantiles}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> UnifiedScorer:
        """A bundle that :meth:`save` wrote; another format raises."""
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
        if meta.get("version") != VERSION:
            raise ValueError(f"bundle of version {meta.get('version')}, not {VERSION}")
        kept = meta["rules"]
        rules = [Rule(**{**r, "conditions": tuple(Condition(**c) for c in r["conditions"])}) for r in kept["rules"]]
        forest = None
        if meta["forest"]:
            f = meta["forest"]
            nodes = spark.read.parquet(f"{path}/forest").toPandas().sort_values(["tree", "node"])  # trees x nodes
            arrays = [nodes[k].to_numpy().reshape(nodes["tree"].nunique(), -1) for k in _NODE_ARRAYS]
            scaler = {k: tuple(v) for k, v in f["scaler"].items()} if f["scaler"] else None
            forest = Forest(f["features"], scaler, f["sample_size"], *arrays, tuple(f["quantiles"]) if f["quantiles"] else None)
        return cls(RuleSet(**{**kept, "rules": rules}), load_supervised(f"{path}/supervised") if meta["supervised"] else None, forest,
                   meta["weights"], meta["stats"])


def fit_unified(train: DataFrame, features: Sequence[str], label: str = "label", id_col: str = "event_id", validation: DataFrame | None = None,
                rules: RuleSet = DEFAULT_RULES, kind: str = "gbt", params: dict | None = None, n_trees: int = ISOLATION_TREES,
                sample_size: int = ISOLATION_SAMPLE, weights: dict[str, float] | None = None, seed: int = SPLIT_SEED) -> UnifiedScorer:
    """Fit both models on ``train``; the forest keeps the 5, 50 and 95 % quantiles of its scores there, for batches of any size."""
    train = cut_lineage(train)  # read by each of the fits below
    supervised = fit_supervised(train, features, label, kind, params, validation=validation)
    forest = fit_isolation_forest(train, features, n_trees, sample_size, seed, id_col=id_col)
    raw = cut_lineage(train.select(isolation_column(forest).alias("s")))
    forest.quantiles = tuple(exact_quantiles(raw, "s", (0.05, 0.5, 0.95)))
    return UnifiedScorer(rules, supervised, forest, weights, collect_stats(fit_reference_stats(train, list(features))))
