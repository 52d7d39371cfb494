"""Isolation forest as a Spark job.

Isolation forest (Liu, Ting, Zhou 2008): each tree is grown on its own subsample of ``sample_size``
rows. Rows are picked by seeded hashes of a unique id -- a first filter keeps only rows that any
tree may use, then each tree takes the rows whose per-tree hash is smallest -- so the input of every
tree is bounded (about ``2 * sample_size`` rows per ``applyInPandas`` group) whatever the table size.
The forest (trees x at most ``2 * sample_size - 1`` nodes) is broadcast as plain arrays and every
Arrow batch is scored with a vectorised level-by-level walk: ``s = 2^(-E[h(x)] / c(psi))``.

Scores are turned into [0, 1] by the batch percentile sigmoid (F23) or stored quantiles. The local
outlier factor (M5) is not here: an exact one needs a partitioned nearest-neighbour join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.config import ISOLATION_SAMPLE, ISOLATION_TREES
from alertloom.operators.scaling import exact_quantiles, fit_standard_scaler, percentile_sigmoid, standard_scale
from alertloom.session import cut_lineage

_EULER = 0.5772156649015329
_MASK = (1 << 63) - 1


def avg_path_length(n):
    """c(n): average path length of an unsuccessful search in a binary search tree of n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + _EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


@dataclass
class Forest:
    features: list[str]
    scaler: dict[str, tuple[float, float]] | None
    sample_size: int
    feature: np.ndarray      # (trees, max_nodes) split feature, -1 for leaves
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray         # rows that reached a leaf
    depth: np.ndarray
    quantiles: tuple | None = None


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    """One isolation tree over ``x`` (rows x features) as flat node arrays."""
    feat, thr, left, right, size, depth = [], [], [], [], [], []

    def new(d, n):
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(n), depth.append(d)
        return len(feat) - 1

    stack = [(new(0, len(x)), np.arange(len(x)), 0)]
    while stack:
        node, idx, d = stack.pop()
        if len(idx) <= 1 or d >= max_depth:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if len(usable) == 0:
            continue
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        go = sub[:, f] < t
        li, ri = idx[go], idx[~go]
        ln, rn = new(d + 1, len(li)), new(d + 1, len(ri))
        feat[node], thr[node], left[node], right[node] = f, t, ln, rn
        stack.append((ln, li, d + 1))
        stack.append((rn, ri, d + 1))
    return feat, thr, left, right, size, depth


def fit_isolation_forest(df: DataFrame, features: Sequence[str], n_trees: int = ISOLATION_TREES,
                         sample_size: int = ISOLATION_SAMPLE, seed: int = 42, scale: bool = True,
                         *, id_col: str) -> Forest:
    """M4 fit. ``scale`` standardises features first (as the window-level scorer does); the
    event-level variant (M11) fits on raw values. ``id_col`` is unique for each row: rows are drawn by
    its hash, so equal feature rows are drawn one by one. Exactly ``n_trees`` trees, or an error."""
    feats = list(features)
    data = df.select(F.xxhash64(id_col).alias("_id"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f)
                                                      for f in feats])
    scaler = fit_standard_scaler(data, feats) if scale else None
    if scaler:
        data = standard_scale(data, scaler)
    n = data.count()
    psi = min(sample_size, n)
    if n == 0:
        raise ValueError("cannot fit on an empty table")
    key = F.col("_id")
    q_tree = min(1.0, 2.0 * psi / n)
    q_any = min(1.0, n_trees * q_tree)
    frac = lambda h: F.pmod(h, F.lit(1 << 62)).cast("double") / float(1 << 62)
    cand = data.where(frac(F.xxhash64(key, F.lit(seed))) < q_any)
    per_tree = (cand.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("_tree"))
                .withColumn("_h", frac(F.xxhash64(key, F.col("_tree"), F.lit(seed + 1))))
                .where(F.col("_h") < F.lit(q_tree / q_any if q_any > 0 else 1.0)))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    out_schema = ("tree int, node int, feature int, threshold double, left int, right int, size int, depth int")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["_tree"].iloc[0])
        pdf = pdf.sort_values(["_h", "_id"]).head(psi)
        rng = np.random.default_rng(seed * 100_003 + t)
        f, th, l, r, s, d = _grow(pdf[feats].to_numpy(dtype=float), rng, max_depth)
        return pd.DataFrame({"tree": t, "node": np.arange(len(f)), "feature": f, "threshold": th,
                             "left": l, "right": r, "size": s, "depth": d})

    nodes = per_tree.groupBy("_tree").applyInPandas(build, out_schema).toPandas()  # bounded forest
    trees = sorted(nodes.tree.unique())
    if len(trees) != n_trees:
        raise ValueError(f"{id_col} is not unique: only {len(trees)} of {n_trees} trees got rows")
    width = int(nodes.groupby("tree").node.max().max()) + 1
    arr = {k: np.full((len(trees), width), -1 if k in ("feature", "left", "right") else 0,
                      dtype=float if k == "threshold" else np.int64) for k in
           ("feature", "threshold", "left", "right", "size", "depth")}
    for i, t in enumerate(trees):
        g = nodes[nodes.tree == t]
        for k in arr:
            arr[k][i, g.node.to_numpy()] = g[k].to_numpy()
    return Forest(feats, scaler, psi, arr["feature"], arr["threshold"], arr["left"], arr["right"],
                  arr["size"], arr["depth"])


#: The arrays of a forest that scoring walks.
_NODE_ARRAYS = ("feature", "threshold", "left", "right", "size", "depth")


def _path_lengths(forest: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Path length of each row in each tree. Leaves lead back to themselves, so all rows take the same number of steps."""
    feature, threshold, left, right, size, depth = (forest[k] for k in _NODE_ARRAYS)
    trees, width = feature.shape
    leaf, own = feature < 0, np.arange(width)
    at = np.where(leaf, 0, feature)
    kids = np.stack([np.where(leaf, own, right), np.where(leaf, own, left)], axis=2).reshape(trees, -1)
    length = depth + avg_path_length(size)
    steps = np.where(leaf, depth, 0).max(axis=1)
    out = np.zeros((len(x), trees))
    for start in range(0, len(x), 4096):  # small enough to stay in the cache
        part = x[start : start + 4096]
        m, d = part.shape
        flat, rows = np.ascontiguousarray(part).ravel(), np.arange(m) * d
        for t in range(trees):
            node = np.zeros(m, dtype=np.int64)
            for _ in range(steps[t]):
                node = kids[t].take(2 * node + (flat.take(rows + at[t].take(node)) < threshold[t].take(node)))
            out[start : start + m, t] = length[t].take(node)
    return out


def isolation_scores(forest: Forest, df: DataFrame, keep: Sequence[str] = (), depth_stats: bool = False
                     ) -> DataFrame:
    """``keep`` columns + ``if_raw`` = 2^(-E[h]/c(psi)) (higher = more isolated) and, with
    ``depth_stats`` (M7), the mean and population std of the per-tree path lengths."""
    spark = df.sparkSession
    # Plain arrays: workers unpickle a broadcast without this package.
    bc = spark.sparkContext.broadcast({k: getattr(forest, k) for k in _NODE_ARRAYS})
    feats = forest.features
    data = df.select(*keep, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in feats])
    if forest.scaler:
        data = standard_scale(data, forest.scaler)
    fields = [data.schema[c] for c in keep] + [T.StructField("if_raw", T.DoubleType())]
    if depth_stats:
        fields += [T.StructField("avg_isolation_depth", T.DoubleType()),
                   T.StructField("isolation_depth_std", T.DoubleType())]
    cpsi = float(avg_path_length(np.array([forest.sample_size]))[0]) or 1.0

    def score(batches):
        fo = bc.value
        for pdf in batches:
            h = _path_lengths(fo, pdf[feats].to_numpy(dtype=float))
            out = pdf[list(keep)].copy()
            out["if_raw"] = np.power(2.0, -h.mean(axis=1) / cpsi)
            if depth_stats:
                out["avg_isolation_depth"] = h.mean(axis=1)
                out["isolation_depth_std"] = h.std(axis=1)
            yield out

    return data.mapInPandas(score, T.StructType(fields))


# ------------------------------------------------------------------------------ combined (M6 without LOF, M7, M11, T3)

def score_outliers(forest: Forest, df: DataFrame, keep: Sequence[str], quantiles: Sequence[float] | None = None) -> DataFrame:
    """``if_score`` (percentile sigmoid of the raw scores: the batch's own, or the stored ``quantiles``),
    ``combined_score`` (equal to it, as there is no second detector) and the ``> 0.5`` flags.
    One row per input row. The batch's own quantiles take several passes, so raw scores are written for them first."""
    raw = isolation_scores(forest, df, keep)
    s, _ = percentile_sigmoid(raw if quantiles is not None else cut_lineage(raw), "if_raw", "if_score", quantiles)
    flags = (F.col("if_score") > 0.5).cast("int")
    return s.withColumns({"if_anomaly": flags, "combined_score": F.col("if_score"), "is_anomaly": flags})


def top_anomalies(scored: DataFrame, k: int, score: str = "if_score", id_col: str = "event_id") -> DataFrame:
    """The ``k`` rows with the highest score, ties to the smaller id."""
    return scored.orderBy(F.col(score).desc(), id_col).limit(k)


def isolation_depth(forest: Forest, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """M7: mean / population std of the true per-tree path length and a flag for rows below the
    batch's 10th percentile of the mean depth (easy to isolate)."""
    s = cut_lineage(isolation_scores(forest, df, list(keep), depth_stats=True))
    (p10,) = exact_quantiles(s, "avg_isolation_depth", (0.10,))
    return s.withColumn("depth_anomaly_indicator", (F.col("avg_isolation_depth") < F.lit(p10)).cast("int"))


def event_isolation_forest(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str],
                           n_trees: int = ISOLATION_TREES, seed: int = 42, id_col: str = "event_id") -> DataFrame:
    """Unscaled forest on event rows, min-max normalised scores; the attack rate (capped
    at 0.5) is the contamination -- recorded only, as it does not change the ranking."""
    forest = fit_isolation_forest(df, features, n_trees, ISOLATION_SAMPLE, seed, scale=False, id_col=id_col)
    from alertloom.operators.scaling import min_max
    return min_max(isolation_scores(forest, df, list(keep) + [label]), "if_raw", "if_score")
