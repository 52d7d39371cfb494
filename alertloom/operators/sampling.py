"""Deterministic stratified splits and samples, class weights, temporal split.

Rows are ranked inside their class by a seeded 64-bit hash of their id (``xxhash64``), so the
result does not depend on partitioning or on re-execution after a lost executor. The cut-off
hash per class comes from an exact order statistic (:func:`kth_smallest`, bounded driver
traffic), so there is no per-class ``row_number`` window that would put a big class into one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.config import SPLIT_SEED
from alertloom.operators.ordering import kth_smallest


def _rank_key(id_col: str, seed: int) -> Column:
    return F.xxhash64(F.col(id_col), F.lit(seed))


def _class_counts(df: DataFrame, label: str) -> dict:
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def _cutoffs(df: DataFrame, label: str, id_col: str, seed: int, quotas: dict) -> Column:
    """Column that is true for the ``quota`` lowest-ranked rows of each class."""
    cond = F.lit(False)
    key = _rank_key(id_col, seed)
    for cls, q in quotas.items():
        if q <= 0:
            continue
        in_cls = F.col(label).isNull() if cls is None else (F.col(label) == F.lit(cls))
        cut = kth_smallest(df.where(in_cls), key, q)
        cond = cond | (in_cls & (key <= F.lit(cut)))
    return cond


def stratified_split(df: DataFrame, label: str = "label", test_size: float = 0.2, id_col: str = "id",
                     seed: int = SPLIT_SEED) -> DataFrame:
    """Add ``split`` = 'test' for ``ceil(test_size * n_class)`` rows of every class, else 'train'."""
    counts = _class_counts(df, label)
    quotas = {c: int(math.ceil(test_size * n)) for c, n in counts.items()}
    return df.withColumn("split", F.when(_cutoffs(df, label, id_col, seed, quotas), "test").otherwise("train"))


def train_validation_test(df: DataFrame, label: str = "label", test_size: float = 0.2, val_size: float = 0.15,
                          id_col: str = "id", seed: int = SPLIT_SEED) -> DataFrame:
    """P1 twice: 80/20 train/test, then 85/15 of train into train/validation."""
    first = stratified_split(df, label, test_size, id_col, seed)
    train = first.where(F.col("split") == "train").drop("split")
    second = stratified_split(train, label, val_size, id_col, seed + 1).withColumn(
        "split", F.when(F.col("split") == "test", "validation").otherwise("train"))
    return second.unionByName(first.where(F.col("split") == "test"))


def stratified_sample(df: DataFrame, n: int, label: str = "label", id_col: str = "id",
                      seed: int = SPLIT_SEED) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, allotted to classes in proportion (largest remainders)."""
    counts = _class_counts(df, label)
    total = sum(counts.values())
    n = min(n, total)
    raw = {c: n * k / total for c, k in counts.items()} if total else {}
    quotas = {c: int(math.floor(v)) for c, v in raw.items()}
    rest = n - sum(quotas.values())
    for c in sorted(raw, key=lambda c: (-(raw[c] - quotas[c]), str(c)))[:rest]:
        quotas[c] += 1
    return df.where(_cutoffs(df, label, id_col, seed, quotas))


def class_weight(df: DataFrame, label: str = "label", out: str = "weight") -> tuple[DataFrame, float]:
    """Positive-class weight ``negatives / max(positives, 1)`` as a weight column."""
    r = df.agg(F.count(F.when(F.col(label) == 1, 1)).alias("p"), F.count(F.when(F.col(label) != 1, 1)).alias("n")
               ).first()
    w = r["n"] / max(r["p"], 1)
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(w))).otherwise(F.lit(1.0))), w


def temporal_split(df: DataFrame, ts_col: str, test_size: float = 0.2) -> DataFrame:
    """The latest ``test_size`` share of rows (by time) is 'test'; ties at the cut stay together."""
    n = df.where(F.col(ts_col).isNotNull()).count()
    k = max(1, int(math.ceil((1 - test_size) * n)))
    cut = kth_smallest(df, F.col(ts_col), k)
    return df.withColumn("split", F.when(F.col(ts_col) > F.lit(cut), "test").otherwise("train"))
