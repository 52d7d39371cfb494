"""Table profiles as single aggregates (one pass each, partial-aggregated)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class, share of all rows and the imbalance ratio negatives / positives.
    The share's total comes from a window over the per-class table (one row per class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    whole = Window.partitionBy()
    pos = F.sum(F.when(F.col(label) == 1, F.col("count")).otherwise(0)).over(whole)
    neg = F.sum(F.when(F.col(label) == 1, 0).otherwise(F.col("count"))).over(whole)
    return counts.select(label, "count", (F.col("count") / F.sum("count").over(whole)).alias("share"),
                         F.when(pos > 0, neg / pos).alias("imbalance_ratio"))


def category_means(df: DataFrame, category: str, features: Sequence[str] | None = None) -> DataFrame:
    """Mean of each feature per category (attack signatures)."""
    feats = list(features or numeric_columns(df, (category,)))
    return df.groupBy(category).agg(*[F.avg(c).alias(f"{c}_mean") for c in feats])


def label_correlation(df: DataFrame, label: str = "label", features: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every numeric column with the label, long form, with a
    rank by absolute value (1 = strongest)."""
    feats = [c for c in (features or numeric_columns(df, (label,)))]
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in feats])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("correlation"))
                                          for c in feats])).alias("x")).select("x.*")
    # |r| snapped to 9 decimals so that equal correlations tie exactly and fall back to the name
    strength = F.round(F.abs(F.col("correlation")) * 1e9) / 1e9
    return long.withColumn("rank", F.row_number().over(
        Window.orderBy(strength.desc_nulls_last(), F.col("feature"))))


def null_profile(df: DataFrame) -> DataFrame:
    """NULL count per column (one aggregate), long form, with the table's row count and
    the column's kind (numeric / categorical)."""
    kinds = {f.name: "numeric" if isinstance(f.dataType, T.NumericType) else "categorical" for f in df.schema.fields}
    one = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("kind"), F.col(c).alias("null_count"),
                 F.col("__rows").alias("rows")) for c in df.columns])).alias("x")).select("x.*")
