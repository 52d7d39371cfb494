"""Window labels (1 if any attack in the window) joined onto the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions.timebucket import floor_ts


def window_labels(events: DataFrame, seconds: int = 60, label: str = "label", timestamp_col: str = "timestamp"
                  ) -> DataFrame:
    """``max(label)`` per window (partial-aggregated)."""
    return (events.where(F.col(timestamp_col).isNotNull())
            .groupBy(floor_ts(timestamp_col, seconds).alias("window_start"))
            .agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("label")))


def attach_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join on ``window_start``; windows without a label row get 0 (also the rows that
    exist only because of a larger window)."""
    return (features.join(labels, "window_start", "left")
            .withColumn("label", F.coalesce(F.col("label"), F.lit(0))))
