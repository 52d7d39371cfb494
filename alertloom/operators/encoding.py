"""One-hot encoding and event-level feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions.scalar import flag


def fit_categories(df: DataFrame, col: str) -> list:
    """F7 fit: sorted distinct non-null values, for a column known to be a small vocabulary (each
    becomes a column); :func:`one_hot_vector` takes columns of any vocabulary."""
    return sorted(r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().collect())


def one_hot_vector(df: DataFrame, col: str, out: str) -> DataFrame:
    """F7 for a vocabulary of any size: one sparse vector column, positions by falling frequency, ties by
    value; NULL is a category of its own, the last."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    index = f"_{out}_index"
    indexed = StringIndexer(inputCol=col, outputCol=index, handleInvalid="keep").fit(df).transform(df)
    return OneHotEncoder(inputCol=index, outputCol=out, dropLast=False).fit(indexed).transform(indexed).drop(index)


def one_hot(df: DataFrame, col: str, values: Sequence, prefix: str | None = None, drop: bool = True,
            lower: bool = False) -> DataFrame:
    """F7/F8 transform: ``<prefix>_<value>`` 0/1 columns; NULL or unknown values give all zeros."""
    p = prefix or col
    src = F.lower(F.col(col)) if lower else F.col(col)
    out = df.withColumns({f"{p}_{v}": F.coalesce((src == F.lit(v)).cast("int"), F.lit(0)) for v in values})
    return out.drop(col) if drop else out


EVENT_NUMERIC = ("src_port", "dst_port", "bytes_in", "bytes_out", "duration")


def event_level_features(events: DataFrame, protocols: Sequence[str] | None = None,
                         keep: Sequence[str] = ("event_id",)) -> DataFrame:
    """Numeric event columns (NULL -> 0), ``proto_*`` one-hot and ``status_failed``."""
    protos = list(protocols) if protocols is not None else fit_categories(events, "protocol")
    cols = [c for c in keep if c in events.columns]
    nums = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in EVENT_NUMERIC if c in events.columns]
    status = [flag("status", "failed").alias("status_failed")] if "status" in events.columns else []
    base = events.select(*cols, *nums, "protocol", *status)
    return one_hot(base, "protocol", protos, prefix="proto")


def event_vector(events: DataFrame, feature_columns: Sequence[str]) -> DataFrame:
    """F8: event -> the saved feature column order; numeric NULL -> 0.0, ``proto_<lower(protocol)>``
    one-hot against the saved vocabulary (unknown protocol: all zeros), ``status_failed``."""
    out = []
    for c in feature_columns:
        if c.startswith("proto_"):
            out.append(F.coalesce((F.lower(F.col("protocol")) == F.lit(c[len("proto_"):])).cast("double"),
                                  F.lit(0.0)).alias(c))
        elif c == "status_failed":
            out.append(flag("status", "failed").cast("double").alias(c))
        elif c in events.columns:
            out.append(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c))
        else:
            out.append(F.lit(0.0).alias(c))
    keep = [c for c in ("event_id",) if c in events.columns]
    return events.select(*keep, *out)
