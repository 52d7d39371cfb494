"""Derived columns, missing-value fill and ratio clipping (narrow, no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.config import (BYTE_RATIO_SUFFIXES, HIGH_ENTROPY_SUFFIXES, HIGH_ENTROPY_THRESHOLD,
                              PORT_SCAN_MAX_IPS, PORT_SCAN_MIN_PORTS, PORT_SCAN_SUFFIXES)


def derived_features(df: DataFrame) -> DataFrame:
    """``bytes_ratio_<s> = out_mean / (in_mean + 1)``; ``port_scan_indicator_<s> =
    ports > 50 AND ips < 5``; ``high_entropy_<s> = port_entropy > 4`` (NULL inputs give 0)."""
    cols = set(df.columns)
    new = {}
    for s in BYTE_RATIO_SUFFIXES:
        i, o = f"bytes_in_mean_{s}", f"bytes_out_mean_{s}"
        if i in cols and o in cols:
            new[f"bytes_ratio_{s}"] = F.try_divide(F.col(o), F.col(i) + 1)
    for s in PORT_SCAN_SUFFIXES:
        p, i = f"unique_dst_ports_{s}", f"unique_dst_ips_{s}"
        if p in cols and i in cols:
            new[f"port_scan_indicator_{s}"] = F.coalesce(
                (F.col(p) > PORT_SCAN_MIN_PORTS) & (F.col(i) < PORT_SCAN_MAX_IPS), F.lit(False)).cast("int")
    for s in HIGH_ENTROPY_SUFFIXES:
        e = f"port_entropy_{s}"
        if e in cols:
            new[f"high_entropy_{s}"] = F.coalesce(F.col(e) > HIGH_ENTROPY_THRESHOLD, F.lit(False)).cast("int")
    return df.withColumns(new)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def fill_and_clip(df: DataFrame, clip: str = "reference") -> DataFrame:
    """F6 + F9: numeric NULLs become 0; ratio columns are clipped to [0, 1].

    ``clip='reference'`` clips every column whose name contains ``ratio`` -- which also hits
    ``bytes_ratio_*`` and ``conn_duration_*`` (Q1, kept for parity). ``clip='shares'`` clips
    only true shares (``*_ratio_*`` except ``bytes_ratio``)."""
    if clip not in ("reference", "shares", "none"):
        raise ValueError(f"unknown clip mode {clip!r}")
    nums = set(numeric_columns(df))
    out = {}
    for c in df.columns:
        if c not in nums:
            continue
        e = F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType))
        low = c.lower()
        hit = ("ratio" in low) if clip == "reference" else (
            clip == "shares" and "_ratio_" in low and not low.startswith("bytes_ratio"))
        if hit:
            e = F.least(F.greatest(e, F.lit(0)), F.lit(1)).cast(df.schema[c].dataType)
        out[c] = e
    return df.withColumns(out)
