"""Rolling baseline over the joined window table, without a single-partition window.

The reference rolls over *rows* of the merged table ordered by ``window_start`` (Q2: the
5/15-minute columns are NULL on most rows and NULLs occupy a slot). A plain
``Window.orderBy`` puts every row in one partition. Instead:

1. rows are bucketed by day; a day-count table (one row per day, so bounded by the time span,
   not by the data volume) gives each day's global row offset with a prefix sum;
2. ``rn = offset + row_number() within the day`` is the exact global row number;
3. rows are cut into chunks of ``chunk_rows`` consecutive rows; the last ``lookback`` rows of
   every chunk are copied into the next chunk, so each row sees its full frame inside its own
   chunk; the window runs ``partitionBy(chunk)`` and the copies are dropped afterwards.

The result is identical to the global frame (it is the same row order and the same frame).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.config import ROLLING_LOOKBACK, ROLLING_STD_DEFAULT, ROLLING_STD_FLOOR
from alertloom.functions.timebucket import floor_micros, to_micros


def with_global_chunks(df: DataFrame, order_col: str, lookback: int, chunk_rows: int = 4096,
                       bucket_seconds: int = 86_400) -> DataFrame:
    """Add ``_rn`` (exact 0-based global row number by ``order_col``), ``_chunk`` and
    ``_copy``; rows with ``_copy`` are overlap copies of the previous chunk's tail.

    ``order_col`` must be a timestamp with unique values (one row per window start).
    """
    if chunk_rows < lookback:
        raise ValueError("chunk_rows must be at least the lookback")
    us = to_micros(order_col)
    keyed = df.withColumn("_day", floor_micros(us, bucket_seconds))
    per_day = keyed.groupBy("_day").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per day: the prefix sum is over a table bounded by the time span
    offsets = per_day.select(
        "_day",
        (F.sum("_cnt").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    numbered = (keyed.join(offsets, "_day", "left")
                .withColumn("_rn", F.coalesce(F.col("_off"), F.lit(0))
                            + F.row_number().over(Window.partitionBy("_day").orderBy(order_col)) - 1)
                .drop("_day", "_off"))
    chunk = F.floor(F.col("_rn") / F.lit(chunk_rows)).cast("long")
    tail = F.pmod(F.col("_rn"), F.lit(chunk_rows)) >= chunk_rows - lookback
    return (numbered
            .withColumn("_home", chunk)
            .withColumn("_chunk", F.explode(F.when(tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
            .withColumn("_copy", F.col("_chunk") != F.col("_home"))
            .drop("_home"))


def rolling_baseline(table: DataFrame, order_col: str = "window_start", lookback: int = ROLLING_LOOKBACK,
                     count_prefix: str = "event_count_", chunk_rows: int = 4096) -> DataFrame:
    """Add ``baseline_mean_<s>``, ``baseline_std_<s>``, ``baseline_deviation_<s>`` and
    ``rate_change_<s>`` for every ``event_count_<s>`` column.

    * mean: average of the non-null values among the current and previous ``lookback-1`` rows;
    * std: their sample std, 1.0 when fewer than two values;
    * deviation: ``(x - mean) / max(std, 0.1)`` (NULL when x is NULL);
    * rate change: ``x / previous row - 1``, 0 when either is NULL.
    """
    counts = [c for c in table.columns if c.startswith(count_prefix)]
    if not counts:
        return table
    framed = with_global_chunks(table, order_col, lookback, chunk_rows)
    w = Window.partitionBy("_chunk").orderBy("_rn")
    frame = w.rowsBetween(-(lookback - 1), 0)
    cols: dict[str, Column] = {}
    for c in counts:
        s = c[len(count_prefix):]
        x = F.col(c).cast("double")
        mean = F.avg(x).over(frame)
        std = F.coalesce(F.stddev_samp(x).over(frame), F.lit(ROLLING_STD_DEFAULT))
        cols[f"baseline_mean_{s}"] = mean
        cols[f"baseline_std_{s}"] = std
        cols[f"baseline_deviation_{s}"] = (x - mean) / F.greatest(std, F.lit(ROLLING_STD_FLOOR))
        cols[f"rate_change_{s}"] = F.coalesce(F.try_divide(x, F.lag(x).over(w)) - 1, F.lit(0.0))
    return (framed.withColumns(cols)
            .where(~F.col("_copy"))
            .drop("_rn", "_chunk", "_copy"))


def rolling_columns(count_columns: Sequence[str], count_prefix: str = "event_count_") -> list[str]:
    out = []
    for c in count_columns:
        s = c[len(count_prefix):]
        out += [f"baseline_mean_{s}", f"baseline_std_{s}", f"baseline_deviation_{s}", f"rate_change_{s}"]
    return out
