"""First-seen novelty and rolling baselines on a stream, by batches of finished windows.

A stream of finished windows (append mode) goes through ``foreachBatch``. Each batch reads the state that the batch
before it wrote, and writes its rows and its own state under its batch number. A batch that is run again after a
failure reads the same state and overwrites the same folders, so results and state are exactly-once. Windows are
finished in the order of time, so all windows of a batch come after those of earlier batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.config import NOVELTY_ENTITIES, NOVELTY_SECONDS, ROLLING_LOOKBACK
from alertloom.operators.novelty import novelty_from_windows
from alertloom.operators.rolling import rolling_baseline
from alertloom.session import ensure_utc


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _latest(spark: SparkSession, folder: str, before: int) -> str | None:
    """The finished state of the last batch before ``before``."""
    root = _path(spark, folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if fs.exists(_path(spark, f"{s.getPath()}/_SUCCESS"))]
    found = [b for b in found if b < before]
    return f"{folder}/batch={max(found)}" if found else None


def _run(stream: DataFrame, step, folder: str) -> None:
    """Run ``step(batch, state or None)`` -> (rows, state) over all input that is there; go on after a restart."""
    spark = stream.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        at = _latest(spark, f"{folder}/memory", number)
        rows, state = step(batch, spark.read.parquet(at) if at else None)
        # State first: a batch is done when its rows are, and then its state is there too.
        state.write.mode("overwrite").parquet(f"{folder}/memory/batch={number}")
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def _rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    root = _path(spark, f"{folder}/rows")
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{folder}/rows").drop("batch")


def stream_novelty(events: DataFrame, folder: str, delay: str = "10 minutes", seconds: int = NOVELTY_SECONDS, entities: Sequence[str] = NOVELTY_ENTITIES,
                   suffix: str = "1min", timestamp_col: str = "timestamp") -> DataFrame:
    """First-seen novelty of the finished windows of a streaming event table, kept in ``folder`` on shared storage.

    State is the entity memory (entity_type, entity). Call again with the same folder to go on from where the last call ended.
    """
    ensure_utc(events.sparkSession)
    present = [e for e in entities if e in events.columns]
    rows = events.withColumn("_ts", F.col(timestamp_col).cast("timestamp")).where(F.col("_ts").isNotNull()).withWatermark("_ts", delay)
    each = rows.select("_ts", F.explode(F.array(*[F.struct(F.lit(e).alias("entity_type"), F.col(e).cast("string").alias("entity")) for e in present])).alias("x"))
    seen = each.where(F.col("x.entity").isNotNull()).groupBy(F.window("_ts", f"{seconds} seconds").alias("w"), "x.entity_type", "x.entity").count()
    seen = seen.select(F.unix_micros("w.start").alias("_w"), "entity_type", "entity")

    def step(batch: DataFrame, memory: DataFrame | None):
        batch = batch.persist()
        mine = batch.select("entity_type", "entity")
        state = mine if memory is None else mine.union(memory.select("entity_type", "entity"))
        return novelty_from_windows(batch, present, memory, suffix), state.distinct()

    _run(seen, step, folder)
    schema = "window_start timestamp_ntz, " + ", ".join(f"new_{e}_ratio_{suffix} double, new_{e}_count_{suffix} long" for e in present)
    return _rows(events.sparkSession, folder, schema)


def stream_rolling_baseline(windows: DataFrame, folder: str, lookback: int = ROLLING_LOOKBACK, count_prefix: str = "event_count_") -> DataFrame:
    """Rolling baseline over a stream of finished windows (``window_start`` and counts, e.g. of ``stream_window_features``).

    State is the last ``lookback`` rows. Rows equal those of ``rolling_baseline`` over all finished windows.
    """
    counts = [c for c in windows.columns if c.startswith(count_prefix)]
    stream = windows.select("window_start", *counts)

    def step(batch: DataFrame, memory: DataFrame | None):
        batch = batch.persist()
        known = batch if memory is None else batch.unionByName(memory)
        first = batch.agg(F.min("window_start")).first()[0]
        rolled = rolling_baseline(known, lookback=lookback, chunk_rows=max(4096, lookback))
        return rolled.where(F.col("window_start") >= F.lit(first)), known.orderBy(F.col("window_start").desc()).limit(lookback)

    _run(stream, step, folder)
    extra = ", ".join(f"{k}_{c[len(count_prefix):]} double" for c in counts for k in ("baseline_mean", "baseline_std", "baseline_deviation", "rate_change"))
    return _rows(windows.sparkSession, folder, "window_start timestamp_ntz, " + ", ".join(f"{c} long" for c in counts) + ", " + extra)
