"""First-seen novelty per window, and the entity memory that carries it across calls.

The reference walks windows in time order and keeps a set of seen entities. The same answer,
order-free: an entity is *new* in window ``w`` iff ``w`` is the first window it appears in
(``min(window)`` per entity) and it is not in the memory of earlier calls. Every step is a
group-by with a map-side partial aggregate (``min`` and ``count`` are algebraic), so a hot
entity or a hot window is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.config import NOVELTY_ENTITIES, NOVELTY_SECONDS
from alertloom.functions.timebucket import floor_micros, from_micros, to_micros

MEMORY_SCHEMA = "entity_type string, entity string, first_window timestamp_ntz"


def _window_entities(events: DataFrame, timestamp_col: str, seconds: int, entities: Sequence[str]) -> DataFrame:
    present = [e for e in entities if e in events.columns]
    if not present:
        raise ValueError(f"none of the entity columns {list(entities)} is present")
    stacked = events.select(
        floor_micros(to_micros(timestamp_col), seconds).alias("_w"),
        F.explode(F.array(*[F.struct(F.lit(e).alias("t"), F.col(e).cast("string").alias("v")) for e in present]))
        .alias("_e"))
    return (stacked.where(F.col("_w").isNotNull() & F.col("_e.v").isNotNull())
            .select("_w", F.col("_e.t").alias("entity_type"), F.col("_e.v").alias("entity"))
            .distinct())


def novelty_features(events: DataFrame, timestamp_col: str = "timestamp", seconds: int = NOVELTY_SECONDS,
                     entities: Sequence[str] = NOVELTY_ENTITIES, memory: DataFrame | None = None,
                     suffix: str = "1min") -> DataFrame:
    """``window_start`` + ``new_<e>_ratio_<suffix>`` and ``new_<e>_count_<suffix>`` per entity
    column; windows without any entity value of that column have NULLs (filled later)."""
    present = [e for e in entities if e in events.columns]
    return novelty_from_windows(_window_entities(events, timestamp_col, seconds, present), present, memory, suffix)


def novelty_from_windows(seen: DataFrame, present: Sequence[str], memory: DataFrame | None, suffix: str) -> DataFrame:
    """Novelty from distinct (``_w`` in microseconds, entity_type, entity)."""
    first = seen.groupBy("entity_type", "entity").agg(F.min("_w").alias("_first"))
    if memory is not None:
        first = first.join(memory.select("entity_type", "entity"), ["entity_type", "entity"], "left_anti")
    fresh = first.groupBy(F.col("_first").alias("_w"), "entity_type").agg(F.count(F.lit(1)).alias("_new"))
    totals = seen.groupBy("_w", "entity_type").agg(F.count(F.lit(1)).alias("_tot"))
    per = (totals.join(fresh, ["_w", "entity_type"], "left")
           .withColumn("_new", F.coalesce(F.col("_new"), F.lit(0))))
    aggs = []
    for e in present:
        hit = F.col("entity_type") == e
        aggs += [F.max(F.when(hit, F.col("_new") / F.col("_tot"))).alias(f"new_{e}_ratio_{suffix}"),
                 F.max(F.when(hit, F.col("_new"))).alias(f"new_{e}_count_{suffix}")]
    return per.groupBy("_w").agg(*aggs).select(from_micros(F.col("_w")).alias("window_start"),
                                               *[a for e in present for a in
                                                 (f"new_{e}_ratio_{suffix}", f"new_{e}_count_{suffix}")])


def empty_memory(spark) -> DataFrame:
    """A14 reset: the memory starts empty."""
    return spark.createDataFrame([], MEMORY_SCHEMA)


def update_memory(memory: DataFrame | None, events: DataFrame, timestamp_col: str = "timestamp",
                  seconds: int = NOVELTY_SECONDS, entities: Sequence[str] = NOVELTY_ENTITIES) -> DataFrame:
    """A14 carry: union of the memory and this batch's entities, keeping the earliest window.
    Write the result as a table (e.g. Parquet in the shared checkpoint folder) between calls."""
    seen = _window_entities(events, timestamp_col, seconds, [e for e in entities if e in events.columns])
    batch = seen.select("entity_type", "entity", from_micros(F.col("_w")).alias("first_window"))
    merged = batch if memory is None else batch.unionByName(memory.select("entity_type", "entity", "first_window"))
    return merged.groupBy("entity_type", "entity").agg(F.min("first_window").alias("first_window"))
