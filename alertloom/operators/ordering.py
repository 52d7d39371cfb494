"""Exact order-dependent computations without a single-partition window.

* :func:`global_row_number` -- range-partition by a *unique* sort key (so a hot timestamp is
  split by the tie-breaker), number rows inside each partition, and add each partition's offset
  from a per-partition count table (one row per partition: bounded by the partition count).
* :func:`chunked` -- cut the numbered rows into chunks of ``chunk_rows`` and copy the last
  ``overlap`` rows of each chunk into the next, so ``lag`` / short frames are exact per chunk.
* :func:`running_sum` -- exact global running sums: chunk totals (one row per chunk) are
  prefix-summed and added to the in-chunk running sum.
* :func:`kth_values` -- exact order statistics by refinement around drawn pivots; all ranks share
  their rounds, and only pivots and counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.session import cut_lineage


def global_row_number(df: DataFrame, order: Sequence[Column | str], partitions: int | None = None,
                      rn_col: str = "_rn") -> DataFrame:
    """0-based global row number by ``order`` (which must be unique per row).

    Eager: the range-partitioned rows are checkpointed (``spark.checkpoint.dir``)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    # Range bounds come from a sample seeded by the RDD id, so two evaluations of this plan
    # (the count branch and the row branch, or a recompute after an executor loss) may cut
    # differently. A reliable checkpoint pins one partitioning for both.
    ranged = cut_lineage(ranged)
    per = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_mid0"))
    # one row per partition: a size bound fixed by the partition count
    offs = per.select("_pid", "_mid0", F.coalesce(
        F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offs), "_pid")
            .withColumn(rn_col, F.col("_off") + F.col("_mid") - F.col("_mid0"))
            .drop("_pid", "_mid", "_mid0", "_off"))


def chunked(numbered: DataFrame, chunk_rows: int, overlap: int, rn_col: str = "_rn") -> DataFrame:
    """Add ``_chunk`` and ``_copy``; copies carry the previous chunk's last ``overlap`` rows."""
    if overlap > chunk_rows:
        raise ValueError("overlap must not exceed chunk_rows")
    chunk = F.floor(F.col(rn_col) / F.lit(chunk_rows)).cast("long")
    tail = F.pmod(F.col(rn_col), F.lit(chunk_rows)) >= chunk_rows - overlap
    arr = F.when(tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)) if overlap > 0 else F.array(chunk)
    return (numbered.withColumn("_home", chunk)
            .withColumn("_chunk", F.explode(arr))
            .withColumn("_copy", F.col("_chunk") != F.col("_home"))
            .drop("_home"))


def running_sum(df: DataFrame, value: str, out: str, chunk_col: str = "_chunk", rn_col: str = "_rn",
                copy_col: str | None = "_copy") -> DataFrame:
    """Inclusive global running sum of ``value`` in ``rn`` order, on a chunked frame."""
    home = df.where(~F.col(copy_col)) if copy_col else df
    totals = home.groupBy(chunk_col).agg(F.sum(value).alias("_tot"))
    offs = totals.select(chunk_col, F.coalesce(F.sum("_tot").over(
        Window.orderBy(chunk_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_coff"))
    w = Window.partitionBy(chunk_col).orderBy(rn_col).rowsBetween(Window.unboundedPreceding, 0)
    return (home.join(offs, chunk_col, "left")
            .withColumn(out, F.coalesce(F.col("_coff"), F.lit(0)) + F.sum(value).over(w))
            .drop("_coff"))


def _place(pivots: Sequence, first: int = 0) -> Column:
    """2 i + 1 for ``_k`` on pivot i, 2 i between the pivots before and after it: by halving."""
    if not pivots:
        return F.lit(2 * first)
    m = len(pivots) // 2
    p = F.lit(pivots[m])
    return (F.when(F.col("_k") == p, F.lit(2 * (first + m) + 1)).when(F.col("_k") < p, _place(pivots[:m], first))
            .otherwise(_place(pivots[m + 1 :], first + m + 1)))


def kth_values(df: DataFrame, col: Column | str, ranks: Sequence[int], pivots: int = 63) -> list:
    """The non-null values of the given ranks (1-based, ties counted individually), None beyond the last.

    Exact for every orderable type and at every size. All ranks share their rounds: a round draws up to ``pivots``
    rows from each range that still holds a rank, counts the rows on and between them (values are compared
    in the column's own order, times as microseconds), and narrows each rank to a pivot or to the range between two.
    Only pivots and counts reach the driver, ``pivots`` for each open range; a round is two jobs.
    """
    c = F.col(col) if isinstance(col, str) else col
    cur = df.select(c.alias("_v")).where(F.col("_v").isNotNull())
    kind = cur.schema["_v"].dataType.typeName()
    key = {"timestamp": lambda: F.unix_micros("_v"), "timestamp_ntz": lambda: F.unix_micros(F.col("_v").cast("timestamp")),
           "date": lambda: F.unix_date("_v")}.get(kind, lambda: F.col("_v"))()
    cur = cur.withColumn("_k", key)
    found: dict[int, object] = {}
    # (key above, key below), None where open -> {rank: rank inside the range}
    ranges: dict[tuple, dict[int, int]] = {(None, None): {k: k for k in set(ranks) if k >= 1}}
    while any(ranges.values()):
        bounds = list(ranges)
        inside = [F.lit(True) if lo is None else F.col("_k") > F.lit(lo) for lo, _ in bounds]
        inside = [a if hi is None else a & (F.col("_k") < F.lit(hi)) for a, (_, hi) in zip(inside, bounds)]
        drawn = None
        for i, a in enumerate(inside):
            # rows, not distinct values: each task keeps its first rows by a drawn number, and nothing is shuffled
            some = cur.where(a).select(F.lit(i).alias("_i"), "_k", "_v", F.rand(i).alias("_r")).orderBy("_r").limit(pivots).drop("_r")
            drawn = some if drawn is None else drawn.unionAll(some)
        at: list[list] = [[] for _ in bounds]
        for r in drawn.distinct().orderBy("_i", "_k").collect():
            if not at[r["_i"]] or at[r["_i"]][-1][0] != r["_k"]:
                at[r["_i"]].append((r["_k"], r["_v"]))
        if not any(at):
            break
        # 2 i + 1: on pivot i; 2 i: between the pivots before and after.
        place = F.lit(None)
        for i, a in enumerate(inside):
            if not at[i]:
                continue
            place = F.when(a, F.struct(F.lit(i).alias("i"), _place([k for k, _ in at[i]]).alias("b"))).otherwise(place)
        counts = cur.groupBy(place.alias("_p")).agg(F.count(F.lit(1)).alias("c")).where(F.col("_p").isNotNull()).select("_p.i", "_p.b", "c")
        rows = sorted((r["i"], r["b"], r["c"]) for r in counts.collect())
        narrower: dict[tuple, dict[int, int]] = {}
        for i, (lo, hi) in enumerate(bounds):
            here = [(b, c) for j, b, c in rows if j == i]
            for rank, k in ranges[lo, hi].items():
                for b, c in here:
                    if k > c:
                        k -= c
                        continue
                    if b % 2:
                        found[rank] = at[i][b // 2][1]
                    else:
                        part = (at[i][b // 2 - 1][0] if b else lo, at[i][b // 2][0] if b < 2 * len(at[i]) else hi)
                        narrower.setdefault(part, {})[rank] = k
                    break
        ranges = narrower
    return [found.get(k) for k in ranks]


def kth_smallest(df: DataFrame, col: Column | str, k: int, pivots: int = 63):
    """The ``k``-th smallest non-null value, or None; see :func:`kth_values`."""
    return kth_values(df, col, [k], pivots)[0]
