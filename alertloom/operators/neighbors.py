"""Exact k-nearest-neighbour join over partitions, and the local outlier factor on it.

Rows are first collapsed to distinct points with their number, so copies are never paired. Points are dealt to the
cells of a bounded set of pivots. Triangle inequalities give each cell a radius within which the k nearest
neighbours of all its points must lie, and a point is compared only with the cells whose radius reaches it (the
pivot-based kNN join of Lu et al. 2012). Cells that lie near each other share a group, so a point is copied once to
each of a few groups and not to each cell; large groups are cut into blocks, so none has to fit one task, and the
best of all blocks are ranked. No point is dropped, capped or sampled; only pivots and one row of bounds per cell
reach the driver.

The local outlier factor follows Breunig et al. 2000 with exactly ``k`` neighbours per row (ties: smaller id).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.operators.scaling import fit_standard_scaler, percentile_sigmoid, standard_scale
from alertloom.session import cut_lineage

#: Pivots at most, points for each pivot, and the least points of a block.
MOST_PIVOTS, CELL, BLOCK = 256, 2048, 4096
#: Blocks of a side, as long as their vectors take no more than so many bytes.
SIDES, BLOCK_BYTES = 4, 64 << 20
#: Relative room left for rounding in the bounds; it only copies a few points more.
_SLACK = 1e-9


def distinct_points(df: DataFrame, features: Sequence[str] | str, id_col: str) -> DataFrame:
    """(pid, v, n): distinct feature vectors, the smallest id that has each and the number of its rows.

    ``features`` are numeric columns or the name of one array column; NULL and NaN values count as 0, NULL ids are
    left out. A vector of many rows is combined before the shuffle.
    """
    clean = lambda c: F.coalesce(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    v = F.transform(features, clean) if isinstance(features, str) else F.array(*[clean(F.col(f)) for f in features])
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), v.alias("v")).where(F.col("v").isNotNull())
    return rows.groupBy("v").agg(F.min("_id").alias("pid"), F.count(F.lit(1)).alias("n")).select("pid", "v", "n")


def _matrix(column) -> np.ndarray:
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances from differences, some rows at a time."""
    out = np.empty((len(x), len(y)))
    step = max(1, 4_000_000 // max(1, y.size))
    for i in range(0, len(x), step):
        out[i : i + step] = np.sqrt(((x[i : i + step, None, :] - y[None]) ** 2).sum(2))
    return out


def _to_cells(pivots: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            d = _distances(_matrix(batch.column(1)), pivots)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])],
                                             names=[*batch.schema.names, "cell", "d"])
    return run


def _reached(pivots: np.ndarray, radius: np.ndarray, groups: np.ndarray):
    """mapInArrow: (pid, v) to (pid, v, groups): the groups of all cells whose radius around the pivot reaches the point."""
    def run(batches):
        import pyarrow as pa

        member = groups[:, None] == np.arange(groups.max() + 1)
        for batch in batches:
            hit = (_distances(_matrix(batch.column(1)), pivots) <= radius) @ member
            found = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(hit.sum(1))).astype(np.int32)), pa.array(np.nonzero(hit)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["pid", "v", "groups"])
    return run


def _grouped(sizes: dict[int, int], between: np.ndarray, block: int) -> np.ndarray:
    """The group of each cell: cells in a chain, each followed by the nearest that is left, put together up to ``block`` points."""
    groups, left = np.full(len(between), -1), sorted(sizes)
    at, group, held = left[0], 0, 0
    while left:
        at = min(left, key=lambda c: (between[at, c], c))
        left.remove(at)
        if held and held + sizes[at] > block:
            group, held = group + 1, 0
        groups[at], held = group, held + sizes[at]
    return groups


def _nearest(k: int, other: bool, pivots: np.ndarray, radius: np.ndarray):
    """Cogrouped: the k nearest reference points of each query point of a block; ``other`` leaves out the point itself."""
    def run(key, queries, refs):
        import pyarrow as pa

        mine, theirs, dist = [], [], []
        if queries.num_rows and refs.num_rows:
            refs = refs.sort_by("rpid")
            x, whole, q, ids = _matrix(queries["v"]), _matrix(refs["rv"]), queries["pid"].to_numpy(), refs["rpid"].to_numpy()
            cells = queries["cell"].to_numpy()
            for cell in np.unique(cells):
                here = np.flatnonzero(cells == cell)
                near = np.flatnonzero(_distances(whole, pivots[cell : cell + 1])[:, 0] <= radius[cell])
                if not len(near):
                    continue
                y, r = (whole, ids) if len(near) == len(whole) else (whole[near], ids[near])
                yy = (y**2).sum(1)
                step = max(1, min(256, 8_000_000 // len(y)))
                for i in range(0, len(here), step):
                    rows = here[i : i + step]
                    part = x[rows]
                    xx = (part**2).sum(1)[:, None]
                    square = xx + yy - 2 * (part @ y.T)  # rounded: chooses candidates only
                    room = 1e-10 * (xx + yy.max())
                    first, last = (np.searchsorted(r, q[rows], side) if other else np.zeros(len(rows), int) for side in ("left", "right"))
                    for j, row in enumerate(rows):
                        own = slice(first[j], last[j])
                        square[j, own] = np.inf
                        at = np.arange(len(r))
                        if len(r) - (last[j] - first[j]) > k:
                            s = square[j]
                            at = np.flatnonzero(s <= np.partition(s, k - 1)[k - 1] + 2 * room[j])
                        at = at[(at < own.start) | (at >= own.stop)]
                        d = np.sqrt(((y[at] - part[j]) ** 2).sum(1))
                        best = np.argsort(d, kind="stable")[:k]
                        mine.append(np.full(len(best), row))
                        theirs.append(near[at[best]])
                        dist.append(d[best])
        mine, theirs, dist = (np.concatenate([np.zeros(0, t), *x]).astype(t) for x, t in ((mine, np.int64), (theirs, np.int64), (dist, np.float64)))
        refs_id = refs["rpid"].take(pa.array(theirs))
        return pa.table({"pid": queries["pid"].take(pa.array(mine)), "nid": refs_id, "distance": pa.array(dist)})
    return run


def knn_join(queries: DataFrame, reference: DataFrame | None, k: int, most_pivots: int = MOST_PIVOTS, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(pid, rank, nid, distance): the k nearest reference points of each query point, exactly.

    Both sides are ``distinct_points`` with long ids and vectors of one length. ``reference`` None joins the queries with
    themselves, each without itself. Ties go to the smaller id. Fewer than k rows if the reference has fewer points.
    """
    other = reference is None
    points = cut_lineage(queries.select(F.col("pid").cast("long").alias("pid"), "v"))
    refs = points if other else cut_lineage(reference.select(F.col("pid").cast("long").alias("pid"), "v"))
    n, n_refs = points.count(), refs.count()
    kinds = "pid long, nid long, distance double"
    spark = queries.sparkSession
    if not n or not n_refs:
        return spark.createDataFrame([], kinds).select("pid", F.lit(1).alias("rank"), "nid", "distance")
    count = min(most_pivots, max(1, n_refs // cell))
    pivots = np.array([r.v for r in refs.orderBy(F.xxhash64("pid"), "pid").limit(count).collect()], float)  # most_pivots rows
    dealt = cut_lineage(points.mapInArrow(_to_cells(pivots), "pid long, v array<double>, cell int, d double"))
    home = dealt if other else refs.mapInArrow(_to_cells(pivots), "pid long, v array<double>, cell int, d double")
    # The k + 1 reference points nearest to each pivot bound the neighbours of every cell: one is left out as a point itself.
    w = Window.partitionBy("cell").orderBy("d", "pid")
    near = home.select("cell", "d", "pid").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    close: list[list[float]] = [[] for _ in pivots]
    for r in near.select("cell", "d").collect():  # k + 1 numbers for each pivot
        close[r.cell].append(r.d)
    widest = {r.cell: (r.u, r.n) for r in dealt.groupBy("cell").agg(F.max("d").alias("u"), F.count(F.lit(1)).alias("n")).collect()}
    between = _distances(pivots, pivots)
    radius = np.full(len(pivots), -1.0)
    for i, (u, _) in widest.items():
        bound = sorted(between[i, j] + d for j, ds in enumerate(close) for d in ds)
        kth = bound[k] if len(bound) > k else math.inf
        radius[i] = (2 * u + kth) * (1 + _SLACK) + _SLACK
    most = max(1, BLOCK_BYTES // (8 * pivots.shape[1]))
    q_block, r_block = (min(most, max(block, math.ceil(x / SIDES))) for x in (n, n_refs))
    # Groups have points of cells with queries only; the others' radius reaches nothing.
    groups = _grouped({c: v[1] for c, v in widest.items()}, between, q_block)
    reached = refs.mapInArrow(_reached(pivots, radius, groups), "pid long, v array<double>, groups array<int>")
    copies = reached.select(F.col("pid").alias("rpid"), F.col("v").alias("rv"), F.explode("groups").alias("rc"))
    sizes = {r.rc: r.n for r in copies.groupBy("rc").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = {g: sum(v[1] for c, v in widest.items() if groups[c] == g) for g in range(groups.max() + 1)}
    mapped = lambda m, c: F.element_at(F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))]), c)
    parts = lambda m, size, c: mapped({g: max(1, math.ceil(v / size)) for g, v in m.items()}, c)
    q_parts, r_parts = (lambda c: parts(held, q_block, c)), (lambda c: parts({g: sizes.get(g, 0) for g in held}, r_block, c))
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    mine = dealt.select("pid", "v", "cell", mapped({c: int(groups[c]) for c in widest}, F.col("cell")).alias("c"))
    mine = mine.withColumns({"qb": F.pmod(F.xxhash64("pid"), q_parts(F.col("c"))).cast("int"), "rb": every(r_parts(F.col("c")))})
    theirs = copies.select("rpid", "rv", F.col("rc").alias("c")).withColumn("rb", F.pmod(F.xxhash64("rpid"), r_parts(F.col("c"))).cast("int"))
    theirs = theirs.withColumn("qb", every(q_parts(F.col("c"))))
    keys = lambda p: [F.col("c").alias(f"{p}c"), F.col("qb").alias(f"{p}qb"), F.col("rb").alias(f"{p}rb")]
    mine, theirs = mine.select("pid", "v", "cell", *keys("a")), theirs.select("rpid", "rv", *keys("b"))
    best = mine.groupBy("ac", "aqb", "arb").cogroup(theirs.groupBy("bc", "bqb", "brb")).applyInArrow(_nearest(k, other, pivots, radius), kinds)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("pid").orderBy("distance", "nid")))
    return ranked.where(F.col("rank") <= k).select("pid", "rank", "nid", "distance")


# ---------------------------------------------------------------- local outlier factor

@dataclass
class LofModel:
    """A fitted factor: ``points`` is a written table (pid, v, n, k_distance, lrd, lof) of all distinct reference points."""

    points: DataFrame
    features: list[str] | str
    scaler: dict[str, tuple[float, float]] | None
    k: int


def _taken(neighbors: DataFrame, points: DataFrame, own: DataFrame | None, k: int) -> DataFrame:
    """(pid, nid, distance, times): how often each neighbour point counts among the k nearest rows of a point's rows.

    ``own`` (pid, n) adds the other rows of the point itself, at distance 0 and before all others.
    """
    counted = neighbors.join(points.select(F.col("pid").alias("nid"), "n"), "nid")
    if own is not None:
        counted = counted.select("pid", "rank", "nid", "distance", "n").union(
            own.select("pid", F.lit(0), F.col("pid"), F.lit(0.0), F.col("n") - 1))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    times = F.greatest(F.lit(0), F.least(F.col("n"), k - before))
    return counted.withColumn("times", times).where(F.col("times") > 0).select("pid", "nid", "distance", "times")


def _density(taken: DataFrame, k_distance: DataFrame) -> DataFrame:
    """(pid, lrd): local reachability densities, 1 / (mean reach distance + 1e-10)."""
    reach = taken.join(k_distance.select(F.col("pid").alias("nid"), "k_distance"), "nid")
    mean = F.sum(F.col("times") * F.greatest("k_distance", "distance")) / F.sum("times")
    return reach.groupBy("pid").agg((1.0 / (mean + 1e-10)).alias("lrd"))


def _factor(taken: DataFrame, densities: DataFrame, own: DataFrame) -> DataFrame:
    """(pid, lof): mean density of the neighbours by the point's own."""
    around = taken.join(densities.select(F.col("pid").alias("nid"), F.col("lrd").alias("their")), "nid")
    mean = around.groupBy("pid").agg((F.sum(F.col("times") * F.col("their")) / F.sum("times")).alias("around"))
    return mean.join(own, "pid").select("pid", (F.col("around") / F.col("lrd")).alias("lof"))


def fit_lof(df: DataFrame, features: Sequence[str] | str, k: int = 20, scale: bool = True, *, id_col: str, **join) -> LofModel:
    """M5 fit on all rows of ``df``: neighbours, k-distances, densities and factors of its distinct points.

    ``id_col`` is a whole number, unique for each row. ``scale`` standardises numeric columns first (not an array column).
    With k rows or fewer, all other rows are neighbours. A single point of a single row has no neighbour and raises ValueError.
    """
    scaler = fit_standard_scaler(df, features) if scale and not isinstance(features, str) else None
    data = standard_scale(df, scaler) if scaler else df
    points = cut_lineage(distinct_points(data, features, id_col))
    own = points.select("pid", "n")
    taken = cut_lineage(_taken(knn_join(points, None, k, **join), points, own, k))
    k_distance = cut_lineage(taken.groupBy("pid").agg(F.max("distance").alias("k_distance")))
    lrd = cut_lineage(_density(taken, k_distance))
    model = points.join(k_distance, "pid").join(lrd, "pid").join(_factor(taken, lrd, lrd), "pid")
    model = cut_lineage(model)
    if not model.limit(1).count():
        raise ValueError("a local outlier factor needs two rows at least")
    return LofModel(model, features if isinstance(features, str) else list(features), scaler, k)


def _members(model: LofModel, df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, v) and distinct points of a table, scaled as the model."""
    data = standard_scale(df, model.scaler) if model.scaler else df
    rows = distinct_points(data.withColumn("_one", F.col(id_col)), model.features, "_one")
    clean = lambda c: F.coalesce(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    v = F.transform(model.features, clean) if isinstance(model.features, str) else F.array(*[clean(F.col(f)) for f in model.features])
    return data.select(F.col(id_col), v.alias("v")), rows


def training_factors(model: LofModel, df: DataFrame, id_col: str) -> DataFrame:
    """(id, lof) of the rows that the model was fitted on, each judged without itself."""
    rows, _ = _members(model, df, id_col)
    return rows.join(model.points.select("v", "lof"), "v").select(id_col, "lof")


def novelty_factors(model: LofModel, df: DataFrame, id_col: str, **join) -> DataFrame:
    """M5 score: (id, lof) of new rows against the fitted points; every reference row may be a neighbour, equal ones too."""
    rows, points = _members(model, df, id_col)
    points = cut_lineage(points)
    taken = cut_lineage(_taken(knn_join(points, model.points, model.k, **join), model.points, None, model.k))
    lrd = cut_lineage(_density(taken, model.points))
    found = points.select("pid", "v").join(_factor(taken, model.points.select("pid", "lrd"), lrd), "pid")
    return rows.join(found.select("v", "lof"), "v").select(id_col, "lof")


def lof_scores(factors: DataFrame, quantiles: Sequence[float] | None = None) -> DataFrame:
    """``lof_score`` (percentile sigmoid of the factors: the batch's own, or stored quantiles) and the ``> 0.5`` flag."""
    out, _ = percentile_sigmoid(factors, "lof", "lof_score", quantiles)
    return out.withColumn("lof_anomaly", (F.col("lof_score") > 0.5).cast("int"))


def combine_outliers(forest: DataFrame, lof: DataFrame, id_col: str) -> DataFrame:
    """M6: isolation and factor scores of the same rows; ``combined_score`` is their mean, ``is_anomaly`` its ``> 0.5`` flag."""
    both = forest.drop("combined_score", "is_anomaly").join(lof, id_col)
    mean = (F.col("if_score") + F.col("lof_score")) / 2
    return both.withColumn("combined_score", mean).withColumn("is_anomaly", (mean > 0.5).cast("int"))
