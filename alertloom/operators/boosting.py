"""M1: training of boosted trees of two classes, the trees of MLlib's ``GBTClassifier`` from packed rows.

A row is kept as one small integer per feature (the bin it falls in), in blocks of ``BLOCK`` rows spread over all tasks. Rows of a block
with the same bins and label have the same margin in every round: such a cell is kept once, with the number of its rows drawn for the
round; each row is still drawn for itself. A level of a tree is one job: each task sums its cells into histograms of (node, feature, bin),
the driver adds these up (a tree of adds if there are many tasks) and picks the splits. Bins, row draws, feature subsets, gains and leaf
values are MLlib's, so the trees are too, up to the rounding of sums. MLlib makes an object per row and level and draws anew for each level.

* The driver holds the trees and one level's histograms (``maxMemoryInMB`` at most, as in MLlib), a task one block and its histograms.
* Rows of the validation are carried along, so their loss after every round costs no pass of its own and training ends at the stop.
* NaN falls in the last bin; rows that come twice count twice; labels other than 0 and 1, or no rows, raise.
"""

from __future__ import annotations

import gc
import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.session import checkpoint_dir, cut_lineage

LANES, STEPS = 4096, 64  # parallel streams of draws, each of STEPS steps, two steps a row
DRAWN = LANES * STEPS // 2
BLOCK = 8 * DRAWN  # rows
CHUNK = 16_384  # cells summed at a time, which stay in the cache
BUNDLE = 64  # small features are summed as one, of so many bins at most
_64 = (1 << 64) - 1
_EPSILON = 2.220446049250313e-16
NODE_SCHEMA = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, "
               "leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>")


# ------------------------------------------------------------------------------ MLlib's draws

def _murmur(data: bytes, h: int) -> int:
    m32 = 0xFFFFFFFF
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & m32
        h ^= ((k << 15 | k >> 17) & m32) * 0x1B873593 & m32
        h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & m32
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m32
    h = (h ^ h >> 13) * 0xC2B2AE35 & m32
    return h ^ h >> 16


def xorshift_start(seed: int) -> int:
    """State of Spark's XORShiftRandom after it was given ``seed``."""
    data = (seed & _64).to_bytes(8, "big")
    low = _murmur(data, 0x3C074A61)
    return _murmur(data, low) << 32 | low


def xorshift_step(s):
    """The next state; of a Python int or of many states at once."""
    if isinstance(s, int):
        s ^= s << 21 & _64
        s ^= s >> 35
        return s ^ (s << 4 & _64)
    s = s ^ s << np.uint64(21)
    s = s ^ s >> np.uint64(35)
    return s ^ s << np.uint64(4)


def _jump(tables: np.ndarray, s: np.ndarray) -> np.ndarray:
    out = tables[0][(s & np.uint64(255)).astype(np.intp)]
    for i in range(1, 8):
        out = out ^ tables[i][(s >> np.uint64(8 * i) & np.uint64(255)).astype(np.intp)]
    return out


def draw_tables() -> list[np.ndarray]:
    """For i = 0, 1, ...: tables by byte of the state that follows 2^i lanes later."""
    images, out, n = np.uint64(1) << np.arange(64, dtype=np.uint64), [], 1
    for _ in range(STEPS):
        images = xorshift_step(images)
    while n <= LANES:
        t = np.zeros((8, 256), dtype=np.uint64)
        for bit in range(64):
            at = 1 << bit % 8
            t[bit // 8, at : 2 * at] = t[bit // 8, :at] ^ images[bit]
        out.append(t)
        images, n = _jump(t, images), 2 * n
    return out


def draws(start: int, tables: Sequence[np.ndarray], rate: float) -> tuple[np.ndarray, int]:
    """Which of the next ``DRAWN`` rows are drawn, and the state after them."""
    s = np.array([start], dtype=np.uint64)
    for t in tables[:-1]:
        s = np.concatenate([s, _jump(t, s)])
    after = int(_jump(tables[-1], s[:1])[0])
    high, low, unit = np.uint64((1 << 26) - 1), np.uint64((1 << 27) - 1), 2.0**-53
    out = np.empty((STEPS // 2, LANES), dtype=bool)
    for i in range(STEPS // 2):
        s = xorshift_step(s)
        a = (s & high) << np.uint64(27)
        s = xorshift_step(s)
        out[i] = (a + (s & low)).astype(np.float64) * unit < rate
    return out.T.ravel(), after


class JavaRandom:
    """java.util.Random, as far as MLlib uses it to seed the feature subsets."""

    def __init__(self, seed: int):
        self.s = (seed ^ 0x5DEECE66D) & (1 << 48) - 1

    def _next32(self) -> int:
        self.s = (self.s * 0x5DEECE66D + 0xB) & (1 << 48) - 1
        return self.s >> 16

    def next_long(self) -> int:
        high, low = self._next32(), self._next32()
        return ((high << 32) + (low - (1 << 32) if low >> 31 else low)) & _64


def feature_subset(d: int, k: int, seed: int) -> list[int]:
    """``k`` of ``d`` features by a reservoir, in MLlib's order."""
    out, s = list(range(min(k, d))), None
    for item in range(k, d):
        s = xorshift_step(xorshift_start(seed) if s is None else s)
        a = s & (1 << 26) - 1
        s = xorshift_step(s)
        at = int(((a << 27) + (s & (1 << 27) - 1)) * 2.0**-53 * (item + 1))
        if at < k:
            out[at] = item
    return out


def subset_size(strategy: str, d: int) -> int:
    """Features tried at a node of a single tree."""
    name = strategy.lower()
    if name in ("auto", "all"):
        return d
    if name in ("sqrt", "log2", "onethird"):
        return {"sqrt": lambda: int(np.ceil(np.sqrt(d))), "log2": lambda: max(1, int(np.ceil(np.log2(d)))), "onethird": lambda: int(np.ceil(d / 3.0))}[name]()
    return min(int(name), d) if name.isdigit() else int(np.ceil(float(name) * d))


# ------------------------------------------------------------------------------ bins and blocks

def bin_borders(train: DataFrame, features: Sequence[str], weight: float, n: int, weighted: float, max_bins: int, seed: int) -> list[np.ndarray]:
    """MLlib's candidate splits of each feature: between values at even shares of the weight, from all rows or from its sample of about
    ``max(max_bins^2, 10,000)`` rows."""
    bins = min(max_bins, n)
    wanted = max(bins * bins, 10_000)
    fraction = wanted / n if wanted < n else 1.0
    frame = train.select(*features, "label_d")
    if fraction < 1.0:
        s = xorshift_step(xorshift_start(seed)) & 0xFFFFFFFF
        some = frame._jdf.toJavaRDD().sample(False, fraction, s - (1 << 32) if s >> 31 else s)
        frame = DataFrame(train.sparkSession._jsparkSession.createDataFrame(some, frame._jdf.schema()), train.sparkSession)
    found = frame.toPandas()
    w = np.where(found["label_d"].to_numpy(dtype=float) == 1, weight, 1.0)
    out = []
    for f in features:
        x = found[f].to_numpy(dtype=float)
        put = x != 0.0
        values, at = np.unique(x[put], return_inverse=True)
        if not len(values):
            out.append(np.zeros(0))
            continue
        weights, total = np.bincount(at, weights=w[put], minlength=len(values)), fraction * weighted
        zero = total - weights.sum()
        if zero > _EPSILON * put.sum() * 100:
            i = int(np.searchsorted(values, 0.0))
            values, weights = np.insert(values, i, 0.0), np.insert(weights, i, zero)
        middle = (values[:-1] + values[1:]) / 2.0
        if len(middle) > bins - 1:
            stride, target, seen, kept = total / bins, total / bins, weights[0], []
            for i in range(1, len(values)):
                before, seen = seen, seen + weights[i]
                if abs(before - target) < abs(seen - target):
                    kept.append(i - 1)
                    target += stride
            middle = middle[kept]
        out.append(middle)
    return out


def packed(rows: DataFrame, features: Sequence[str], borders: Sequence[np.ndarray]) -> DataFrame:
    """Blocks of ``BLOCK`` rows to train on, or held out: the bins (features x cells), labels (1 or -1) and rows of the cells, and the cell
    of each row in the rows' order; only a partition's last is smaller."""
    kind, feats = _bin_type(max(map(len, borders), default=0)), list(features)

    def pack(batches):
        import pyarrow as pa

        waiting = {False: [], True: []}

        def block(held, least):
            parts = waiting[held]
            while parts and sum(p.shape[1] for p in parts) >= least:
                all_of = np.concatenate(parts, axis=1)
                out, rest = all_of[:, :BLOCK], all_of[:, BLOCK:]
                parts[:] = [rest] if rest.shape[1] else []
                order = np.lexsort(out)
                new = np.ones(len(order), dtype=bool)
                new[1:] = (out[:, order[1:]] != out[:, order[:-1]]).any(axis=0)
                cell = np.empty(len(order), dtype="<i4")
                cell[order] = np.cumsum(new) - 1
                cells = out[:, order[new]]
                yield pa.RecordBatch.from_pydict({"held": [held], "bins": [cells[:-1].astype(kind).tobytes()], "sign": [np.where(cells[-1] > 0, 1, -1).astype("i1").tobytes()],
                                                  "cell": [cell.tobytes()]})

        for batch in batches:
            names = batch.schema.names
            column = lambda c: batch.column(names.index(c)).to_numpy(zero_copy_only=False)
            codes = np.empty((len(feats) + 1, batch.num_rows), dtype=kind)
            for i, f in enumerate(feats):
                codes[i] = np.searchsorted(borders[i], column(f), side="left")
            codes[-1] = column("label_d") == 1
            val = column("_val").astype(bool)
            for held in (False, True):
                if (val == held).any():
                    waiting[held].append(codes[:, val == held])
                    yield from block(held, BLOCK)
        yield from block(False, 1)
        yield from block(True, 1)

    return rows.select(*feats, "label_d", "_val").mapInArrow(pack, "held boolean, bins binary, sign binary, cell binary")


def _bin_type(borders: int) -> str:
    return "u1" if borders < 256 else "<u2" if borders < 65_536 else "<u4"


def bundles(n_splits: Sequence[int]) -> list[list[int]]:
    """The features in groups of at most ``BUNDLE`` joint bins, or of one feature."""
    out, size = [], BUNDLE + 1
    for f in sorted(range(len(n_splits)), key=lambda f: n_splits[f]):
        if size * (n_splits[f] + 1) > BUNDLE:
            out, size = [*out, []], 1
        out[-1].append(f)
        size *= int(n_splits[f]) + 1
    return out


@dataclass
class Tree:
    """Nodes as lists; a leaf's feature is -1. ``stats``: rows, weight, sum and sum of squares of what the tree fits."""
    feature: list = field(default_factory=lambda: [-1])
    border: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [-1])
    level: list = field(default_factory=lambda: [0])
    stats: list = field(default_factory=lambda: [None])
    gain: list = field(default_factory=lambda: [None])
    valid: list = field(default_factory=lambda: [True])
    is_leaf: list = field(default_factory=lambda: [False])

    def add(self, level: int, stats: tuple, leaf: bool) -> int:
        for x, v in ((self.feature, -1), (self.border, 0), (self.left, -1), (self.level, level), (self.stats, stats), (self.gain, None), (self.valid, True), (self.is_leaf, leaf)):
            x.append(v)
        return len(self.feature) - 1

    def plain(self) -> tuple:
        """(feature, border, children, steps) for :func:`walked`; leaves lead to themselves."""
        feature, own, left = np.array(self.feature), np.arange(len(self.feature)), np.array(self.left)
        kids = np.stack([np.where(feature < 0, own, left), np.where(feature < 0, own, left + 1)], axis=1).ravel()
        return np.where(feature < 0, 0, feature), np.array(self.border), kids, max(self.level)

    def values(self) -> np.ndarray:
        return np.array([_mean(x) for x in self.stats])


def walked(tree: tuple, bins: np.ndarray) -> np.ndarray:
    """The node each row of a block (features x rows) ends in."""
    feature, border, kids, steps = tree
    n = bins.shape[1]
    node, flat, own = np.zeros(n, dtype=np.int64), bins.ravel(), np.arange(n)
    for _ in range(steps):
        node = kids.take(2 * node + (flat.take(feature.take(node) * n + own) > border.take(node)))
    return node


def _advance(tree, values, step: float, seed: int | None, rate: float, tables) -> Callable:
    """Blocks with the tree's values added to the margins, and of each cell the rows drawn for the next tree."""

    def advance(index, blocks):
        s = None if seed is None else xorshift_start(seed + index + 1)
        for held, bins, sign, margin, cell, rows in blocks:
            if tree is not None:
                margin = margin + step * values.take(walked(tree, bins))
            if s is not None and not held:
                rows = np.zeros(len(sign), dtype=np.int64)
                for start in range(0, len(cell), DRAWN):
                    drawn, s = draws(s, tables.value, rate)
                    part = cell[start : start + DRAWN]
                    rows += np.bincount(part[drawn[: len(part)]], minlength=len(sign))
            yield held, bins, sign, margin, cell, rows

    return advance


def _histograms(tree, slot: np.ndarray, slots: int, groups: Sequence[Sequence[int]], n_splits: np.ndarray, weight: float, first: bool) -> Callable:
    """Of a task's drawn rows: (rows, rows of label 1, weighted sum, weighted sum of squares) x node x joint bin for each group of features;
    of the rows held out the weighted sum of their losses and their weight."""
    widths = [int(np.prod([n_splits[f] + 1 for f in group])) for group in groups]

    def count(blocks):
        gc.freeze()  # else a worker looks through all its modules for cycles after each of some thousand tasks
        total, loss, held_weight = None, 0.0, 0.0
        for held, bins, sign, margin, _, rows in blocks:
            if held:
                counted = rows * np.where(sign > 0, weight, 1.0)
                loss, held_weight = loss + float(counted @ (2.0 * np.logaddexp(0.0, -2.0 * sign * margin))), held_weight + float(counted.sum())
                continue
            if total is None:
                total = [np.zeros((4, (slots + 1) * width)) for width in widths]
            for start in range(0, len(sign), CHUNK):
                part, y, m = np.ascontiguousarray(bins[:, start : start + CHUNK]), sign[start : start + CHUNK], margin[start : start + CHUNK]
                n = rows[start : start + CHUNK].astype(float)
                r = y.astype(float) if first else 4.0 * y / (1.0 + np.exp(2.0 * y * m))
                wr, one = np.where(y > 0, weight, 1.0) * n * r, np.flatnonzero(y > 0)
                wrr, n_one, at = wr * r, n.take(one), slot.take(walked(tree, part))
                for group, width, out in zip(groups, widths, total):
                    code = at * width
                    step = 1
                    for f in group:
                        code += part[f] if step == 1 else step * part[f].astype(np.int64)
                        step *= int(n_splits[f]) + 1
                    size = out.shape[1]
                    out[0] += np.bincount(code, weights=n, minlength=size)
                    out[1] += np.bincount(code.take(one), weights=n_one, minlength=size)
                    out[2] += np.bincount(code, weights=wr, minlength=size)
                    out[3] += np.bincount(code, weights=wrr, minlength=size)
        yield total, loss, held_weight

    return count


def _by_feature(total: Sequence[np.ndarray], slots: int, groups: Sequence[Sequence[int]], n_splits: np.ndarray) -> np.ndarray:
    """4 x feature x node x bin from the histograms of the groups."""
    out = np.zeros((4, len(n_splits), slots, int(n_splits.max(initial=0)) + 1))
    for group, h in zip(groups, total):
        shape = [int(n_splits[f]) + 1 for f in reversed(group)]
        h = h.reshape(4, slots + 1, *shape)[:, :slots]
        for i, f in enumerate(reversed(group)):
            out[:, f, :, : n_splits[f] + 1] = h.sum(axis=tuple(j + 2 for j in range(len(group)) if j != i))
    return out


def _added(a: tuple, b: tuple) -> tuple:
    total = a[0] if b[0] is None else b[0] if a[0] is None else [x + y for x, y in zip(a[0], b[0])]
    return total, a[1] + b[1], a[2] + b[2]


def _gathered(counted: RDD) -> tuple:
    if counted.getNumPartitions() > 32:
        return counted.treeReduce(_added, depth=2)
    parts = counted.collect()
    out = parts[0]
    for p in parts[1:]:
        out = _added(out, p)
    return out


# ------------------------------------------------------------------------------ splits

def _mean(stats: tuple) -> float:
    return stats[2] / stats[1] if stats[1] else 0.0


def _variance(stats) -> np.ndarray:
    _, w, s, q = stats
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(w == 0, 0.0, (q - s * s / w) / w)


def _split(tree: Tree, group: list, h: np.ndarray, n_splits: np.ndarray, weight: float, limits: tuple, max_depth: int) -> list[int]:
    """Splits the group's nodes by the histograms; the children to go on with, in MLlib's order."""
    least_rows, least_weight, least_gain = limits
    go_on = []
    h = np.stack([h[0], h[0] - h[1] + weight * h[1], h[2], h[3]])
    left = h.cumsum(axis=3)
    # a row of one feature is (slot, border); beyond a feature's own borders nothing is valid
    whole = left[..., -1:]
    right = whole - left
    for slot, (node, subset) in enumerate(group):
        tried = [f for f in subset if n_splits[f]]
        if tree.stats[node] is None:
            tree.stats[node] = tuple(float(x) for x in whole[:, tried[0] if tried else subset[0], slot, 0])
        best = (-np.inf, -1, -1)
        if tried:
            a, b = left[:, tried, slot, :-1], right[:, tried, slot, :-1]
            own = float(_variance(tree.stats[node]))
            with np.errstate(divide="ignore", invalid="ignore"):
                both = a[1] + b[1]
                gain = own - a[1] / both * _variance(a) - b[1] / both * _variance(b)
            ok = (a[0] >= least_rows) & (b[0] >= least_rows) & (a[1] >= least_weight) & (b[1] >= least_weight) & (gain >= least_gain)
            gain = np.where(ok & (np.arange(a.shape[2]) < n_splits[tried][:, None]), gain, -np.inf)
            at = gain.argmax(axis=1)
            k = int(gain[np.arange(len(tried)), at].argmax())
            best = (float(gain[k, at[k]]), k, int(at[k]))
        tree.gain[node], tree.valid[node] = best[0], best[0] > -np.inf
        if best[0] <= 0 or tree.level[node] == max_depth:
            tree.is_leaf[node] = True
            continue
        tree.feature[node], tree.border[node] = tried[best[1]], best[2]
        deeper = tree.level[node] + 1
        for side in (a, b):
            stats = tuple(float(x) for x in side[:, best[1], best[2]])
            leaf = deeper == max_depth or abs(float(_variance(stats))) < _EPSILON
            child = tree.add(deeper, stats, leaf)
            if side is a:
                tree.left[node] = child
            if not leaf:
                go_on.append(child)
    return go_on


def _grown(state: RDD, first: bool, d: int, k: int, n_splits: np.ndarray, weight: float, limits: tuple, max_depth: int, memory: int, seed: int) -> tuple[Tree, float, float]:
    """One tree, and the loss and weight of the rows held out before it."""
    tree, stack, rng, loss = Tree(), [0], JavaRandom(seed), None
    groups = bundles(n_splits)
    while stack:
        group, used = [], 0
        while stack:
            subset = feature_subset(d, k, rng.next_long()) if k < d else list(range(d))
            need = 3 * 8 * int(sum(n_splits[f] + 1 for f in subset))
            if used and used + need > memory:
                break
            group.append((stack.pop(0), subset))
            used += need
        slot = np.full(len(tree.feature), len(group), dtype=np.int64)
        slot[[node for node, _ in group]] = np.arange(len(group))
        total, *held = _gathered(state.mapPartitions(_histograms(tree.plain(), slot, len(group), groups, n_splits, weight, first)))
        loss = held if loss is None else loss
        h = _by_feature(total, len(group), groups, n_splits)
        for child in _split(tree, group, h, n_splits, weight, limits, max_depth):
            stack.insert(0, child)
    return tree, *loss


def fit_boosted_trees(clf: GBTClassifier, rows: DataFrame, features: Sequence[str], weight: float, n: int, n_positive: int, n_held: int = 0,
                      stop: Callable[[Sequence[float]], tuple[int, bool]] | None = None) -> tuple[GBTClassificationModel, list[float]]:
    """Boosted trees of the classifier's setting, and the weighted mean loss of the held rows after each round.

    ``rows`` (written already, spread over the tasks): the features as doubles, ``label_d``, and ``_val`` for rows held out; ``weight`` is that
    of label 1. ``stop`` is given the losses so far and says (best round, whether to stop): the model then has the best rounds only.
    """
    spark, d = rows.sparkSession, len(features)
    if not n:
        raise ValueError("boosted trees need rows to train on")
    if rows.where("label_d IS NULL OR label_d NOT IN (0, 1)").limit(1).count():
        raise ValueError("boosted trees need labels 0 and 1")
    weighted = (n - n_positive) + weight * n_positive
    seed, most, rate, every = clf.getSeed(), clf.getMaxIter(), clf.getSubsamplingRate(), clf.getCheckpointInterval()
    borders = bin_borders(rows.where(~F.col("_val")), features, weight, n, weighted, clf.getMaxBins(), seed)
    n_splits, k = np.array([len(b) for b in borders]), subset_size(clf.getFeatureSubsetStrategy(), d)
    limits = clf.getMinInstancesPerNode(), clf.getMinWeightFractionPerNode() * weighted, clf.getMinInfoGain()
    kind = _bin_type(n_splits.max(initial=0))

    def unpacked(r):
        sign, cell = np.frombuffer(bytes(r.sign), dtype="i1"), np.frombuffer(bytes(r.cell), dtype="<i4")
        return r.held, np.frombuffer(bytes(r.bins), dtype=kind).reshape(d, -1), sign, np.zeros(len(sign)), cell, np.bincount(cell, minlength=len(sign))

    tables = spark.sparkContext.broadcast(draw_tables())
    state, kept, written = cut_lineage(packed(rows, features, borders)).rdd.map(unpacked), [], []
    trees, losses, best, ended = [], [], 0, False
    for m in range(most + 1):
        done = m == most
        if done and not (n_held and stop):
            break
        last = trees[-1] if trees else None
        state = state.mapPartitionsWithIndex(_advance(last and last.plain(), last and last.values(), 1.0 if m == 1 else clf.getStepSize(),
                                                      None if rate >= 1.0 or done else seed + m, rate, tables), preservesPartitioning=True)
        state.persist(StorageLevel.MEMORY_AND_DISK)
        if every > 0 and m and m % every == 0 and not done:
            state.checkpoint()
        if done:
            loss, held = _gathered(state.filter(lambda b: b[0]).mapPartitions(_histograms(None, None, 0, [], n_splits, weight, False)))[1:]
        else:
            tree, loss, held = _grown(state, m == 0, d, k, n_splits, weight, limits, clf.getMaxDepth(), clf.getMaxMemoryInMB() << 20, seed + m)
        kept.append(state)
        for old in kept[:-1]:
            old.unpersist()
        kept[:-1] = []
        if state.isCheckpointed():
            written.append(state.getCheckpointFile())
            _delete(spark, written[:-1])
            written[:-1] = []
        if n_held and stop and m:
            losses.append(loss / held)
            best, ended = stop(losses)
            if ended:
                break
        if not done:
            trees.append(tree)
    state.unpersist()
    _delete(spark, written)
    tables.destroy()
    return as_model(clf, spark, trees[: best if n_held and stop else len(trees)], borders, d), losses


def _delete(spark, files: Sequence[str]) -> None:
    for f in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# ------------------------------------------------------------------------------ the model

def _node_rows(tree: Tree, number: int, borders: Sequence[np.ndarray]) -> list[tuple]:
    """The tree as MLlib saves it: nodes numbered from the root, left before right; children that predict the same are one leaf."""
    out: list = []

    def value(node):  # of a leaf, or of a node whose children come to the same; else None
        if tree.feature[node] < 0:
            return _mean(tree.stats[node])
        a, b = value(tree.left[node]), value(tree.left[node] + 1)
        same[node] = a if a is not None and a == b else None
        return same[node]

    def put(node) -> int:
        own, stats = len(out), tree.stats[node]
        out.append(None)
        numbers = [float(x) for x in stats[1:]], int(stats[0])
        if tree.feature[node] < 0 or same[node] is not None:
            impurity = float(_variance(stats)) if tree.valid[node] else -1.0
            out[own] = (number, (own, _mean(stats) if tree.feature[node] < 0 else same[node], impurity, *numbers, -1.0, -1, -1, (-1, [], -1)))
        else:
            a, b, f = put(tree.left[node]), put(tree.left[node] + 1), int(tree.feature[node])
            out[own] = (number, (own, _mean(stats), float(_variance(stats)), *numbers, tree.gain[node], a, b, (f, [float(borders[f][tree.border[node]])], -1)))
        return own

    same: dict = {}
    value(0)
    put(0)
    return out


def as_model(clf: GBTClassifier, spark, trees: Sequence[Tree], borders: Sequence[np.ndarray], d: int) -> GBTClassificationModel:
    """MLlib's model of these trees: they are written as MLlib saves a model, and read by it."""
    path = f"{checkpoint_dir(spark)}/alertloom-model-{uuid.uuid4().hex}"
    given = {p.name: v for p, v in clf._paramMap.items()}
    default = {p.name: v for p, v in clf._defaultParamMap.items()}

    def about(kind: str, uid: str, params: dict, defaults: dict, **more) -> str:
        return json.dumps({"class": kind, "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid, "paramMap": params, "defaultParamMap": defaults, **more})

    base, one = "org.apache.spark.ml", "org.apache.spark.ml.regression.DecisionTreeRegressionModel"
    whole = about(f"{base}.classification.GBTClassificationModel", clf.uid, given, default, numFeatures=d, numTrees=len(trees))
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    weights = [(i, about(one, f"dtr_{uuid.uuid4().hex[:12]}", {}, {}), 1.0 if i == 0 else clf.getStepSize()) for i in range(len(trees))]
    spark.createDataFrame(weights, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    nodes = [x for i, t in enumerate(trees) for x in _node_rows(t, i, borders)]
    spark.createDataFrame(nodes, NODE_SCHEMA).coalesce(1).write.parquet(f"{path}/data")
    model = clf._copyValues(GBTClassificationModel.load(path)._resetUid(clf.uid))
    _delete(spark, [path])
    return model
