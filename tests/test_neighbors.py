import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.operators import neighbors as NB


def brute_lof(x, k, q=None):
    """Factors of the rows of x (each without itself), or of q against x, by plain loops; ties to the earlier row."""
    def near(p, skip):
        d = np.sqrt(((x - p) ** 2).sum(1))
        order = [i for i in np.argsort(d, kind="stable") if i != skip][:k]
        return order, d[order]
    fit = [near(p, i) for i, p in enumerate(x)]
    kd = np.array([d.max() for _, d in fit])
    density = lambda idx, d: 1 / (np.maximum(kd[idx], d).mean() + 1e-10)
    lrd = np.array([density(*f) for f in fit])
    if q is None:
        return np.array([lrd[i].mean() / lrd[j] for j, (i, _) in enumerate(fit)])
    return np.array([lrd[i].mean() / density(i, d) for i, d in (near(p, None) for p in q)])


def table(spark, x, start=0):
    return spark.createDataFrame([(start + i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"f{j} double" for j in range(x.shape[1])))


@pytest.mark.parametrize("cell, block", [(2048, 4096), (20, 4096), (20, 7)])
def test_knn_join_equals_brute_force(spark, cell, block):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 1, (150, 3)), r.normal(9, 0.1, (100, 3)), r.integers(0, 3, (60, 3))])
    points = NB.distinct_points(table(spark, x), ["f0", "f1", "f2"], "id")
    rows = {p.pid: np.array(p.v) for p in points.collect()}
    assert sum(p.n for p in points.collect()) == 310 and len(rows) == len(np.unique(x, axis=0))
    got = {}
    for g in NB.knn_join(points, None, 5, cell=cell, block=block).collect():
        got.setdefault(g.pid, []).append((g["rank"], g.nid, g.distance))
    for pid, v in rows.items():
        want = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in rows.items() if i != pid)[:5]
        assert [(i + 1, n) for i, (_, n) in enumerate(want)] == [g[:2] for g in sorted(got[pid])]
        assert np.allclose([d for d, _ in want], [g[2] for g in sorted(got[pid])])


def test_few_points_and_empty_tables(spark):
    x = np.array([[0.0, 0], [1, 0], [1, 0]])
    points = NB.distinct_points(table(spark, x), ["f0", "f1"], "id")
    assert [tuple(r) for r in NB.knn_join(points, None, 5).collect()] and NB.knn_join(points.limit(0), None, 5).count() == 0
    assert NB.knn_join(points, points.limit(0), 5).count() == 0
    odd = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 1.0), (None, 0.0, 1.0), (3, 0.0, 1.0)], "id long, f0 double, f1 double")
    assert [(p.pid, p.v, p.n) for p in NB.distinct_points(odd, ["f0", "f1"], "id").collect()] == [(1, [0.0, 1.0], 3)]
    with pytest.raises(ValueError):
        NB.fit_lof(table(spark, x[:1]), ["f0", "f1"], id_col="id")


@pytest.mark.parametrize("cell", [2048, 25])
def test_lof_equals_brute_force(spark, cell):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 1, (120, 2)), np.repeat(r.normal(5, 1, (4, 2)), [1, 3, 12, 40], axis=0), [[30.0, 30.0]]])
    df = table(spark, x)
    model = NB.fit_lof(df, ["f0", "f1"], 10, scale=False, id_col="id", cell=cell)
    got = {g.id: g.lof for g in NB.training_factors(model, df, "id").collect()}
    # Copies have equal factors whichever of them are taken as neighbours.
    assert np.allclose([got[i] for i in range(len(x))], brute_lof(x, 10), rtol=1e-6)
    q = np.concatenate([r.normal(0, 1, (20, 2)), x[:3], x[-20:-18], [[50.0, 0.0], [50.0, 0.0]]])
    new = {g.id: g.lof for g in NB.novelty_factors(model, table(spark, q, 1000), "id", cell=cell).collect()}
    assert np.allclose([new[1000 + i] for i in range(len(q))], brute_lof(x, 10, q), rtol=1e-6)


def test_combined_scores(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 1, (200, 3)), r.normal(0, 1, (20, 3)) * 5 + 10])
    df = table(spark, x)
    feats = ["f0", "f1", "f2"]
    lof = NB.lof_scores(NB.training_factors(NB.fit_lof(df, feats, id_col="id"), df, "id"))
    forest = spark.createDataFrame([(i, 0.5) for i in range(220)], "id long, if_score double")
    both = NB.combine_outliers(forest, lof, "id").collect()
    assert len(both) == 220 and all(b.combined_score == pytest.approx((0.5 + b.lof_score) / 2) and b.is_anomaly == int(b.combined_score > 0.5) for b in both)
    assert np.mean([b.lof for b in both if b.id >= 200]) > np.mean([b.lof for b in both if b.id < 200])


def test_lof_of_an_array_column(spark):
    r = np.random.default_rng(3)
    x = r.normal(0, 1, (60, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<float>").withColumn("other", F.lit(1))
    got = {g.id: g.lof for g in NB.training_factors(NB.fit_lof(df, "e", 7, id_col="id"), df, "id").collect()}
    assert np.allclose([got[i] for i in range(60)], brute_lof(x.astype(float), 7), rtol=1e-6)


def test_near_cells_share_a_group(spark):
    r = np.random.default_rng(4)
    pivots = r.normal(0, 1, (200, 3))
    sizes = {int(c): int(n) for c, n in zip(range(200), r.integers(1, 60, 200)) if c % 9}
    groups = NB._grouped(sizes, NB._distances(pivots, pivots), 1000)
    held = [sum(n for c, n in sizes.items() if groups[c] == g) for g in range(groups.max() + 1)]
    # A point was copied to each of the cells before.
    assert sum(held) == sum(sizes.values()) and max(held) <= 1000 and len(held) <= 2 * sum(held) / 1000 + 1
    assert all((groups[c] >= 0) == (c in sizes) for c in range(200))
    assert NB._grouped({0: 5, 1: 5000}, NB._distances(pivots[:2], pivots[:2]), 1000).tolist() == [0, 1]


def test_points_of_one_id_are_left_out_together(spark):
    x = [[0.0, 0.0], [1.0, 0.0], [2.0, 0.0], [9.0, 0.0]]
    points = spark.createDataFrame([(5, x[0]), (5, x[1]), (6, x[2]), (7, x[3])], "pid long, v array<double>")
    got = sorted((g.pid, g.nid, g.distance) for g in NB.knn_join(points, None, 1).collect())
    assert set(got) == {(5, 6, 1.0), (6, 5, 1.0), (7, 6, 7.0)}
