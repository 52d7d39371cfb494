import math

import numpy as np

from alertloom.llm import whitening
from tests.llm.conftest import SF, clash


def brute(rows, k=4):
    """rows: (id, list of whole numbers): (n, eigenvalues' shares, deviations, absolute whitened values) by plain numpy."""
    x = np.array([v for _, v in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    keep = e > whitening.LEAST * np.trace(c.T @ c / n)
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s)) for v in x]
    return n, e[keep] / np.trace(c.T @ c / n), dev, np.abs((x - s / n) @ u[:, keep] / np.sqrt(e[keep]))


def check(df, rows):
    got = df.collect()
    n, share, dev, want = brute(rows)
    assert len(got) == len(rows) * len(share) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    assert len({r.identity_error for r in got}) == 1
    mine = sorted((r.vec_id is None, r.vec_id or 0, r.deviation, r.component, abs(r.whitened), r.explained) for r in got)
    theirs = sorted((i is None, i or 0, d, c + 1, w[c], share[c]) for (i, _), d, w in zip(rows, dev, want) for c in range(len(share)))
    assert [x[:4] for x in mine] == [x[:4] for x in theirs]
    assert np.allclose([x[4:] for x in mine], [x[4:] for x in theirs], rtol=1e-8, atol=1e-9)
    return got


def test_given_embeddings_with_repeats(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    e = e.union(e.limit(100)).repartition(5)
    rows = [(r.vec_id, [math.floor(256 * float(x)) for x in r.embedding]) for r in e.collect()]
    got = check(whitening.whiten(whitening.whole_rows(e)), rows)
    signs = {}
    for r in got:  # a row's copies lie on one side
        signs.setdefault((r.vec_id, r.component), set()).add(r.whitened)
    assert all(len(x) == 1 for x in signs.values())


def test_blocks_of_few_rows_and_columns(spark, monkeypatch):
    for name, value in (("ROWS", 16), ("COLUMNS", 3), ("BLOCKS", 2)):
        monkeypatch.setattr(whitening, name, value)
    r = np.random.default_rng(2)
    rows = [(int(i), [int(x) for x in r.integers(-50, 50, 8) * np.arange(1, 9)]) for i in range(150)]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, x array<long>").repartition(4)), rows)


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0, 0.5]), (None, [0.0, 1.0, 0.25]), (2, [3.0, -1.0, 0.0]), (2, [3.0, -1.0, 0.0]), (3, [2.0]), (4, []), (5, None), (6, [1.0, None, 0.0]),
            (7, [float("nan"), 0.0, 0.0]), (8, [float("-inf"), 0.0, 0.0]), (9, [-0.0, 0.001, 1.0])]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    ok = [(i, ([math.floor(256 * float(np.float32(x))) for x in v] + [0] * 3)[:3]) for i, v in rows
          if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    check(whitening.whiten(whitening.whole_rows(df)), ok)
    for none in (df.limit(0), df.where("vec_id = 2"), df.where("vec_id = 4"), df.where("vec_id >= 5 and vec_id < 9")):
        assert whitening.whiten(whitening.whole_rows(none)).collect() == []


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(1, [2**33, 0]), (2, [0, 1]), (3, [1, 5])], "vec_id long, x array<long>")
    got = {(r.vec_id, r.deviation) for r in whitening.whiten(df).collect()}
    assert got == {(1, None), (2, None), (3, None)}
