import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.llm import negatives
from tests.llm.conftest import SF, clash


def brute(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    """rows: (id, label, vector) in any order; all result rows as a sorted list."""
    live = [(i, y, v) for i, y, v in rows if v is not None and y is not None]
    out = []
    for a, (ai, ay, av) in enumerate(live):
        if not is_anchor(ai):
            continue
        scored = sorted((-sum(x * w for x, w in zip(av, v)), i is None, i or 0, b, y == ay) for b, (i, y, v) in enumerate(live) if b != a)
        for s, pnull, pid, _, _ in [x for x in scored if x[4]][:positives]:
            hard = [x for x in scored if not x[4] and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(ai, None if pnull else pid, r + 1, None if null else i, -s, -n) for r, (n, null, i, _, _) in enumerate(hard)]
    return sorted(out, key=str)


def run(df, **kw):
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 10 == 0, **kw).collect()), key=str)


def anchors(i):
    return i is not None and i % 10 == 0


def test_packed_products_are_exact_for_signs_and_widths():
    r = np.random.default_rng(1)
    for most, width, n in ((1, 3, 5), (200, 64, 100), (40_000, 16, 7), (2**28, 8, 4)):
        a, c = r.integers(-most, most + 1, (6, width)), r.integers(-most, most + 1, (n, width))
        bits = negatives.field_bits(int(max((a * a).sum(1).max(), (c * c).sum(1).max())))
        got = negatives.packed_products(a, negatives.pack(c, most, bits), most, bits, n)
        assert (got == a @ c.T).all()


def test_given_embeddings_in_several_blocks(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.label, [math.floor(256 * float(x)) for x in r.embedding]) for r in e.collect()]
    df = e.select("vec_id", "label", negatives.quantise("embedding").alias("v"))
    assert run(df, block=130) == brute(rows, anchors)


def test_odd_rows(spark):
    r = random.Random(3)
    point = lambda: [float(r.randint(-3, 3)) for _ in range(3)]
    rows = [(r.choice([None, *range(60)]), r.choice([None, 0, 0, 1, 2]), point()) for _ in range(200)]
    rows += [(0, 1, None), (10, None, [1.0]), (20, 1, [1.0, None]), (30, 1, [float("nan")]), (40, 1, [float("inf")]), (50, 1, []), (3, 0, [2.0])]
    rows += [(10, 1, [1.0, 2.0, 3.0])] * 3 + [(20, 9, [1.0, 1.0, 1.0])]  # repeated anchors, an anchor alone in its label
    df = clash(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("v", negatives.quantise("embedding", 4)))
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    plain = [(i, y, ([math.floor(4 * x) for x in v] + [0, 0, 0])[:3] if ok(v) else None) for i, y, v in rows]
    key = lambda x: str((x[0], x[2], x[4], x[5]))  # noqa: E731  equal ids may change places
    for block in (3, 4096):
        assert sorted(map(key, run(df, block=block))) == sorted(map(key, brute(plain, anchors)))
    assert run(df, positives=2, negatives=1) and run(df.limit(0)) == []
    with pytest.raises(ValueError):
        negatives.mine(spark.createDataFrame([(0, 0, [2**40])], "vec_id long, label int, v array<long>"), F.lit(True))


def test_many_copies_of_one_vector(spark):
    rows = [(i, 0, [5, 5]) for i in range(300)] + [(300 + i, 1, [5, 4 + i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<long>")
    assert run(df, block=100) == brute(rows, anchors)
