import math

import numpy as np
from pyspark.sql import functions as F

from alertloom.llm import topk
from tests.llm.conftest import SF


def brute(rows, k, is_query):
    """rows: (id, vector or None) in any order; the multiset of (query, rank, id, score)."""
    live = [(i, v) for i, v in rows if v is not None]
    out = []
    for a, (q, v) in enumerate(live):
        if is_query(q):
            s = []
            for b, (c, w) in enumerate(live):
                if a != b:
                    m = min(len(v), len(w))
                    s.append((-sum(x * y for x, y in zip(v[:m], w[:m])), c is None, c or 0))
            out += [(q, r + 1, None if null else c, -n) for r, (n, null, c) in enumerate(sorted(s)[:k])]
    return sorted(out, key=str)


def run(df, k, **kw):
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k, **kw).collect()
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in got), key=str)


def test_given_embeddings_in_several_blocks(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").limit(300)
    rows = [(r.vec_id, [math.floor(64 * float(np.float64(x))) for x in r.embedding]) for r in e.collect()]
    df = e.select("vec_id", topk.quantise("embedding").alias("v"))
    assert run(df, 20, query_block=4, candidate_block=70) == brute(rows, 20, lambda q: q % 20 == 0)


def test_odd_vectors(spark):
    big = 2**53 + 1
    rows = [(0, [1.0, 0.0, -2.5]), (20, None), (40, [1.0, None, 0.0]), (60, [float("nan"), 1.0, 1.0]), (80, [float("inf"), 1.0, 1.0]),
            (0, [1.0, 0.0, -2.5]), (0, [1.0, 0.0, -2.5]), (None, [3.0, 0.0, 1.0]), (7, [1.0]), (8, []), (big, [1.0, 0.0, -2.5]), (9, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = df.select("vec_id", topk.quantise("embedding").alias("v"))
    ok = [(i, [math.floor(64 * x) for x in v] if v is not None and all(x is not None and math.isfinite(x) for x in v) else None) for i, v in rows]
    for k in (2, 20):
        assert run(q, k, query_block=1, candidate_block=3) == brute(ok, k, lambda q: q is not None and q % 20 == 0)
    assert run(q.limit(0), 3) == []


def test_columns_and_postings(spark):
    r = np.random.default_rng(5)
    # Dense, sparse and empty terms; sums beyond 32 bits in the second table.
    for high in (50, 2**29):
        v = r.integers(-high, high, (130, 9)) * (r.random((130, 9)) < [1, 1, 0.9, 0.3, 0.2, 0.05, 0.02, 0, 1])
        rows = [(i, [int(x) for x in w[: r.integers(1, 10)]]) for i, w in enumerate(v)]
        df = spark.createDataFrame(rows, "vec_id long, v array<long>")
        assert run(df, 6, query_block=4, candidate_block=50) == brute(rows, 6, lambda q: q % 20 == 0)
