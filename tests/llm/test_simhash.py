import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from alertloom.llm import simhash
from tests.llm.conftest import clash, doc_frame, odd_docs


def brute_fp(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, t):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= t:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def near_docs(spark):
    r = random.Random(2)
    base = [r.choice("abcdefghij") + str(r.randrange(50)) for _ in range(400)]
    rows, n = [], 100
    for g in range(6):
        words = [f"{w}{g}" for w in base]
        for _ in range(15):
            n += 1
            x = list(words)
            for _ in range(r.randrange(3)):
                x[r.randrange(len(x))] = f"new{r.randrange(9)}"
            rows.append((n, " ".join(x), "en", "s"))
    r.shuffle(rows)
    return doc_frame(spark, rows)


@pytest.mark.parametrize("make", [lambda s, d: near_docs(s), lambda s, d: clash(odd_docs(s))])
def test_against_all_pairs(spark, docs, make):
    df = make(spark, docs)
    rows = df.select("doc_id", "text").collect()
    fps = [brute_fp(r.text) for r in rows]
    root = brute_components(fps, 2)
    low = {}
    for r, c in zip(rows, root):
        ids = [x for x in (low.get(c), r.doc_id) if x is not None]
        low[c] = min(ids) if ids else None
    want = sorted(((r.doc_id, f, low[c]) for r, f, c in zip(rows, fps, root)), key=str)
    got = simhash.near_duplicates(df)
    assert sorted(((r.id, r.fp % 2**64, r.component_id) for r in got.collect()), key=str) == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(low.values(), key=str)


def test_golay_anchors_see_every_near_pair(spark):
    leaders, r = simhash.golay_table(), np.random.default_rng(1)
    words = r.integers(0, 1 << 23, 200)
    code = words ^ leaders[simhash.syndromes(words)]
    assert (simhash.syndromes(code) == 0).all() and (np.bitwise_count(code ^ words) <= 3).all()
    at, near, extra = simhash.near_codewords(words[:20], leaders, 2)
    every = np.arange(1 << 23)
    every = every[simhash.syndromes(every) == 0]
    for i in range(20):
        d = np.bitwise_count(every ^ words[i])
        assert sorted(near[at == i]) == every[d <= 5].tolist()


def test_links_on_random_fingerprints_and_salts(spark):
    r = random.Random(4)
    fps = [r.getrandbits(64) for _ in range(12)]
    for f in list(fps):
        for _ in range(12):
            x = f
            for b in r.sample(range(64), r.choice([1, 2, 3, 4])):
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    want = brute_components(fps, 2)
    for group in (4096, 3):
        comp = simhash.components(simhash.links(df, 2, group)).collect()
        root = {x.node % 2**64: x.root for x in comp}
        label = [root.get(f, f - 2**64 if f >= 2**63 else f) for f in fps]
        assert len(set(label)) == len(set(want)) == len(set(zip(label, want)))


def test_long_chain(spark):
    e = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = simhash.components(e).collect()
    assert {(x.node, x.root) for x in got} == {(i, 0) for i in range(1, 41)}


def test_empty(spark, docs):
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 == simhash.keep_one(docs.limit(0)).count()
