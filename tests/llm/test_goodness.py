import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from alertloom.llm import goodness
from alertloom.llm.queries import fold, op11_goodness
from tests.llm.conftest import SF, clash, odd_docs


def plain_score(text, weights):
    """Dot product of a text's feature counts with the weights, n-gram by n-gram."""
    import re

    import xxhash

    found = re.findall(r"[^\W_]+|(?:[^\w\s]|_)+", (text or "").lower())
    h = [xxhash.xxh64_intdigest(w) for w in found]
    h = [xxhash.xxh64_intdigest("\n") if i and found[i] == found[i - 1] else x for i, x in enumerate(h)]
    m, k = 0x9E3779B97F4A7C15, 2**64
    grams = h + [(a * m % k) ^ b for a, b in zip(h, h[1:])]
    total = sum(weights[g * m % k >> 46] for g in grams)
    return 1 / (1 + math.exp(-(total * goodness.SCALE / max(1, len(grams)) + weights[-1])))


def test_scores_equal_the_plain_sum(spark):
    weights = np.random.default_rng(0).normal(0, 1, goodness.BUCKETS + 1)
    docs = clash(odd_docs(spark))
    got = goodness.score(docs, weights, ("doc_id", "text", "ids")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.ids == "z" and math.isclose(r.score, plain_score(r.text, weights), rel_tol=1e-6, abs_tol=1e-12)
    assert goodness.score(docs.limit(0), weights).count() == 0


def test_updates_minimise_the_regularised_loss():
    """The closed form of a weight is where the derivative of z w + l1 |w| + (rate / 2) w ** 2 is zero."""
    m, r = goodness.Ftrl(), random.Random(1)
    for _ in range(50):
        m.learn(np.array(sorted(r.sample(range(20), 5))), np.full(5, 4.0), r.randint(0, 1))
    w, rate = m.weights(np.arange(20)), (m.beta + np.sqrt(m.n[:20])) / m.alpha + m.l2
    live = w != 0
    assert live.any() and np.allclose((m.z[:20] + m.l1 * np.sign(w) + rate * w)[live], 0) and (np.abs(m.z[:20][~live]) <= m.l1).all()


def test_labels_of_the_held_out_third(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in op11_goodness(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    right = [got[r.doc_id].predicted == r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(right) > 50 and sum(right) / len(right) > 0.97


def test_held_out_labels_and_odd_labels_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    base = goodness.fit(docs, labels, fold(3) != 1)
    turned = labels.withColumn("quality", F.when(fold(3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 7, 0), (10**9, 0, 0)], labels.schema)
    again = goodness.fit(clash(docs.repartition(3)), clash(turned.union(odd).union(labels)), fold(3) != 1)
    assert np.count_nonzero(base) > 100 and np.allclose(base, again)


def test_few_labels_and_empty_texts(spark):
    docs = odd_docs(spark)
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    every = F.lit(True)
    assert not goodness.fit(docs, label([]), every).any()
    assert goodness.fit(docs, label([(4, 1)]), every)[-1] > 0 > goodness.fit(docs, label([(4, 0), (2, 0)]), every)[-1]
    assert not goodness.fit(docs.limit(0), label([(4, 1), (2, 0)]), every).any()
    weights = goodness.fit(docs, label([(4, 1), (2, 0), (3, 0), (1, 1), (5, 0), (5, 1), (-9, 0)]), every)
    got = goodness.score(docs, weights).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
