import random

from pyspark.sql import functions as F

from alertloom.functions.scalar import fixed_text, round_exact


def values():
    r = random.Random(4)
    out = [0.0, -0.0, 2.675, 2.665, 0.12345, 0.5, 1.5, 2.5, 0.125, 0.375, 0.99995, 99.995, 1e15 + 0.3, 1e300, -2.675, 0.00005, 0.00015, 123456789.125, 4503599627370495.5]
    out += [r.uniform(-10, 10) for _ in range(40_000)] + [r.randint(0, 10**6) / 10**5 for _ in range(40_000)] + [r.randint(0, 10**7) / 2**r.randint(1, 20) for _ in range(20_000)]
    return out


def test_rounding_equals_the_exact_decimal(spark):
    df = spark.createDataFrame([(v,) for v in values()], "x double").repartition(8)
    off = [(r.x, r.a, r.b, r.t) for r in df.select("x", round_exact(F.col("x"), 4).alias("a"), round_exact(F.col("x"), 2).alias("b"), fixed_text(F.col("x")).alias("t")).collect()
           if r.a != round(r.x, 4) or r.b != round(r.x, 2) or (abs(r.x) < 1e18 and r.t != f"{r.x + 0.0:.2f}")]
    assert not off, off[:5]


def test_odd_values(spark):
    df = spark.createDataFrame([(None,), (float("inf"),), (float("-inf"),)], "x double")
    assert [r.a for r in df.select(round_exact(F.col("x")).alias("a")).collect()] == [None, float("inf"), float("-inf")]
