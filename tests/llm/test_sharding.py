from collections import Counter

import pytest
from pyspark.sql import functions as F

from alertloom.llm import sharding
from tests.llm.conftest import clash, odd_docs


def placed(spark, df, tree):
    return {r.id: r.shard for r in sharding.shard_rows(df, "id", tree).collect()}


def test_only_the_new_shard_gains(spark):
    df = spark.range(20_000)
    tree = sharding.balanced_tree(16)
    old, new = placed(spark, df, tree), placed(spark, df, sharding.grow(tree))
    assert {new[i] for i in old if old[i] != new[i]} == {16}
    n = Counter(old.values())
    assert sorted(n) == list(range(16)) and max(n.values()) < 1.2 * 1250 and min(n.values()) > 0.8 * 1250
    assert abs(Counter(new.values())[16] - 20_000 / 17) < 150


def test_a_changed_weight_moves_rows_only_into_its_subtree(spark):
    df = spark.range(20_000)
    tree = sharding.balanced_tree(16)
    heavier = {g: {k: {s: 3.0 if s == 5 else w for s, w in r.items()} for k, r in ks.items()} for g, ks in tree.items()}
    old, new = placed(spark, df, tree), placed(spark, df, heavier)
    for i in old:
        if old[i] != new[i]:
            assert new[i] // 8 == 0  # into the region of shard 5 ...
            if old[i] // 8 == 0:
                assert new[i] // 4 == 1  # ... from inside it only into its rack ...
            if old[i] // 4 == 1:
                assert new[i] == 5  # ... and from inside the rack only into the shard
    share = Counter(new.values())[5] / 20_000
    assert abs(share - 3 / 18) < 0.015


def test_zero_weight_and_clash(spark):
    df = spark.range(500)
    tree = {"a": {"r": {0: 0.0, 1: 1.0}}, "b": {"r": {2: 0.0}}}
    assert set(placed(spark, df, tree).values()) == {1}
    with pytest.raises(ValueError):
        sharding.shard_rows(df.withColumn("shard", F.lit(1)), "id", tree)


def test_slots_have_no_gaps(spark, docs):
    for df in (docs, clash(odd_docs(spark)), docs.limit(0)):
        rows = sharding.shard_rows(df, "doc_id", sharding.balanced_tree(16))
        got = sharding.number_slots(rows, "shard", "doc_id", ["text"]).collect()
        assert len(got) == df.count()
        for s, n in Counter(r.shard for r in got).items():
            assert sorted(r.slot for r in got if r.shard == s) == list(range(n))


def plain_shard(key, tree):
    """Descend by the best draw at every level, hash by hash."""
    import hashlib
    import math
    weight = lambda node: sum(map(weight, node.values())) if isinstance(node, dict) else node
    text, path, node = "null" if key is None else f"k{key}", "", tree
    while isinstance(node, dict):
        draw = {}
        for name, child in node.items():
            first = int(hashlib.md5(f"{text}|{path}/{name}".encode()).hexdigest()[:13], 16)
            if weight(child) > 0:
                draw[name] = math.log((first + 1) / (2**52 + 1)) / weight(child)
        best = max(draw, key=draw.get)
        path, node = f"{path}/{best}", node[best]
    return best


def test_draws_equal_plain_hashes(spark):
    df = spark.range(400).union(spark.sql("select cast(null as long)"))
    for tree in (sharding.balanced_tree(16), sharding.grow(sharding.balanced_tree(16), 2.5), {"a": {"r": {0: 1.0, 3: 2.0}}, "b": {"s": {1: 4.0}, "t": {2: 0.5}}}):
        got = {r.id: r.shard for r in sharding.shard_rows(df, "id", tree).collect()}
        assert got == {i: plain_shard(i, tree) for i in got} and len(got) == 401


def test_columns_of_any_name_are_kept(spark):
    names = ["_key", "_at", "_b", "_one", "row", "key", "at", "shard_", "bucket", "one", "tie0", "slot_", "_t", "_s", "_p"]
    df = odd_docs(spark).withColumns({n: F.lit(n) for n in names})
    out = sharding.number_slots(sharding.shard_rows(df, "doc_id", sharding.balanced_tree(4)), "shard", "doc_id", ["text"])
    assert out.columns == [*df.columns, "shard", "slot"]
    rows = out.collect()
    assert len(rows) == df.count() and all(r[n] == n for r in rows for n in names)
    with pytest.raises(ValueError):
        sharding.number_slots(out, "shard", "doc_id", ["text"])
