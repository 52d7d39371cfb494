"""Hierarchical weighted hash tree: rows descend region, rack and shard by weighted hash draws.

At every level each child of the chosen node draws a uniform number from a hash of (key, path of
the child) and the child with the highest ``ln(u) / weight`` wins; a child's chance is its share of
the weight. A draw depends on the key and the child alone, so a child whose weight grows only wins
rows, one whose weight shrinks only loses rows, and rows outside a changed subtree stay put.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import running_offsets

#: region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]


def balanced_tree(shards: int, shards_per_rack: int = 4, racks_per_region: int = 2) -> dict:
    """A tree of equal shards 0 .. shards-1, racks and regions filled in order."""
    tree: dict = {}
    for s in range(shards):
        rack = s // shards_per_rack
        tree.setdefault(f"g{rack // racks_per_region}", {}).setdefault(f"k{rack}", {})[s] = 1.0
    return tree


def grow(tree: Tree, weight: float = 1.0) -> dict:
    """The tree with one more shard, in a rack and region of its own.

    Only the top-level draws gain a child, so every row that moves goes into the new shard.
    """
    shard = 1 + max(s for racks in tree.values() for rack in racks.values() for s in rack)
    return {**tree, f"g+{shard}": {f"k+{shard}": {shard: weight}}}


def draw_key(key: str | Column) -> Column:
    """The text that draws hash; NULL keys share one key of their own."""
    c = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.concat(F.lit("k"), c.cast("string")), F.lit("null"))


def _draw(key: Column, path: str, weight: float) -> Column:
    first = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + path))), 1, 13), 16, 10).cast("double")  # 52 bits
    return F.ln((first + 1.0) / float(2**52 + 1)) / F.lit(float(weight))


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, Mapping) else float(node)


def _choose(key: Column, path: str, node: Mapping) -> Column:
    """Path of the child of ``node`` with the best draw; NULL if none has weight."""
    live = {f"{path}/{name}": _weight(child) for name, child in node.items() if _weight(child) > 0}
    draws = [F.struct(_draw(key, p, w).alias("d"), F.lit(p).alias("path")) for p, w in live.items()]
    if not draws:
        return F.lit(None).cast("string")
    return (F.greatest(*draws) if len(draws) > 1 else draws[0])["path"]


def shard_rows(rows: DataFrame, key_col: str, tree: Tree, shard_col: str = "shard") -> DataFrame:
    """All rows with the shard of ``key_col``: one column of draws for each level of the tree.

    Equal keys share a shard; NULL is one more key. Only the key decides, so texts may be NULL, empty or long and rows may
    repeat; all columns are kept, whatever their names, and an empty table gives no rows. Raises ValueError if ``shard_col`` is taken.
    """
    if shard_col in rows.columns:
        raise ValueError(f"column {shard_col} exists")
    out = rows.select(F.struct("*").alias("row"), draw_key(key_col).alias("key")).withColumn("at", _choose(F.col("key"), "", tree))
    level: dict[str, Mapping] = {f"/{name}": node for name, node in tree.items()}
    while level and all(isinstance(n, Mapping) for n in level.values()):
        down = F.lit(None).cast("string")
        for path, node in level.items():
            down = F.when(F.col("at") == path, _choose(F.col("key"), path, node)).otherwise(down)
        out = out.withColumn("at", down)
        level = {f"{path}/{name}": child for path, node in level.items() for name, child in node.items()}
    return out.select("row.*", F.element_at(F.split("at", "/"), -1).cast("int").alias(shard_col))


def number_slots(rows: DataFrame, shard_col: str, key_col: str, tie_cols: list[str], slot_col: str = "slot") -> DataFrame:
    """All rows, all their columns, with a number in their shard from 0 without gaps.

    The order is (12 hash bits of the key, 8 of the ties, key, ties): a shard is cut into buckets that are numbered apart and
    put behind each other by their counts, and the rows of one key, as NULL, are spread by their ties. Equal rows get any of
    their numbers; NULL keys come first in their bucket, an empty table gives no rows. Raises ValueError if ``slot_col`` is taken.
    """
    if slot_col in rows.columns:
        raise ValueError(f"column {slot_col} exists")
    ties = [f"tie{i}" for i in range(len(tie_cols))]
    held = rows.select(F.struct("*").alias("row"), F.col(shard_col).alias("shard"), F.col(key_col).alias("key"), *[F.col(c).alias(t) for c, t in zip(tie_cols, ties)])
    first = F.conv(F.substring(F.md5(draw_key("key")), 1, 3), 16, 10).cast("long") * 256
    second = F.pmod(F.xxhash64(*ties), F.lit(256)) if ties else F.lit(0)
    placed = held.withColumns({"bucket": (first + second).cast("long"), "one": F.lit(1).cast("long")})
    return running_offsets(placed, ["shard"], "bucket", ["key", *ties], "one", "slot").select("row.*", F.col("slot").alias(slot_col))


def write_shards(rows: DataFrame, path: str, shard_col: str = "shard") -> None:
    """Write one folder per shard; several tasks share a large shard."""
    rows.write.partitionBy(shard_col).parquet(path)
