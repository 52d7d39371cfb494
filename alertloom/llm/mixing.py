"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The words of a source, in row order, are one stream cut into blocks of equal length; runs of 1,024
blocks are its shards. All blocks of the mix go to the sources by highest quotients
``target / (2 * seats + 1)``, each source's seats go to its shards in the same way, and a shard with
q seats over n blocks takes every block q // n times and q % n of them, chosen by a seeded hash, once
more. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.llm.common import let, materialise, rid_bucket, running_offsets, source_key, with_row_id, word_count, words

#: Blocks of a shard.
SHARD_BLOCKS = 1024


def weight_cycle(weights: tuple[float, ...]) -> Column:
    """Weight of a source by its place ``place`` (from 0): the given weights, over and over."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float, share: float = 1.0) -> DataFrame:
    """Targets of sources: shares of the total by weight (``weights`` over and over, by code point), none above ``most`` times the source's size.

    ``sizes`` has a row per source (``sk``, ``source_size``). What a source can't take is shared
    again by weight among the others until none is above; this ends at one common level
    ``target / weight`` for all sources below their limit, found by sorting limits per weight.
    """
    # One row per source: the windows over all sources see no more rows than there are sources.
    ranked = sizes.withColumn("place", F.row_number().over(W.orderBy("sk")) - 1).withColumn("weight", weight_cycle(weights))
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    ranked = ranked.withColumn("goal", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
    by = W.orderBy(F.col("limit") / F.col("weight"), "sk")
    before, onward = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    level = (F.col("goal") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    # The first source, by limit per weight, that the level doesn't fill sets the level of all after it.
    ranked = ranked.withColumns({"level": level, "nth": F.row_number().over(by)})
    reached = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("nth", "level"))
    ranked = ranked.withColumn("level", F.min(reached).over(W.partitionBy())["level"])
    return ranked.withColumn("target", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight")))) \
        .drop("goal", "level", "limit", "nth")


def apportion(parties: DataFrame, group: list[str], order: str, votes: str, seats: str, most: str) -> DataFrame:
    """Sainte-Lague: add ``got``, each party's whole number of the group's ``seats`` by highest quotients.

    Quotients are votes / (2k + 1), ties go to the smaller ``order``; a party takes no more than
    ``most`` seats, which is to be no less than its share of the seats, rounded up less one. Seats that every quotient order gives are handed out at once; only the quotients
    around the last seat, about two per party, are ranked.
    """
    all_of = W.partitionBy(*group)
    p = parties.withColumns({"_v": F.sum(votes).over(all_of), "_n": F.count(F.lit(1)).over(all_of)})
    ideal = lambda more: F.coalesce(F.try_divide(F.col(votes) * (F.col(seats) + more), F.col("_v")), F.lit(0.0))
    p = p.withColumn("_lo", F.least(F.col(most), F.greatest(F.lit(0), F.ceil(ideal(-F.col("_n")) - 0.5) - 1)).cast("long"))
    p = p.withColumn("_hi", F.least(F.col(most), F.floor(ideal(2 * F.col("_n")) + 2)).cast("long"))
    p = p.withColumn("_left", F.col(seats) - F.sum("_lo").over(all_of))
    tried = p.where((F.col("_hi") > F.col("_lo")) & (F.col(votes) > 0)).withColumn("_k", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)))
    rank = F.row_number().over(W.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), order, "_k"))
    won = tried.withColumn("_r", rank).where(F.col("_r") <= F.col("_left")).groupBy(*group, order).agg(F.count(F.lit(1)).alias("_won"))
    return (p.join(won, [*group, order], "left").withColumn("got", F.col("_lo") + F.coalesce("_won", F.lit(0)))
            .drop("_v", "_n", "_lo", "_hi", "_left", "_won"))


def _block_seats(sources: DataFrame, block: int, most: int, seed: int) -> DataFrame:
    """How often each block is taken: a row per (sk, shard) with ``times``, an array over its blocks."""
    total = F.sum("target").over(W.partitionBy())
    s = sources.withColumns({"blocks": F.ceil(F.col("source_size") / block).cast("long"), "all_seats": F.round(total / block).cast("long")})
    s = s.where(F.col("blocks") > 0).withColumn("limit", F.col("blocks") * most)
    s = apportion(s, [], "sk", "target", "all_seats", "limit").withColumnRenamed("got", "source_seats")
    last = F.floor((F.col("blocks") - 1) / SHARD_BLOCKS)
    shards = s.select("sk", "source_size", "blocks", "source_seats", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("shard"))
    held = F.least(F.lit(SHARD_BLOCKS).cast("long"), F.col("blocks") - F.col("shard") * SHARD_BLOCKS)
    votes = F.least(F.lit(SHARD_BLOCKS * block).cast("double"), (F.col("source_size") - F.col("shard") * SHARD_BLOCKS * block).cast("double"))
    shards = shards.withColumns({"held": held, "votes": votes}).withColumn("limit", F.col("held") * most)
    shards = apportion(shards, ["sk"], "shard", "votes", "source_seats", "limit")
    each = shards.select("sk", "shard", "held", "got", F.explode(F.sequence(F.lit(0).cast("long"), F.col("held") - 1)).alias("at"))
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), "sk", (F.col("shard") * SHARD_BLOCKS + F.col("at")).cast("string")))
    rank = F.row_number().over(W.partitionBy("sk", "shard").orderBy("draw", "at"))
    each = each.withColumn("draw", drawn).withColumn("rank", rank)
    times = (F.floor(F.col("got") / F.col("held")) + (F.col("rank") <= F.col("got") % F.col("held")).cast("int")).cast("int")
    chosen = each.select("sk", "shard", F.struct("at", times.alias("times")).alias("b"))
    return chosen.groupBy("sk", "shard").agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["times"]).alias("times"))


def mix_plan(rows: DataFrame, weights: tuple[float, ...], block: int = 32, most: int = 3, share: float = 1.0, seed: int = 17) -> DataFrame:
    """What the mix takes of each row: adds source_size, target, taken and ``spans``.

    ``rows`` is a written table with rid, sk (source key) and size (words). ``spans`` lists
    (shard, first word, words, times of its blocks) for the pieces of the row; rows without words have
    none and taken 0. Sources with no words have target 0. An empty table gives no rows.
    """
    sizes = rows.groupBy("sk").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes, weights, most, share)
    at = running_offsets(rows.where(F.col("size") > 0).select("rid", "sk", "size").withColumn("_b", rid_bucket()), ["sk"], "_b", ["rid"], "size", "off").drop("_b")
    span = SHARD_BLOCKS * block
    first, last = F.floor(F.col("off") / span), F.floor((F.col("off") + F.col("size") - 1) / span)
    cut = at.withColumn("shard", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("off"), F.col("shard") * span)
    cut = cut.withColumns({"begin": begin, "n": F.least(F.col("off") + F.col("size"), (F.col("shard") + 1) * span) - begin})
    cut = cut.join(_block_seats(sources, block, most, seed), ["sk", "shard"])
    inside = F.col("begin") - F.col("shard") * span
    k0 = F.floor(inside / block).cast("int")
    k1 = F.floor((inside + F.col("n") - 1) / block).cast("int")
    cut = cut.withColumns({"inside": inside, "mine": F.slice("times", k0 + 1, k1 - k0 + 1), "k0": k0})
    got = lambda t, i: t * (F.least(F.col("inside") + F.col("n"), (F.col("k0") + i + 1).cast("long") * block)
                            - F.greatest(F.col("inside"), (F.col("k0") + i).cast("long") * block))
    cut = cut.withColumn("taken", F.aggregate(F.transform("mine", got), F.lit(0).cast("long"), lambda a, b: a + b))
    piece = F.struct("shard", (F.col("begin") - F.col("off")).alias("start"), "n", (F.col("inside") - F.col("k0").cast("long") * block).alias("skip"), "mine")
    taken = cut.groupBy("rid").agg(F.sum("taken").alias("taken"), F.array_sort(F.collect_list(piece)).alias("spans"))
    return (rows.join(sources.select("sk", "source_size", "target"), "sk").join(taken, "rid", "left")
            .withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))))


def sized_rows(docs: DataFrame, text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The written table that ``mix_plan`` reads: the kept columns, sk, size and rid."""
    light = docs.select(*keep, source_key(source_col).alias("sk"), word_count(text_col).alias("size"))
    return materialise(with_row_id(light))


def mix_documents(docs: DataFrame, weights: tuple[float, ...], text_col: str = "text", source_col: str = "source", block: int = 32,
                  most: int = 3, share: float = 1.0, seed: int = 17) -> DataFrame:
    """The documents of the mix: the same columns, a row per copy.

    Copy number c of a document holds its words whose block is taken c times or more, joined by a
    space; a copy that holds all its words keeps the text as it is. Documents without words have
    nothing to take and stay once as they are. NULL sources are one source.
    """
    names = docs.columns
    held = docs.select(F.struct(*names).alias("doc"), F.col(text_col).alias("_text"), source_key(source_col).alias("sk"), word_count(text_col).alias("size"))
    held = materialise(with_row_id(held))
    plan = mix_plan(held.select("rid", "sk", "size"), weights, block, most, share, seed).select("rid", "spans", "taken")
    full = held.join(plan, "rid").withColumn("_w", words("_text"))
    # times of each word: the times of the block it lies in
    per_word = lambda s: F.transform(F.sequence(F.lit(0).cast("long"), s["n"] - 1), lambda i: F.element_at(s["mine"], (F.floor((i + s["skip"]) / block) + 1).cast("int")))
    full = full.withColumn("_times", F.flatten(F.transform("spans", per_word)))
    full = full.withColumn("_c", F.explode(F.when(F.col("size") == 0, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.lit(most)))))
    full = full.where((F.col("size") == 0) | (F.array_max("_times") >= F.col("_c")))
    part = let(F.col("_times"), lambda t: F.array_join(F.filter("_w", lambda w, i: F.element_at(t, i + 1) >= F.col("_c")), " "))
    text = F.when((F.col("size") == 0) | (F.array_min("_times") >= F.col("_c")), F.col("_text")).otherwise(part)
    out = {n: text if n == text_col else F.col("doc")[n] for n in names}
    return full.select(*[c.alias(n) for n, c in out.items()])
