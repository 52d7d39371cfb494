"""Hard-negative mining: exact inner products by Kronecker-packed multiplication.

Components are biased to be non-negative and those of several candidates are put into separate fields of one wide
integer. An anchor's component multiplies all of them at once; the sum over the components holds every candidate's
inner product in its own field, from where it is unpacked exactly. The fields are wide enough for any inner product of
the table, by the Cauchy-Schwarz bound. Anchors and candidates meet in blocks; in each the best are chosen, and the
blocks' best are ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.llm.common import materialise, with_row_id

#: Anchors whose products with a block of candidates are held at a time.
AT_ONCE = 512


def quantise(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; NULL if the vector is NULL or holds a NULL or non-finite one."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(v, lambda x: F.floor(x.cast("double") * scale)))


def field_bits(bound: int) -> int:
    """Width of a field that holds every whole number from -bound to bound as a non-negative one."""
    return (2 * bound + 1).bit_length()


def pack(vectors, bias: int, bits: int):
    """Rows of whole numbers packed, a column for each group of 63 // bits rows (one at least): (components, groups).

    Row g * fields + f takes bits ``f * bits`` onwards of group g, each component with ``bias`` added. The packed numbers
    count modulo 2**64, which the products undo, so a field may be as narrow as the products allow.
    """
    import numpy as np

    fields = max(1, 63 // bits)
    groups = -(-len(vectors) // fields)
    out = np.zeros((vectors.shape[1], groups), np.uint64)
    for f in range(fields):
        part = vectors[f::fields]
        out[:, : len(part)] += (part.T + bias).astype(np.uint64) << np.uint64(f * bits)
    return out


def packed_products(anchors, packed, bias: int, bits: int, rows: int):
    """Inner products (anchors, rows) of whole-number rows with packed ones: one multiplication per anchor component and group."""
    import numpy as np

    fields = max(1, 63 // bits)
    total = anchors.astype(np.uint64) @ packed
    # Each field now has its product and bias * (sum of the anchor); half a field is added so that none is negative.
    half = np.uint64(1 << (bits - 1))
    ones = np.uint64(sum(1 << (f * bits) for f in range(fields)))
    total -= (anchors.sum(1) * bias).astype(np.uint64)[:, None] * ones
    total += half * ones
    out = np.empty((len(anchors), packed.shape[1], fields), np.int64)
    mask = np.uint64((1 << bits) - 1)
    for f in range(fields):
        out[:, :, f] = ((total >> np.uint64(f * bits)) & mask).astype(np.int64) - int(half)
    return out.reshape(len(anchors), -1)[:, :rows]


def _matrix(column, width: int):
    """Arrow lists of whole numbers as rows filled up with zeros."""
    import numpy as np

    column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _best(score, pool, k: int):
    """The k places of ``pool`` with the highest scores, ties to the earlier place."""
    import numpy as np

    if len(pool) > k:
        s = score[pool]
        pool = pool[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return pool[np.argsort(-score[pool], kind="stable")][:k]


def _blocks(width: int, bias: int, bits: int, choose):
    """Cogrouped function: all products of a block of anchors with a block of candidates, a row per choice of ``choose``.

    ``choose(scores of an anchor, which have its label, which are other rows, its limits)`` yields (limit, places).
    """

    def run(key, anchors, candidates):
        import numpy as np
        import pyarrow as pa

        mine, theirs, limits, scores = [], [], [], []
        if anchors.num_rows and candidates.num_rows:
            # Places in the order that ties go by.
            candidates = candidates.sort_by([("vec_id", "ascending"), ("rid", "ascending")])  # NULL ids last
            crid, labels = (candidates[c].to_numpy() for c in ("rid", "label"))
            own, own_labels, matrix = anchors["arid"].to_numpy(), anchors["own"].to_numpy(), _matrix(anchors["av"], width)
            given = anchors["limits"].to_pylist() if "limits" in anchors.column_names else [None] * len(own)
            packed = pack(_matrix(candidates["v"], width), bias, bits)
            for i in range(0, len(matrix), AT_ONCE):
                for j, score in enumerate(packed_products(matrix[i : i + AT_ONCE], packed, bias, bits, len(crid)), i):
                    for limit, at in choose(score, labels == own_labels[j], crid != own[j], given[j]):
                        mine.append(np.full(len(at), j))
                        theirs.append(at)
                        limits.append(np.full(len(at), limit))
                        scores.append(score[at])
        mine, theirs, limits, scores = (pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)) for x in (mine, theirs, limits, scores))
        return pa.table({"arid": anchors["arid"].take(mine), "anchor_id": anchors["anchor_id"].take(mine), "limit": limits,
                         "vec_id": candidates["vec_id"].take(theirs), "crid": candidates["rid"].take(theirs), "score": scores})

    return run


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id",
         label_col: str = "label", vector_col: str = "v", block: int = 4096) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vector_col`` holds arrays of whole numbers. A row's score is its inner product with the anchor; higher ones come first,
    ties by smaller id, NULL ids last, then rows as they stand. An anchor's positives are its first ``positives`` other rows of
    its label; for each the first ``negatives`` rows of other labels with low * p <= 100 * n <= high * p are returned, ranked
    from 1. Rows whose vector or label is NULL take no part; shorter vectors count as if filled with zeros. Anchors without a
    positive and positives without a negative give no rows, nor does an empty table. Repeated rows are rows of their own: an
    anchor leaves out itself alone, and equal anchors get equal rows each. Other columns are not read. Every row is compared with
    every anchor, in blocks of ``block`` each, so that no label or group of copies meets in one task. Raises ValueError if 100
    times an inner product might not fit a long.
    """
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                          F.col(vector_col).cast("array<long>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = materialise(with_row_id(kept.where("v is not null and label is not null")))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, n_anchors, width, most, longest = rows.agg(F.count("*"), F.count(F.when(F.col("anchor"), 1)), F.coalesce(F.max(F.size("v")), F.lit(0)),
                                                  F.coalesce(F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    bound = math.ceil(longest * (1 + 1e-9)) + 1
    if max(low, high, 100) * bound >= 2**62 or width * most * most >= 2**62:
        raise ValueError("inner products of these vectors might not fit a long")
    bits = field_bits(bound)
    blocks, a_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(n_anchors / block))
    dealt = lambda count: F.pmod(F.xxhash64("rid"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    facing = rows.select("rid", "vec_id", "label", "v", every(a_blocks).alias("ab"), dealt(blocks).alias("cb"))
    anchors = rows.where("anchor").select(F.col("rid").alias("arid"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("own"), F.col("v").alias("av"), dealt(a_blocks).alias("ab"))

    def meet(some: DataFrame, choose, keys: list[str], k: int) -> DataFrame:
        """The k best rows, by ``keys``, of what ``choose`` finds in each pair of blocks."""
        grouped = some.withColumn("cb", every(blocks)).groupBy("ab", "cb").cogroup(facing.groupBy("ab", "cb"))
        found = grouped.applyInArrow(_blocks(int(width), int(most), bits, choose), "arid long, anchor_id long, limit long, vec_id long, crid long, score long")
        w = W.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "crid")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def nearest(score, same, other, _):
        import numpy as np

        yield 0, _best(score, np.flatnonzero(same & other), positives)

    def hardest(score, same, other, limits):
        import numpy as np

        at = np.flatnonzero(~same & (100 * score <= high * max(limits)) & (100 * score >= low * min(limits)))
        s = 100 * score[at]
        for p in limits:
            yield p, _best(score, at[(low * p <= s) & (s <= high * p)], negatives)

    first = materialise(meet(anchors, nearest, ["arid"], positives))
    limits = first.groupBy("arid").agg(F.collect_set("score").alias("limits"))  # ``positives`` rows of an anchor at most
    second = meet(anchors.join(limits, "arid"), hardest, ["arid", "limit"], negatives)
    pairs = first.select("arid", F.col("vec_id").alias("positive_id"), F.col("score").alias("limit"))
    return second.join(pairs, ["arid", "limit"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("limit").alias("positive_score"),
                                                        F.col("score").alias("negative_score"))
