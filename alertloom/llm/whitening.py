"""Embedding whitening with the distributed block matrices of Spark MLlib.

Centred rows are indexed without gaps and cut into distributed blocks. The transpose of the distinct rows' matrix times
itself is their scatter; its eigenvectors, found locally, give the whitening matrix, and one more block multiplication
projects all rows.
"""

from __future__ import annotations

import math

from pyspark import SparkContext, StorageLevel
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import materialise, running_offsets, with_row_id
from alertloom.session import checkpoint_dir

#: Rows and columns of a block, and blocks of rows that one task multiplies.
ROWS, COLUMNS, BLOCKS = 1024, 1024, 32
#: Components below this part of the trace have no direction of their own and are left out.
LEAST = 1e-12


def whole_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and x, floor(scale * c) of every entry; rows whose vector is NULL or holds a NULL or non-finite entry are dropped."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(v, lambda c: F.floor(c.cast("double") * scale))
    return vectors.where(v.isNotNull() & finite).select(F.col(id_col).alias("vec_id"), whole.alias("x"))


def numbered(rows: DataFrame) -> DataFrame:
    """Written rows with ``i``, their number from 0 without gaps, from the counts of the parts that made them."""
    written = materialise(with_row_id(rows))
    place, part = F.col("rid").bitwiseAND((1 << 33) - 1), F.shiftright("rid", 33)
    counts = written.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    first = running_offsets(counts, [], "part", ["part"], "n", "first")  # a row for each task of the write
    return written.withColumn("part", part).join(F.broadcast(first.select("part", "first")), "part").withColumn("i", F.col("first") + place).drop("part", "first", "rid")


def block_matrix(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """Block matrix of (i, c): row numbers and arrays of doubles; rows that are not there are zero.

    The blocks are kept, as a multiplication reads them up to four times; lost ones are made again.
    """
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("i").alias("index"), array_to_vector("c").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(ROWS, COLUMNS).persist(StorageLevel.MEMORY_AND_DISK)


def _release(matrix: BlockMatrix) -> None:
    matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)


def scatter(matrix: BlockMatrix, n: int):
    """The transpose of a matrix times itself. The inner dimension is dealt over tasks of ``BLOCKS`` blocks each."""
    java = matrix._java_matrix_wrapper._java_model
    splits = max(1, math.ceil(n / ROWS / BLOCKS))
    # The Scala method also takes the number of splits of the inner dimension; without it one task would get all blocks.
    return BlockMatrix(java.transpose().multiply(java, splits), COLUMNS, COLUMNS).toLocalMatrix().toArray()


def project(matrix: BlockMatrix, onto) -> DataFrame:
    """(i, y): the rows of a block matrix times a local matrix of few columns."""
    width, k = onto.shape
    cuts = range(0, width, COLUMNS)
    blocks = [((j, 0), Matrices.dense(len(onto[c : c + COLUMNS]), k, onto[c : c + COLUMNS].ravel(order="F").tolist())) for j, c in enumerate(cuts)]
    right = BlockMatrix(SparkContext.getOrCreate().parallelize(blocks, len(blocks)), COLUMNS, k, width, k)
    found = matrix.multiply(right).toIndexedRowMatrix()
    return callMLlibFunc("getIndexedRows", found._java_matrix_wrapper._java_model).select(F.col("index").alias("i"), vector_to_array("vector").alias("y"))


def covariance_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of (y), centred first, less the identity."""
    means = whitened.agg(*[(F.sum(F.get("y", F.lit(a))) / n).alias(f"m{a}") for a in range(k)]).first()
    y = [F.get("y", F.lit(a)) - F.lit(float(means[a])) for a in range(k)]
    pairs = [(a, b) for a in range(k) for b in range(a + 1)]
    got = whitened.agg(*[(F.sum(y[a] * y[b]) / n).alias(f"v{a}_{b}") for a, b in pairs]).first()
    return max(abs(float(v) - (a == b)) for v, (a, b) in zip(got, pairs))


def whiten(rows: DataFrame, components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row of (vec_id, x) and component from 1.

    ``x`` holds whole numbers. The mean S / n and the covariance come from the distinct vectors, n of them, however often each
    stands; every row is projected. ``deviation`` is the exact sum of (n * x - S) ** 2, NULL if it does not fit a long.
    Components are numbered by falling eigenvalue; those of (nearly) no variance are left out, so one distinct vector, or an
    empty table, gives no rows. Shorter vectors count as if filled with zeros, rows with a NULL vector or NULL entry are left
    out, NULL ids are kept, and repeated rows are rows of their own; equal vectors get equal values. Other columns are not
    read. To the driver come a matrix of width x width and the sums; widths of some thousands fit there.
    """
    spark = rows.sparkSession
    checkpoint_dir(spark)
    ok = rows.select("vec_id", F.col("x").cast("array<long>").alias("x")).where("x is not null and forall(x, e -> e is not null)")
    kinds = f"vec_id {dict(ok.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    table = numbered(ok)
    total, width = table.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if not total or not width:
        return spark.createDataFrame([], kinds)
    fill = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    table = table.select("i", "vec_id", fill.alias("x"))
    fit = materialise(table.groupBy("x").agg(F.min("i").alias("i")))
    sums = fit.agg(F.count(F.lit(1)), *[F.sum(F.get("x", F.lit(d))) for d in range(width)]).first()
    n, s = sums[0], list(sums[1:])
    mean = F.array(*[F.lit(v / n) for v in s])
    centre = lambda df: df.select("i", F.zip_with("x", mean, lambda x, m: x - m).alias("c"))

    import numpy as np

    distinct = block_matrix(centre(fit), total, width)
    v = scatter(distinct, total) / n
    _release(distinct)
    e, u = np.linalg.eigh((v + v.T) / 2)
    trace, order = float(e.sum()), np.argsort(-e, kind="stable")[:components]
    order = order[e[order] > LEAST * max(trace, 0.0)] if trace > 0 else order[:0]
    if not len(order):
        return spark.createDataFrame([], kinds)
    k = len(order)
    every = block_matrix(centre(table), total, width)
    projected = materialise(project(every, u[:, order] / np.sqrt(e[order])))
    _release(every)
    error = covariance_error(projected.join(fit.select("i"), "i", "left_semi"), n, k)
    whole = F.array(*[F.lit(x).cast("long") for x in s])
    square = lambda x, t: F.try_multiply(F.try_subtract(F.try_multiply(F.lit(n).cast("long"), x), t), F.try_subtract(F.try_multiply(F.lit(n).cast("long"), x), t))
    deviation = F.aggregate(F.zip_with("x", whole, square), F.lit(0).cast("long"), lambda a, b: F.try_add(a, b))
    parts = F.posexplode(F.arrays_zip("y", F.array(*[F.lit(float(e[o] / trace)) for o in order]).alias("w"))).alias("at", "p")
    out = table.select("i", "vec_id", deviation.alias("deviation")).join(projected, "i").select("vec_id", "deviation", parts)
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                      F.col("p.y").alias("whitened"), F.col("p.w").alias("explained"), F.lit(error).alias("identity_error"))
