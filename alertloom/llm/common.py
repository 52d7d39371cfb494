"""Helpers shared by the training-data operators: words, row ids, written tables, prefix sums."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.session import checkpoint_dir

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_TRIM = " \t\n\x0b\x0c\r"


def word_count(text: str | Column) -> Column:
    """Number of words of a text; 0 for NULL and for texts without a word."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: str | Column) -> Column:
    """The words of a text as an array; empty for NULL and for texts without a word."""
    t = F.btrim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(_TRIM))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, SPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is made once for each row, however the optimizer moves the expression.

    A column used inside a lambda can be replaced by its definition, e.g. when a filter is pushed below it, and would
    then be made again for every element.
    """
    return F.get(F.transform(F.array(value), body), 0)


def source_key(source: str | Column) -> Column:
    """A never-NULL key that orders like the source by code point, NULL last."""
    c = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("0"), c.cast("string")), F.lit("1"))


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to a new folder under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage with files that outlive executors; unlike ``checkpoint()`` later reads can
    leave out columns. Row ids made before the write are fixed by it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/alertloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_id(df: DataFrame, name: str = "rid") -> DataFrame:
    """Add a row id (partition number and place in it); write the result before relying on it."""
    return df.withColumn(name, F.monotonically_increasing_id())


#: Rows of a bucket of consecutive row ids, as a power of two.
_BUCKET_BITS = 8
_SUPER_BITS = 10


def rid_bucket(rid: str = "rid") -> Column:
    """Bucket of up to 256 rows that follow each other; the buckets keep the order of the ids."""
    return F.shiftright(F.col(rid), _BUCKET_BITS)


def running_offsets(df: DataFrame, group: list[str], bucket: str, order: list[str], size: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``size`` over the rows of the group that come before the row.

    The order is (``bucket``, ``order``). Only rows of one bucket meet in one window; sums of
    buckets, and of runs of 1,024 buckets, carry the totals on, so a group of any size is spread
    over as many tasks as it has buckets. ``bucket`` is a whole number, never NULL.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(size).alias("_t")).withColumn("_s", F.shiftright(bucket, _SUPER_BITS))
    tops = sums.groupBy(*group, "_s").agg(F.sum("_t").alias("_st"))
    before = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select(*group, "_s", F.coalesce(F.sum("_st").over(before(*group).orderBy("_s")), F.lit(0)).alias("_sp"))
    heads = (sums.join(tops, [*group, "_s"])
             .withColumn("_p", F.col("_sp") + F.coalesce(F.sum("_t").over(before(*group, "_s").orderBy(bucket)), F.lit(0)))
             .select(*group, bucket, "_p"))
    inner = F.coalesce(F.sum(size).over(before(*group, bucket).orderBy(*order)), F.lit(0))
    return df.join(heads, [*group, bucket]).withColumn(out, (F.col("_p") + inner).cast("long")).drop("_p")


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, so later tasks find what earlier ones made.

    The first word of the name says whose it is; what other operators have left in the worker goes.
    """
    module = sys.modules.setdefault("alertloom_worker_cache", types.ModuleType("alertloom_worker_cache"))
    held = module.__dict__.setdefault("held", {})
    for other in [k for k in held if k.split()[0] != name.split()[0]]:
        del held[other]
    return held.setdefault(name, {})


def release_memory() -> None:
    """Give memory that a Python worker has freed back to the machine, at most once a second.

    The C library and Arrow keep it else for as long as the worker lives, beside what the next operator takes.
    """
    import ctypes
    import time

    import pyarrow as pa

    module = sys.modules.setdefault("alertloom_worker_cache", types.ModuleType("alertloom_worker_cache"))
    if time.monotonic() - module.__dict__.get("released", 0.0) > 1.0:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)
        module.__dict__["released"] = time.monotonic()


def lean(run: Callable, rows: int = 2048) -> Callable:
    """A mapInArrow function that sees at most ``rows`` rows at once and gives its memory back when a partition ends."""

    def sliced(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                yield batch.slice(i, rows)

    def wrapped(batches):
        try:
            yield from run(sliced(batches))
        finally:
            release_memory()

    return wrapped


def doc_type(df: DataFrame, column: str) -> str:
    """DDL type of a column."""
    return df.schema[column].dataType.simpleString()
