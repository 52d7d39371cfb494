"""Flow tables from CSV: the schema follows the header, known names get their types, two formats are told apart.

Nothing is inferred from values: a scan reads the first line for its names, and every column that the format knows as numeric
is a double. Rows that don't fit are kept with NULLs, dropped, or raise, as asked for.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.config import FLOW_CATEGORICAL_COLUMNS, FLOW_NUMERIC_COLUMNS, FLOW_RENAME
from alertloom.functions.scalar import select_existing
from alertloom.operators.encoding import event_level_features, fit_categories, one_hot
from alertloom.sources.events import EVENT_SCHEMA, nan_to_null, read_event_csv

#: Numeric columns beside the features: ports, counters and the label.
_OTHER_NUMERIC = ("id", "sport", "dsport", "label")
_NUMERIC = {*FLOW_NUMERIC_COLUMNS, *_OTHER_NUMERIC}
_BROKEN = "_broken_row"


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file or folder as they stand there, without the byte order mark and outer spaces."""
    line = spark.read.csv(path).first()
    return [(c or f"_c{i}").strip("\ufeff ") for i, c in enumerate(line or ())]


def flow_format(columns: Sequence[str]) -> str:
    """``flow`` if the header has ``dur`` and ``spkts`` in any case, else ``event``."""
    return "flow" if {"dur", "spkts"} <= {c.lower() for c in columns} else "event"


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that can be read; all missing raises."""
    for path in paths:
        try:
            spark.read.option("header", True).csv(path)
            return path
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of {list(paths)} exists")


def read_flow_csv(spark: SparkSession, path: str, broken: str = "null") -> DataFrame:
    """The flow table with lower-case names; numeric columns of the format as doubles, NaN as NULL, others as strings.

    ``broken`` rows (values that are no numbers, wrong numbers of fields) keep what can be read (``null``), go (``drop``) or raise
    (``fail``). Two columns whose names differ in case alone raise.
    """
    if broken not in ("null", "drop", "fail"):
        raise ValueError(f"broken rows: {broken!r} is neither null, drop nor fail")
    names = [c.lower() for c in header(spark, path)]
    if len(set(names)) < len(names):
        raise ValueError(f"columns named twice: {sorted({c for c in names if names.count(c) > 1})}")
    schema = T.StructType([T.StructField(c, T.DoubleType() if c in _NUMERIC else T.StringType()) for c in names])
    reader = spark.read.option("header", True).option("enforceSchema", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    if broken == "fail":
        return nan_to_null(reader.option("mode", "FAILFAST").schema(schema).csv(path))
    held = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN).schema(schema.add(_BROKEN, T.StringType())).csv(path)
    if broken == "drop":
        held = held.where(F.col(_BROKEN).isNull())
    return nan_to_null(held.drop(_BROKEN))


def _labelled(df: DataFrame) -> DataFrame:
    if "label" not in df.columns:
        raise ValueError(f"no label column among {df.columns}")
    return df.withColumn("label", F.col("label").cast("int"))


def renamed_flows(df: DataFrame) -> DataFrame:
    """S3: the event schema's names; numeric features and ``is_attack`` (if there is one), without addresses and categories."""
    named = df.withColumnsRenamed({k: v for k, v in FLOW_RENAME.items() if k in df.columns})
    features = [f.name for f in named.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != "is_attack"]
    return named.select(*features, *[F.col(c).cast("int").alias(c) for c in named.columns if c == "is_attack"])


def numeric_flows(df: DataFrame) -> DataFrame:
    """All numeric columns, NULL as 0, and the label; a table without one raises."""
    rows = _labelled(df)
    return rows.select(*[F.coalesce(F.col(f.name), F.lit(0.0)).alias(f.name) for f in rows.schema.fields
                         if isinstance(f.dataType, T.NumericType) and f.name != "label"], "label")


def encoded_flows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The format's numeric features that exist, NULL as 0, 0/1 columns of ``proto``, ``service`` and ``state``, and the label.

    Each distinct category becomes a column, so their names reach the driver; a missing label raises.
    """
    rows = _labelled(df)
    numeric = select_existing(rows, FLOW_NUMERIC_COLUMNS).columns
    kinds = [c for c in FLOW_CATEGORICAL_COLUMNS if c in rows.columns]
    values = {c: fit_categories(rows, c) for c in kinds}
    out = rows.select(*keep, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in numeric], *kinds, "label")
    for c in kinds:
        out = one_hot(out, c, values[c])
    return out.select(*[c for c in out.columns if c != "label"], "label")


def load_table(spark: SparkSession, path: str, broken: str = "null") -> DataFrame:
    """Features and label of a CSV of either format, told apart by its header."""
    columns = header(spark, path)
    if flow_format(columns) == "flow":
        return encoded_flows(read_flow_csv(spark, path, broken))
    known = {f.name: f for f in EVENT_SCHEMA.fields}
    schema = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in columns])
    return event_level_features(_labelled(read_event_csv(spark, path, schema)), keep=("label",))


def write_csv(df: DataFrame, folder: str) -> str:
    """Rows as CSV files with headers in a new folder below ``folder``; its path."""
    path = f"{folder.rstrip('/')}/alertloom-csv-{uuid.uuid4().hex}"
    df.write.option("header", True).csv(path)
    return path
