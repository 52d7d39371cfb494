"""Event-table sources (S1) and the projection of the driver's ``events`` table onto the
security-event schema.

Timestamps stay ``TIMESTAMP_NTZ`` in batch jobs so window arithmetic is independent of
the session time zone; the streaming path casts to ``TIMESTAMP`` (watermarks need it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("bytes_in", T.DoubleType()),
    T.StructField("bytes_out", T.DoubleType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("attack_category", T.StringType()),
])


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn floating NaN into NULL (Spark orders NaN above every number, so ``NaN > 3``
    would be true in a rule; pandas treats NaN as missing)."""
    cols = columns or [f.name for f in df.schema.fields
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType))
                           for c in cols})


def read_event_csv(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA,
                   timestamp_format: str | None = None) -> DataFrame:
    """Header CSV with an explicit schema (no inference); timestamp parsed at the scan."""
    raw_schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "timestamp" else f
                               for f in schema.fields])
    df = spark.read.schema(raw_schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    if "timestamp" not in df.columns:
        return nan_to_null(df)
    ts = (F.to_timestamp_ntz(F.col("timestamp"), F.lit(timestamp_format)) if timestamp_format
          else F.to_timestamp_ntz(F.col("timestamp")))
    return nan_to_null(df.withColumn("timestamp", ts))


def _k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def events_from_table(events: DataFrame) -> DataFrame:
    """Project the driver's ``events(event_id, ts, user_id, event_type, value, props)`` onto
    the security-event schema (fixed mapping; see FIXTURES.md §4). Pure projection: one
    narrow stage, no shuffle, prunes to the six source columns."""
    k = _k(F.col("props"))
    et = F.col("event_type")
    uid = F.col("user_id")
    dst_port = F.when(et == "error", F.lit(1024) + k * 7).otherwise(
        F.element_at(F.array(*[F.lit(p) for p in (80, 443, 22, 53, 25, 3306)]), F.pmod(k, F.lit(6)) + 1))
    protocol = F.element_at(F.array(*[F.lit(p) for p in ("http", "https", "dns", "ssh", "smtp")]),
                            F.pmod(k, F.lit(5)) + 1)
    return events.select(
        F.col("event_id"),
        F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        F.concat(F.lit("10.0."), F.expr("user_id div 256").cast("string"), F.lit("."),
                 F.pmod(uid, F.lit(256)).cast("string")).alias("src_ip"),
        F.concat(F.lit("192.168.0."), k.cast("string")).alias("dst_ip"),
        (F.lit(1024) + F.pmod(F.col("event_id"), F.lit(60000))).cast("int").alias("src_port"),
        dst_port.cast("int").alias("dst_port"),
        protocol.alias("protocol"),
        F.concat(F.lit("u"), uid.cast("string")).alias("user"),
        (F.col("value") * 10.0).alias("bytes_in"),
        (F.col("value") * (k + 1)).cast("double").alias("bytes_out"),
        (F.col("value") / 50.0).alias("duration"),
        F.when(et.isin("signup", "error"), "auth").otherwise("connection").alias("event_type"),
        F.when(et == "error", "failed").otherwise("success").alias("status"),
        F.when((et == "error") & (k >= 50), 1).otherwise(0).alias("label"),
    )


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read ``events.parquet`` from a test-data folder and project it (column pruning and
    filter pushdown reach the Parquet scan)."""
    return events_from_table(spark.read.parquet(f"{sf_dir}/events.parquet"))


# DuckDB form of the same projection, used by the SQL oracles.
EVENTS_DUCKDB_CTE = """
e0 AS (SELECT event_id, ts, user_id, event_type AS et, value,
              CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
ev AS (
SELECT event_id, ts AS "timestamp",
  concat('10.0.', CAST(user_id // 256 AS VARCHAR), '.', CAST(user_id % 256 AS VARCHAR)) AS src_ip,
  concat('192.168.0.', CAST(k AS VARCHAR)) AS dst_ip,
  CAST(1024 + event_id % 60000 AS INT) AS src_port,
  CAST(CASE WHEN et = 'error' THEN 1024 + k * 7
       ELSE ([80, 443, 22, 53, 25, 3306])[k % 6 + 1] END AS INT) AS dst_port,
  (['http', 'https', 'dns', 'ssh', 'smtp'])[k % 5 + 1] AS protocol,
  concat('u', CAST(user_id AS VARCHAR)) AS "user",
  value * 10.0::DOUBLE AS bytes_in, value * (k + 1) AS bytes_out, value / 50.0::DOUBLE AS duration,
  CASE WHEN et IN ('signup', 'error') THEN 'auth' ELSE 'connection' END AS event_type,
  CASE WHEN et = 'error' THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN et = 'error' AND k >= 50 THEN 1 ELSE 0 END AS label
FROM e0)"""


def metric_input(events: DataFrame) -> DataFrame:
    """Labelled scores for the metric operators (FIXTURES.md §4): ``id``, ``ts``, ``y_true`` =
    the projection's label, ``y_score`` = value / 600 rounded to 4 decimals (half away from
    zero on the binary value, as DuckDB rounds), so ties occur."""
    k = _k(F.col("props"))
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when((F.col("event_type") == "error") & (k >= 50), 1).otherwise(0).alias("y_true"),
        (F.round(F.col("value") / 600.0 * 10000.0) / 10000.0).alias("y_score"))


METRICS_DUCKDB_CTE = """
m AS (SELECT event_id AS id, ts,
             CASE WHEN event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS INT) >= 50
                  THEN 1 ELSE 0 END AS y_true,
             round(value / 600.0::DOUBLE * 10000.0::DOUBLE) / 10000.0::DOUBLE AS y_score
      FROM events)"""
