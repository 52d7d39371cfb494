"""Tumbling window features on a stream, exact, by chained aggregations in append mode.

Three stateful steps, all behind one watermark:

1. one-second sub-buckets: equal events counted, whole, so that state holds an event once and not once for each
   of its values;
2. windows: counts of words and durations, the sums of the byte columns (a row for each, not one for each value),
   and the sub-buckets' first and last event and sum of squared gaps (``lag`` is refused on streams);
3. one row per window: distinct counts and entropy from the value counts, percentiles weighted by them, and the
   inter-arrival deviation from the sub-buckets in order (as many as the window has seconds).

A window is emitted once, when the watermark has passed its end; the rows equal those of the batch operator for the
same events. Events later than the watermark allows are dropped by Spark and counted in the query's progress.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.config import BYTE_COLUMNS, CARDINALITY_COLUMNS, ENTROPY_COLUMNS, PROTOCOL_SHARES, WindowSpec
from alertloom.session import checkpoint_dir, ensure_utc


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def stream_window_features(events: DataFrame, window: WindowSpec | tuple[str, int], delay: str = "10 minutes", timestamp_col: str = "timestamp") -> DataFrame:
    """Features of one window size on a streaming event table; columns as ``window_features`` names them.

    The names depend on the columns that are there. NULL timestamps drop out, NULL and NaN values count as the batch
    operator counts them. ``window_start`` is a TIMESTAMP_NTZ in UTC.
    """
    name, seconds = (window.name, window.seconds) if isinstance(window, WindowSpec) else window
    ensure_utc(events.sparkSession)
    present = set(events.columns)
    cats = [c for c in CARDINALITY_COLUMNS if c in present]
    words = cats + (["protocol"] if "protocol" in present and "protocol" not in cats else [])
    numbers = [c for c in (*BYTE_COLUMNS, "duration") if c in present]
    auth = {"status", "event_type"} <= present
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    missing = F.lit(None).cast("long")

    def one(kind, s=text, d=number, at=missing, x=number, us=missing):
        return F.struct(F.lit(kind).alias("kind"), s.alias("s"), d.alias("d"), at.alias("at"), x.alias("x"), us.alias("us"))

    at = F.col(timestamp_col).cast("timestamp")
    rows = events.withColumn("_ts", at).where(F.col("_ts").isNotNull()).withWatermark("_ts", delay)
    told = [F.col(c).cast("string").alias(f"s_{c}") for c in words]
    told += [F.nanvl(F.col(c).cast("double"), number).alias(f"d_{c}") for c in numbers]
    if auth:
        told.append(F.when(F.col("event_type") == "auth", F.when(F.col("status") == "failed", "failed").otherwise("other")).alias("s_auth"))
    rows = rows.select("_ts", _micros(F.col("_ts")).alias("us"), *told)
    read = [c for c in rows.columns if c != "_ts"]
    event = rows.groupBy(F.window("_ts", "1 second").alias("w1"), *read).agg(F.count(F.lit(1)).alias("c"))

    values = [one("ts", at=F.unix_seconds("w1.start"), us=F.col("us")), *(one(c, F.col(f"s_{c}")) for c in words)]
    values += [one(c, d=F.col("d_duration")) if c == "duration" else one(c, x=F.col(f"d_{c}")) for c in numbers]
    if auth:
        values.append(one("auth", F.col("s_auth")))
    each = event.select(F.window_time("w1").alias("_t1"), "c", F.explode(F.array(*values)).alias("v")).select("_t1", "c", "v.*")
    each = each.where(F.col("us").isNotNull() | F.col("s").isNotNull() | F.col("d").isNotNull() | F.col("x").isNotNull())
    whole = each.groupBy(F.window("_t1", f"{seconds} seconds").alias("w"), "kind", "s", "d", "at").agg(
        F.sum("c").alias("c"), F.sum(F.col("c") * F.col("x")).alias("t"), F.sum(F.col("c") * F.col("x") * F.col("x")).alias("q"),
        F.max("x").alias("hi"), F.min("x").alias("lo"), F.sort_array(F.collect_set("us")).alias("us"))
    # Equal times have no gap, so distinct ones are enough.
    gaps = F.transform(F.sequence(F.lit(1), F.size("us") - 1), lambda i: F.col("us")[i] - F.col("us")[i - 1])
    square = F.when(F.size("us") > 1, F.aggregate(gaps, F.lit(0.0), lambda a, g: a + (g / 1e6) * (g / 1e6))).otherwise(F.lit(0.0))
    bucket = F.when(F.col("kind") == "ts", F.struct(F.col("us")[0].alias("first"), F.element_at("us", -1).alias("last"), square.alias("sq")))
    whole = whole.select(F.window_time("w").alias("_t"), "kind", "s", "d", "c", "t", "q", "hi", "lo", bucket.alias("g"))

    hit = lambda kind: F.col("kind") == kind
    total = lambda when, x=F.col("c"): F.sum(F.when(when, x))
    aggs = [total(hit("ts")).alias("n"), F.sort_array(F.collect_list("g")).alias("g")]
    for c in cats:
        aggs.append(F.count(F.when(hit(c), 1)).alias(f"d_{c}"))
    for c, _ in ENTROPY_COLUMNS:
        if c in cats:
            aggs += [total(hit(c)).alias(f"en_{c}"), total(hit(c), F.col("c") * F.log2("c")).alias(f"es_{c}")]
    for c in numbers:
        if c != "duration":
            aggs += [total(hit(c)).alias(f"n_{c}"), total(hit(c), F.col("t")).alias(f"sum_{c}"), F.max(F.when(hit(c), F.col("hi"))).alias(f"max_{c}"),
                     total(hit(c), F.col("q")).alias(f"sq_{c}"), F.min(F.when(hit(c), F.col("lo"))).alias(f"min_{c}")]
    if "duration" in numbers:
        aggs.append(F.percentile(F.when(hit("duration"), F.col("d")), F.array(F.lit(0.5), F.lit(0.95)), F.when(hit("duration"), F.col("c")).otherwise(F.lit(0))).alias("q"))
    if auth:
        aggs += [total(hit("auth")).alias("n_auth"), total(hit("auth") & (F.col("s") == "failed")).alias("n_fail")]
    if "protocol" in words:
        aggs += [total(hit("protocol") & (F.col("s") == p)).alias(f"p_{p}") for p in PROTOCOL_SHARES]
    out = whole.groupBy(F.window("_t", f"{seconds} seconds").alias("w")).agg(*aggs)

    n, zero = F.col("n"), F.lit(0)
    cols = [F.col("w.start").cast("timestamp_ntz").alias("window_start"), n.alias(f"event_count_{name}")]
    cols += [F.coalesce(f"d_{c}", zero).alias(f"unique_{c}s_{name}") for c in cats]
    cols += [F.coalesce(F.log2(f"en_{c}") - F.col(f"es_{c}") / F.col(f"en_{c}"), F.lit(0.0)).alias(f"{e}_{name}") for c, e in ENTROPY_COLUMNS if c in cats]
    for c in numbers:
        if c != "duration":
            k, s, q = F.col(f"n_{c}"), F.col(f"sum_{c}"), F.col(f"sq_{c}")
            spread = F.when((k == 1) | (F.col(f"max_{c}") == F.col(f"min_{c}")), 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), q - s * s / k) / (k - 1)))
            cols += [(s / k).alias(f"{c}_mean_{name}"), F.when(k > 0, spread).alias(f"{c}_std_{name}"), s.alias(f"{c}_sum_{name}")]
    if "duration" in numbers:
        cols += [F.col("q")[0].alias(f"conn_duration_p50_{name}"), F.col("q")[1].alias(f"conn_duration_p95_{name}")]
    if auth:
        cols.append(F.coalesce(F.try_divide(F.coalesce("n_fail", zero).cast("double"), F.col("n_auth")), F.lit(0.0)).alias(f"failed_auth_ratio_{name}"))
    g = F.col("g")
    last = lambda i: g[i]["last"]
    across = F.when(F.size(g) > 1, F.aggregate(F.transform(F.sequence(F.lit(1), F.size(g) - 1), lambda i: (g[i]["first"] - last(i - 1)) / 1e6), F.lit(0.0), lambda a, x: a + x * x)).otherwise(0.0)
    squares = F.aggregate(g, F.lit(0.0), lambda a, x: a + x["sq"]) + across
    length = (F.element_at(g, -1)["last"] - g[0]["first"]) / 1e6
    mean = F.try_divide(length, n - 1)
    spread = F.when(n > 2, F.sqrt(F.greatest(F.lit(0.0), squares - length * length / (n - 1)) / (n - 2)))
    ok = (n > 1) & (mean > 0)
    cols += [F.when(ok, mean).alias(f"inter_arrival_mean_{name}"), F.when(ok, spread / mean).alias(f"inter_arrival_cv_{name}")]
    if "protocol" in words:
        cols += [(F.coalesce(f"p_{p}", zero) / n).alias(f"{p}_ratio_{name}") for p in PROTOCOL_SHARES]
    return out.select(*cols)


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Run a streaming table over all input that is there, write its rows to the shared checkpoint folder and read them."""
    import uuid

    spark: SparkSession = stream.sparkSession
    at = f"{checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    query = (stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
