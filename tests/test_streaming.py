import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from alertloom.operators.novelty import novelty_features
from alertloom.operators.rolling import rolling_baseline
from alertloom.operators.windows import window_features
from alertloom.streaming.stateful import stream_novelty, stream_rolling_baseline
from alertloom.streaming.windows import run_to_end, stream_window_features

SCHEMA = ("timestamp timestamp_ntz, src_ip string, dst_ip string, dst_port int, protocol string, user string, bytes_in double, bytes_out double, "
          "duration double, event_type string, status string")


def events(seed, n, start, spread):
    r = random.Random(seed)
    t0 = datetime(2024, 1, 1) + timedelta(seconds=start)
    rows = []
    for _ in range(n):
        at = t0 + timedelta(microseconds=int(r.random() * spread * 1e6) // 250_000 * 250_000 if r.random() < 0.5 else int(r.random() * spread * 1e6))
        rows.append((at, f"s{r.randint(0, 4)}", f"d{r.randint(0, 30)}", r.choice([80, 443, 22, None]), r.choice(["http", "dns", "ssh", None]), r.choice(["a", "b", None]),
                     r.choice([None, float("nan"), r.random() * 1000]), r.random() * 50, r.choice([None, r.randint(0, 9) / 4]), r.choice(["auth", "connection"]), r.choice(["failed", "success"])))
    return rows


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Files of events, read one a batch: each goes back a little behind the one before it, the last but one holds a late row."""
    folder = str(tmp_path_factory.mktemp("events"))
    files = [events(1, 300, 0, 600), events(2, 300, 540, 600), events(3, 2, 1100, 900), events(4, 200, 2400, 300)]
    late = [(datetime(2024, 1, 1, 0, 1), "late", "late", 1, "dns", "x", 1.0, 1.0, 1.0, "auth", "failed")]
    files += [late, [(datetime(2024, 1, 1, 6, 0), "end", "end", 1, "dns", "x", 1.0, 1.0, 1.0, "auth", "failed")]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    good = spark.createDataFrame([r for f in files[:4] for r in f], SCHEMA)
    return folder, good


def stream(spark, folder, files=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def same(got, want, keys=("window_start",)):
    assert sorted(got.columns) == sorted(want.columns)
    a, b = ({tuple(r[k] for k in keys): r.asDict() for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and len(a)
    for k in a:
        for c, x in a[k].items():
            y = b[k][c]
            assert (x is None and y is None) or x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (k, c, x, y)


@pytest.mark.parametrize("name, seconds", [("1min", 60), ("5min", 300)])
def test_stream_equals_batch(spark, parts, name, seconds):
    folder, good = parts
    got = run_to_end(stream_window_features(stream(spark, folder), (name, seconds), delay="5 minutes"), "t")
    # The late row came 59 minutes behind the watermark and is dropped; the last row's window is not finished.
    same(got, window_features(good, [(name, seconds)]).where(F.col(f"event_count_{name}").isNotNull()))


def test_late_rows_within_the_delay_count(spark, parts):
    folder, good = parts
    got = run_to_end(stream_window_features(stream(spark, folder).select("timestamp", "src_ip"), ("1min", 60), delay="50 minutes"), "t")
    first = got.where(F.col("window_start") == F.lit(datetime(2024, 1, 1, 0, 1)).cast("timestamp_ntz")).first()
    before = window_features(good.select("timestamp", "src_ip"), [("1min", 60)]).where(F.col("window_start") == F.lit(datetime(2024, 1, 1, 0, 1)).cast("timestamp_ntz")).first()
    assert first.event_count_1min == before.event_count_1min + 1


def test_novelty_equals_batch_over_restarts(spark, parts, tmp_path):
    folder, good = parts
    at = str(tmp_path / "novelty")
    src = str(tmp_path / "in")
    files = sorted(r.f for r in spark.read.schema(SCHEMA).parquet(folder).select(F.input_file_name().alias("f")).distinct().collect())
    by_time = sorted(files, key=lambda f: spark.read.parquet(f).agg(F.min("timestamp")).first()[0])
    order = [f for f in by_time if spark.read.parquet(f).first().src_ip != "late"]
    for f in order:  # a run for each file: every one goes on from the state of the last
        spark.read.parquet(f).coalesce(1).write.mode("append").parquet(src)
        got = stream_novelty(spark.readStream.schema(SCHEMA).parquet(src), at, delay="5 minutes")
    same(got, novelty_features(good))


def test_rolling_equals_batch(spark, parts, tmp_path):
    folder, good = parts
    counts = stream_window_features(stream(spark, folder).select("timestamp"), ("1min", 60), delay="5 minutes").select("window_start", "event_count_1min")
    got = stream_rolling_baseline(counts, str(tmp_path / "rolling"), lookback=7)
    want = rolling_baseline(window_features(good.select("timestamp"), [("1min", 60)]).select("window_start", "event_count_1min"), lookback=7)
    same(got, want)


def test_state_holds_an_event_once(spark, parts, tmp_path):
    folder, good = parts
    made = stream_window_features(stream(spark, folder, 100), ("1h", 3600), delay="5 minutes")
    query = (made.writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "state"))
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    first = max((p for p in query.recentProgress if p["numInputRows"]), key=lambda p: p["numInputRows"])
    assert first["stateOperators"][-1]["numRowsUpdated"] <= good.count() + 2  # each of its twelve values before
