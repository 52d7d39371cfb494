import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("alertloom-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.driver.memory", "4g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        d = tempfile.mkdtemp(prefix="alertloom-test-ckpt-")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s
    s.stop()


def ev_frame(spark, rows, columns=None):
    """rows: list of dicts with keys of the event schema; timestamps as strings."""
    import datetime as dt
    from pyspark.sql import types as T
    schema = T.StructType([
        T.StructField("timestamp", T.TimestampNTZType()), T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()), T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.StringType()), T.StructField("bytes_in", T.DoubleType()),
        T.StructField("bytes_out", T.DoubleType()), T.StructField("duration", T.DoubleType()),
        T.StructField("event_type", T.StringType()), T.StructField("status", T.StringType()),
    ])
    cols = columns or [f.name for f in schema.fields]
    schema = T.StructType([f for f in schema.fields if f.name in cols])
    data = []
    for r in rows:
        ts = r.get("timestamp")
        if isinstance(ts, str):
            ts = dt.datetime.fromisoformat(ts)
        rec = dict(r, timestamp=ts)
        data.append(tuple(rec.get(c) for c in cols))
    return spark.createDataFrame(data, schema)
