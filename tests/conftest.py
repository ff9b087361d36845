import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from driftwise.session import local_session

    s = local_session(cores=4, partitions=4, app="driftwise-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="dw-test-ckpt-", dir="/tmp"))
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="dw-test-", dir="/tmp")


def events(spark, rows, payload_schema="price double, quantity double, close double"):
    """Envelope rows from (event_id, source, type, second, payload-tuple)."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(
        [(e, s, t, sec, p) for e, s, t, sec, p in rows],
        f"event_id string, source string, type string, sec long, payload struct<{payload_schema}>",
    )
    return df.select("event_id", "source", "type", F.timestamp_seconds("sec").alias("timestamp"), "payload",
                     F.lit("{}").alias("meta"))
