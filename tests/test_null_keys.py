"""NULL keys, folder tables, NaN text and shared storage."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from petrograph.functions.exprs import to_fixed
from petrograph.operators.sequences import neighbour
from petrograph.operators.throttle import throttle
from petrograph.plans.registry import load_all
from petrograph.plans.storage import shared_root

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id bigint, user_id bigint, ts timestamp_ntz, value double"


def events(spark, key, n, minutes):
    return spark.createDataFrame([(i, key, T0 + dt.timedelta(minutes=minutes * i), float(i)) for i in range(n)], SCHEMA)


@pytest.mark.parametrize("key", [7, None])
def test_previous_row(spark, key):
    got = neighbour(events(spark, key, 5, 60), ["user_id"], ["ts", "id"], ["value"]).orderBy("id").collect()
    assert [r.prev_value for r in got] == [None, 0.0, 1.0, 2.0, 3.0]


def test_throttle_keeps_as_many_under_a_null_key(spark):
    assert [r.id for r in throttle(events(spark, None, 40, 25), "user_id", 3600).orderBy("id").collect()] == \
        [r.id for r in throttle(events(spark, 7, 40, 25), "user_id", 3600).orderBy("id").collect()]


def test_streams_read_a_table_that_is_a_folder(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    feed = load_all()["stream_live_feed"].build
    assert feed(spark, str(tmp_path)).exceptAll(feed(spark, sf)).isEmpty()
    assert feed(spark, str(tmp_path)).count() == feed(spark, sf).count() > 0


def test_to_fixed_edges(spark):
    row = spark.createDataFrame([(float("nan"), 1e300, -1.005, None)], "a double, b double, c double, d double") \
        .select(*[to_fixed(F.col(c), 2).alias(c) for c in "abcd"]).first()
    assert row.a == "NaN" and row.b is None and row.c.startswith("-1.0") and row.d is None


def test_shared_root_is_required_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        shared_root(Session())
