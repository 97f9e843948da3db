"""Streams against the batch form of the same rows; restarts; late and repeated rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphspark.streaming import runs

SCHEMA = "run string, sample string, correct boolean, ts timestamp"
BEGIN = datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def provider(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def row(run, sample, correct, minutes):
    return (run, sample, correct, BEGIN + timedelta(minutes=minutes))


class Stream:
    """Files that are fed one by one, each to a new start of the query on one checkpoint."""

    def __init__(self, spark, tmp, build, mode):
        self.spark, self.tmp, self.build, self.mode, self.out, self.fed = spark, tmp, build, mode, [], 0

    def feed(self, rows):
        self.fed += 1
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.tmp}/in")
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"{self.tmp}/in")
        got = []
        keep = lambda df, _: got.extend(tuple(r) for r in df.collect())
        query = self.build(stream).writeStream.outputMode(self.mode).foreachBatch(keep).option("checkpointLocation", f"{self.tmp}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        self.out += got
        return sorted(got)


def test_runs_complete_in_any_order(spark, tmp_path):
    s = Stream(spark, str(tmp_path), lambda df: runs.completed_runs(df, 3, patience="2 hours", late="10 minutes"), "update")
    assert s.feed([row("b", "1", True, 0), row("a", "1", True, 1), row("a", "2", False, 2), row("c", "1", True, 3), (None, "1", True, BEGIN), ("a", None, True, BEGIN)]) == []
    # the second start goes on with the state of the first
    assert s.feed([row("a", "2", True, 4), row("a", "3", None, 5), row("b", "2", True, 6)]) == [("a", "complete", 3, 1, 1)]
    assert s.feed([row("a", "4", True, 7), row("b", "3", True, 8), row("b", "3", True, 8)]) == [("a", "late", 1, 1, 0), ("b", "complete", 3, 3, 0), ("b", "late", 1, 1, 0)]
    # event time passes run c's patience: it is given up, and what comes after is late
    s.feed([row("d", "1", True, 400)])
    s.feed([row("d", "2", True, 401), row("c", "2", True, 401)])
    assert [r for r in s.out if r[0] == "c"] == [("c", "given up", 1, 1, 0), ("c", "late", 1, 1, 0)]


ROWS = [row(f"r{k % 3}", str(k), k % 2 == 0, (k * 37) % 700) for k in range(60)]


@pytest.mark.parametrize("build", [runs.sliding, runs.sessions])
def test_windows_equal_the_batch(spark, tmp_path, build):
    """Rows out of order over several starts; a last row far ahead closes all windows."""
    batch = sorted(tuple(r) for r in build(spark.createDataFrame(ROWS, SCHEMA)).collect())
    s = Stream(spark, str(tmp_path), build, "append")
    for k in range(0, 60, 20):
        s.feed(ROWS[k : k + 20])
    s.feed([row("end", "x", True, 60 * 24 * 10)])
    s.feed([row("end", "y", True, 60 * 24 * 20)])
    assert sorted(r for r in s.out if r[-3] != "end") == batch


def test_rows_behind_the_watermark_go(spark, tmp_path):
    s = Stream(spark, str(tmp_path), lambda df: runs.sliding(df, "1 hour", "30 minutes", late="1 hour"), "append")
    s.feed([row("r", "1", True, 0), row("r", "2", True, 300)])
    s.feed([row("r", "3", True, 10), row("r", "4", True, 310)])  # the third is later than an hour
    s.feed([row("r", "5", True, 6000)])
    s.feed([row("r", "6", True, 12000)])
    start = BEGIN - timedelta(minutes=30)
    assert [r[2] for r in s.out if r[0] in (start, BEGIN)] == [1, 1]
