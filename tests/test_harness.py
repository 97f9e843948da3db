"""Stops between any two steps leave the old or the new state; calls that resume; runs over a log."""

import os

import pytest
from pyspark.sql import functions as F

from graphspark.functions import harness
from graphspark.sources import versions


class Stopped(Exception):
    pass


def stop(*_args, **_more):
    raise Stopped


def test_a_stop_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table = lambda n: lambda: spark.range(n)
    assert versions.cached(spark, path, {"a": 1}, table(3)).count() == 3
    with monkeypatch.context() as m:  # the data is written, its name is not
        m.setattr(versions, "put", stop)
        with pytest.raises(Stopped):
            versions.cached(spark, path, {"a": 1}, table(5), rebuild=True)
    assert versions.cached(spark, path, {"a": 1}, stop).count() == 3
    with pytest.raises(Stopped):  # nothing is written
        versions.cached(spark, path, {"a": 2}, stop)
    assert versions.cached(spark, path, {"a": 1}, stop).count() == 3
    assert versions.cached(spark, path, {"a": 2}, table(6)).count() == 6
    assert versions.cached(spark, path, {"a": 2}, stop).count() == 6
    assert versions.cached(spark, path, {"a": 2}, table(7), rebuild=True).count() == 7
    assert len([f for f in os.listdir(path) if f.startswith("v-")]) == 2  # this and the one before


def test_a_run_is_in_the_log_once(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    assert versions.read_runs(spark, log) is None and versions.finished(spark, log) == []
    with monkeypatch.context() as m:
        m.setattr(versions, "put", stop)
        with pytest.raises(Stopped):
            versions.append_run(spark.range(4), log, "t", 0)
    assert versions.read_runs(spark, log) is None
    assert versions.append_run(spark.range(4), log, "t", 0)
    assert not versions.append_run(spark.range(4), log, "t", 0)
    # two writers at once: the second finds the file of the first
    with monkeypatch.context() as m:
        m.setattr(versions, "get", lambda *a: None)
        assert not versions.append_run(spark.range(9), log, "t", 0)
    assert versions.append_run(spark.range(2), log, "t", 1) and versions.append_run(spark.range(1), log, "u/v", 0)
    assert versions.read_runs(spark, log).count() == 7 and versions.read_runs(spark, log, "t").count() == 6
    assert {r.task: r.remaining for r in versions.runs_to_do(spark, log, {"t": 5, "u/v": 1, "w": 2}).collect()} == {"t": 3, "u/v": 0, "w": 2}


def counting(folder, fails=()):
    """A client that leaves a file for each call, and fails for some prompts."""

    def client():
        def call(p):
            open(os.path.join(folder, f"{p}-{os.urandom(8).hex()}"), "w").close()
            if p in fails:
                raise RuntimeError("no answer")
            return f"YES {p}"

        return call

    return client


def calls(folder):
    return sorted(f.rsplit("-", 1)[0] for f in os.listdir(folder))


def test_only_what_is_missing_is_asked(spark, tmp_path, monkeypatch):
    folder, store = tmp_path / "calls", str(tmp_path / "store")
    folder.mkdir()
    df = spark.createDataFrame([(k, f"p{k % 6}") for k in range(12)] + [(12, None)], "n int, q string")
    quick = {"attempts": 1, "pause": 0.0}
    asked = harness.ask_once(df, "q", store, counting(folder, ("p1", "p4")), chunk=2, **quick)
    assert (asked.prompts, asked.failed) == (6, 2) and calls(folder) == [f"p{k}" for k in range(6)]
    got = {r.n: (r.answer, r.answer_error) for r in asked.rows.collect()}
    assert got[0] == ("YES p0", None) and got[1] == (None, "no answer") and got[12] == (None, None) and len(got) == 13
    again = harness.ask_once(df, "q", store, counting(folder, ()), chunk=2, **quick)
    assert (again.prompts, again.failed) == (2, 0) and calls(folder) == sorted([f"p{k}" for k in range(6)] + ["p1", "p4"])
    assert {r.answer for r in again.rows.collect()} == {f"YES p{k}" for k in range(6)} | {None}
    done = harness.ask_once(df, "q", store, counting(folder), **quick)
    assert done.prompts == 0 and len(calls(folder)) == 8


def test_a_batch_that_breaks_off_keeps_its_chunks(spark, tmp_path, monkeypatch):
    folder, store = tmp_path / "calls", str(tmp_path / "store")
    folder.mkdir()
    df = spark.createDataFrame([(f"p{k}",) for k in range(20)], "q string")
    left, put = [2], versions.put

    def breaks(*a, **b):
        if not left[0]:
            raise Stopped
        left[0] -= 1
        return put(*a, **b)

    with monkeypatch.context() as m:
        m.setattr(versions, "put", breaks)
        with pytest.raises(Stopped):
            harness.ask_once(df, "q", store, counting(folder), chunk=4)
    kept = versions.read_runs(spark, store).count()
    assert 0 < kept < 20
    assert harness.ask_once(df, "q", store, counting(folder), chunk=4).prompts == 20 - kept


def test_runs_of_a_task(spark, tmp_path):
    folder, log = tmp_path / "calls", str(tmp_path / "log")
    folder.mkdir()
    samples = spark.createDataFrame([(f"p{k}", k % 3 == 0) for k in range(9)], "q string, positive boolean")
    score = lambda rows: rows.withColumn("right", F.col("answer").startswith("YES") == F.col("positive"))
    quick = {"attempts": 1, "pause": 0.0}
    assert harness.compiled(spark, log, [], {}) is None
    assert harness.run_task(samples, log, "edit", 2, "q", score, counting(folder), **quick) == [0, 1]
    assert harness.run_task(samples, log, "edit", 3, "q", score, counting(folder, ("p2",)), **quick) == []  # a call fails: not appended
    assert harness.run_task(samples, log, "edit", 3, "q", score, counting(folder), **quick) == [2]
    assert len(calls(folder)) == 3 * 9 + 1  # the failed one again, nothing else
    rows = {(r.task, r.metric): (r.mean, r.runs) for r in harness.compiled(spark, log, [], {"accuracy": F.avg(F.col("right").cast("int")), "n": F.count("*")}).collect()}
    assert rows == {("edit", "accuracy"): (0.333333, 3), ("edit", "n"): (9.0, 3)}
