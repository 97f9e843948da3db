"""Tables that change as a whole: every write is a folder of its own, and one small file, put in place by a rename, says which one counts.

A kill between any two steps leaves the old state or the new one: a folder that
no file names is never read. Where two writers race, the file that comes last
(``current``) or first (a run of a log) counts.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def _hadoop(spark: SparkSession):
    return spark._jvm.org.apache.hadoop.fs


def put(spark: SparkSession, path: str, name: str, content: dict, replace: bool = True) -> bool:
    """Put a small JSON file at <path>/<name> in one step; without ``replace`` False where there is one already."""
    fs, conf = _hadoop(spark), spark._jsc.hadoopConfiguration()
    target, staged = fs.Path(f"{path}/{name}"), fs.Path(f"{path}/_staged/{uuid.uuid4().hex}")
    system = target.getFileSystem(conf)
    out = system.create(staged, True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    system.mkdirs(target.getParent())
    kind = getattr(fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE if replace else kind.NONE
    try:
        fs.FileContext.getFileContext(system.getUri(), conf).rename(system.makeQualified(staged), system.makeQualified(target), how)
    except Exception as e:
        if replace or "FileAlreadyExists" not in str(e):
            raise
        system.delete(staged, False)
        return False
    return True


def _absent(error: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(error)


def get(spark: SparkSession, path: str, name: str) -> dict | None:
    """The content of such a file, None where there is none."""
    try:
        rows = spark.read.text(f"{path}/{name}", wholetext=True).collect()  # one small file
    except Exception as e:
        if _absent(e):
            return None
        raise
    return json.loads(rows[0].value) if rows else None


def cached(spark: SparkSession, path: str, options: dict, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """A table built with these options: read if it is there with equal ones, else built, written, and then named as the current one.

    The version before stays until the next build, for those who still read it; older ones go.
    """
    now = get(spark, path, "current")
    if now and not rebuild and now["options"] == json.loads(json.dumps(options)):
        return spark.read.parquet(f"{path}/{now['folder']}")
    folder = f"v-{uuid.uuid4().hex}"
    build().write.parquet(f"{path}/{folder}")
    put(spark, path, "current", {"options": options, "folder": folder})
    fs, conf = _hadoop(spark), spark._jsc.hadoopConfiguration()
    root = fs.Path(path)
    system = root.getFileSystem(conf)
    for status in system.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in (folder, (now or {}).get("folder")):
            system.delete(status.getPath(), True)
    return spark.read.parquet(f"{path}/{folder}")


def _run_file(task: str, run: int) -> str:
    return f"{hashlib.sha256(task.encode()).hexdigest()[:16]}-{run}"


def append_run(df: DataFrame, path: str, task: str, run: int) -> bool:
    """Add one run of a task to a log; False, and nothing changes, where the log has that run."""
    spark = df.sparkSession
    if get(spark, f"{path}/done", _run_file(task, run)) is not None:
        return False
    folder = uuid.uuid4().hex
    df.withColumns({"task": F.lit(task), "run": F.lit(run)}).write.parquet(f"{path}/runs/{folder}")
    return put(spark, f"{path}/done", _run_file(task, run), {"task": task, "run": run, "folder": folder}, replace=False)


def finished(spark: SparkSession, path: str) -> list[dict]:
    """(task, run, folder) of each run of the log."""
    try:
        rows = spark.read.schema("task string, run long, folder string").json(f"{path}/done").collect()  # a row for each run
    except Exception as e:
        if _absent(e):
            return []
        raise
    return sorted((r.asDict() for r in rows), key=lambda r: (r["task"], r["run"]))


def read_runs(spark: SparkSession, path: str, task: str | None = None) -> DataFrame | None:
    """The rows of all runs of the log, or of one task; None where there are none."""
    folders = [f"{path}/runs/{r['folder']}" for r in finished(spark, path) if task in (None, r["task"])]
    return spark.read.parquet(*folders) if folders else None


def runs_to_do(spark: SparkSession, path: str, expected: dict[str, int]) -> DataFrame:
    """(task, remaining): how many runs of each task are still to come."""
    done: dict[str, int] = {}
    for r in finished(spark, path):
        done[r["task"]] = done.get(r["task"], 0) + 1
    return spark.createDataFrame([(t, max(0, n - done.get(t, 0))) for t, n in expected.items()], "task string, remaining int")
