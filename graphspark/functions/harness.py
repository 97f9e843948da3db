"""Model calls that resume, and runs of a task over a log: ask what is missing, score, append once, compile.

Answers are kept by the hash of their prompt in a log of chunks. A chunk is
written as soon as it is asked, so after a crash (or where some calls failed)
only prompts without an answer are asked again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..operators.entities import _written
from ..operators.statistics import run_statistics
from ..sources import versions
from .models import ask, echo_client


@dataclass
class Asked:
    """rows: the table with its answers; prompts: how many distinct prompts were asked now; failed: how many of them have no answer."""

    rows: DataFrame
    prompts: int
    failed: int


def _answers(spark, store: str) -> DataFrame:
    """(key, answer, error) of the store: an answer where there is one, else the last error."""
    found = versions.read_runs(spark, store, "answers")
    if found is None:
        return spark.createDataFrame([], "key string, answer string, error string")
    return found.groupBy("key").agg(F.max("answer").alias("answer"), F.max_by("error", "run").alias("error"))


def ask_once(df: DataFrame, prompt: str, store: str, client: Callable[[], Callable[[str], str]] = echo_client, out: str = "answer", chunk: int = 100_000, **options) -> Asked:
    """Add answers and ``<out>_error``, each distinct prompt asked once, whoever asked it before.

    Null prompts have a null answer. An error counts as not asked: the next call tries it again.
    """
    spark = df.sparkSession
    prompts = df.select(F.col(prompt).alias("prompt")).where("prompt IS NOT NULL").distinct().withColumn("key", F.sha2("prompt", 256))
    known = _answers(spark, store).where("answer IS NOT NULL").select("key")
    missing = _written(prompts.join(known, "key", "left_anti"), "prompts")
    n, asked, failed = missing.count(), 0, 0
    first = 1 + max((r["run"] for r in versions.finished(spark, store)), default=-1)
    parts = -(-n // chunk)
    for k in range(parts):
        seen = Observation()
        own = missing.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k)
        answered = ask(own, "prompt", client, out="answer", **options).select("key", "answer", F.col("answer_error").alias("error"))
        answered = answered.observe(seen, F.count("*").alias("asked"), F.count_if(F.col("answer").isNull()).alias("failed"))
        versions.append_run(answered, store, "answers", first + k)
        asked, failed = asked + seen.get["asked"], failed + seen.get["failed"]
    found = _answers(spark, store).select("key", F.col("answer").alias(out), F.when(F.col("answer").isNull(), F.col("error")).alias(f"{out}_error"))
    keyed = df.drop(out, f"{out}_error").withColumn("_key", F.sha2(F.col(prompt), 256))
    return Asked(keyed.join(found, keyed["_key"] == found["key"], "left").drop("_key", "key"), asked, failed)


def run_task(samples: DataFrame, log: str, task: str, runs: int, prompt: str, score: Callable[[DataFrame], DataFrame], client: Callable[[], Callable[[str], str]] = echo_client, **options) -> list[int]:
    """Do what is left of ``runs`` runs of a task: ask (each run its own answers), score, and append the run to the log once.

    Gives the runs that were done now. A run that broke off goes on with the answers that it has; one with failed calls
    isn't appended, so that it is tried again.
    """
    spark, now = samples.sparkSession, []
    done = {r["run"] for r in versions.finished(spark, log) if r["task"] == task}
    for run in range(runs):
        if run in done:
            continue
        asked = ask_once(samples, prompt, f"{log}/answers/{versions._run_file(task, run)}", client, **options)
        if not asked.failed and versions.append_run(score(asked.rows), log, task, run):
            now.append(run)
    return now


def compiled(spark, log: str, keys: list[str], metrics: dict[str, Column]) -> DataFrame | None:
    """(task, keys, metric, mean, sd, low, high, runs) over the log's runs: ``metrics`` are aggregates of a run's rows."""
    rows = versions.read_runs(spark, log)
    if rows is None:
        return None
    each = rows.groupBy("task", "run", *keys).agg(*(m.alias(n) for n, m in metrics.items()))
    return run_statistics(each.drop("run"), ["task", *keys], list(metrics))
