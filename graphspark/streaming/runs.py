"""Runs that arrive as streams: results of each run as soon as it is complete, in whatever order runs and answers come.

A run's state is the samples that it has answers for and its sums. It is
complete with its ``expected``-th distinct sample; then its row comes out and the
samples are forgotten. A run without an answer for ``patience`` of event time is
given up: its row says that it isn't complete. Answers of a sample that the run
has are repeats, and rows of a run that has ended are late; both are counted, and
late ones come out as rows of their own. State is by run, so a run is in one task
and runs are dealt over all; it lives in the checkpoint, and a restarted query
goes on where it stopped.

Windows of event time (sliding, and sessions with a pause) take late rows up to
a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RESULT = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("answers", T.LongType()),
    T.StructField("correct", T.LongType()), T.StructField("repeats", T.LongType()),
])
COMPLETE, GIVEN_UP, LATE = "complete", "given up", "late"


class _Runs(StatefulProcessor):
    def __init__(self, expected: int, patience_ms: int):
        self.expected, self.patience = expected, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", T.StructType([T.StructField(c, T.LongType()) for c in ("answers", "correct", "repeats", "ended")]))
        self.samples = handle.getMapState("samples", T.StructType([T.StructField("sample", T.StringType())]), T.StructType([T.StructField("seen", T.BooleanType())]))

    def _ended(self, outcome: str, key, answers: int, correct: int, repeats: int) -> pd.DataFrame:
        self.samples.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        self.sums.update((answers, correct, repeats, 1))
        return pd.DataFrame({"run": [key[0]], "outcome": [outcome], "answers": [answers], "correct": [correct], "repeats": [repeats]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        answers, correct, repeats, ended = self.sums.get() if self.sums.exists() else (0, 0, 0, 0)
        late = late_correct = 0
        last = 0
        for pdf in rows:
            for sample, right, at in zip(pdf["sample"], pdf["correct"], pdf["ms"]):
                last = max(last, int(at))
                if ended:
                    late, late_correct = late + 1, late_correct + int(bool(right))
                    continue
                if self.samples.containsKey((sample,)):
                    repeats += 1
                    continue
                self.samples.updateValue((sample,), (True,))
                answers, correct = answers + 1, correct + int(bool(right))
                if answers == self.expected:
                    ended = 1
                    yield self._ended(COMPLETE, key, answers, correct, repeats)
        if late:
            yield pd.DataFrame({"run": [key[0]], "outcome": [LATE], "answers": [late], "correct": [late_correct], "repeats": [0]})
        if not ended:
            self.sums.update((answers, correct, repeats, 0))
            due = last + self.patience
            timers = [t if isinstance(t, int) else t[0] for t in self.handle.listTimers()]
            if not timers or max(timers) < due:
                for t in timers:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        answers, correct, repeats, ended = self.sums.get() if self.sums.exists() else (0, 0, 0, 1)
        if not ended:
            yield self._ended(GIVEN_UP, key, answers, correct, repeats)

    def close(self) -> None:
        pass


def completed_runs(answers: DataFrame, expected: int, patience: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(run, outcome, answers, correct, repeats) of a stream (run, sample, correct, ts); for output mode ``update``.

    Needs the RocksDB provider of state stores. Null runs and samples are left out; a null ``correct`` counts as wrong.
    ``late``: how far behind the newest row a row may be.
    """
    rows = answers.where("run IS NOT NULL AND sample IS NOT NULL").withWatermark("ts", late)
    rows = rows.select(F.col("run").cast("string").alias("run"), F.col("sample").cast("string").alias("sample"), F.coalesce("correct", F.lit(False)).alias("correct"), F.unix_millis("ts").alias("ms"), "ts")
    patience_ms = int(pd.Timedelta(patience).total_seconds() * 1000)
    return rows.groupBy("run").transformWithStateInPandas(_Runs(expected, patience_ms), RESULT, "update", "eventTime")


def sliding(answers: DataFrame, width: str = "6 hours", slide: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, run, answers, correct): each answer in every window that holds it."""
    each = answers.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "run")
    return each.agg(F.count("*").alias("answers"), F.count_if("correct").alias("correct")).select(F.col("w.start").alias("start"), "run", "answers", "correct")


def sessions(answers: DataFrame, pause: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(start, end, run, answers, correct): answers of a run with no longer pause between them."""
    each = answers.withWatermark("ts", late).groupBy(F.session_window("ts", pause).alias("w"), "run")
    return each.agg(F.count("*").alias("answers"), F.count_if("correct").alias("correct")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "run", "answers", "correct")
