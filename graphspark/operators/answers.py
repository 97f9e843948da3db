"""Scoring of a model's answers: which are correct, summaries over sessions, and metrics by run.

Rows are scored answers; null flags count as false, null scores are left out of means
and quartiles; an empty table gives empty summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .statistics import binary_metrics, ratio

# The options that count as right, by the kind of question.
POSITIVE_STRICT = {"DELETE_LINK": ["Fully Blocked"], "CHANGE_LINK": ["Contra-indicated", "Fully Blocked"]}
POSITIVE_RELAXED = {"DELETE_LINK": ["Fully Blocked", "Partially Blocked"], "CHANGE_LINK": ["Contra-indicated", "Fully Blocked", "Partially Blocked"]}
NEGATIVE = {"DELETE_LINK": ["No Effect"], "CHANGE_LINK": ["No Effect"]}


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _among(option: Column, query_type: Column, options: dict[str, list[str]]) -> Column:
    out = F.lit(False)
    for kind, names in options.items():
        out = out | ((query_type == kind) & option.isin(names))
    return _flag(out)


def minimal_match() -> Column:
    """The answer's graph could have matched more than the prompt's nodes and the end points, and did not."""
    n = F.col
    more = (n("n_nodes_ref") > n("n_prompt_ref_nodes") + 2) & (n("n_nodes_target") != 0)
    return _flag(n("has_ref_graph") & n("has_target_graph") & more & (n("n_nodes_matched_ref") <= n("n_prompt_ref_nodes_matched") + 2))


def minimal_target() -> Column:
    """A minimal match all of whose nodes are matched."""
    return minimal_match() & _flag(F.col("n_nodes_matched_target") == F.col("n_nodes_target"))


def add_link_correct(is_negative: Column, no_graph_found: Column, has_target_graph: Column) -> Column:
    return F.when(is_negative, _flag(no_graph_found)).otherwise(_flag(has_target_graph))


def predicted_positive(option: Column, query_type: Column, is_positive: Column, relaxed: bool = False) -> Column:
    """Whether an answer counts as "positive": an expected option, or for a negative sample any but the expected ones (null too)."""
    return F.when(is_positive, _among(option, query_type, POSITIVE_RELAXED if relaxed else POSITIVE_STRICT)).otherwise(~_among(option, query_type, NEGATIVE))


def edit_link_correct(option: Column, query_type: Column, is_positive: Column, relaxed: bool = False) -> Column:
    return predicted_positive(option, query_type, is_positive, relaxed) == is_positive


def quartiles(c: str, digits: int = 6) -> list[Column]:
    """mean, least, most, q1, q2, q3 of a column, NaN and null left out."""
    v = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [F.round(f, digits).alias(n) for n, f in (("mean", F.avg(v)), ("least", F.min(v)), ("most", F.max(v)))] + [F.round(F.get(q, k), digits).alias(f"q{k + 1}") for k in range(3)]


def match_summary(df: DataFrame, *keys: str) -> DataFrame:
    """Binary metrics of graphs found, with the counts and shares of minimal matches among true ones."""
    binary = binary_metrics(df, _flag(F.col("has_ref_graph")), _flag(F.col("has_target_graph")), *keys)
    counts = df.groupBy(*keys).agg(
        F.count_if("has_ref_graph").alias("n_true"), F.count_if(~_flag(F.col("has_ref_graph"))).alias("n_false"),
        F.count_if(minimal_match()).alias("minimal"), F.count_if(minimal_target()).alias("minimal_target"),
    )
    joined = binary.join(counts, list(keys)) if keys else binary.crossJoin(counts)  # one row each
    return joined.withColumn("prop_very_different", F.when(F.col("n_true") > 0, F.round((F.col("minimal") - F.col("minimal_target")) / F.col("n_true"), 6)))


def true_positive_scores(df: DataFrame, scores: list[str], *keys: str) -> DataFrame:
    """(keys, metric, mean, least, most, q1, q2, q3) over true positives."""
    tp = df.where(_flag(F.col("has_ref_graph")) & _flag(F.col("has_target_graph")))
    long = tp.select(*keys, *(F.col(s).cast("double").alias(s) for s in scores)).unpivot(list(keys) or [], scores, "metric", "v")
    return long.groupBy(*keys, "metric").agg(*quartiles("v"))


def option_report(df: DataFrame, options: list[str], *keys: str) -> DataFrame:
    """(keys, option_key, n, share): every option, null for none found, and "Totals"; options that nobody chose count 0."""
    spark = df.sparkSession
    every = spark.createDataFrame([(o,) for o in (*options, None)], "option_key string")
    groups = df.select(*keys).distinct() if keys else spark.range(1).select()
    n = df.groupBy(*keys, "option_key").agg(F.count("*").alias("n"))
    frame = groups.crossJoin(F.broadcast(every))  # a handful of options for each group
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "option_key")]
    on = same[0]
    for s in same[1:]:
        on = on & s
    counted = frame.alias("a").join(n.alias("b"), on, "left").select(*(F.col(f"a.{k}").alias(k) for k in (*keys, "option_key")), F.coalesce("b.n", F.lit(0)).alias("n"))
    total = counted.groupBy(*keys).agg(F.sum("n").alias("all"))
    with_total = counted.join(total, list(keys)) if keys else counted.crossJoin(total)
    rows = with_total.select(*keys, "option_key", "n", ratio(F.col("n"), F.col("all")).alias("share"))
    return rows.unionByName(total.select(*keys, F.lit("Totals").alias("option_key"), F.col("all").alias("n"), F.lit(1.0).alias("share")))


def negative_metrics(df: DataFrame, no_graph_found: str, *keys: str) -> DataFrame:
    """Binary metrics of negative samples: all are true, an answer is right where no graph was found."""
    return binary_metrics(df, F.lit(True), _flag(F.col(no_graph_found)), *keys)


def attribution(df: DataFrame, correct: Column, keys: list[Column]) -> DataFrame:
    """(key, value, correct, incorrect): counters of right and wrong answers by each key; rows of several sessions merge by themselves."""
    pairs = F.inline(F.array(*(F.struct(F.lit(str(n)).alias("key"), k.cast("string").alias("value")) for n, k in enumerate(keys))))
    return df.select(correct.alias("_right"), pairs).groupBy("key", "value").agg(F.count_if("_right").alias("correct"), F.count_if(~_flag(F.col("_right"))).alias("incorrect"))


def main_metrics(metrics: DataFrame, keys: list[str], wanted: list[str]) -> DataFrame:
    """The wanted metrics of each row, NaN for those that are absent or null."""
    have = set(metrics.columns)
    nan = F.lit(float("nan"))
    return metrics.select(*keys, *((F.coalesce(F.col(w).cast("double"), nan) if w in have else nan).alias(w) for w in wanted))


def flattened(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, values): nested structs as "a/b", the values of several runs as a list in the order of ``run``."""
    columns = []
    for f in metrics.schema.fields:
        if f.name in (*keys, "run"):
            continue
        if hasattr(f.dataType, "fields"):
            columns += [(f"{f.name}/{g.name}", F.col(f"{f.name}.{g.name}")) for g in f.dataType.fields]
        else:
            columns.append((f.name, F.col(f.name)))
    each = F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), c.cast("double").alias("v")) for n, c in columns)))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("run", "v"))), lambda x: x["v"])
    return metrics.select(*keys, "run", each).groupBy(*keys, "metric").agg(listed.alias("values"))


def compiled_runs(runs: DataFrame, model: str, models: list[str], metrics: list[str]) -> DataFrame:
    """(metric, row, a column for each model, low, high): mean and s.d. of each metric over runs, and the range of the models' values."""
    long = runs.unpivot([model], metrics, "metric", "v")
    v = F.nanvl("v", F.lit(None).cast("double"))
    stats = long.groupBy("metric", model).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))
    rows = stats.unpivot(["metric", model], ["mean", "sd"], "row", "v")
    wide = rows.groupBy("metric", "row").pivot(model, models).agg(F.round(F.first("v"), 6))
    return wide.withColumns({"low": F.least(*models), "high": F.greatest(*models)})
