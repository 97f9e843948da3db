"""Queries of evaluation sessions and statistics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import knowledge as kg, statistics as s
from ..operators.quantiles import group_quantiles
from ..sources.views import SESSION_SQL, sessions, table
from .registry import query

SE = f"WITH {SESSION_SQL}"
METRICS_SQL = """count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn"""
RATIOS_SQL = """tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, CASE WHEN tp + fn = 0 THEN 0 ELSE round(tp / (tp + fn), 6) END AS accuracy_true,
 CASE WHEN tn + fp = 0 THEN 0 ELSE round(tn / (tn + fp), 6) END AS accuracy_false, CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp), 6) END AS "precision",
 CASE WHEN tp + fn = 0 THEN 0 ELSE round(tp / (tp + fn), 6) END AS recall, CASE WHEN tp = 0 THEN 0 ELSE round(2 * tp / (2 * tp + fp + fn), 6) END AS f1"""


@query("binary_metrics", f"WITH m AS (SELECT {METRICS_SQL} FROM (SELECT quality = 1 AS y, toxic = 0 AS p FROM labels)) SELECT {RATIOS_SQL} FROM m")
def _(spark, d):
    return s.binary_metrics(table(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 0)


@query("binary_metrics_by_model", f"{SE}, m AS (SELECT model, {METRICS_SQL} FROM (SELECT model, is_positive AS y, predicted AS p FROM session) GROUP BY 1) SELECT model, {RATIOS_SQL} FROM m")
def _(spark, d):
    return s.binary_metrics(sessions(spark, d), F.col("is_positive"), F.col("predicted"), "model")


@query("option_counts", f"{SE} SELECT model, option, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY model), 6) AS pct, round(quantile_cont(score, 0.5), 6) AS mid FROM session GROUP BY 1, 2")
def _(spark, d):
    rows = sessions(spark, d).select("model", "option", "score")
    mids = group_quantiles(rows, ["model", "option"], F.col("score"), {"mid": 0.5}).select(F.col("model").alias("m"), F.col("option").alias("o"), F.round("mid", 6).alias("mid"))
    c = rows.groupBy("model", "option").agg(F.count("*").alias("n"))
    c = c.join(mids, c.model.eqNullSafe(mids.m) & c.option.eqNullSafe(mids.o), "left").drop("m", "o")
    return c.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("model")), 6))


@query("contrast_table", f"{SE} SELECT coalesce(option, 'TOTAL') AS option, count(*) FILTER (correct) AS right_n, count(*) FILTER (NOT correct) AS wrong_n, round(avg(correct::INT), 6) AS share FROM session GROUP BY ROLLUP (option)")
def _(spark, d):
    c = sessions(spark, d).rollup("option").agg(F.count_if("correct").alias("right_n"), F.count_if(~F.col("correct")).alias("wrong_n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("share"))
    return c.withColumn("option", F.coalesce("option", F.lit("TOTAL")))


@query("metrics_pivot", f"{SE} SELECT option, {', '.join(f'''round(avg(correct::INT) FILTER (model = 'm{k}'), 6) AS m{k}''' for k in range(5))} FROM session GROUP BY 1")
def _(spark, d):
    return sessions(spark, d).groupBy("option").pivot("model", [f"m{k}" for k in range(5)]).agg(F.round(F.avg(F.col("correct").cast("int")), 6))


@query("multirun_stats", f"{SE}, r AS (SELECT model, run, avg(correct::INT) AS a FROM session GROUP BY 1, 2) SELECT model, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS sd, round(min(a), 6) AS lo, round(max(a), 6) AS hi, count(*) AS runs FROM r GROUP BY 1")
def _(spark, d):
    r = sessions(spark, d).groupBy("model", "run").agg(F.avg(F.col("correct").cast("int")).alias("a"))
    a = F.nanvl("a", F.lit(None).cast("double"))
    return r.groupBy("model").agg(F.round(F.avg(a), 6).alias("mean"), F.round(F.stddev_pop(a), 6).alias("sd"), F.round(F.min(a), 6).alias("lo"), F.round(F.max(a), 6).alias("hi"), F.count("*").alias("runs"))


@query("multirun_compiled", f"{SE}, r AS (SELECT model, run, avg(correct::INT) AS accuracy, avg(score) AS score FROM session GROUP BY 1, 2), l AS (UNPIVOT r ON accuracy, score INTO NAME metric VALUE v) SELECT metric, {', '.join(f'''round(avg(v) FILTER (model = 'm{k}'), 5) AS m{k}''' for k in range(5))} FROM l GROUP BY 1")
def _(spark, d):
    r = sessions(spark, d).groupBy("model", "run").agg(F.avg(F.col("correct").cast("int")).alias("accuracy"), F.avg("score").alias("score"))
    long = r.unpivot(["model", "run"], ["accuracy", "score"], "metric", "v")
    return long.groupBy("metric").pivot("model", [f"m{k}" for k in range(5)]).agg(F.round(F.avg("v"), 5))


@query("quartiles", f"{SE} SELECT option, round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.5), 6) AS q2, round(quantile_cont(score, 0.75), 6) AS q3, round(avg(score), 6) AS mean FROM session WHERE correct GROUP BY 1")
def _(spark, d):
    rows = sessions(spark, d).where("correct").select("option", "score")
    q = group_quantiles(rows, ["option"], F.col("score"), {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    mean = rows.groupBy(F.col("option").alias("o")).agg(F.round(F.avg("score"), 6).alias("mean"))
    return mean.join(q, F.col("o").eqNullSafe(F.col("option")), "left").select(F.col("o").alias("option"), *(F.round(f"q{k}", 6).alias(f"q{k}") for k in (1, 2, 3)), "mean")


@query("dataset_stats", f"{SE}, f AS (SELECT run, bool_and(option IN ('click', 'view', 'purchase')) AS surface, count(*) AS n, count(*) FILTER (is_positive) AS pos FROM session GROUP BY 1) SELECT * FROM f")
def _(spark, d):
    return sessions(spark, d).groupBy("run").agg(F.bool_and(F.col("option").isin("click", "view", "purchase")).alias("surface"), F.count("*").alias("n"), F.count_if("is_positive").alias("pos"))


@query("dataset_summary", f"{SE} SELECT option, count(*) FILTER (is_positive) AS positive, count(*) FILTER (NOT is_positive) AS negative FROM session GROUP BY 1")
def _(spark, d):
    return sessions(spark, d).groupBy("option").pivot("is_positive", [True, False]).agg(F.count(F.lit(1))).withColumnsRenamed({"true": "positive", "false": "negative"}).fillna(0)


@query("session_summary", f"{SE} SELECT model, count(*) AS n, count(DISTINCT k) AS samples, count(DISTINCT user_id) AS drugs, count(DISTINCT (user_id, option)) AS pairs FROM session GROUP BY 1")
def _(spark, d):
    return sessions(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.count_distinct("k").alias("samples"), F.count_distinct("user_id").alias("drugs"), F.count_distinct("user_id", "option").alias("pairs"))


@query("session_compare", f"{SE} SELECT option, {', '.join(f"count(*) FILTER (model = 'm{k}') AS m{k}" for k in range(5))} FROM session GROUP BY 1")
def _(spark, d):
    models = [f"m{k}" for k in range(5)]
    return sessions(spark, d).groupBy("option").pivot("model", models).agg(F.count(F.lit(1))).fillna(0)


@query("session_positional_zip", f"{SE}, p AS (SELECT model, option, row_number() OVER (PARTITION BY model ORDER BY event_id) AS pos FROM session WHERE model IN ('m0', 'm1')) SELECT a.option AS option_0, b.option AS option_1, count(*) AS n FROM p a JOIN p b ON a.pos = b.pos AND a.model = 'm0' AND b.model = 'm1' GROUP BY 1, 2")
def _(spark, d):
    p = kg.numbered(sessions(spark, d).where(F.col("model").isin("m0", "m1")).select("model", "option", "event_id"), "model", ["event_id"], "pos")
    a, b = (p.where(F.col("model") == k).select("pos", F.col("option").alias(f"option_{k[1]}")) for k in ("m0", "m1"))
    return a.join(b, "pos").groupBy("option_0", "option_1").agg(F.count("*").alias("n"))


@query("remaining_runs", f"{SE}, done AS (SELECT model, count(DISTINCT run) AS n FROM session GROUP BY 1) SELECT model, n AS done, greatest(9 - n, 0) AS remaining FROM done")
def _(spark, d):
    done = sessions(spark, d).groupBy("model").agg(F.count_distinct("run").alias("done"))
    return done.select("model", "done", F.greatest(9 - F.col("done"), F.lit(0)).alias("remaining"))


@query("deterministic_sample", "SELECT o_orderkey FROM orders ORDER BY (o_orderkey * 2654435761) % 4294967296, o_orderkey LIMIT 100")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey").orderBy(F.col("o_orderkey") * 2654435761 % 4294967296, "o_orderkey").limit(100)


@query("bounded_rejection", "WITH c AS (SELECT l_orderkey, l_linenumber, l_discount > 0.05 AS rejected, count(*) FILTER (l_discount > 0.05) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rejects FROM lineitem) SELECT l_orderkey, l_linenumber FROM c WHERE NOT rejected AND rejects < 2")
def _(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(Window.unboundedPreceding, 0)  # equal line numbers count together
    c = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") > 0.05).alias("rejected"))
    return c.withColumn("rejects", F.sum(F.col("rejected").cast("int")).over(w)).where("NOT rejected AND rejects < 2").select("l_orderkey", "l_linenumber")


@query("bootstrap_ci")
def _(spark, d):
    return s.stratified_bootstrap(sessions(spark, d), F.col("correct"), "option")


@query("permutation_pvalue")
def _(spark, d):
    return s.permutation_test(sessions(spark, d), F.col("correct"), F.col("model") == "m0")


@query("monte_carlo_pvalue")
def _(spark, d):
    return s.monte_carlo_test(sessions(spark, d), F.col("correct"), 0.5)


@query("logreg_depth")
def _(spark, d):
    e = sessions(spark, d).select(F.col("event_id").alias("key"), (F.col("k") % 5).alias("root_distance"), (F.col("user_id") % 4).alias("sink_distance"), F.col("correct").cast("int").alias("y"))
    return s.logistic_depth(e, ["root_distance", "sink_distance"], "y")
