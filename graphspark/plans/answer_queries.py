"""Queries that score answers and compile metrics over sessions and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as a, resampling as r, statistics as s
from ..operators.quantiles import group_quantiles
from ..sources import files
from ..sources.views import ANSWER_SQL, EVENT_OPTION, answers
from .registry import query
from .session_queries import RATIOS_SQL

AN = f"WITH {ANSWER_SQL}"
MIN_SQL = "coalesce(has_ref_graph AND has_target_graph AND n_nodes_ref > n_prompt_ref_nodes + 2 AND n_nodes_target <> 0 AND n_nodes_matched_ref <= n_prompt_ref_nodes_matched + 2, false)"
STRICT_SQL = "(option_key IS NOT NULL AND (option_key = 'Fully Blocked' OR (query_type = 'CHANGE_LINK' AND option_key = 'Contra-indicated')))"
RELAXED_SQL = "(option_key IS NOT NULL AND (option_key IN ('Fully Blocked', 'Partially Blocked') OR (query_type = 'CHANGE_LINK' AND option_key = 'Contra-indicated')))"
NO_EFFECT_SQL = "(option_key IS NOT NULL AND option_key = 'No Effect')"


@query("minimal_matches", f"{AN} SELECT model, count(*) FILTER ({MIN_SQL}) AS minimal, count(*) FILTER ({MIN_SQL} AND n_nodes_matched_target = n_nodes_target) AS minimal_target FROM answer GROUP BY 1")
def _(spark, d):
    return answers(spark, d).groupBy("model").agg(F.count_if(a.minimal_match()).alias("minimal"), F.count_if(a.minimal_target()).alias("minimal_target"))


@query("answer_correctness", f"{AN} SELECT query_type, is_positive, count(*) AS n, count(*) FILTER (CASE WHEN is_positive THEN {STRICT_SQL} ELSE {NO_EFFECT_SQL} END) AS strict, count(*) FILTER (CASE WHEN is_positive THEN {RELAXED_SQL} ELSE {NO_EFFECT_SQL} END) AS relaxed, count(*) FILTER (CASE WHEN is_positive THEN {STRICT_SQL} ELSE NOT {NO_EFFECT_SQL} END) AS predicted, count(*) FILTER (CASE WHEN is_positive THEN has_target_graph ELSE option_key = 'No Effect' END) AS add_link FROM answer GROUP BY 1, 2")
def _(spark, d):
    o, q, p = F.col("option_key"), F.col("query_type"), F.col("is_positive")
    return answers(spark, d).groupBy("query_type", "is_positive").agg(
        F.count("*").alias("n"), F.count_if(a.edit_link_correct(o, q, p)).alias("strict"), F.count_if(a.edit_link_correct(o, q, p, relaxed=True)).alias("relaxed"),
        F.count_if(a.predicted_positive(o, q, p)).alias("predicted"), F.count_if(a.add_link_correct(~p, o == "No Effect", F.col("has_target_graph"))).alias("add_link"),
    )


@query("edit_link_metrics", f"{AN}, m AS (SELECT model, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM (SELECT model, is_positive AS y, CASE WHEN is_positive THEN {RELAXED_SQL} ELSE NOT {NO_EFFECT_SQL} END AS p FROM answer) GROUP BY 1) SELECT model, {RATIOS_SQL} FROM m")
def _(spark, d):
    return s.binary_metrics(answers(spark, d), F.col("is_positive"), a.predicted_positive(F.col("option_key"), F.col("query_type"), F.col("is_positive"), relaxed=True), "model")


OPTIONS = [*EVENT_OPTION.values(), "Never chosen"]


@query("option_report", f"{AN}, o(option_key) AS (VALUES {', '.join(f'({o!r})' for o in OPTIONS)}, (NULL)), g AS (SELECT DISTINCT model, query_type FROM answer), c AS (SELECT g.model, g.query_type, o.option_key, count(x.event_id) AS n FROM g CROSS JOIN o LEFT JOIN answer x ON x.model = g.model AND x.query_type = g.query_type AND x.option_key IS NOT DISTINCT FROM o.option_key GROUP BY 1, 2, 3) SELECT model, query_type, option_key, n, round(n / sum(n) OVER (PARTITION BY model, query_type), 6) AS share FROM c UNION ALL SELECT model, query_type, 'Totals', sum(n)::BIGINT, 1.0 FROM c GROUP BY 1, 2")
def _(spark, d):
    return a.option_report(answers(spark, d), OPTIONS, "model", "query_type")


Q_SQL = "round(avg(v), 6) AS mean, round(min(v), 6) AS least, round(max(v), 6) AS most, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS q2, round(quantile_cont(v, 0.75), 6) AS q3"


@query("option_scores", f"{AN} SELECT query_type, count(*) FILTER (option_key IS NULL) AS none, {Q_SQL} FROM (SELECT query_type, option_key, CASE WHEN option_key IS NOT NULL THEN match_score END AS v FROM answer) GROUP BY 1")
def _(spark, d):
    chosen = answers(spark, d).withColumn("v", F.when(F.col("option_key").isNotNull(), F.col("match_score")))
    return chosen.groupBy("query_type").agg(F.count_if(F.col("option_key").isNull()).alias("none"), *a.quartiles("v"))


@query("match_summary", f"{AN}, m AS (SELECT model, count(*) FILTER (has_ref_graph AND has_target_graph) AS tp, count(*) FILTER (NOT has_ref_graph AND has_target_graph) AS fp, count(*) FILTER (has_ref_graph AND NOT has_target_graph) AS fn, count(*) FILTER (NOT has_ref_graph AND NOT has_target_graph) AS tn, count(*) FILTER (has_ref_graph) AS n_true, count(*) FILTER (NOT has_ref_graph) AS n_false, count(*) FILTER ({MIN_SQL}) AS minimal, count(*) FILTER ({MIN_SQL} AND n_nodes_matched_target = n_nodes_target) AS minimal_target FROM answer GROUP BY 1) SELECT model, {RATIOS_SQL}, n_true, n_false, minimal, minimal_target, round((minimal - minimal_target) / n_true, 6) AS prop_very_different FROM m")
def _(spark, d):
    return a.match_summary(answers(spark, d), "model")


@query("true_positive_scores", f"{AN}, t AS (SELECT model, interior_node_match_score AS i, edge_match_score_reduced AS e, n_nodes_matched_ref::DOUBLE AS n FROM answer WHERE has_ref_graph AND has_target_graph), l AS (SELECT model, 'interior_node_match_score' AS metric, i AS v FROM t UNION ALL SELECT model, 'edge_match_score_reduced', e FROM t UNION ALL SELECT model, 'n_nodes_matched_ref', n FROM t) SELECT model, metric, {Q_SQL} FROM l GROUP BY 1, 2")
def _(spark, d):
    return a.true_positive_scores(answers(spark, d), ["interior_node_match_score", "edge_match_score_reduced", "n_nodes_matched_ref"], "model")


@query("negative_metrics", f"{AN}, m AS (SELECT session, count(*) FILTER (p) AS tp, 0::BIGINT AS fp, count(*) FILTER (NOT p) AS fn, 0::BIGINT AS tn FROM (SELECT session, coalesce(option_key = 'No Effect', false) AS p FROM answer WHERE NOT is_positive) GROUP BY 1) SELECT session, {RATIOS_SQL} FROM m")
def _(spark, d):
    return a.negative_metrics(answers(spark, d).where("NOT is_positive").withColumn("no_graph", F.col("option_key") == "No Effect"), "no_graph", "session")


ATTR = ["from_root", "from_sink", "min_distance", "total_distance", "source_type"]


@query("attribution", f"{AN}, r AS (SELECT *, CASE WHEN is_positive THEN {STRICT_SQL} ELSE {NO_EFFECT_SQL} END AS ok FROM answer), l AS (SELECT ok, 'from_root' AS key, from_root::VARCHAR AS value FROM r UNION ALL SELECT ok, 'from_sink', from_sink::VARCHAR FROM r UNION ALL SELECT ok, 'min_distance', least(from_root, from_sink)::VARCHAR FROM r UNION ALL SELECT ok, 'total_distance', (from_root + from_sink)::VARCHAR FROM r UNION ALL SELECT ok, 'source_type', source_type FROM r) SELECT key, value, count(*) FILTER (ok) AS correct, count(*) FILTER (NOT ok) AS incorrect FROM l GROUP BY 1, 2")
def _(spark, d):
    """Right and wrong answers of all sessions by distances of the link and by the source's type."""
    root, sink = F.col("from_root"), F.col("from_sink")
    keys = [root, sink, F.least(root, sink), root + sink, F.col("source_type")]
    out = a.attribution(answers(spark, d), a.edit_link_correct(F.col("option_key"), F.col("query_type"), F.col("is_positive")), keys)
    return out.withColumn("key", F.element_at(F.array(*map(F.lit, ATTR)), F.col("key").cast("int") + 1))


@query("link_distance_by_result", f"{AN} SELECT has_target_graph AS found, source_type, count(*) AS n, min(from_root) AS least, max(from_root) AS most, round(avg(from_root), 6) AS mean, round(quantile_cont(from_root, 0.5), 6) AS mid FROM answer WHERE is_positive GROUP BY 1, 2")
def _(spark, d):
    """True positives and false negatives by the source's type, with range, mean and median of the distance."""
    v = F.col("from_root")
    rows = answers(spark, d).where("is_positive").select(F.col("has_target_graph").alias("found"), "source_type", v)
    mids = group_quantiles(rows, ["found", "source_type"], v, {"mid": 0.5}).select(F.col("found").alias("f"), F.col("source_type").alias("s"), F.round("mid", 6).alias("mid"))
    each = rows.groupBy("found", "source_type").agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(v), 6).alias("mean"))
    return each.join(mids, each.found.eqNullSafe(mids.f) & each.source_type.eqNullSafe(mids.s), "left").drop("f", "s")


MAIN = ["n_true", "n_false", "recall", "tp", "fp", "fn", "tn", "accuracy", "accuracy_true", "accuracy_false", "prop_very_different", "edge_match_score_reduced:mean"]


@query("main_metrics", f"{AN}, m AS (SELECT model, count(*) FILTER (has_ref_graph AND has_target_graph) AS tp, count(*) FILTER (has_ref_graph AND NOT has_target_graph) AS fn, count(*) FILTER (has_ref_graph) AS n_true FROM answer GROUP BY 1) SELECT model, n_true::DOUBLE AS n_true, round(tp / (tp + fn), 6) AS recall, isnan('nan'::DOUBLE) AS absent FROM m")
def _(spark, d):
    m = a.main_metrics(a.match_summary(answers(spark, d), "model"), ["model"], MAIN)
    return m.select("model", "n_true", "recall", F.isnan("edge_match_score_reduced:mean").alias("absent"))


RUN_SQL = "run AS (SELECT model, session AS run, avg(has_target_graph::INT) AS accuracy, avg(edge_match_score_reduced) AS edge FROM answer GROUP BY 1, 2)"


def _runs(spark, d):
    return answers(spark, d).groupBy("model", F.col("session").alias("run")).agg(F.avg(F.col("has_target_graph").cast("int")).alias("accuracy"), F.avg("edge_match_score_reduced").alias("edge"))


@query("flattened_metrics", f"{AN}, {RUN_SQL}, l AS (SELECT model, run, 'binary/accuracy' AS metric, accuracy AS v FROM run UNION ALL SELECT model, run, 'edge', edge FROM run) SELECT model, metric, array_to_string(list(round(v, 5)::DECIMAL(12, 5)::VARCHAR ORDER BY run), ',') AS vals FROM l GROUP BY 1, 2")
def _(spark, d):
    f = a.flattened(_runs(spark, d).select("model", "run", F.struct("accuracy").alias("binary"), "edge"), ["model"])
    return f.select("model", "metric", F.array_join(F.transform("values", lambda v: F.round(v, 5).cast("decimal(12,5)").cast("string")), ",").alias("vals"))


M5 = [f"m{k}" for k in range(5)]


@query("compiled_runs", f"{AN}, {RUN_SQL}, l AS (SELECT model, 'accuracy' AS metric, accuracy AS v FROM run UNION ALL SELECT model, 'edge', edge FROM run), st AS (SELECT metric, model, 'mean' AS row, avg(v) AS v FROM l GROUP BY 1, 2 UNION ALL SELECT metric, model, 'sd', stddev_pop(v) FROM l GROUP BY 1, 2), w AS (SELECT metric, row, {', '.join(f'''round(max(v) FILTER (model = '{m}'), 6) AS {m}''' for m in M5)} FROM st GROUP BY 1, 2) SELECT *, least({', '.join(M5)}) AS low, greatest({', '.join(M5)}) AS high FROM w")
def _(spark, d):
    return a.compiled_runs(_runs(spark, d), "model", M5, ["accuracy", "edge"])


@query("session_files", f"{AN} SELECT 'edit' AS dataset, model, session AS run, count(*) AS n, count(*) FILTER (CASE WHEN is_positive THEN {STRICT_SQL} ELSE {NO_EFFECT_SQL} END) AS correct FROM answer GROUP BY 2, 3")
def _(spark, d):
    """Answers written as session files, one folder for each model and run, read back with what their paths say."""
    path = files.scratch_path(spark, "sessions")
    files.write_session_files(answers(spark, d).select("model", "session", "query_type", "option_key", "is_positive"), path, "edit", "model", "session")
    ok = a.edit_link_correct(F.col("option_key"), F.col("query_type"), F.col("is_positive"))
    read = files.read_session_files(spark, path, "query_type string, option_key string, is_positive boolean")
    return read.groupBy("dataset", "model", F.col("run").cast("long").alias("run")).agg(F.count("*").alias("n"), F.count_if(ok).alias("correct"))


@query("regression_csv", f"{AN} SELECT (CASE WHEN is_positive THEN {STRICT_SQL} ELSE {NO_EFFECT_SQL} END)::INT AS response_is_correct, from_root, from_sink, count(*) AS n FROM answer GROUP BY 1, 2, 3")
def _(spark, d):
    """The parameters of a regression, written as CSV with a header and read again with types."""
    path = files.scratch_path(spark, "regression")
    ok = a.edit_link_correct(F.col("option_key"), F.col("query_type"), F.col("is_positive")).cast("int").alias("response_is_correct")
    files.write_csv(answers(spark, d).select(ok, "from_root", "from_sink"), path)
    read = files.read_csv(spark, path, "response_is_correct int, from_root long, from_sink long")
    return read.groupBy("response_is_correct", "from_root", "from_sink").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------
# Intervals and tests


def _correct():
    return a.edit_link_correct(F.col("option_key"), F.col("query_type"), F.col("is_positive"))


CORRECT_SQL = f"(CASE WHEN is_positive THEN {STRICT_SQL} ELSE {NO_EFFECT_SQL} END)"
# (name, SQL of the filter): groups by kind of question, sample, source and distance
GROUPS = {
    "all": "true", "positive": "is_positive", "negative": "NOT is_positive", "delete": "query_type = 'DELETE_LINK'", "change": "query_type = 'CHANGE_LINK'",
    "delete positive": "query_type = 'DELETE_LINK' AND is_positive", "delete negative": "query_type = 'DELETE_LINK' AND NOT is_positive",
    "change positive": "query_type = 'CHANGE_LINK' AND is_positive", "change negative": "query_type = 'CHANGE_LINK' AND NOT is_positive",
    "drug": "source_type = 'Drug'", "protein": "source_type = 'Protein'", "family": "source_type = 'GeneFamily'", "drug positive": "source_type = 'Drug' AND is_positive",
    "protein positive": "source_type = 'Protein' AND is_positive", "near root": "from_root <= 1", "near sink": "from_sink <= 1", "far": "from_root > 1 AND from_sink > 1",
}
GROUP_SQL = f"WITH {ANSWER_SQL}, grps AS ({' UNION ALL '.join(f"SELECT '{n}' AS grp, model, session, {CORRECT_SQL} AS ok FROM answer WHERE {w}" for n, w in GROUPS.items())})"


@query("group_accuracy", f"""{GROUP_SQL} SELECT grp, round(sum(CASE WHEN session = 1 THEN 4 ELSE 1 END * ok::INT) / sum(CASE WHEN session = 1 THEN 4 ELSE 1 END), 6) AS value, sum(CASE WHEN session = 1 THEN 4 ELSE 1 END)::BIGINT AS n, true AS inside FROM grps GROUP BY 1""")
def _(spark, d):
    """Seventeen groups with intervals, resampled within sessions; rows of one session count four times."""
    g = s.group_intervals(answers(spark, d), _correct(), "session", {n: F.expr(w) for n, w in GROUPS.items()}, upsample={1: 4})
    return g.select(F.col("group").alias("grp"), F.round("value", 6).alias("value"), "n", ((F.col("low") <= F.col("value") + 1e-9) & (F.col("value") <= F.col("high") + 1e-9) & (F.col("stderr") >= 0)).alias("inside"))


@query("group_accuracy_by_model", f"""{GROUP_SQL}, p AS (SELECT grp, model, round(avg(ok::INT), 6) AS v FROM grps GROUP BY 1, 2) SELECT grp, {', '.join(f"max(v) FILTER (model = '{m}') AS {m}" for m in M5)} FROM p GROUP BY 1""")
def _(spark, d):
    """One table of the groups for each model, side by side."""
    g = s.group_intervals(answers(spark, d), _correct(), "session", {n: F.expr(w) for n, w in GROUPS.items()}, keys=["model"], replicates=199)
    return g.groupBy(F.col("group").alias("grp")).pivot("model", M5).agg(F.round(F.first("value"), 6))


BOOTSTRAP_SEED, REPLICATES = 17, 99
BOOTSTRAP_SQL = f"""{AN}, v AS (SELECT event_id, session AS stratum, match_score AS v FROM answer WHERE match_score IS NOT NULL),
  d AS (SELECT b, stratum, sum(w)::DOUBLE AS w, sum(w * v) AS t FROM (SELECT b, stratum, v, {r.weight_sql("event_id", "b", BOOTSTRAP_SEED)} AS w FROM v, range({REPLICATES}) x(b)) GROUP BY 1, 2),
  n AS (SELECT stratum, count(*)::DOUBLE AS n FROM v GROUP BY 1), p AS (SELECT b, sum(t) / sum(w) AS plain FROM d GROUP BY 1),
  s AS (SELECT b, sum(t * n / w) / sum(n) AS strata FROM d JOIN n USING (stratum) GROUP BY 1)"""


@query("pooled_bootstrap", f"{BOOTSTRAP_SQL} SELECT (SELECT round(avg(v), 6) FROM v) AS value, (SELECT count(*) FROM v) AS n, round(quantile_cont(plain, 0.05), 6) AS low, round(quantile_cont(plain, 0.95), 6) AS high, round(stddev_samp(plain), 6) AS stderr FROM p")
def _(spark, d):
    """A plain bootstrap of the mean score of all sessions together, with its limits."""
    b = r.bootstrap(answers(spark, d), [F.col("match_score")], F.col("event_id"), method="percentile", replicates=REPLICATES, seed=BOOTSTRAP_SEED)
    return b.select("n", *(F.round(c, 6).alias(c) for c in ("value", "low", "high", "stderr")))


@query("stratified_limits", f"{BOOTSTRAP_SQL} SELECT (SELECT round(avg(v), 6) FROM v) AS value, (SELECT count(*) FROM v) AS n, round(2 * (SELECT avg(v) FROM v) - quantile_cont(strata, 0.95), 6) AS low, round(2 * (SELECT avg(v) FROM v) - quantile_cont(strata, 0.05), 6) AS high, round(stddev_samp(strata), 6) AS stderr FROM s")
def _(spark, d):
    """The same resampled within sessions, with basic limits."""
    b = r.bootstrap(answers(spark, d), [F.col("match_score")], F.col("event_id"), F.col("session"), method="basic", replicates=REPLICATES, seed=BOOTSTRAP_SEED)
    return b.select("n", *(F.round(c, 6).alias(c) for c in ("value", "low", "high", "stderr")))


KINDS_SQL = f"""{AN}, ind AS (SELECT avg(match_score) FILTER (is_positive) - avg(match_score) FILTER (NOT is_positive) AS s FROM answer),
  m AS (SELECT row_number() OVER (ORDER BY model) - 1 AS i, avg(from_root) FILTER (is_positive) - avg(from_sink) FILTER (is_positive) AS gap, avg(from_root) AS a, avg(from_sink) AS b FROM answer GROUP BY model),
  z AS (SELECT i, gap, (a - avg(a) OVER ()) / coalesce(nullif(stddev_pop(a) OVER (), 0), 1) AS a, (b - avg(b) OVER ()) / coalesce(nullif(stddev_pop(b) OVER (), 0), 1) AS b FROM m),
  sam AS (SELECT k, avg(gap * (1 - 2 * ((k >> i) & 1))) AS s FROM z, range(32) t(k) GROUP BY k),
  perm AS (SELECT row_number() OVER () AS k, [a, b, c, d, e] AS p FROM range(5) x1(a), range(5) x2(b), range(5) x3(c), range(5) x4(d), range(5) x5(e) WHERE len(list_distinct([a, b, c, d, e])) = 5),
  pai AS (SELECT k, any_value(p) AS p, avg(x.a * y.b) AS s FROM perm JOIN z x ON true JOIN z y ON y.i = p[x.i + 1] GROUP BY k),
  seen AS (SELECT (SELECT s FROM sam WHERE k = 0) AS sam, (SELECT s FROM pai WHERE p = [0, 1, 2, 3, 4]) AS pai)
  SELECT 'independent' AS kind, round(s, 6) AS statistic, NULL::DOUBLE AS exact_p FROM ind
  UNION ALL SELECT 'samples', round(any_value(seen.sam), 6), round(avg((abs(s) >= abs(seen.sam) - 1e-9)::INT), 6) FROM sam, seen
  UNION ALL SELECT 'pairings', round(any_value(seen.pai), 6), round(avg((abs(s) >= abs(seen.pai) - 1e-9)::INT), 6) FROM pai, seen"""


@query("permutation_kinds", KINDS_SQL)
def _(spark, d):
    """Two groups, changed places within pairs, and new pairs; p where all permutations are looked at."""
    x = answers(spark, d)
    by_model = x.groupBy("model").agg(*(F.avg(F.when(F.col("is_positive"), F.col(c))).alias(f"{c}_p") for c in ("from_root", "from_sink")), F.avg("from_root").alias("a"), F.avg("from_sink").alias("b"))
    tests = {
        "independent": r.permutation(x, F.col("match_score"), F.col("is_positive"), replicates=199),
        "samples": r.permutation(by_model, F.col("from_root_p"), F.col("from_sink_p"), "samples"),
        "pairings": r.permutation(by_model, F.col("a"), F.col("b"), "pairings"),
    }
    rows = [t.select(F.lit(k).alias("kind"), F.round("statistic", 6).alias("statistic"), F.when(F.col("exact"), F.round("p", 6)).alias("exact_p")) for k, t in tests.items()]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


@query("permutation_draws")
def _(spark, d):
    """The p of drawn permutations: two groups' scores over all answers."""
    return r.permutation(answers(spark, d), F.col("match_score"), F.col("is_positive"), replicates=499)


@query("monte_carlo_mean", f"{AN} SELECT round(avg(match_score), 6) AS value FROM answer")
def _(spark, d):
    """The mean score against uniform ones."""
    return r.monte_carlo(answers(spark, d), F.col("match_score"), lambda rng, n: rng.random(n), replicates=99).where("p BETWEEN 0 AND 1").select(F.round("value", 6).alias("value"))


@query("run_statistics", f"{AN}, {RUN_SQL}, l AS (SELECT model, 'accuracy' AS metric, accuracy AS v FROM run UNION ALL SELECT model, 'edge', edge FROM run) SELECT model, metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(min(v), 6) AS low, round(max(v), 6) AS high, count(*) AS runs FROM l GROUP BY 1, 2")
def _(spark, d):
    """Metrics of several runs of a task."""
    return s.run_statistics(_runs(spark, d), ["model"], ["accuracy", "edge"])


@query("accumulated_metrics", f"{AN} SELECT model, query_type, sum(n_nodes_ref)::BIGINT AS nodes, round(max(match_score), 6) AS best FROM answer GROUP BY 1, 2")
def _(spark, d):
    return s.accumulated(answers(spark, d), ["model", "query_type"], {"nodes": F.sum("n_nodes_ref"), "best": F.round(F.max("match_score"), 6)})


@query("counts_table", f"{AN}, c AS (SELECT option_key, count(*) AS n FROM answer GROUP BY 1), r AS (SELECT option_key, n, round(100.0 * n / sum(n) OVER (), 6) AS pct, sum(n) OVER w::BIGINT AS running, round(100.0 * sum(n) OVER w / sum(n) OVER (), 6) AS running_pct FROM c WINDOW w AS (ORDER BY n DESC, option_key NULLS FIRST ROWS UNBOUNDED PRECEDING)) SELECT * FROM r UNION ALL SELECT 'SUM', sum(n)::BIGINT, 100.0, NULL, NULL FROM c")
def _(spark, d):
    """Counts with shares, running totals and their sum, as reports show them."""
    return files.counts_table(answers(spark, d).groupBy("option_key").agg(F.count("*").alias("n")), "n", running=True)
