"""Pass/fail comparison, frontier and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delta, explore, frontier, scoring, twins
from .corpus import FEATURES, KNOBS, RUNS_SQL, runs, table
from .registry import query
from .stats_queries import FAIL, WITH_RUNS

NUMS = ["nation", "month", "year", "balance"]


def _num_delta(f: str) -> str:
    return f"""SELECT test_name AS sequence, '{f}' AS field, 'numeric' AS kind, NULL AS value,
    round(avg({f}) FILTER (WHERE {FAIL}), 4) AS fail_value, round(avg({f}) FILTER (WHERE NOT {FAIL}), 4) AS pass_value,
    round(avg({f}) FILTER (WHERE {FAIL}) - avg({f}) FILTER (WHERE NOT {FAIL}), 4) AS delta,
    round((avg({f}) FILTER (WHERE {FAIL}) - avg({f}) FILTER (WHERE NOT {FAIL})) / stddev_samp({f}), 4) AS effect_size
    FROM runs GROUP BY 1"""


DELTA_SQL = f"""WITH {RUNS_SQL},
side AS (SELECT test_name AS sequence, count(*) FILTER (WHERE {FAIL}) AS n_fail, count(*) FILTER (WHERE NOT {FAIL}) AS n_pass FROM runs GROUP BY 1),
sh AS (SELECT test_name AS sequence, priority AS v, count(*) FILTER (WHERE {FAIL}) / max(n_fail) AS fs, count(*) FILTER (WHERE NOT {FAIL}) / max(n_pass) AS ps
  FROM runs JOIN side ON test_name = sequence GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY abs(fs - ps) DESC, v) AS k FROM sh),
d AS ({' UNION ALL '.join(_num_delta(f) for f in NUMS)} UNION ALL
  SELECT sequence, 'priority', 'categorical', v, round(fs, 4), round(ps, 4), round(fs - ps, 4), round(fs - ps, 4) FROM best WHERE k = 1)
SELECT d.*, n_fail, n_pass, round(n_fail / (n_fail + n_pass), 4) AS fail_rate FROM d JOIN side USING (sequence)
WHERE n_fail >= 5 AND n_pass >= 5"""


@query("a10_pass_fail_delta", DELTA_SQL)
def pass_fail_delta(spark, sf):
    return delta.aggregate_delta(runs(spark, sf), FEATURES)


SAMPLE_SQL = f"""fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test_name ORDER BY md5('42:' || run_id), run_id) AS k
  FROM runs WHERE {FAIL}) WHERE k <= 200)"""


@query("w09_failing_sample", f"WITH {RUNS_SQL}, {SAMPLE_SQL} SELECT test_name AS sequence, run_id FROM fs")
def failing_sample(spark, sf):
    base = runs(spark, sf).withColumn("sequence", F.col("test_name"))
    return twins.sample_failing(base, 200, 42).select("sequence", "run_id")


_DIST = " + ".join(f"pow((f.{c} - p.{c}) / sd_{c}, 2)" for c in NUMS) + " + 2 * CAST(f.priority <> p.priority AS INT)"
_TWIN_CTE = f"""{RUNS_SQL}, fs AS (SELECT * FROM runs WHERE {FAIL}),
sd AS (SELECT test_name, {', '.join(f'stddev_pop({c}) AS sd_{c}' for c in NUMS)} FROM runs GROUP BY 1),
tol AS (SELECT {', '.join(f'0.5 * stddev_samp({c}) AS t_{c}' for c in NUMS)} FROM runs),
pr AS (SELECT f.test_name AS sequence, f.run_id AS failing_run, p.run_id AS passing_run, sqrt({_DIST}) AS distance,
  f.primary_error_tag AS error_tag, {', '.join(f'f.{c} AS f_{c}, p.{c} AS p_{c}' for c in [*NUMS, 'priority'])}
  FROM fs f JOIN sd USING (test_name) JOIN runs p ON p.test_name = f.test_name AND p.pass_fail = 'pass'),
tw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY failing_run ORDER BY distance, passing_run) AS k FROM pr) WHERE k = 1),
df AS (SELECT tw.*, {', '.join(f'CAST(abs(f_{c} - p_{c}) > t_{c} AS INT) AS d_{c}' for c in NUMS)}, CAST(f_priority <> p_priority AS INT) AS d_priority FROM tw, tol)"""
_ND = " + ".join(f"d_{c}" for c in [*NUMS, "priority"])


@query(
    "j04_nearest_twins",
    f"WITH {_TWIN_CTE} SELECT sequence, failing_run, passing_run, round(distance, 4) AS distance, CAST({_ND} AS INTEGER) AS n_differences FROM df",
)
def nearest_twins(spark, sf):
    base = runs(spark, sf)
    pairs, num, cat = twins.nearest_twins(base, FEATURES)
    diffs = twins.twin_differences(base, pairs, num, cat)
    return diffs.select("sequence", "failing_run", "passing_run", F.round("distance", 4).alias("distance"), "n_differences")


@query(
    "a11_twin_field_ranking",
    f"WITH {_TWIN_CTE} " + " UNION ALL ".join(
        f"SELECT '{c}' AS field, CAST(sum(d_{c}) AS BIGINT) AS diff_count, count(*) AS total_pairs, round(sum(d_{c}) / count(*), 4) AS diff_rate FROM df"
        for c in [*NUMS, "priority"]
    ),
)
def twin_field_ranking(spark, sf):
    base = runs(spark, sf)
    pairs, num, cat = twins.nearest_twins(base, FEATURES)
    return twins.field_ranking(twins.twin_differences(base, pairs, num, cat), FEATURES)


@query(
    "w10_example_pairs",
    f"""WITH {_TWIN_CTE} SELECT sequence, failing_run, passing_run, round(distance, 4) AS distance, CAST({_ND} AS INTEGER) AS n_differences
    FROM df WHERE {_ND} > 0 ORDER BY {_ND}, round(distance, 4), failing_run LIMIT 40""",
)
def example_pairs(spark, sf):
    base = runs(spark, sf)
    pairs, num, cat = twins.nearest_twins(base, FEATURES)
    shown = twins.example_pairs(twins.twin_differences(base, pairs, num, cat))
    return shown.select("sequence", "failing_run", "passing_run", "distance", "n_differences")


GROUPING = ["test_name", "priority", "month", "year"]
CONFIG_SQL = f"""{RUNS_SQL},
cfg AS (SELECT concat_ws('|', test_name, priority, month, year) AS signature, avg(throughput_mbps) AS throughput, avg(risk) AS risk,
  avg(execution_time_ms) AS exec_ms, avg(CAST({FAIL} AS DOUBLE)) AS observed, count(*) AS n_runs FROM runs
  GROUP BY test_name, priority, month, year HAVING count(*) >= 3),
swept AS (SELECT *, coalesce(risk < min(risk) OVER (ORDER BY throughput DESC, risk, signature ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_pareto FROM cfg),
pts AS (SELECT signature, round(throughput, 6) AS throughput_mbps, round(risk, 6) AS predicted_risk, round(observed, 6) AS observed_fail_rate,
  round(exec_ms, 6) AS execution_time_ms, n_runs, is_pareto FROM swept)"""


def _points(spark, sf):
    base = runs(spark, sf)
    grouping = frontier.group_features(base, FEATURES)
    return frontier.report_points(frontier.mark_frontier(frontier.configurations(base, grouping)), digits=6, rate_digits=6).drop("config")


@query("a12_w01_frontier", f"WITH {CONFIG_SQL} SELECT * FROM pts")
def frontier_points(spark, sf):
    return _points(spark, sf)


@query(
    "j06_representative_config",
    f"""WITH {CONFIG_SQL} SELECT p.signature, string_split(p.signature, '|')[1] AS test_name, string_split(p.signature, '|')[2] AS priority,
    CAST(string_split(p.signature, '|')[3] AS INTEGER) AS month, CAST(string_split(p.signature, '|')[4] AS INTEGER) AS year,
    r.run_id AS first_run, r.nation AS first_nation, r.balance AS first_balance FROM pts p JOIN (SELECT *, row_number() OVER (
      PARTITION BY test_name, priority, month, year ORDER BY run_id) AS k FROM runs) r
    ON k = 1 AND p.signature = concat_ws('|', r.test_name, r.priority, r.month, r.year) WHERE is_pareto""",
)
def representative_config(spark, sf):
    base = runs(spark, sf)
    grouping = frontier.group_features(base, FEATURES)
    marked = frontier.mark_frontier(frontier.configurations(base, grouping))
    first = F.col("representative")
    return marked.where("is_pareto").select(
        "signature", "config.*", first["run_id"].alias("first_run"), first["nation"].alias("first_nation"), first["balance"].alias("first_balance"))


KNEE_SQL = """e AS (SELECT count(*) AS n, min(predicted_risk) AS r0, max(predicted_risk) AS r1, min(throughput_mbps) AS t0, max(throughput_mbps) AS t1,
  arg_max(predicted_risk, throughput_mbps) AS fr, arg_min(predicted_risk, throughput_mbps) AS lr FROM pts WHERE is_pareto),
g AS (SELECT pts.*, CASE WHEN n < 3 THEN 0 ELSE abs((-1) * ((predicted_risk - r0) / (r1 - r0)) - ((lr - fr) / (r1 - r0)) * ((throughput_mbps - t0) / (t1 - t0))
  + ((lr - r0) / (r1 - r0)) * 1 - 0) END AS gap FROM pts, e WHERE is_pareto)"""


@query(
    "w02_w03_operating_points",
    f"""WITH {CONFIG_SQL}, {KNEE_SQL}
    (SELECT 'max_throughput' AS point, * FROM pts WHERE is_pareto ORDER BY throughput_mbps DESC, signature LIMIT 1) UNION ALL
    (SELECT 'lowest_risk', * FROM pts WHERE is_pareto ORDER BY predicted_risk, throughput_mbps DESC, signature LIMIT 1) UNION ALL
    (SELECT 'best_safe', * FROM pts WHERE is_pareto AND predicted_risk <= 0.3 ORDER BY throughput_mbps DESC, signature LIMIT 1) UNION ALL
    (SELECT 'knee', * EXCLUDE (gap) FROM g ORDER BY gap DESC, throughput_mbps DESC, signature LIMIT 1)""",
)
def named_points(spark, sf):
    return frontier.operating_points(_points(spark, sf), max_risk=0.3)


@query(
    "w04_cloud_sample",
    f"WITH {CONFIG_SQL} SELECT * FROM pts WHERE NOT is_pareto ORDER BY md5('42:' || signature), signature LIMIT 4000",
)
def cloud_sample(spark, sf):
    return frontier.cloud_sample(_points(spark, sf))


ROC_SQL = f"""{RUNS_SQL},
sc AS (SELECT risk AS score, count(*) FILTER (WHERE {FAIL}) AS pos, count(*) FILTER (WHERE NOT {FAIL}) AS neg FROM runs GROUP BY 1),
cu AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS rn FROM sc
  WINDOW w AS (ORDER BY score DESC)),
tot AS (SELECT sum(pos) AS p, sum(neg) AS n FROM sc),
kept AS (SELECT *, row_number() OVER (ORDER BY score DESC) AS idx FROM cu WHERE rn = 1 OR np IS NULL OR np <> pos OR nn <> neg),
pts AS (SELECT CAST(0 AS BIGINT) AS idx, CAST(1.0 AS DOUBLE) AS threshold, CAST(0.0 AS DOUBLE) AS fpr, CAST(0.0 AS DOUBLE) AS tpr UNION ALL SELECT idx, least(score, 1.0), CAST(cn AS DOUBLE) / n, CAST(cp AS DOUBLE) / p FROM kept, tot)"""


@query(
    "w12_roc_curve",
    f"""WITH {ROC_SQL} SELECT idx, round(threshold, 4) AS threshold, round(fpr, 4) AS fpr, round(tpr, 4) AS tpr FROM pts
    WHERE idx % greatest(1, CAST(floor((SELECT count(*) FROM pts) / 100) AS BIGINT)) = 0""",
)
def roc_curve(spark, sf):
    return scoring.thin_curve(scoring.roc_points(runs(spark, sf)))


_CELLS = f"""count(*) FILTER (WHERE risk >= t AND {FAIL}) AS tp, count(*) FILTER (WHERE risk >= t AND NOT {FAIL}) AS fp,
  count(*) FILTER (WHERE risk < t AND {FAIL}) AS fn, count(*) FILTER (WHERE risk < t AND NOT {FAIL}) AS tn"""


@query(
    "w13_operating_cutoffs",
    f"""WITH {ROC_SQL}, cuts AS ((SELECT 'best_balance' AS point, threshold AS t FROM pts ORDER BY tpr - fpr DESC, idx LIMIT 1) UNION ALL SELECT 'default', 0.5),
    c AS (SELECT point, t, {_CELLS} FROM runs, cuts GROUP BY 1, 2)
    SELECT point, round(CAST(t AS DOUBLE), 4) AS threshold, round(fp / (fp + tn), 4) AS fpr, round(tp / (tp + fn), 4) AS tpr, tp, fp, fn, tn FROM c""",
)
def operating_cutoffs(spark, sf):
    return scoring.operating_points(runs(spark, sf))


@query(
    "w14_w15_areas",
    f"""WITH {ROC_SQL} SELECT round(sum(neg * (2 * cp - pos)) / (2.0 * max(p) * max(n)), 6) AS roc_auc,
    round(sum(pos * CAST(cp AS DOUBLE) / (cp + cn)) / max(p), 6) AS pr_auc FROM cu, tot""",
)
def areas(spark, sf):
    return scoring.areas(runs(spark, sf))


@query(
    "a15_threshold_metrics",
    f"""WITH {RUNS_SQL}, c AS (SELECT {_CELLS} FROM runs, (SELECT 0.5 AS t))
    SELECT tn, fp, fn, tp, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round(tp / (tp + fp), 4) AS precision,
    round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM c""",
)
def threshold_metrics(spark, sf):
    return scoring.threshold_metrics(runs(spark, sf))


@query(
    "a16_classification_report",
    f"""WITH {RUNS_SQL}, c AS (SELECT {_CELLS} FROM runs, (SELECT 0.5 AS t))
    SELECT 'fail' AS class, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, tp + fn AS support FROM c UNION ALL
    SELECT 'pass', round(tn / (tn + fn), 4), round(tn / (tn + fp), 4), round(2 * tn / (2 * tn + fp + fn), 4), tn + fp FROM c""",
)
def classification_report(spark, sf):
    return scoring.classification_report(runs(spark, sf))


@query(
    "a13_risk_bands",
    f"""WITH {RUNS_SQL} SELECT CASE WHEN risk < 0.25 THEN 'low (<25%)' WHEN risk < 0.5 THEN 'moderate (25-50%)' WHEN risk < 0.75 THEN 'high (50-75%)'
    ELSE 'critical (>=75%)' END AS band, count(*) AS n, (SELECT round(avg(risk), 4) FROM runs) AS mean_predicted_risk FROM runs GROUP BY 1""",
)
def risk_bands(spark, sf):
    return scoring.risk_bands(runs(spark, sf))


@query(
    "w05_j07_top_risk",
    f"""WITH {RUNS_SQL} SELECT run_id, pass_fail, round(risk, 4) AS predicted_risk,
    '{{"test_name":"' || test_name || '","priority":"' || priority || '","nation":' || nation || ',"month":' || month || ',"year":' || year || '}}' AS config
    FROM runs ORDER BY round(risk, 4) DESC, run_id LIMIT 20""",
)
def top_risk(spark, sf):
    return scoring.top_risk(runs(spark, sf), FEATURES[:5])


@query(
    "w11_stratified_split",
    f"""WITH {RUNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY pass_fail ORDER BY md5('42:' || run_id), run_id) AS k, count(*) OVER (PARTITION BY pass_fail) AS n FROM runs)
    SELECT run_id, pass_fail, k <= round(n * 0.2) AS is_test FROM r""",
)
def stratified_split(spark, sf):
    return scoring.stratified_split(runs(spark, sf)).select("run_id", "pass_fail", "is_test")


@query(
    "m16_constant_risk",
    WITH_RUNS + f"SELECT pass_fail, count(*) AS n, round(max((SELECT avg(CAST({FAIL} AS DOUBLE)) FROM runs)), 6) AS risk FROM runs GROUP BY 1",
)
def constant_risk(spark, sf):
    scored = scoring.observed_risk(runs(spark, sf).drop("risk"))
    return scored.groupBy("pass_fail").agg(F.count("*").alias("n"), F.round(F.max("risk"), 6).alias("risk"))


@query(
    "p17_p18_run_explorer",
    WITH_RUNS + f"""SELECT run_id, test_name, pass_fail, primary_error_tag, throughput_mbps FROM runs
    WHERE {FAIL} AND primary_error_tag = 'TAG_3' AND (contains(lower(run_id), 'build') OR contains(lower(test_name), 'build'))""",
)
def run_explorer(spark, sf):
    found = explore.run_filter(runs(spark, sf), search="Build", status="fail", error_tag="TAG_3")
    return found.select("run_id", "test_name", "pass_fail", "primary_error_tag", "throughput_mbps")


@query(
    "w06_sorted_page",
    WITH_RUNS + "SELECT run_id, test_name, throughput_mbps FROM runs ORDER BY throughput_mbps DESC, run_id LIMIT 50 OFFSET 150",
)
def sorted_page(spark, sf):
    return explore.page(runs(spark, sf), 3, 50, "throughput_mbps", True).select("run_id", "test_name", "throughput_mbps")


@query(
    "w06_page_info",
    WITH_RUNS + "SELECT count(*) AS total, CAST(50 AS INTEGER) AS per_page, CAST(ceil(count(*) / 50) AS BIGINT) AS n_pages FROM runs WHERE pass_fail = 'fail'",
)
def page_info(spark, sf):
    return explore.page_info(explore.run_filter(runs(spark, sf), status="fail"), 50)


def _diff_sql() -> str:
    from ..functions.vocab import DIFF_OUTCOMES

    one = """SELECT '{f}' AS field, '{k}' AS kind, CAST(a.{f} AS VARCHAR) AS run_a, CAST(b.{f} AS VARCHAR) AS run_b,
    CAST(a.{f} AS VARCHAR) IS DISTINCT FROM CAST(b.{f} AS VARCHAR) AS changed FROM a, b"""
    names = ["run_id", "test_name", "priority", "nation", "month", "year", "seed", "pass_fail", "cycles", "primary_error_tag"]
    picks = "a AS (SELECT * FROM runs WHERE run_id = (SELECT min(run_id) FROM runs WHERE pass_fail = 'pass')), b AS (SELECT * FROM runs WHERE run_id = (SELECT min(run_id) FROM runs WHERE pass_fail = 'fail'))"
    return f"WITH {RUNS_SQL}, {picks} " + " UNION ALL ".join(
        one.format(f=f, k="outcome" if f in DIFF_OUTCOMES else "config") for f in names
    )


def _two_run_diff(spark, sf):
    base = runs(spark, sf)
    firsts = base.agg(
        F.min(F.when(F.col("pass_fail") == "pass", F.col("run_id"))).alias("a"),
        F.min(F.when(F.col("pass_fail") == "fail", F.col("run_id"))).alias("b"),
    ).first()
    fields = ["run_id", "test_name", "priority", "nation", "month", "year", "seed", "pass_fail", "cycles", "primary_error_tag"]
    return explore.diff_runs(base, firsts["a"], firsts["b"], fields)


@query("j05_two_run_diff", _diff_sql())
def two_run_diff(spark, sf):
    return _two_run_diff(spark, sf)


@query(
    "j05_diff_summary",
    f"""SELECT count(*) FILTER (WHERE changed) AS n_changed, count(*) FILTER (WHERE changed AND kind = 'config') AS n_config_changed,
    count(*) FILTER (WHERE changed AND kind = 'outcome') AS n_outcome_changed FROM ({_diff_sql()})""",
)
def diff_summary(spark, sf):
    return explore.diff_summary(_two_run_diff(spark, sf))
