"""Summary, rate and combination queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rates, summary
from .corpus import ERRORS_SQL, FEATURES, KNOBS, RUNS_SQL, errors, runs, table
from .registry import query

WITH_RUNS = f"WITH {RUNS_SQL} "
WITH_BOTH = f"WITH {RUNS_SQL}, {ERRORS_SQL} "
FAIL = "(pass_fail = 'fail')"


def bin_case(column: str, q: list[str]) -> str:
    """SQL label of an equal-frequency bin from scalar subqueries ``q`` (inner edges)."""
    return "'q' || (1 + " + " + ".join(f"CAST({column} > {e} AS INTEGER)" for e in q) + ")"


def quantiles_cte(column: str, probs: list[float], name: str) -> str:
    cols = ", ".join(f"quantile_cont(CAST({column} AS DOUBLE), {p}) AS e{i}" for i, p in enumerate(probs))
    return f"{name} AS (SELECT {cols} FROM runs)"


FIFTHS = [i / 5 for i in range(6)]
WIDE_SQL = f"""{quantiles_cte('nation', FIFTHS, 'qn')}, {quantiles_cte('balance', FIFTHS, 'qb')},
long AS (
  SELECT 'test_name' AS field, test_name AS level, NULL AS low, NULL AS high, pass_fail FROM runs UNION ALL
  SELECT 'priority', priority, NULL, NULL, pass_fail FROM runs UNION ALL
  SELECT 'month', CAST(month AS VARCHAR), NULL, NULL, pass_fail FROM runs UNION ALL
  SELECT 'year', CAST(year AS VARCHAR), NULL, NULL, pass_fail FROM runs UNION ALL
  SELECT 'nation', 'q' || b, [e0,e1,e2,e3,e4,e5][b], [e0,e1,e2,e3,e4,e5][b+1], pass_fail FROM
    (SELECT *, 1 + CAST(nation > e1 AS INT) + CAST(nation > e2 AS INT) + CAST(nation > e3 AS INT) + CAST(nation > e4 AS INT) AS b FROM runs, qn) UNION ALL
  SELECT 'balance', 'q' || b, [e0,e1,e2,e3,e4,e5][b], [e0,e1,e2,e3,e4,e5][b+1], pass_fail FROM
    (SELECT *, 1 + CAST(balance > e1 AS INT) + CAST(balance > e2 AS INT) + CAST(balance > e3 AS INT) + CAST(balance > e4 AS INT) AS b FROM runs, qb))"""

RATE_SQL = f"""WITH {RUNS_SQL}, {WIDE_SQL},
overall AS (SELECT avg(CAST({FAIL} AS DOUBLE)) AS o FROM runs),
lv AS (SELECT field, level, low, high, count(*) AS n, CAST(sum(CAST({FAIL} AS INT)) AS BIGINT) AS fails,
  avg(CAST({FAIL} AS DOUBLE)) AS r FROM long GROUP BY ALL)
SELECT field, level, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, n, fails, round(r, 4) AS fail_rate, round(r / o, 3) AS lift,
  round(max(round(r, 4)) OVER (PARTITION BY field) - min(round(r, 4)) OVER (PARTITION BY field), 4) AS spread
FROM lv, overall"""


@query("a06_fail_rate_by_field", RATE_SQL)
def fail_rate_by_field(spark, sf):
    return rates.rate_by_field(runs(spark, sf), FEATURES)


@query(
    "w16_fields_by_spread",
    f"""SELECT *, CAST(row_number() OVER (ORDER BY spread DESC, field, fail_rate DESC, level) AS INTEGER) AS place
    FROM ({RATE_SQL}) ORDER BY place""",
)
def fields_by_spread(spark, sf):
    from pyspark.sql import Window

    found = rates.rate_by_field(runs(spark, sf), FEATURES)
    # Levels of a handful of settings: a bounded window.
    order = Window.orderBy(F.desc("spread"), "field", F.desc("fail_rate"), "level")
    return rates.ranked_fields(found).withColumn("place", F.row_number().over(order))


@query(
    "a01_corpus_summary",
    WITH_BOTH + f"""SELECT count(*) AS n_runs, count(*) FILTER (NOT {FAIL}) AS n_pass,
    count(*) FILTER {FAIL.replace('(', '(WHERE ', 1)} AS n_fail,
    round(avg(CAST({FAIL} AS DOUBLE)), 4) AS fail_rate, (SELECT count(*) FROM errors) AS n_error_lines
    FROM runs""".replace("FILTER (NOT", "FILTER (WHERE NOT"),
)
def corpus_summary(spark, sf):
    return summary.corpus_summary(runs(spark, sf), errors(spark, sf))


@query("a02_error_tags", WITH_RUNS + f"SELECT primary_error_tag, count(*) AS n FROM runs WHERE {FAIL} GROUP BY 1")
def error_tags(spark, sf):
    return summary.error_tags(runs(spark, sf))


@query("a03_severities", f"WITH {ERRORS_SQL} SELECT severity, count(*) AS n FROM errors GROUP BY 1")
def severities(spark, sf):
    return summary.severities(errors(spark, sf))


STATS = """SELECT '{c}' AS field, round(avg({c}), 2) AS mean, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 2) AS median,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.95), 2) AS p95, round(stddev_samp({c}), 2) AS std,
  round(CAST(min({c}) AS DOUBLE), 2) AS min, round(CAST(max({c}) AS DOUBLE), 2) AS max FROM runs"""


@query(
    "a04_a21_metric_stats",
    WITH_RUNS + " UNION ALL ".join(STATS.format(c=c) for c in summary.METRICS),
)
def metric_stats(spark, sf):
    return summary.metric_stats(runs(spark, sf))


@query(
    "a05_time_by_tag",
    WITH_RUNS + """SELECT primary_error_tag, count(execution_time_ms) AS n,
    round(avg(execution_time_ms), 2) AS mean_execution_time_ms FROM runs GROUP BY 1""",
)
def time_by_tag(spark, sf):
    return summary.time_by_tag(runs(spark, sf))


@query(
    "a07_quantile_bins",
    WITH_RUNS + f""", {quantiles_cte('throughput_mbps', [1 / 3, 2 / 3], 'q')}
    SELECT test_name, 'q' || (1 + CAST(throughput_mbps > e0 AS INT) + CAST(throughput_mbps > e1 AS INT)) AS bin,
    count(*) AS n FROM runs, q GROUP BY 1, 2""".replace(" ,", ",", 1),
)
def quantile_bins(spark, sf):
    labelled, _ = rates.binned(runs(spark, sf), ["throughput_mbps"], 3, 3)
    return labelled.groupBy("test_name", F.col("throughput_mbps").alias("bin")).agg(F.count("*").alias("n"))


COMBO_KNOBS = ["test_name", "priority", "nation", "month", "balance"]
_PAIR = "CASE WHEN grouping({c}) = 0 THEN {t} END"
_NAMES = ", ".join(_PAIR.format(c=c, t=f"'{c}'") for c in COMBO_KNOBS)
_CONDS = ", ".join(_PAIR.format(c=c, t=f"'{c}=' || {c}") for c in COMBO_KNOBS)


def _sets() -> str:
    from itertools import combinations

    return ", ".join(
        "(" + ", ".join(c) + ")" for k in (2, 3) for c in combinations(COMBO_KNOBS, k)
    )


COMBO_SQL = f"""WITH {RUNS_SQL}, {quantiles_cte('nation', [1 / 3, 2 / 3], 'qn')}, {quantiles_cte('balance', [1 / 3, 2 / 3], 'qb')},
{quantiles_cte('month', [1 / 3, 2 / 3], 'qm')},
b AS (SELECT test_name, priority, {bin_case('nation', ['qn.e0', 'qn.e1'])} AS nation, {bin_case('month', ['qm.e0', 'qm.e1'])} AS month,
  {bin_case('balance', ['qb.e0', 'qb.e1'])} AS balance, pass_fail FROM runs, qn, qb, qm),
o AS (SELECT avg(CAST({FAIL} AS DOUBLE)) AS base FROM runs),
g AS (SELECT concat_ws(',', {_NAMES}) AS features, concat_ws(' AND ', {_CONDS}) AS conditions, count(*) AS support,
  sum(CAST({FAIL} AS DOUBLE)) / count(*) AS rate FROM b GROUP BY GROUPING SETS ({_sets()}))
SELECT features, conditions, CAST(len(string_split(features, ',')) AS INTEGER) AS "order", support, round(rate, 4) AS fail_rate,
  round(base, 4) AS baseline_fail_rate, round(rate / base, 2) AS lift FROM g, o WHERE support >= 10 AND rate > 1.2 * base"""


@query("a08_interactions", COMBO_SQL)
def interactions(spark, sf):
    return rates.interactions(runs(spark, sf), COMBO_KNOBS)


@query(
    "a09_feature_frequency",
    f"""SELECT feature, count(*) AS appearances FROM (SELECT unnest(string_split(features, ',')) AS feature FROM
    (SELECT * FROM ({COMBO_SQL}) ORDER BY lift DESC, support DESC, conditions LIMIT 30)) GROUP BY 1""",
)
def feature_frequency(spark, sf):
    return rates.feature_frequency(rates.interactions(runs(spark, sf), COMBO_KNOBS))


def _profile_sql(columns: list[tuple[str, str]]) -> str:
    one = """SELECT '{c}' AS field, '{t}' AS dtype, count(DISTINCT {c}) AS n_distinct, count({c}) AS n_values,
    (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM runs ORDER BY v LIMIT 4)) AS samples FROM runs"""
    return " UNION ALL ".join(one.format(c=c, t=t) for c, t in columns)


PROFILED = [("run_id", "string"), ("test_name", "string"), ("priority", "string"), ("nation", "int"), ("month", "int"), ("seed", "bigint")]


@query("a17_column_profile", WITH_RUNS + _profile_sql(PROFILED))
def column_profile(spark, sf):
    return summary.profile(runs(spark, sf), [c for c, _ in PROFILED])


@query(
    "a18_verdict_shares",
    WITH_RUNS + "SELECT pass_fail, count(*) AS n, round(count(*) / (SELECT count(*) FROM runs), 4) AS share FROM runs GROUP BY 1",
)
def verdict_shares(spark, sf):
    return summary.counts_by(runs(spark, sf), "pass_fail")


@query(
    "a19_rate_by_input_field",
    f"""WITH {RUNS_SQL}, {WIDE_SQL.replace('), ', '), ', 1)}
    SELECT field, level, count(*) AS n, round(avg(CAST({FAIL} AS DOUBLE)), 4) AS fail_rate FROM long
    WHERE field IN ('nation', 'balance', 'priority', 'year') GROUP BY 1, 2""",
)
def rate_by_input_field(spark, sf):
    found = rates.rate_by_field(runs(spark, sf), ["nation", "balance", "priority", "year"], max_levels=10)
    return found.select("field", "level", "n", "fail_rate")


@query(
    "a20_crosstab",
    WITH_RUNS + f"""SELECT primary_error_tag, count(*) FILTER (WHERE pass_fail = 'pass') AS n_pass,
    count(*) FILTER (WHERE pass_fail = 'fail') AS n_fail FROM runs GROUP BY 1""",
)
def crosstab(spark, sf):
    return summary.crosstab(runs(spark, sf), "primary_error_tag", "pass_fail", ["pass", "fail"])


CHECKS = {
    "urgent & nation>=20": "priority = '1-URGENT' AND nation >= 20",
    "balance>9000": "balance > 9000",
    "december & building": "month = 12 AND test_name = 'BUILDING'",
}


@query(
    "a22_spot_checks",
    WITH_RUNS + " UNION ALL ".join(
        f"""SELECT '{n}' AS subgroup, count(*) AS n, round(avg(CAST({FAIL} AS DOUBLE)), 4) AS fail_rate,
        round(avg(CAST({FAIL} AS DOUBLE)) / (SELECT avg(CAST({FAIL} AS DOUBLE)) FROM runs), 3) AS ratio FROM runs WHERE {c}"""
        for n, c in CHECKS.items()
    ),
)
def spot_checks(spark, sf):
    return summary.spot_checks(runs(spark, sf), {n: F.expr(c) for n, c in CHECKS.items()})


@query(
    "a26_distinct_counts",
    "SELECT 'l_partkey' AS field, count(DISTINCT l_partkey) AS n_distinct FROM lineitem UNION ALL "
    "SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem UNION ALL "
    "SELECT 'l_extendedprice', count(DISTINCT l_extendedprice) FROM lineitem",
)
def distinct_counts(spark, sf):
    from ..operators.cleaning import distinct_counts as exact

    return exact(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey", "l_extendedprice"])
