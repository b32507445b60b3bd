"""Rule, synthesis, grading and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grading, quality, rates, rules, scoring, synthesis
from ..session import spread
from ..sources import logs
from .corpus import ERRORS_SQL, FEATURES, RUNS_SQL, errors, runs, table
from .log_queries import LOG_SQL, parsed
from .registry import query
from .stats_queries import COMBO_KNOBS, COMBO_SQL, FAIL

RULES = [
    {"id": "R1", "conditions": [{"field": "test_name", "op": "==", "value": "MACHINERY"}, {"field": "priority", "op": "==", "value": "5-LOW"}],
     "effect": "set", "value": 0.7, "error_tag": "BACKLOG"},
    {"id": "R2", "conditions": [{"field": "month", "op": ">=", "value": 10}], "effect": "add", "value": 0.15, "error_tag": None},
    {"id": "R3", "conditions": [{"field": "nation", "op": "<", "value": 8}, {"field": "balance", "op": ">", "value": 6000.0}],
     "effect": "add", "value": 0.22, "error_tag": "CREDIT_HOLD"},
    {"id": "R4", "conditions": [{"field": "year", "op": "!=", "value": 1996}, {"field": "nation", "op": "<=", "value": 4}],
     "effect": "add", "value": 0.11, "error_tag": "CUSTOMS"},
]
CONDS = {
    "R1": "(test_name = 'MACHINERY' AND priority = '5-LOW')", "R2": "(month >= 10)",
    "R3": "(nation < 8 AND balance > 6000)", "R4": "(year <> 1996 AND nation <= 4)",
}
BASE = 0.04
PROB = f"""least(greatest(CASE WHEN {CONDS['R1']} THEN 0.7 ELSE {BASE} + CASE WHEN {CONDS['R2']} THEN 0.15 ELSE 0 END + CASE WHEN {CONDS['R3']} THEN 0.22 ELSE 0 END
  + CASE WHEN {CONDS['R4']} THEN 0.11 ELSE 0 END END, 0.001), 0.99)"""
TAG = f"CASE WHEN {CONDS['R1']} THEN 'BACKLOG' WHEN {CONDS['R3']} THEN 'CREDIT_HOLD' WHEN {CONDS['R4']} THEN 'CUSTOMS' END"


def draw(key: str, name: str) -> str:
    """SQL of a repeatable uniform draw."""
    return f"(CAST(CAST('0x' || substr(md5('42:{name}:' || {key}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296)"


@query("r01_rules_fired", f"WITH {RUNS_SQL} SELECT run_id, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in CONDS.items()) + ") AS fired FROM runs")
def rules_fired(spark, sf):
    return runs(spark, sf).select("run_id", F.array_join(rules.fired(RULES), ",").alias("fired"))


@query("r02_rule_risk", f"WITH {RUNS_SQL} SELECT run_id, round(CAST({PROB} AS DOUBLE), 6) AS prob FROM runs")
def rule_risk(spark, sf):
    return runs(spark, sf).select("run_id", F.round(rules.failure_probability(RULES, BASE), 6).alias("prob"))


RESOLVED_SQL = f"""{RUNS_SQL}, rp AS (SELECT * EXCLUDE (pass_fail, primary_error_tag), CAST({PROB} AS DOUBLE) AS prob, {TAG} AS claim FROM runs),
rv AS (SELECT *, CASE WHEN {draw('run_id', 'verdict')} < prob THEN 'fail' ELSE 'pass' END AS pass_fail FROM rp),
rs AS (SELECT *, CASE WHEN pass_fail = 'pass' THEN 'NONE' ELSE coalesce(claim, CASE WHEN {draw('run_id', 'noise')} < 0.25 THEN 'UNKNOWN' ELSE 'WEATHER' END) END AS primary_error_tag FROM rv)"""
NOISE = {"UNKNOWN": 0.25, "WEATHER": 0.75}


def resolved(spark, sf):
    return rules.resolve(runs(spark, sf), RULES, BASE, NOISE)


@query("r03_tag_attribution", f"WITH {RESOLVED_SQL} SELECT run_id, pass_fail, primary_error_tag FROM rs")
def tag_attribution(spark, sf):
    return resolved(spark, sf).select("run_id", "pass_fail", "primary_error_tag")


def _support_sql(source: str) -> str:
    one = """SELECT '{r}' AS rule_id, count(*) FILTER (WHERE {c}) AS rows_matched, round(count(*) FILTER (WHERE {c}) / count(*), 4) AS match_share,
    round(avg(f) FILTER (WHERE {c}), 4) AS fail_rate_when_fired, round(avg(f) FILTER (WHERE NOT {c}), 4) AS fail_rate_otherwise,
    round(avg(f) FILTER (WHERE {c}) / avg(f) FILTER (WHERE NOT {c}), 3) AS lift FROM (SELECT *, CAST({fail} AS DOUBLE) AS f FROM {s})"""
    return " UNION ALL ".join(one.format(r=r, c=c, s=source, fail=FAIL) for r, c in CONDS.items())


@query("a23_rule_support", f"WITH {RESOLVED_SQL} {_support_sql('rs')}")
def rule_support(spark, sf):
    return rules.support(resolved(spark, sf), RULES)


@query(
    "r04_sampling_bias",
    f"WITH {RUNS_SQL} SELECT run_id, CASE WHEN {CONDS['R2']} AND {draw('run_id', 'bias/R2')} < 0.4 THEN 'biased' ELSE priority END AS priority FROM runs",
)
def sampling_bias(spark, sf):
    return rules.bias_column(runs(spark, sf), RULES[1], "priority", "biased", 0.4).select("run_id", "priority")


MULTIPLIERS = [
    {"id": "M1", "conditions": RULES[1]["conditions"], "effect": "failure_multiplier", "value": 3.0, "error_tag": "timeout"},
    {"id": "M2", "conditions": RULES[2]["conditions"], "effect": "failure_multiplier", "value": 4.0, "error_tag": "overflow"},
    {"id": "M3", "conditions": RULES[3]["conditions"], "effect": "exec_time_multiplier", "value": 1.5},
    {"id": "M4", "conditions": RULES[0]["conditions"], "effect": "throughput_multiplier", "value": 0.5},
]


@query(
    "r05_outcome_multipliers",
    f"""WITH {RUNS_SQL} SELECT run_id, round(CAST(least(0.1 * CASE WHEN {CONDS['R2']} THEN 3 ELSE 1 END * CASE WHEN {CONDS['R3']} THEN 4 ELSE 1 END, 0.95) AS DOUBLE), 6) AS fail_prob,
    CAST(CASE WHEN {CONDS['R4']} THEN 1.5 ELSE 1 END AS DOUBLE) AS time_factor, CAST(CASE WHEN {CONDS['R1']} THEN 0.5 ELSE 1 END AS DOUBLE) AS throughput_factor,
    CASE WHEN {CONDS['R3']} THEN 'overflow' WHEN {CONDS['R2']} THEN 'timeout' END AS error_bias FROM runs""",
)
def outcome_multipliers(spark, sf):
    out = synthesis.outcome_multipliers(runs(spark, sf), MULTIPLIERS, 0.1)
    return out.select("run_id", F.round("fail_prob", 6).alias("fail_prob"), "time_factor", "throughput_factor", "error_bias")


SPECS = [
    {"name": "route", "kind": "choice", "values": ["air", "rail", "sea"], "weights": [0.2, 0.45, 0.35]},
    {"name": "crates", "kind": "choice", "values": [2, 12, 40]},
    {"name": "distance_km", "kind": "int", "low": 50, "high": 4000},
    {"name": "humidity", "kind": "normal", "mean": 60, "std": 12, "low": 5, "high": 100, "digits": 1},
    {"name": "damage_share", "kind": "float", "low": 0.0, "high": 0.2, "digits": 4},
]


def keys(spark, sf):
    return spread(table(spark, sf, "orders")).select(F.col("o_orderkey").alias("run_id"))


@query(
    "r06_sampled_fields",
    f"""SELECT o_orderkey AS run_id, CASE WHEN {draw('o_orderkey', 'route')} < 0.2 THEN 'air' WHEN {draw('o_orderkey', 'route')} < 0.65 THEN 'rail' ELSE 'sea' END AS route,
    CAST(floor({draw('o_orderkey', 'distance_km')} * 3951) + 50 AS INTEGER) AS distance_km, round({draw('o_orderkey', 'damage_share')} * 0.2, 4) AS damage_share FROM orders""",
)
def sampled_fields(spark, sf):
    return synthesis.sample_fields(keys(spark, sf), SPECS).select("run_id", "route", "distance_km", "damage_share")


@query(
    "r07_repeated_configs",
    f"""SELECT run_id, repeat, CAST(floor({draw('run_id', 'seed')} * 2147483647) AS BIGINT) AS seed FROM
    (SELECT o_orderkey || '-' || r AS run_id, CAST(r AS INTEGER) AS repeat FROM (SELECT o_orderkey, unnest(range(1, 4)) AS r FROM orders))""",
)
def repeated_configs(spark, sf):
    configs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("config_id"))
    return synthesis.repeat_configs(configs, 3).select("run_id", "repeat", "seed")


@query(
    "r10_ideal_score_area",
    f"""WITH {RESOLVED_SQL}, sc AS (SELECT round(prob, 6) AS score, count(*) FILTER (WHERE {FAIL}) AS pos, count(*) FILTER (WHERE NOT {FAIL}) AS neg FROM rs GROUP BY 1),
    cu AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp FROM sc)
    SELECT round(sum(neg * (2 * cp - pos)) / (2.0 * sum(pos) * sum(neg)), 6) AS roc_auc FROM cu""",
)
def ideal_score_area(spark, sf):
    scored = resolved(spark, sf).withColumn("risk", F.round("prob", 6))
    return scoring.areas(scored).select("roc_auc")


# ------------------------------------------------------------------ grading

RULE_FEATURES = {"R1": "priority,test_name", "R2": "month", "R3": "balance,nation", "R4": "nation,year"}
_RULE_ROWS = " UNION ALL ".join(f"SELECT '{r}' AS rule_id, '{f}' AS features" for r, f in RULE_FEATURES.items())


def _findings(spark, sf):
    found = rates.interactions(runs(spark, sf), COMBO_KNOBS)
    return found.select(F.col("conditions").alias("finding_id"), F.split("features", ",").alias("features"), "lift", "support")


def _ranked(spark, sf):
    """Settings ranked by the spread of their failure rates."""
    from pyspark.sql import Window

    spread = rates.rate_by_field(runs(spark, sf), FEATURES).groupBy(F.col("field").alias("feature")).agg(F.max("spread").alias("s"))
    return spread.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), "feature")))


RANK_SQL = """rk AS (SELECT field AS feature, row_number() OVER (ORDER BY max(spread) DESC, field) AS rank FROM ({rate}) GROUP BY 1),
ru AS (SELECT rule_id, string_split(features, ',') AS fs FROM ({rules})),
cov AS (SELECT rule_id, array_to_string(fs, ',') AS rule_features, array_to_string([x FOR x IN fs IF x IN (SELECT feature FROM rk WHERE rank <= 3)], ',') AS matched,
  array_to_string([x FOR x IN fs IF x NOT IN (SELECT feature FROM rk WHERE rank <= 3)], ',') AS missed, CAST(len(fs) AS INTEGER) AS n_features FROM ru)"""


def _coverage_cte() -> str:
    from .stats_queries import RATE_SQL

    return f"""rate AS ({RATE_SQL}), rk AS (SELECT field AS feature, row_number() OVER (ORDER BY max(spread) DESC, field) AS rank FROM rate GROUP BY 1),
    rf AS (SELECT rule_id, unnest(string_split(features, ',')) AS x FROM ({_RULE_ROWS})),
    cov AS (SELECT rule_id, string_agg(x, ',' ORDER BY x) AS rule_features, coalesce(string_agg(x, ',' ORDER BY x) FILTER (WHERE rank <= 3), '') AS matched,
      coalesce(string_agg(x, ',' ORDER BY x) FILTER (WHERE rank > 3), '') AS missed, CAST(count(*) AS INTEGER) AS n_features,
      CAST(count(*) FILTER (WHERE rank <= 3) AS INTEGER) AS n_matched FROM rf JOIN rk ON x = feature GROUP BY 1)"""


@query(
    "a24_feature_coverage",
    f"WITH {_coverage_cte()} SELECT cov.*, round(n_matched / n_features, 4) AS coverage, n_matched = n_features AS fully_detected FROM cov",
)
def feature_coverage(spark, sf):
    return grading.feature_coverage(grading.rule_frame(spark, RULES), _ranked(spark, sf), top_k=3)


MATCH_CTE = f"""co AS ({COMBO_SQL}), rl AS (SELECT rule_id, unnest(string_split(features, ',')) AS x, len(string_split(features, ',')) AS k FROM ({_RULE_ROWS})),
cf AS (SELECT conditions, lift, support, unnest(string_split(features, ',')) AS x FROM co),
ov AS (SELECT rule_id, conditions, count(*) / max(k) AS score, max(lift) AS lift, max(support) AS support FROM rl JOIN cf USING (x) GROUP BY 1, 2 HAVING count(*) / max(k) >= 0.5),
bm AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY score DESC, lift DESC, support DESC, conditions) AS r FROM ov)"""


@query(
    "j12_u07_rule_matches",
    f"""WITH {MATCH_CTE} SELECT a.rule_id, b.rule_id IS NOT NULL AS detected, round(coalesce(score, 0.0), 2) AS match_score, conditions AS finding_id, lift, support
    FROM ({_RULE_ROWS}) a LEFT JOIN bm b ON a.rule_id = b.rule_id AND r = 1""",
)
def rule_matches(spark, sf):
    return grading.best_matches(grading.rule_frame(spark, RULES), _findings(spark, sf))


@query(
    "a24_overall_grade",
    f"""WITH {_coverage_cte()}, {MATCH_CTE}, s AS (SELECT (SELECT sum(n_matched) / sum(n_features) FROM cov) AS f,
      (SELECT count(*) FROM bm WHERE r = 1) / 4 AS r), g AS (SELECT *, round((0.4 * f + 0.6 * r) * 100, 1) AS composite_score FROM s)
    SELECT round(f, 4) AS feature_recall, round(r, 4) AS rule_recall, composite_score,
    CASE WHEN composite_score >= 80 THEN 'A' WHEN composite_score >= 60 THEN 'B' WHEN composite_score >= 40 THEN 'C' WHEN composite_score >= 20 THEN 'D' ELSE 'F' END AS grade FROM g""",
)
def overall_grade(spark, sf):
    frame = grading.rule_frame(spark, RULES)
    return grading.overall_grade(
        grading.feature_coverage(frame, _ranked(spark, sf), top_k=3), grading.best_matches(frame, _findings(spark, sf))
    )


# ------------------------------------------------------------------ data quality


def _row(name: str, n: str) -> str:
    return f"SELECT '{name}' AS name, ({n}) = 0 AS ok, CAST(({n}) AS BIGINT) AS violations"


def outcomes(spark, sf):
    """Outcome table: expected mismatches are the order's returned lines, one off now and then."""
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    counted = l.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").alias("n"))
    return o.select(F.col("o_orderkey").alias("run_id"), "o_orderstatus", "o_orderdate", "o_orderpriority", "o_custkey").join(counted, "run_id", "left").select(
        "run_id", (F.coalesce("n", F.lit(0)) + F.when(F.col("run_id") % 100 == 0, 1).otherwise(0)).alias("scoreboard_mismatches"),
        F.when(F.col("o_orderstatus") == "F", "fail").otherwise("pass").alias("pass_fail"), "o_orderdate",
        F.when(F.col("o_orderstatus") == "F", "x").when(F.col("run_id") % 50 == 0, "odd").otherwise("NONE").alias("failure_type"),
        F.when(F.col("run_id") % 30 != 0, "E1").otherwise("").alias("error_code"),
    )


@query("j09_q06_mismatch_reconciliation", _row("mismatch counts disagree", "SELECT count(*) FROM orders WHERE o_orderkey % 100 = 0"))
def mismatch_reconciliation(spark, sf):
    txn = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "run_id")
    return quality.mismatches_reconcile(outcomes(spark, sf), txn, F.col("l_returnflag") == "R")


@query(
    "j10_q07_start_before_end",
    _row("child starts after its run ended", "SELECT count(*) FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE m > o_orderdate + INTERVAL 90 DAY"),
)
def start_before_end(spark, sf):
    txn = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "run_id")
    return quality.starts_before_end(outcomes(spark, sf), txn, F.expr("o_orderdate + INTERVAL 90 DAY"), "l_shipdate")


@query(
    "q08_outcome_codes",
    _row("passing runs with a failure type", "SELECT count(*) FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 50 = 0") + " UNION ALL " +
    _row("failing runs without an error code", "SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 30 = 0"),
)
def outcome_codes(spark, sf):
    return quality.outcome_codes(outcomes(spark, sf))


@query(
    "q15_tag_iff_fail",
    f"WITH {RUNS_SQL} " + _row("passing rows with an error", f"SELECT count(*) FROM runs WHERE NOT {FAIL} AND primary_error_tag <> 'NONE'") + " UNION ALL " +
    _row("failing rows without an error", f"SELECT count(*) FROM runs WHERE {FAIL} AND primary_error_tag = 'NONE'"),
)
def tag_iff_fail(spark, sf):
    return quality.tag_iff_fail(runs(spark, sf), "primary_error_tag", "NONE")


@query("q09_rate_matches", f"WITH {RUNS_SQL} " + _row("failure rate differs from the manifest", f"SELECT CAST(abs(round(avg(CAST({FAIL} AS DOUBLE)), 4) - 0.3) >= 0.0005 AS INT) FROM runs"))
def rate_matches(spark, sf):
    return quality.rate_matches(runs(spark, sf), 0.3)


@query(
    "u01_q10_keys_align",
    _row("lineitem only", "SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)") + " UNION ALL " +
    _row("orders missing in lineitem", "SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)") + " UNION ALL " +
    _row("events only", "SELECT count(*) FROM (SELECT user_id FROM events EXCEPT SELECT o_orderkey FROM orders)") + " UNION ALL " +
    _row("orders missing in events", "SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT user_id FROM events)"),
)
def keys_align(spark, sf):
    names = {"orders": "o_orderkey", "lineitem": "l_orderkey", "events": "user_id"}
    return quality.keys_align({t: table(spark, sf, t).select(F.col(k).alias("run_id")) for t, k in names.items()})


@query("u02_shared_keys", "SELECT user_id AS run_id FROM events INTERSECT SELECT c_custkey FROM customer")
def shared_keys(spark, sf):
    return quality.shared_keys(
        table(spark, sf, "events").select(F.col("user_id").alias("run_id")), table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"))
    )


@query(
    "u03_q01_files_declared",
    _row("declared files missing", "SELECT count(DISTINCT 'f' || user_id || '.log') FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)") + " UNION ALL " +
    _row("undeclared files", "SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)"),
)
def files_declared(spark, sf):
    name = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"), F.lit(".log")).alias("name")
    return quality.files_declared(
        table(spark, sf, "events").select(name("user_id")), table(spark, sf, "customer").select(name("c_custkey"))
    )


@query(
    "u04_q11_leaked_columns",
    "SELECT 'derived columns in scored' AS name, false AS ok, CAST(2 AS BIGINT) AS violations UNION ALL SELECT 'derived columns in orders', true, 0",
)
def leaked_columns(spark, sf):
    scored = runs(spark, sf).withColumnsRenamed({"risk": " Risk_Score", "cycles": "LATENCY"})
    return quality.leaked_columns({"scored": scored, "orders": table(spark, sf, "orders")})


@query(
    "q02_log_parses",
    f"""WITH {LOG_SQL} SELECT 'expected number of runs' AS name, true AS ok, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'malformed blocks', true, 0""",
)
def log_parses(spark, sf):
    return quality.log_parses(logs.parse_stats(parsed(spark, sf)), table(spark, sf, "orders").count())


@query("q03_required_columns", "SELECT 'required columns' AS name, false AS ok, CAST(1 AS BIGINT) AS violations")
def required_columns(spark, sf):
    return quality.columns_present(logs.runs_of(parsed(spark, sf)), ["test_name", "queue_depth", "voltage", "seed"])


@query(
    "j08_q04_q05_log_agreement",
    f"""WITH {LOG_SQL} """ + _row("outcomes without a log run", "SELECT 0") + " UNION ALL " +
    _row("verdict disagrees", "SELECT count(*) FROM lg WHERE o_orderstatus = 'P' AND o_orderkey % 20 = 0") + " UNION ALL " +
    _row("error count disagrees", "SELECT count(*) FROM lg WHERE n > 2") + " UNION ALL " + _row("fatal count disagrees", "SELECT count(*) FROM lg WHERE n > 2"),
)
def log_agreement(spark, sf):
    """The stand-in outcomes count fatal lines as errors and call some open runs failed."""
    k, bad = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    from .corpus import run_key

    out = table(spark, sf, "orders").select(
        run_key("o_orderkey").alias("run_id"),
        F.when(bad | ((F.col("o_orderstatus") == "P") & (k % 20 == 0)), "fail").otherwise("pass").alias("pass_fail"),
        F.when(bad, 1 + k % 3).otherwise(0).alias("uvm_error_count"), F.lit(0).alias("uvm_fatal_count"),
    )
    return quality.log_agrees(out, logs.runs_of(parsed(spark, sf), {}))


@query(
    "q13_q14_rules_supported",
    f"WITH {RESOLVED_SQL}, s AS ({_support_sql('rs')}) " +
    _row("rules with too little support", "SELECT count(*) FROM s WHERE rows_matched < 25 OR match_share < 0.01") + " UNION ALL " +
    _row("rules with weak lift", "SELECT count(*) FROM s WHERE lift < 1.3"),
)
def rules_supported(spark, sf):
    return quality.rules_supported(rules.support(resolved(spark, sf), RULES))


@query("q16_undone_aliases", "SELECT o_orderkey AS run_id, o_orderstatus AS status FROM orders")
def undone_aliases(spark, sf):
    aliased = table(spark, sf, "orders").select(F.col("o_orderkey").alias("runId"), F.col("o_orderstatus").alias("result"))
    return quality.undo_aliases(aliased, {"run_id": "runId", "status": "result"})


@query("q12_waveform_heads", _row("waveform missing or malformed", "SELECT count(*) FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 7 = 3"))
def waveform_heads(spark, sf):
    """One text file per nation; every fifth lacks the opening line, some are never written."""
    from ..session import scratch_path

    path = scratch_path(spark, "waves")
    n = table(spark, sf, "nation")
    head = F.when(F.col("n_nationkey") % 5 == 0, "no header").otherwise("$date")
    body = F.concat(head, F.lit("\n$end\n#0\n1!"))
    n.where("n_nationkey % 7 <> 3").select(body.alias("value"), F.col("n_nationkey").alias("k")).write.partitionBy("k").text(path)
    place = F.substring_index("_metadata.file_path", "/", -2)
    found = spark.read.text(f"{path}/*").select(place.alias("name")).distinct()
    found = found.withColumn("k", F.regexp_extract("name", r"^k=(\d+)/", 1))
    declared = n.select(F.col("n_nationkey").cast("string").alias("k")).join(found, "k", "left")
    return quality.waveform_heads(spark, f"{path}/*", declared.select(F.coalesce("name", F.lit("absent")).alias("name")), depth=2)
