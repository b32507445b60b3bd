"""Model, attribution and recommendation queries. The models of a folder are fitted once a session, in full."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import attribution, learning, recommend, scoring
from ..session import cut
from .compare_queries import CONFIG_SQL, _points
from .corpus import FEATURES, RUNS_SQL, runs
from .registry import query
from .rule_queries import RESOLVED_SQL, resolved

_FITTED: dict[tuple, object] = {}


def _once(spark, sf, name, make):
    """What ``make`` gives, kept for this session: several queries report on the same fitted model."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def _risk_model(spark, sf):
    """Runs with planted verdicts, the risk model, and the runs marked with the split."""
    def make():
        base = cut(resolved(spark, sf).drop("prob", "risk"))
        model, marked = learning.train_risk(base, FEATURES)
        return base, model, cut(marked)

    return _once(spark, sf, "risk", make)


def _throughput_model(spark, sf):
    return _once(spark, sf, "throughput", lambda: learning.train_throughput(_risk_model(spark, sf)[0], FEATURES))


def _baseline(spark, sf, name):
    """A baseline at its stated size, and its scored held-out runs."""
    def make():
        chosen = {"numeric": ["nation", "month", "balance"], "categorical": ["test_name", "priority", "year"]}
        model, marked = learning.train_baseline(cut(resolved(spark, sf).drop("prob", "risk")), chosen, name)
        return model, cut(model.score(marked.where("is_test")))

    return _once(spark, sf, name, make)


@query(
    "m01_one_hot_lineage",
    f"""WITH {RUNS_SQL} SELECT 'priority' AS feature, 'priority_' || priority AS encoded FROM runs GROUP BY 2 UNION ALL
    SELECT 'year', 'year_' || year FROM runs GROUP BY 2 UNION ALL SELECT 'balance', 'balance' UNION ALL SELECT 'priority', 'priority_other' UNION ALL SELECT 'year', 'year_other'""",
)
def one_hot_lineage(spark, sf):
    return learning.lineage_table(spark, learning.one_hot_encoder(runs(spark, sf), ["priority", "year"], ["balance"]))


@query(
    "m01_one_hot_rows",
    f"""WITH {RUNS_SQL} SELECT run_id, CAST(1 AS INTEGER) AS n_hot, round(balance, 4) AS balance, dense_rank() OVER (ORDER BY priority) AS slot FROM runs""",
)
def one_hot_rows(spark, sf):
    df = runs(spark, sf)
    encoded = learning.one_hot_encoder(df, ["priority"], ["balance"]).transform(df)
    x = vector_to_array("features")
    hot = F.slice(x, F.lit(2), F.lit(100))
    return encoded.select(
        "run_id", F.size(F.filter(hot, lambda v: v != 0)).alias("n_hot"), F.round(x[0], 4).alias("balance"), F.array_position(hot, 1.0).alias("slot")
    )


@query("m02_ordinal_codes", f"WITH {RUNS_SQL} SELECT run_id, CAST(dense_rank() OVER (ORDER BY priority) - 1 AS INTEGER) AS code FROM runs")
def ordinal_codes(spark, sf):
    df = runs(spark, sf)
    encoded = learning.ordinal_encoder(df, ["priority", "month"]).transform(df)
    return encoded.select("run_id", vector_to_array("features")[0].cast("int").alias("code"))


@query("m03_m06_baseline_forest")
def baseline_forest(spark, sf):
    return scoring.threshold_metrics(_baseline(spark, sf, "random_forest")[1])


@query("m05_baseline_logistic")
def baseline_logistic(spark, sf):
    return scoring.areas(_baseline(spark, sf, "logistic_regression")[1])


@query("m04_risk_model_areas")
def risk_model_areas(spark, sf):
    _, model, marked = _risk_model(spark, sf)
    return scoring.areas(model.score(marked.where("is_test")))


@query("m07_batch_scores")
def batch_scores(spark, sf):
    base, model, _ = _risk_model(spark, sf)
    return model.score(base, "failure_probability", digits=4).select("run_id", "pass_fail", "failure_probability")


@query("a25_w07_importance_rollup")
def importance_rollup(spark, sf):
    model, _ = _baseline(spark, sf, "random_forest")
    return learning.rolled_up_importances(learning.raw_importances(spark, model), learning.lineage_table(spark, model.encoder))


def _explained(spark, sf):
    """Contributions for every run."""
    def make():
        base, model, _ = _risk_model(spark, sf)
        return attribution.long_form(cut(attribution.with_values(model, base, attribution.contributions(model, base)[0])))

    return _once(spark, sf, "explained", make)


@query("m08_m09_w07_attribution")
def attributions(spark, sf):
    return attribution.importance(_explained(spark, sf))


@query("m09_attribution_per_value")
def attribution_per_value(spark, sf):
    return attribution.per_value(_explained(spark, sf))


@query("m10_beeswarm")
def beeswarm(spark, sf):
    long = _explained(spark, sf)
    return attribution.beeswarm(long, attribution.importance(long))


@query(
    "m12_search_space",
    f"""WITH {RUNS_SQL} SELECT 'nation' AS feature, 'int' AS kind, CAST(min(nation) AS DOUBLE) AS low, CAST(max(nation) AS DOUBLE) AS high, CAST(NULL AS INTEGER) AS n_choices FROM runs
    UNION ALL SELECT 'month', 'int', min(month), max(month), NULL FROM runs UNION ALL SELECT 'balance', 'float', min(balance), max(balance), NULL FROM runs
    UNION ALL SELECT 'priority', 'choice', NULL, NULL, CAST(count(DISTINCT priority) AS INTEGER) FROM runs UNION ALL SELECT 'year', 'choice', NULL, NULL, CAST(count(DISTINCT year) AS INTEGER) FROM runs""",
)
def search_space(spark, sf):
    return recommend.space_table(spark, recommend.search_space(runs(spark, sf), ["nation", "month", "balance", "priority", "year"]))


@query(
    "m13_frozen_defaults",
    f"""WITH {RUNS_SQL}, p AS (SELECT * FROM runs WHERE pass_fail = 'pass')
    SELECT 'nation' AS feature, CAST(CAST(floor(quantile_cont(CAST(nation AS DOUBLE), 0.5)) AS INTEGER) AS VARCHAR) AS value FROM p UNION ALL
    SELECT 'priority', (SELECT priority FROM p GROUP BY 1 ORDER BY count(*) DESC, priority LIMIT 1)""",
)
def frozen_defaults(spark, sf):
    _, frozen = recommend.active_features(["month", "nation", "priority"], ["month", "nation", "priority"], limit=1)
    found = recommend.frozen_defaults(runs(spark, sf), frozen)
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "feature string, value string")


@query("m11_m14_m15_recommendations")
def recommendations(spark, sf):
    base, model, _ = _risk_model(spark, sf)
    speed = _throughput_model(spark, sf)
    space = recommend.search_space(base, FEATURES)
    scored = recommend.evaluate(recommend.candidates(spark, base, space, {}, 5000), model, speed, max_risk=0.3)
    return recommend.best_candidates(scored)


# Observed configurations in the place of drawn candidates: selection without a model.
CAND_SQL = f"""{CONFIG_SQL}, ca AS (SELECT signature AS trial, predicted_risk, throughput_mbps AS predicted_throughput_mbps, predicted_risk <= 0.4 AS feasible,
  round(throughput_mbps - 1000000 * greatest(0, predicted_risk - 0.4), 2) AS value FROM pts)"""


def _observed(spark, sf):
    over = F.greatest(F.lit(0.0), F.col("predicted_risk") - 0.4)
    return _points(spark, sf).select(
        F.col("signature").alias("trial"), "predicted_risk", F.col("throughput_mbps").alias("predicted_throughput_mbps"),
        (F.col("predicted_risk") <= 0.4).alias("feasible"), F.round(F.col("throughput_mbps") - recommend.PENALTY * over, 2).alias("value"),
    )


@query(
    "m15_best_candidates",
    f"WITH {CAND_SQL} SELECT trial, predicted_risk, predicted_throughput_mbps, feasible, false AS is_fallback FROM ca WHERE feasible ORDER BY predicted_throughput_mbps DESC, trial LIMIT 10",
)
def best_candidates(spark, sf):
    return recommend.best_candidates(_observed(spark, sf)).drop("value")


@query(
    "m15_search_summary",
    f"""WITH {CAND_SQL}, b AS (SELECT avg(throughput_mbps) AS base FROM runs WHERE pass_fail = 'pass')
    SELECT count(*) AS n_trials, count(*) FILTER (WHERE feasible) AS n_feasible, round(count(*) FILTER (WHERE feasible) / count(*), 4) AS feasible_rate, true AS constraint_satisfiable,
    round(min(predicted_risk), 5) AS min_achievable_risk, round(max(base), 2) AS baseline_mean_throughput_mbps,
    round((max(predicted_throughput_mbps) FILTER (WHERE feasible) / max(base) - 1) * 100, 1) AS throughput_uplift_pct FROM ca, b""",
)
def search_summary(spark, sf):
    return recommend.search_summary(_observed(spark, sf), runs(spark, sf))


@query("w17_search_history", f"WITH {CAND_SQL} SELECT trial FROM ca WHERE value > -500000 ORDER BY trial LIMIT 400")
def search_history(spark, sf):
    return recommend.history(_observed(spark, sf)).select("trial")


# What must hold for any fitted model, as exact facts that SQL can state from the tables.


@query(
    "m07_m16_score_contract",
    f"WITH {RUNS_SQL} SELECT count(*) AS n_runs, count(*) AS n_probabilities, count(DISTINCT run_id) AS n_ids, true AS finds_the_rules FROM runs",
)
def score_contract(spark, sf):
    """Every run is scored once, with a probability; runs that the fit has not seen are ranked by the planted rules."""
    base, model, marked = _risk_model(spark, sf)
    area = scoring.areas(model.score(marked.where("is_test"))).select((F.col("roc_auc") > 0.75).alias("finds_the_rules"))
    p = F.col("failure_probability")
    return model.score(base, "failure_probability").agg(
        F.count("*").alias("n_runs"), F.count_if((p >= 0) & (p <= 1)).alias("n_probabilities"), F.count_distinct("run_id").alias("n_ids")
    ).withColumn("finds_the_rules", area.scalar())


HELD_SQL = f"""{RESOLVED_SQL}, ho AS (SELECT pass_fail, row_number() OVER (PARTITION BY pass_fail ORDER BY md5('42:' || run_id), run_id) AS k,
count(*) OVER (PARTITION BY pass_fail) AS n FROM rs), held AS (SELECT pass_fail FROM ho WHERE k <= round(n * 0.2))"""
HELD_COUNTS = f"WITH {HELD_SQL} SELECT {{}}count(*) FILTER (WHERE pass_fail = 'fail') AS n_fail, count(*) FILTER (WHERE pass_fail = 'pass') AS n_pass, true AS finds_the_rules FROM held"


def _held_counts(scored, area: float):
    cells = scoring.threshold_metrics(scored).select((F.col("tp") + F.col("fn")).alias("n_fail"), (F.col("tn") + F.col("fp")).alias("n_pass"))
    return cells.withColumn("finds_the_rules", scoring.areas(scored).select(F.col("roc_auc") > area).scalar())


@query("m04_held_out_contract", HELD_COUNTS.format(""))
def held_out_contract(spark, sf):
    """The confusion counts of the risk model are those of an exact fifth of each verdict."""
    _, model, marked = _risk_model(spark, sf)
    return _held_counts(model.score(marked.where("is_test")), 0.75)


@query(
    "m03_m05_m06_baseline_contract",
    f"SELECT b.name, h.* FROM ({HELD_COUNTS.format('')}) h, (VALUES ('logistic_regression'), ('random_forest')) b(name)",
)
def baseline_contract(spark, sf):
    """Baselines are measured on the same split; trees see the planted rules, a linear model their main effects."""
    parts = [_held_counts(_baseline(spark, sf, name)[1], area).withColumn("name", F.lit(name)) for name, area in (("logistic_regression", 0.6), ("random_forest", 0.7))]
    return parts[0].unionByName(parts[1])


@query(
    "m09_per_value_contract",
    f"""WITH {RESOLVED_SQL}, v AS (SELECT 'test_name' AS feature, test_name AS value, pass_fail FROM rs UNION ALL SELECT 'priority', priority, pass_fail FROM rs),
    f AS (SELECT feature, value, avg(CASE WHEN pass_fail = 'fail' THEN 1.0 ELSE 0.0 END) AS rate FROM v GROUP BY 1, 2)
    SELECT feature, count(*) AS n_values, arg_max(value, rate) AS riskiest FROM f GROUP BY 1""",
)
def per_value_contract(spark, sf):
    """The word of highest mean contribution is the one of highest failure rate, for the settings of a planted rule."""
    found = attribution.per_value(_explained(spark, sf)).where(F.col("feature").isin("test_name", "priority"))
    return found.groupBy("feature").agg(F.count("*").alias("n_values"), F.max_by("value", "mean_shap").alias("riskiest"))


@query(
    "m10_beeswarm_contract",
    f"""WITH {RUNS_SQL}, s AS (SELECT run_id FROM runs ORDER BY md5('42:' || run_id), run_id LIMIT 300), f AS (SELECT unnest({FEATURES}) AS feature)
    SELECT feature, run_id, true AS in_range FROM s, f""",
)
def beeswarm_contract(spark, sf):
    """The picture shows every setting of the first 300 runs in hash order."""
    return beeswarm(spark, sf).select("feature", "run_id", F.col("value_norm").between(0, 1).alias("in_range"))


@query(
    "m08_m09_contribution_contract",
    f"WITH {RUNS_SQL} SELECT count(*) AS n_runs, count(*) AS n_add_up, CAST({len(FEATURES)} AS BIGINT) AS n_features FROM runs",
)
def contribution_contract(spark, sf):
    """Contributions of all runs add up, with the base, to the model's margin."""
    base, model, _ = _risk_model(spark, sf)
    phi, offset = attribution.contributions(model, base)
    total = F.aggregate("phi", F.lit(0.0), lambda a, b: a + b) + offset
    return phi.join(model.margin(base).select("run_id", "margin"), "run_id").agg(
        F.count("*").alias("n_runs"), F.count_if(F.abs(total - F.col("margin")) < 1e-6).alias("n_add_up"), F.max(F.size("phi")).cast("long").alias("n_features")
    )


@query("a25_w07_importance_contract", "SELECT CAST(6 AS BIGINT) AS n_features, true AS shares_add_up, CAST(6 AS BIGINT) AS n_ranks")
def importance_contract(spark, sf):
    """Importances of one-hot columns roll up to one share per setting."""
    ranked = importance_rollup(spark, sf)
    return ranked.agg(
        F.count("*").alias("n_features"), (F.abs(F.sum("importance") - 1) < 0.01).alias("shares_add_up"), F.count_distinct("rank").alias("n_ranks"))


@query(
    "m11_m14_candidate_contract",
    "SELECT CAST(5000 AS BIGINT) AS n_trials, CAST(5000 AS BIGINT) AS n_in_domain, CAST(5000 AS BIGINT) AS n_consistent",
)
def candidate_contract(spark, sf):
    """Drawn candidates lie in the domain that the runs span, and are feasible exactly if their risk is within the limit."""
    base, model, _ = _risk_model(spark, sf)
    speed = _throughput_model(spark, sf)
    drawn = recommend.candidates(spark, base, recommend.search_space(base, FEATURES), {}, 5000)
    scored = recommend.evaluate(drawn, model, speed, max_risk=0.3)
    low = base.agg(*[F.min(f).alias(f"{f}__lo") for f in FEATURES], *[F.max(f).alias(f"{f}__hi") for f in FEATURES])
    inside = F.lit(True)
    for f in FEATURES:
        inside = inside & F.col(f).between(F.col(f"{f}__lo"), F.col(f"{f}__hi"))
    # The limit holds for the risk itself: a reported one is rounded, maybe onto the limit.
    exact = model.score(scored, "exact_risk").join(F.broadcast(low))
    told = F.round("exact_risk", 5) == F.col("predicted_risk")
    return exact.agg(
        F.count("*").alias("n_trials"), F.count_if(inside).alias("n_in_domain"),
        F.count_if(told & (F.col("feasible") == (F.col("exact_risk") <= 0.3))).alias("n_consistent"),
    )
