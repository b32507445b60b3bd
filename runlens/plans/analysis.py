"""The whole analysis of a corpus as a set of named report frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import (
    attribution, clustering, delta, frontier, learning, merge, rates, recommend, roles, scoring, summary, twins,
)
from ..session import cut
from ..sources import logs, tables


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """``(runs, errors)`` of a folder with run logs, CSV tables, or both."""
    kinds = {r["kind"] for r in tables.route(tables.file_listing(spark, path)).select("kind").distinct().collect()}
    log_runs = errors = None
    if "log" in kinds:
        blocks = logs.parse_blocks(logs.read_blocks(spark, path, below=True))
        log_runs, errors = logs.runs_of(blocks), logs.errors_of(blocks)
    found = tables.load_tables(spark, path) if "csv" in kinds else {}
    return merge.combine(found, log_runs, errors)


def run_analysis(
    runs: DataFrame, errors: DataFrame | None = None, max_risk: float = 0.02, n_trials: int = 2000, rounds: int = 400,
    seed: int = 42, leaky: list[str] = (), eps: float = 0.35, min_samples: int = 1, recommender: bool = True,
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """``(reports, failures)``: a stage that fails leaves a message and the others go on.

    Frames are lazy except where a model or an iteration needs data. ``runs`` is materialised
    once, because every stage reads it.
    """
    runs = cut(runs)
    features = roles.select_features(runs, leaky)
    reports: dict[str, DataFrame] = {}
    failures: dict[str, str] = {}

    def stage(name: str, make: Callable[[], DataFrame | dict[str, DataFrame]]) -> None:
        try:
            made = make()
            reports.update(made if isinstance(made, dict) else {name: made})
        except Exception as e:  # one bad stage must not lose the report
            failures[name] = f"{type(e).__name__}: {e}"

    if errors is not None:
        stage("summary", lambda: summary.corpus_summary(runs, errors))
        stage("severities", lambda: summary.severities(errors))
    stage("error_tags", lambda: summary.error_tags(runs))
    stage("metrics", lambda: summary.metric_stats(runs))
    if "execution_time_ms" in runs.columns:
        stage("time_by_tag", lambda: summary.time_by_tag(runs))

    state: dict = {"scored": scoring.observed_risk(runs), "importance": []}

    def risk() -> dict[str, DataFrame]:
        model, marked = learning.train_risk(runs, features, rounds=rounds, seed=seed)
        scored = cut(model.score(marked))
        state.update(model=model, scored=scored)
        held = scored.where("is_test")
        phi, _ = attribution.contributions(model, runs)
        long = attribution.long_form(cut(attribution.with_values(model, runs, phi)))
        ranked = attribution.importance(long)
        state["importance"] = [r["feature"] for r in ranked.orderBy("rank").collect()]
        return {
            "risk_areas": scoring.areas(held), "risk_metrics": scoring.threshold_metrics(held),
            "roc_curve": scoring.thin_curve(scoring.roc_points(held)), "roc_operating_points": scoring.operating_points(held),
            "importance": ranked, "importance_per_value": attribution.per_value(long), "beeswarm": attribution.beeswarm(long, ranked, seed=seed),
        }

    stage("risk_model", risk)
    stage("risk_bands", lambda: scoring.risk_bands(state["scored"]))
    stage("top_risk", lambda: scoring.top_risk(state["scored"], features))

    def clusters() -> dict[str, DataFrame]:
        failing = clustering.failing_runs(runs)
        templates = clustering.distinct_templates(failing)
        found = cut(clustering.cluster_templates(templates, eps, min_samples))
        return {
            "clusters": clustering.cluster_stats(failing, found),
            "cluster_tags": clustering.tag_breakdown(failing.join(found.select("tid", "cluster"), "tid")),
            "cluster_scatter": clustering.scatter(found, clustering.projection(templates)),
        }

    stage("fingerprints", clusters)

    def pareto() -> dict[str, DataFrame]:
        grouping = frontier.group_features(runs, features, state["importance"])
        points = cut(frontier.report_points(frontier.mark_frontier(frontier.configurations(state["scored"], grouping))))
        return {"frontier": points.where("is_pareto"), "cloud": frontier.cloud_sample(points), "operating_points": frontier.operating_points(points, max_risk)}

    stage("frontier", pareto)
    stage("delta", lambda: delta.aggregate_delta(runs, features))

    def pairs() -> dict[str, DataFrame]:
        found, num, cat = twins.nearest_twins(runs, features, seed=seed)
        diffs = cut(twins.twin_differences(runs, found, num, cat))
        return {"twin_fields": twins.field_ranking(diffs, features), "twin_pairs": twins.example_pairs(diffs)}

    stage("twins", pairs)
    stage("rate_by_field", lambda: rates.rate_by_field(runs, features))

    def advise() -> dict[str, DataFrame]:
        active, frozen = recommend.active_features(features, state["importance"])
        speed = learning.train_throughput(runs, features, rounds=rounds, seed=seed)
        space = recommend.search_space(runs, active)
        drawn = recommend.candidates(runs.sparkSession, runs, space, recommend.frozen_defaults(runs, frozen), n_trials, seed)
        scored = cut(recommend.evaluate(drawn, state["model"], speed, max_risk))
        return {
            "recommendations": recommend.best_candidates(scored), "search_summary": recommend.search_summary(scored, runs),
            "search_history": recommend.history(scored), "search_space": recommend.space_table(runs.sparkSession, space),
        }

    if recommender and "model" in state and "throughput_mbps" in runs.columns:
        stage("recommender", advise)
    return reports, failures
