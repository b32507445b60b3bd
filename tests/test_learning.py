"""Models, attribution and the whole analysis on a synthetic corpus with planted rules."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from runlens.operators import attribution, learning, rates, recommend, roles, rules, scoring, synthesis
from runlens.plans import analysis
from runlens.session import cut

SPECS = [
    {"name": "route", "kind": "choice", "values": ["air", "rail", "sea"], "weights": [0.5, 0.3, 0.2]},
    {"name": "crates", "kind": "choice", "values": [2, 12, 40]},
    {"name": "stops", "kind": "choice", "values": [1, 2, 4, 8]},
    {"name": "distance_km", "kind": "int", "low": 400, "high": 1200},
    {"name": "humidity", "kind": "normal", "mean": 60, "std": 12, "low": 5, "high": 100, "digits": 1},
]
PLANTED = [
    {"id": "P1", "conditions": [{"field": "route", "op": "==", "value": "rail"}, {"field": "crates", "op": ">=", "value": 40}],
     "effect": "set", "value": 0.8, "error_tag": "LOST"},
    {"id": "P2", "conditions": [{"field": "distance_km", "op": ">", "value": 1000}], "effect": "add", "value": 0.3, "error_tag": "LATE"},
]
KNOBS = [s["name"] for s in SPECS]


@pytest.fixture(scope="module")
def corpus(spark):
    keys = spark.range(6000).select(F.format_string("RUN-%05d", "id").alias("run_id"))
    df = rules.resolve(synthesis.sample_fields(keys, SPECS), PLANTED, 0.02, {"OTHER": 1.0})
    df = df.withColumns({"execution_time_ms": F.col("distance_km") / 2.0, "throughput_mbps": 50.0 * F.col("crates") / F.col("stops"), "cycles": F.col("distance_km") * 10})
    return cut(df.drop("prob").withColumn("test_name", F.when(F.col("stops") == 4, "wide").otherwise("narrow")))


@pytest.fixture(scope="module")
def model(corpus):
    return learning.train_risk(corpus, KNOBS, rounds=25, patience=8)


def test_model_learns_the_rules(model):
    risk, marked = model
    held = risk.score(marked.where("is_test"))
    assert scoring.areas(held).first()["roc_auc"] > 0.75
    assert marked.where("is_test").count() in (1199, 1200, 1201)


def test_contributions_add_up(corpus, model):
    risk, _ = model
    phi, base = attribution.contributions(risk, corpus)
    gap = phi.join(risk.margin(corpus), "run_id").select(F.abs(F.aggregate("phi", F.lit(0.0), lambda a, b: a + b) + base - F.col("margin")).alias("e"))
    assert gap.count() == 6000 and gap.agg(F.max("e")).first()[0] < 1e-9
    top = attribution.importance(attribution.long_contributions(risk, corpus, phi)).orderBy("rank").limit(3).collect()
    assert {"route", "crates", "distance_km"} == {r["feature"] for r in top}


def test_shapley_values_against_all_coalitions():
    games = [(2.0, [(0, [("<=", 1.0)], 0.25), (1, [("in", frozenset([0.0, 2.0]))], 0.5), (2, [(">", 3.0), ("<=", 9.0)], 0.3)]), (-1.0, [(2, [("<=", 3.0)], 0.7)])]
    rows = np.array([[0.0, 2.0, 5.0], [2.0, 1.0, 1.0], [1.0, 0.0, 10.0]])

    def value(x, members):
        total = 0.0
        for v, parts in games:
            for f, tests, share in parts:
                v *= float(attribution._holds(x[[f]], tests)[0]) if f in members else share
            total += v
        return total

    want = np.zeros(rows.shape)
    for r, x in enumerate(rows):
        for f in range(3):
            others = [g for g in range(3) if g != f]
            for k in range(3):
                for s in itertools.combinations(others, k):
                    w = math.factorial(k) * math.factorial(2 - k) / 6
                    want[r, f] += w * (value(x, {*s, f}) - value(x, set(s)))
    assert np.allclose(attribution.shapley(games, rows), want)


def test_tabled_contributions_are_the_shapley_values(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = [9, 4, 30, 6]
    games = []
    for _ in range(60):
        path = rng.choice(4, rng.integers(1, 5), replace=False).tolist()
        games.append((float(rng.normal()), [(f, [("at", rng.random(sizes[f]) < 0.6)], float(rng.random())) for f in path]))
    bins = np.stack([rng.integers(0, n, 700) for n in sizes], axis=1).astype(np.int16)
    want = attribution.shapley(games, bins)
    for cells in (1, 64, 4096):
        monkeypatch.setattr(attribution, "TABLE_CELLS", cells)
        groups = attribution.grouped(games, sizes)
        assert [k for members, _ in groups for k in members] == list(range(60))
        assert (len(groups) == 60) == (cells == 1)
        assert np.allclose(attribution.explained(games, sizes, bins).T, want, atol=1e-12)


def test_long_paths_and_small_blocks_add_up(corpus, model, monkeypatch):
    risk, _ = model
    monkeypatch.setattr(attribution, "MOST_SLOTS", 2)
    monkeypatch.setattr(attribution, "BLOCK_ROWS", 100)
    runs = corpus.limit(900)
    phi, base = attribution.contributions(risk, runs)
    gap = phi.join(risk.margin(runs), "run_id").select(F.abs(F.aggregate("phi", F.lit(0.0), lambda a, b: a + b) + base - F.col("margin")).alias("e"))
    assert gap.count() == 900 and gap.agg(F.max("e")).first()[0] < 1e-9


def test_planted_rules_are_found(corpus):
    support = {r["rule_id"]: r for r in rules.support(corpus, PLANTED).collect()}
    assert all(r["lift"] > 1.3 and r["rows_matched"] > 25 for r in support.values())
    best = rates.interactions(corpus, ["route", "crates", "stops"]).orderBy(F.desc("lift"), F.desc("support")).first()
    assert "route=rail" in best["conditions"] and "crates=40" in best["conditions"]


def test_results_do_not_depend_on_partitions(corpus):
    one = rates.rate_by_field(corpus.coalesce(1), KNOBS).collect()
    many = rates.rate_by_field(corpus.repartition(16), KNOBS).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


@pytest.mark.parametrize("name", sorted(learning.BASELINES))
def test_baselines(corpus, name):
    chosen = {"numeric": ["distance_km", "humidity"], "categorical": ["route", "crates"]}
    risk, marked = learning.train_baseline(corpus, chosen, name, scale=0.02)
    assert scoring.areas(risk.score(marked.where("is_test"))).first()["roc_auc"] > 0.65
    if name == "random_forest":
        ranked = learning.rolled_up_importances(learning.raw_importances(corpus.sparkSession, risk), learning.lineage_table(corpus.sparkSession, risk.encoder))
        assert abs(sum(r["importance"] for r in ranked.collect()) - 1) < 0.01


def test_unknown_baseline(corpus):
    with pytest.raises(ValueError):
        learning.train_baseline(corpus, {"numeric": [], "categorical": []}, "nope")


def test_recommendations_avoid_the_rules(corpus, model):
    risk, _ = model
    speed = learning.train_throughput(corpus, KNOBS, rounds=15)
    drawn = recommend.candidates(corpus.sparkSession, corpus, recommend.search_space(corpus, KNOBS), {}, 3000)
    scored = cut(recommend.evaluate(drawn, risk, speed, max_risk=0.25))
    best = recommend.best_candidates(scored).collect()
    assert len(best) == 10 and all(r["feasible"] for r in best)
    assert not any(r["route"] == "rail" and r["crates"] == 40 for r in best)
    none = recommend.best_candidates(recommend.evaluate(drawn, risk, speed, max_risk=0.0)).collect()
    assert len(none) == 10 and all(r["is_fallback"] for r in none)


def test_words_are_drawn_from_their_levels(corpus):
    runs = corpus.withColumn("blank", F.lit(None).cast("string"))
    space = recommend.search_space(runs, ["route", "stops", "blank"])
    assert space["route"] == {"kind": "choice", "n": 3} and space["blank"] == {"kind": "choice", "n": 0}
    drawn = recommend.candidates(runs.sparkSession, runs, space, {}, 900)
    assert drawn.where("blank is not null").count() == 0
    sizes = {r["route"]: r["count"] for r in drawn.groupBy("route").count().collect()}
    assert sum(sizes.values()) == 900 and set(sizes) == {"air", "rail", "sea"} and min(sizes.values()) > 200


def test_whole_analysis(corpus):
    errors = corpus.where("pass_fail = 'fail'").select("run_id", F.lit("ERROR").alias("severity"))
    runs = corpus.withColumn("trace_fingerprint", F.when(F.col("pass_fail") == "fail", F.concat(F.lit("unit fault "), F.lower("primary_error_tag"))).otherwise("CLEAN"))
    reports, failures = analysis.run_analysis(runs.withColumn("error_trace", F.col("trace_fingerprint")), errors, max_risk=0.3, n_trials=500, rounds=4)
    assert failures == {}
    assert reports["summary"].first()["n_runs"] == 6000
    for name in ("clusters", "frontier", "operating_points", "delta", "twin_fields", "rate_by_field", "recommendations", "importance", "roc_curve", "top_risk"):
        assert reports[name].count() > 0, name


def test_a_bad_stage_does_not_stop_the_others(corpus, monkeypatch):
    def broken(*args, **kwargs):
        raise ValueError("no frontier today")

    monkeypatch.setattr(analysis.frontier, "configurations", broken)
    reports, failures = analysis.run_analysis(corpus, rounds=2, recommender=False)
    assert failures == {"frontier": "ValueError: no frontier today"}
    assert "frontier" not in reports and reports["rate_by_field"].count() > 0 and reports["twin_fields"].count() > 0


def test_feature_choice(corpus):
    assert set(roles.select_features(corpus, ["humidity"])) == {*KNOBS, "test_name"} - {"humidity"}
