import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from runlens.functions import ordered
from runlens.operators import explore, frontier, scoring


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    cols = {"a": rng.normal(size=5001), "b": rng.integers(0, 4, 5001).astype(float), "c": np.r_[np.zeros(4000), rng.random(1001)]}
    rows = [(k, float(v)) for k, vs in cols.items() for v in vs] + [("a", None), ("b", float("nan"))]
    probs = [0.0, 0.05, 1 / 3, 0.5, 0.95, 1.0]
    got = ordered.exact_quantiles(spark.createDataFrame(rows, "field string, value double").repartition(5), probs).collect()
    for r in got:
        want = np.quantile(cols[r["field"]], probs)
        assert np.allclose([r[f"q{i}"] for i in range(len(probs))], want)


def test_running(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(["x", "y"], 3000), "k": rng.permutation(3000), "v": rng.integers(0, 9, 3000), "m": rng.random(3000)})
    out = ordered.running(spark.createDataFrame(pdf).repartition(7), "k", sums=["v"], mins=["m"], nexts=["v"], by="g").toPandas().sort_values(["g", "k"])
    pdf = pdf.sort_values(["g", "k"])
    want = pdf.groupby("g")
    assert (out["cum_v"].to_numpy() == want["v"].cumsum().to_numpy()).all()
    prior = want["m"].transform(lambda s: s.cummin().shift())
    assert np.allclose(out["prior_min_m"].fillna(-1), prior.fillna(-1))
    assert np.allclose(out["next_v"].fillna(-1), want["v"].shift(-1).fillna(-1))


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 1.0])
def test_exact_share(spark, share):
    df = spark.range(1001).select("id", F.when(F.col("id") % 3 == 0, "fail").otherwise("pass").alias("v"))
    out = ordered.exact_share(df, "id", share, 5, "v").groupBy("v").agg(F.count_if("picked").alias("p"), F.count("*").alias("n"))
    assert all(r["p"] == int(r["n"] * share + 0.5) for r in out.collect())
    again = ordered.exact_share(df.repartition(9), "id", share, 5, "v").where("picked").count()
    assert again == sum(r["p"] for r in out.collect())


def test_areas_against_pairs(spark):
    rng = np.random.default_rng(3)
    y = rng.random(700) < 0.3
    s = np.round(rng.random(700) * 0.5 + 0.2 * y, 2)
    df = spark.createDataFrame([("fail" if a else "pass", float(b)) for a, b in zip(y, s)], "pass_fail string, risk double")
    pos, neg = s[y], s[~y]
    auc = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    cuts = np.unique(s)[::-1]
    tp = np.array([(pos >= c).sum() for c in cuts]); fp = np.array([(neg >= c).sum() for c in cuts])
    ap = np.sum(np.diff(np.r_[0, tp]) / len(pos) * tp / (tp + fp))
    got = scoring.areas(df).first()
    assert got["roc_auc"] == pytest.approx(auc, abs=1e-6) and got["pr_auc"] == pytest.approx(ap, abs=1e-6)
    curve = scoring.roc_points(df).orderBy("idx").collect()
    assert (curve[0]["fpr"], curve[0]["tpr"]) == (0.0, 0.0) and (curve[-1]["fpr"], curve[-1]["tpr"]) == (1.0, 1.0)


def test_frontier_equals_sweep(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"signature": [f"s{i:04d}" for i in range(2000)], "throughput": rng.integers(0, 400, 2000) / 4, "risk": rng.integers(0, 500, 2000) / 1000})
    out = frontier.mark_frontier(spark.createDataFrame(pdf)).where("is_pareto").select("signature").toPandas()
    best, want = np.inf, set()
    for r in pdf.sort_values(["throughput", "risk", "signature"], ascending=[False, True, True]).itertuples():
        if r.risk < best:
            best = r.risk
            want.add(r.signature)
    assert set(out["signature"]) == want


def test_deep_page_equals_shallow(spark, monkeypatch):
    df = spark.range(5000).select(F.concat(F.lit("R"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("run_id"), (F.col("id") % 17).alias("x"))
    shallow = explore.page(df, 37, 50, "x", True).collect()
    monkeypatch.setattr(explore, "TOP_ROWS", 0)
    assert explore.page(df, 37, 50, "x", True).collect() == shallow and len(shallow) == 50
