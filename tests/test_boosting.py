"""Histogram boosting against a plain one-machine version, and its edge cases."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from runlens.operators import boosting, learning

RATE, LEAVES, MIN_LEAF = 0.3, 6, 4.0


def frame(spark, rows):
    """Rows of (numbers and codes, label, weight)."""
    df = spark.createDataFrame(rows, "x array<double>, label double, _weight double")
    return df.select(array_to_vector("x").alias("features"), "label", "_weight")


def sample(n, seed=1):
    """A number with gaps, a number with ties, and a word of four levels."""
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n).round(2), rng.integers(0, 5, n).astype(float), rng.integers(0, 4, n).astype(float)], axis=1)
    x[rng.random(n) < 0.1, 0] = np.nan
    odds = 1.5 * np.nan_to_num(x[:, 0], nan=-1.0) + np.where(np.isin(x[:, 2], [1, 3]), 1.0, -1.0)
    y = (rng.random(n) < 1 / (1 + np.exp(-odds))).astype(float)
    return x, y, rng.integers(1, 4, n).astype(float)


def sides(x, s, words, g, h):
    """All splits of one column as masks of the rows that go left."""
    if words:
        order = sorted(set(x[:, s]), key=lambda v: (g[x[:, s] == v].sum() / (h[x[:, s] == v].sum() + boosting.SMOOTH), v))
        return [np.isin(x[:, s], order[: k + 1]) for k in range(len(order))]
    return [x[:, s] <= v for v in sorted(set(x[~np.isnan(x[:, s]), s]))]


def plain(x, y, w, rounds, loss):
    """Margins of the same boosting by loops over rows."""
    mean = (w * y).sum() / w.sum()
    margin = np.full(len(y), mean if loss == "square" else np.log(mean / (1 - mean)))
    for _ in range(rounds):
        p = margin if loss == "square" else 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * (np.ones(len(y)) if loss == "square" else p * (1 - p))
        leaves, frontier = [np.ones(len(y), bool)], [0]
        while frontier and len(leaves) < LEAVES:
            found = []
            for leaf in frontier:
                inside, best = leaves[leaf], (1e-9, None)
                for s in range(x.shape[1]):
                    for left in sides(x[inside], s, s == 2, g[inside], h[inside]):
                        mask = np.zeros(len(y), bool)
                        mask[np.flatnonzero(inside)[left]] = True
                        a, b = mask, inside & ~mask
                        if w[a].sum() < MIN_LEAF or w[b].sum() < MIN_LEAF:
                            continue
                        gain = g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - g[inside].sum() ** 2 / h[inside].sum()
                        if gain > best[0] + 1e-12:
                            best = (gain, (a, b))
                if best[1]:
                    found.append((best[0], leaf, best[1]))
            frontier = []
            for _, leaf, (a, b) in sorted(found, key=lambda f: -f[0])[: LEAVES - len(leaves)]:
                leaves[leaf] = a
                leaves.append(b)
                frontier += [leaf, len(leaves) - 1]
        for inside in leaves:
            margin[inside] -= RATE * g[inside].sum() / h[inside].sum()
    return margin


def all_rows(train, rounds, loss, **options):
    return boosting.fit(train, [0, 0, 4], loss, rounds=rounds, rate=RATE, leaves=LEAVES, min_leaf=MIN_LEAF, row_share=1.0, column_share=1.0, **options)


@pytest.mark.parametrize("loss", ["log", "square"])
def test_equals_a_plain_version(spark, loss):
    x, y, w = sample(240)
    train = frame(spark, [(a.tolist(), float(b), float(c)) for a, b, c in zip(x, y, w)])
    model = all_rows(train, 12, loss, patience=0)  # past the round at which margins are stored
    assert len(model.trees) == 12
    assert np.allclose(model.margins(model.binning.bins(x)), plain(x, y, w, 12, loss), atol=1e-9)
    scored = model.margin(train).select("features", "_margin").collect()
    for r in scored[:40]:
        assert np.isclose(r["_margin"], model.margins(model.binning.bins(np.array([r["features"].toArray()])))[0])


def test_partitions_do_not_matter_and_patience_stops(spark):
    x, y, w = sample(800, seed=2)
    train = frame(spark, [(a.tolist(), float(b), float(c)) for a, b, c in zip(x, y, w)])
    fits = [boosting.fit(train.repartition(k), [0, 0, 4], rounds=60, rate=0.5, leaves=8, min_leaf=5, patience=4, held_share=0.3) for k in (1, 7)]
    assert np.allclose(fits[0].history, fits[1].history)
    model = fits[0]
    assert len(model.history) < 60 and len(model.trees) == model.best() == len(model.history) - 1 - 4
    assert model.history[model.best()] < model.history[0]


def test_missing_and_unknown_go_right(spark):
    scheme = boosting.Binning([np.array([1.0, 2.0]), np.zeros(0)], [0, 3])
    got = scheme.bins(np.array([[1.0, 0], [1.5, 2], [2.5, 3], [np.nan, np.nan], [-9.0, -1]]))
    assert got.tolist() == [[0, 0], [1, 2], [2, 3], [2, 3], [0, 3]]
    for words in (False, True):
        table = np.array([[-5.0, 5, 5], [1.0, 5, 5], [4.0, 5, 5]])
        gain, goes_left = boosting.best_split(table, words, 1)
        assert gain > 0 and not goes_left[-1]


def test_empty_constant_and_one_sided_tables(spark):
    empty = boosting.fit(frame(spark, []), [0, 0], rounds=3)
    assert empty.trees == [] and empty.base == 0.0
    flat = boosting.fit(frame(spark, [([1.0, float("nan")], 1.0, 50.0), ([1.0, float("nan")], 0.0, 50.0)]), [0, 0], rounds=3, patience=0)
    assert flat.trees == [] and abs(flat.base) < 1e-12
    sure = boosting.fit(frame(spark, [([float(i), 0.0], 1.0, 30.0) for i in range(5)]), [0, 0], rounds=3, patience=0)
    assert sure.margins(np.zeros((1, 2), dtype=np.int16))[0] > 10


def test_margin_keeps_the_columns_of_the_caller(spark):
    runs = spark.createDataFrame(
        [(f"R{i}", ["a", None, "b"][i % 3], float(i % 7), "fail" if i % 3 == 1 else "pass", 1) for i in range(300)],
        "run_id string, word string, number double, pass_fail string, features int",
    ).withColumnRenamed("features", "other")
    model, _ = learning.train_risk(runs, ["word", "number"], rounds=4)
    scored = model.score(runs)
    assert scored.columns == [*runs.columns, "risk"]
    assert sorted(map(tuple, scored.drop("risk").collect()), key=str) == sorted(map(tuple, runs.collect()), key=str)
    mean = {r["word"]: r["m"] for r in scored.groupBy("word").agg(F.avg("risk").alias("m")).collect()}
    assert mean[None] > mean["a"] and mean[None] > mean["b"]
    unseen = model.score(runs.limit(3).withColumn("word", F.lit("zz"))).collect()
    assert all(0 <= r["risk"] <= 1 and r["word"] == "zz" for r in unseen)


def jobs_of(spark, group, make):
    """What ``make`` gives, and how many Spark jobs it took."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        made = make()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return made, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("loss", ["log", "square"])
def test_more_rounds_take_no_more_jobs(spark, monkeypatch, loss):
    x, y, w = sample(600, seed=3)
    train = frame(spark, [(a.tolist(), float(b), float(c)) for a, b, c in zip(x, y, w)])
    fitted = lambda rounds: boosting.fit(train, [0, 0, 4], loss, rounds=rounds, rate=0.3, leaves=8, min_leaf=4, held_share=0.2)
    few, n_few = jobs_of(spark, f"few {loss}", lambda: fitted(1))
    more, n_more = jobs_of(spark, f"more {loss}", lambda: fitted(5))
    assert n_more == n_few and len(more.trees) > 1
    # With a job for every pass, as on several hosts, the model is the same.
    monkeypatch.setattr(boosting, "running_together", lambda spark: 0)
    other = fitted(5)
    assert np.allclose(other.history, more.history) and len(other.trees) == len(more.trees)
    bins = more.binning.bins(x)
    assert np.allclose(other.margins(bins), more.margins(bins), atol=1e-9)


def test_slots_share_codes_without_mixing():
    packed = boosting.Packed([256, 6, 8, 26, 13, 3])
    assert sorted(s for g in packed.groups for s in g) == list(range(6)) and max(packed.cells) <= boosting.JOINT_CELLS
    bins = np.random.default_rng(1).integers(0, [256, 6, 8, 26, 13, 3], (500, 6))
    codes = packed.codes(bins)
    for s in range(6):
        assert (packed.bin_of[s][codes[packed.group_of[s]]] == bins[:, s]).all()
    wide = boosting.Packed([5000])
    assert wide.groups == [[0]] and wide.codes(np.array([[4999]]))[0][0] == 4999


def test_slots_that_part_rows_alike_are_taken_in_order():
    table = np.array([[-5.0, 5, 50], [3.0, 5, 50], [0.0, 0, 0]])
    near = table.copy()
    near[0, 0] -= 1e-13  # the other slot gains more, by rounding alone
    scheme = boosting.Binning([np.array([1.0, 2.0])] * 2, [0, 0])
    tree = boosting.grown(lambda tree, leaves: {0: {0: table, 1: near}} if leaves == [0] else {}, scheme, [0, 1], 0.1, 4, 1)
    assert tree.slot[0] == 0
