"""The counted forest against a plain tree, and its draws."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from runlens.operators import forest

WIDTHS = [0, 0, 3]


def sample(n, seed=1):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 9, n), rng.integers(0, 4, n), rng.integers(0, 3, n)], axis=1).astype(float)
    p = 0.1 + 0.5 * ((x[:, 0] > 4) & (x[:, 2] == 1)) + 0.2 * (x[:, 1] == 2)
    return x, (rng.random(n) < p).astype(float)


def frame(spark, x, y):
    return spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, label double")


def plain(x, y, weights, depth, least):
    """Failure share of every row under one tree, by loops over rows: no draws, all columns at every node."""
    out = np.zeros(len(y))

    def impurity(inside):
        a, b = weights[0] * (y[inside] == 0).sum(), weights[1] * (y[inside] == 1).sum()
        return (a + b), 1 - (a / (a + b)) ** 2 - (b / (a + b)) ** 2, b / (a + b)

    def grow(inside, left):
        total, own, share = impurity(inside)
        out[inside] = share
        best = (1e-12, None)
        tests = [x[:, s] <= v for s in (0, 1) for v in sorted(set(x[:, s]))] + [x[:, 2] != w for w in range(3)]
        for test in tests if left else []:
            a, b = inside & test, inside & ~test
            if a.sum() >= least and b.sum() >= least:
                (ta, ia, _), (tb, ib, _) = impurity(a), impurity(b)
                gain = own - ta / total * ia - tb / total * ib
                if gain > best[0] + 1e-12:
                    best = (gain, (a, b))
        for side in best[1] or ():
            grow(side, left - 1)

    grow(np.ones(len(y), bool), depth)
    return out


def test_one_tree_equals_a_plain_one(spark):
    x, y = sample(900)
    df = frame(spark, x, y)
    found = forest.fit(df, F.col("x"), WIDTHS, trees=1, depth=4, min_rows=5)
    weights = (len(y) / (2 * (y == 0).sum()), len(y) / (2 * (y == 1).sum()))
    rows = found.transform(df).select("x", F.col("probability")).collect()
    want = {tuple(a): p for a, p in zip(x, plain(x, y, weights, 4, 5))}
    assert all(abs(r["probability"][1] - want[tuple(r["x"])]) < 1e-9 for r in rows)
    # Two empty columns a word; shares add up to one, and unseen words or missing numbers have a place.
    assert len(found.featureImportances) == 2 + 3 + 2 and abs(sum(found.featureImportances) - 1) < 1e-9
    odd = spark.createDataFrame([([float("nan"), 1.0, 3.0],), ([2.0, float("nan"), 0.0],)], "x array<double>")
    assert all(0 <= r["probability"][1] <= 1 for r in found.transform(odd).collect())


def test_partitions_and_tasks_do_not_matter(spark, monkeypatch):
    x, y = sample(1500, seed=2)
    df = frame(spark, x, y)
    one = forest.fit(df.repartition(1), F.col("x"), WIDTHS, trees=6, depth=5)
    many = forest.fit(df.repartition(7), F.col("x"), WIDTHS, trees=6, depth=5)
    monkeypatch.setattr(forest, "running_together", lambda spark: 0)
    alone = forest.fit(df, F.col("x"), WIDTHS, trees=6, depth=5)
    assert len({tuple(t.slot) for t in one.trees}) > 1  # draws differ from tree to tree
    for other in (many, alone):
        assert [t.slot for t in other.trees] == [t.slot for t in one.trees]
        assert all(np.allclose(a.value, b.value) for a, b in zip(one.trees, other.trees))
    assert np.mean([r["probability"][1] for r in one.transform(df.where("label = 1")).collect()]) > 0.5


def test_rows_are_counted_before_the_fit(spark, monkeypatch):
    """A thousand times the runs are no more rows for the trees: equal bins and labels are one."""
    seen = []
    keep = forest.cut

    def watched(df):
        out = keep(df)
        seen.append(out.count())
        return out

    monkeypatch.setattr(forest, "cut", watched)
    x, y = sample(108)
    df = frame(spark, x, y)
    forest.fit(df.crossJoin(spark.range(50)).drop("id"), F.col("x"), WIDTHS, trees=2, depth=2)
    assert seen[0] == 5400 and seen[1] <= len({(*a, b) for a, b in zip(x, y)})


@pytest.mark.parametrize("n", [1.0, 3.0, 40.0, 500.0])
def test_draws_follow_the_poisson_distribution(n):
    key = np.random.default_rng(7).integers(-(1 << 62), 1 << 62, 40_000)
    got = forest.poisson(np.full(len(key), n), key, 5)
    assert np.array_equal(got, forest.poisson(np.full(len(key), n), key, 5)) and not np.array_equal(got, forest.poisson(np.full(len(key), n), key, 6))
    assert abs(got.mean() - n) < 5 * math.sqrt(n / len(key)) + 1e-9 and abs(got.var() / n - 1) < 0.05 and (got == np.round(got)).all()


def test_empty_and_one_sided_tables(spark):
    none = forest.fit(spark.createDataFrame([], "x array<double>, label double"), F.col("x"), WIDTHS, trees=2)
    assert none.trees == []
    sure = forest.fit(frame(spark, np.ones((30, 3)), np.ones(30)), F.col("x"), WIDTHS, trees=3)
    assert all(t.slot == [-1] and t.value == [1.0] for t in sure.trees)
