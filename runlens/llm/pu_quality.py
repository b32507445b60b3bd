"""Quality scores by positive-unlabelled learning.

A linear model over text ratios minimises the non-negative unbiased risk: trusted positives, unlabelled web text and a class
prior estimated from both. No negative label is read. Each step of the fit sums gradients over all unlabelled rows on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, small_or_plain, stored, text_or_empty, words
from .quality_rules import CAPITALS, STOP_WORDS

POSITIVES = 20_000  # most trusted rows of a fit
STEPS = 80
RATE = 0.5
DECAY = 1e-3
BINS = 200
THRESHOLD = 0.7


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(0.0)


def features(df: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """Add the model's inputs, all between 0 and 1 or so; an empty or null text has zeros. Gives their names too."""
    body = text_or_empty(text)
    df = df.withColumn("__words", words(body))
    w, chars = F.col("__words"), F.length(body)

    def count(drop: str) -> Column:
        return chars - F.length(F.translate(body, drop, ""))

    df = df.withColumns({
        "__n": F.size(w),
        "__chars": F.length(F.translate(body, SPACES, "")),
        "__lines": F.filter(F.split(body, "\n"), lambda x: F.translate(x, SPACES, "") != ""),
        "__again": F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))),
        "__stop": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))),
        "__capitals": count(CAPITALS),
        "__symbols": count("#*$%&<>=_~^"),
        "__bars": count("|"),
        "__cries": count("!"),
        "__digits": count("0123456789"),
        "__marks": count(".,;:?"),
    })
    n, chars = F.col("__n"), F.col("__chars")
    size = F.size("__lines")
    squashed = {
        "f_length": F.log1p(n.cast("double")) / 10,
        "f_word": F.least(_ratio(chars, n) / 12, F.lit(2.0)),
        "f_again": F.sqrt(_ratio(F.col("__again"), n)),
        "f_stop": F.sqrt(_ratio(F.col("__stop"), n)),
        "f_capitals": F.sqrt(_ratio(F.col("__capitals"), chars)),
        "f_symbols": F.sqrt(F.least(_ratio(F.col("__symbols"), n), F.lit(1.0))),
        "f_bars": F.sqrt(F.least(_ratio(F.col("__bars"), n), F.lit(1.0))),
        "f_cries": F.sqrt(F.least(_ratio(F.col("__cries"), n), F.lit(1.0))),
        "f_digits": F.sqrt(_ratio(F.col("__digits"), chars)),
        "f_marks": F.sqrt(F.least(_ratio(F.col("__marks"), n), F.lit(1.0))),
        "f_same_lines": _ratio(size - F.size(F.array_distinct("__lines")), size),
        "f_lines": F.sqrt(F.least(_ratio(size, n), F.lit(1.0))),
    }
    return df.withColumns(squashed).drop(*[c for c in df.columns if c.startswith("__")]), list(squashed)


@dataclass(frozen=True)
class Model:
    names: list[str]
    means: list[float]
    scales: list[float]
    weights: list[float]
    bias: float
    prior: float

    def score(self) -> Column:
        """Probability of the positive class, as an expression over the features."""
        z = F.lit(self.bias)
        for name, mean, scale, weight in zip(self.names, self.means, self.scales, self.weights):
            z = z + (F.col(name) - mean) / scale * weight
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sums(rows: DataFrame, names: list[str], centre: np.ndarray, weights: np.ndarray, edges: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Over all rows: the logistic loss of calling them negative, its gradient, or, with ``edges``, a histogram of margins."""
    mean, scale = centre

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(edges) + 1 if edges is not None else len(names) + 2), 0
        for batch in batches:
            x = (np.stack([batch.column(c).to_numpy() for c in names], axis=1) - mean) / scale
            z = x @ weights[:-1] + weights[-1]
            if edges is not None:
                total += np.bincount(np.searchsorted(edges, z, side="right"), minlength=len(total))
            else:
                p = _sigmoid(z)
                total += np.concatenate([[np.logaddexp(0, z).sum()], p @ x, [p.sum()]])
            n += len(z)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["total", "n"])

    parts = rows.select(*names).mapInArrow(part, "total array<double>, n long")
    width = len(edges) + 1 if edges is not None else len(names) + 2
    summed = parts.agg(*[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)], F.sum("n").alias("n")).first()
    return np.array([summed[i] or 0.0 for i in range(width)]), summed["n"] or 0


def fit(unlabelled: DataFrame, positives: DataFrame, names: list[str], steps: int = STEPS, prior: float | None = None) -> Model:
    """Fit on stored tables of features. ``positives`` is bounded by the caller and is read to the driver once.

    First a plain classifier of trusted against unlabelled rows orders the texts; the prior is the least ratio, over
    upper parts of that order, of the unlabelled to the trusted share. Then the non-negative risk is minimised: while the
    estimated negative risk is below zero its gradient is followed the other way.
    """
    moments = unlabelled.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(names)]).first()
    k = len(names)
    mean = np.array([moments[i] or 0.0 for i in range(k)])
    scale = np.array([max(moments[k + i] or 0.0, 1e-3) for i in range(k)])
    trusted = positives.select(*names).toPandas().to_numpy(dtype=float).reshape(-1, k)
    centre = np.stack([mean, scale])
    if not len(trusted):
        return Model(names, mean.tolist(), scale.tolist(), [0.0] * k, 0.0, 0.5)
    xp = np.hstack([(trusted - mean) / scale, np.ones((len(trusted), 1))])

    def descend(gradient, rounds: int) -> np.ndarray:
        w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
        for t in range(1, rounds + 1):
            g = gradient(w) + DECAY * np.append(w[:-1], 0.0)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - RATE / np.sqrt(t) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return w

    def negative(w: np.ndarray) -> tuple[float, np.ndarray]:
        total, n = _sums(unlabelled, names, centre, w)
        return total[0] / max(n, 1), total[1:] / max(n, 1)

    if prior is None:
        plain = descend(lambda w: negative(w)[1] - xp.T @ _sigmoid(-(xp @ w)) / len(xp), steps // 4)
        margins = xp @ plain
        edges = np.unique(np.quantile(margins, np.linspace(0, 1, BINS + 1)))
        above_p = 1 - np.searchsorted(np.sort(margins), edges) / len(margins)
        counts, n = _sums(unlabelled, names, centre, plain, edges)
        above_u = (n - np.cumsum(counts[:-1])) / max(n, 1)
        slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(margins)) + 1 / np.sqrt(max(n, 1)))
        use = above_p >= 0.2
        best = np.argmin((above_u[use] + slack) / above_p[use])
        prior = float(np.clip(above_u[use][best] / above_p[use][best], 0.05, 0.98))

    def risk(w: np.ndarray) -> np.ndarray:
        z = xp @ w
        good = -(xp.T @ _sigmoid(-z)) / len(xp)
        wrong, slope = negative(w)
        excess = wrong - prior * np.logaddexp(0, z).mean()
        other = slope - prior * (xp.T @ _sigmoid(z)) / len(xp)
        return prior * good + other if excess >= 0 else -other

    w = descend(risk, steps)
    return Model(names, mean.tolist(), scale.tolist(), w[:-1].tolist(), float(w[-1]), prior)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, steps: int = STEPS) -> tuple[DataFrame, Model]:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (doc_id, text), and the model.

    Trusted rows are those that ``labels`` (doc_id, quality) marks 1 outside the held-out part, the ``positives`` of smallest hash; a
    doc_id with several labels counts if all are 1. All rows outside the held-out part are the unlabelled text. Null and
    empty texts have features of 0 and a score; a null doc_id is never trusted; repeated rows score alike. With no trusted row all scores are 0.5.
    """
    rows, names = features(docs.select("doc_id", "text"))
    rows = stored(rows.drop("text").withColumn("held_out", held_out()), "quality-features")
    good = labels.where(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = good.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).select(F.col("doc_id").alias("good"))
    trusted = rows.join(small_or_plain(stored(good, "trusted"), positives), F.col("doc_id") == F.col("good")).dropDuplicates(["doc_id"])
    model = fit(rows.where("NOT held_out"), stored(trusted.select(*names), "trusted-features"), names, steps)
    scored = rows.select("doc_id", "held_out", model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)), model
