"""Random forest on counted configurations.

Runs of equal bins and label are one row with their number, so the rows of a fit are bounded by the bins whatever the
number of runs. Every tree draws each run with replacement (Poisson, by a hash of the row), every node a few columns. Tasks count
(node, slot, bin, label) over their rows and exchange the counts; counts are whole numbers, so the forest does not
depend on how rows are dealt. Words split one level against the rest, as their one-hot columns do.
"""

from __future__ import annotations

import math
import os
import pickle
import shutil
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut, shared_dir
from .boosting import Binning, Exchange, Tree, binning, local_folder, running_together, vectors, walked

MANY = 200.0  # runs of a row from which their draws follow the normal distribution


@dataclass
class Forest:
    """Trees of failure shares on binned slots; ``columns`` are the encoded ones: slot and level, -1 for numbers."""

    binning: Binning
    x: Column
    columns: list[tuple[int, int]]
    trees: list[Tree] = field(default_factory=list)
    featureImportances: DenseVector | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` of passing and failing, the mean of all trees."""
        # A few hundred trees of bounded size, as arrays: executors have no classes of this package to load.
        shared = df.sparkSession.sparkContext.broadcast([(t.steps(), np.asarray(t.value)) for t in self.trees])
        scheme = self.binning

        @F.arrow_udf("double")
        def mean(x: pa.Array) -> pa.Array:
            bins = scheme.bins(vectors(x, len(scheme.cuts)))
            out = np.zeros(len(bins))
            for steps, value in shared.value:
                out += value[walked(steps, bins)]
            return pa.array(out / max(len(shared.value), 1))

        p = F.col("_p")
        return df.withColumn("_p", mean(self.x)).withColumn("probability", array_to_vector(F.array(1 - p, p))).drop("_p")


def poisson(n: np.ndarray, key: np.ndarray, seed: int) -> np.ndarray:
    """How often the ``n`` runs of each row are drawn with replacement: a function of row key and seed."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
        u = (z >> np.uint64(11)).astype(float) / float(1 << 53)
        v = ((z * np.uint64(0xD1342543DE82EF95) + np.uint64(1)) >> np.uint64(11)).astype(float) / float(1 << 53)
    out = np.zeros(len(n))
    many = n > MANY
    normal = np.sqrt(-2 * np.log(1 - u[many])) * np.cos(2 * math.pi * v[many])
    out[many] = np.maximum(0.0, np.round(n[many] + np.sqrt(n[many]) * normal))
    left = np.flatnonzero(~many)
    p = np.exp(-n[left])
    below, k = p.copy(), 0
    while len(left):
        above = (u[left] >= below) & (p > 0)
        left, p, below = left[above], p[above], below[above]
        k += 1
        out[left] = k
        p = p * n[left] / k
        below = below + p
    return out


def gini(c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    total = np.maximum(c0 + c1, 1e-300)
    return 1.0 - (c0 / total) ** 2 - (c1 / total) ** 2


def grown(rows: dict, sizes: list[int], columns: list[tuple[int, int]], drawn: np.ndarray, weights: tuple[float, float], exchanged, depth: int, min_rows: float, chosen: int, seed: list[int]) -> tuple[Tree, np.ndarray]:
    """One tree over the drawn rows of all tasks, and the gain of every column in it."""
    starts = np.cumsum([0, *sizes])
    at = np.flatnonzero(drawn > 0)
    label, n = rows["label"][at].astype(np.intp), drawn[at]
    bins = [b[at] for b in rows["bins"]]
    node = np.zeros(len(at), dtype=np.intp)
    tree, gains, names = Tree(), np.zeros(len(columns)), [0]
    tree.add(0.0, 0.0)
    for level in range(depth + 1):
        m = len(names)
        table = np.zeros((m, starts[-1], 2))
        for s, b in enumerate(bins):
            code = (node * sizes[s] + b) * 2 + label
            table[:, starts[s] : starts[s + 1]] = np.bincount(code, n, m * sizes[s] * 2).reshape(m, sizes[s], 2)
        table = exchanged(table)
        whole = table[:, : starts[1]].sum(axis=1)
        p0, p1 = whole[:, 0] * weights[0], whole[:, 1] * weights[1]
        for k, name in enumerate(names):
            tree.value[name], tree.cover[name] = float(p1[k] / max(p0[k] + p1[k], 1e-300)), float(p0[k] + p1[k])
        if level == depth or not whole.any():
            break
        # Bins that go left, for every threshold of a number and every level of a word; columns without a split stay out.
        asked = np.random.default_rng([*seed, level]).random((m, len(columns))).argsort(axis=1).argsort(axis=1) < chosen
        best, pick = np.zeros(m), np.full((m, 2), -1)
        for c, (s, word) in enumerate(columns):
            own = table[:, starts[s] : starts[s + 1]]
            if word >= sizes[s]:
                continue
            left = np.cumsum(own, axis=1)[:, :-1] if word < 0 else whole[:, None] - own[:, word : word + 1]
            right = whole[:, None] - left
            ok = asked[:, c, None] & (left.sum(axis=2) >= min_rows) & (right.sum(axis=2) >= min_rows)
            l0, l1, r0, r1 = left[..., 0] * weights[0], left[..., 1] * weights[1], right[..., 0] * weights[0], right[..., 1] * weights[1]
            total = np.maximum(p0 + p1, 1e-300)[:, None]
            gain = gini(p0, p1)[:, None] - (l0 + l1) / total * gini(l0, l1) - (r0 + r1) / total * gini(r0, r1)
            gain = np.where(ok, gain, 0.0)
            if gain.shape[1]:
                k = gain.argmax(axis=1)
                more = gain[np.arange(m), k] > best + 1e-12
                best[more] = gain[np.arange(m), k][more]
                pick[more] = np.stack([np.full(m, c), k], axis=1)[more]
        children = np.full((m, 2), -1)
        goes = np.zeros((m, max(sizes)), dtype=bool)
        slot_of, later = np.zeros(m, dtype=np.intp), []
        for k in np.flatnonzero(pick[:, 0] >= 0).tolist():
            c, t = pick[k].tolist()
            s, word = columns[c]
            side = np.arange(sizes[s]) <= t if word < 0 else np.arange(sizes[s]) != word
            tree.split(names[k], s, side, tree.add(0.0, 0.0), tree.add(0.0, 0.0))
            gains[c] += best[k] * (p0[k] + p1[k])
            goes[k, : sizes[s]], slot_of[k], children[k] = side, s, (len(later), len(later) + 1)
            later += [tree.left[names[k]], tree.right[names[k]]]
        if not later:
            break
        kept = children[node, 0] >= 0
        node, label, n, bins = node[kept], label[kept], n[kept], [b[kept] for b in bins]
        own_bin = np.zeros(len(node), dtype=np.intp)
        for s, b in enumerate(bins):
            own_bin = np.where(slot_of[node] == s, b, own_bin)
        node = np.where(goes[node, own_bin], children[node, 0], children[node, 1])
        names = later
    return tree, gains


def fit(
    train: DataFrame, x: Column, widths: list[int], spare: int = 2, trees: int = 200, depth: int = 12, min_rows: int = 5, bins: int = 32, seed: int = 42,
) -> Forest:
    """Forest on slots ``x`` (numbers, and codes of words) and ``label`` with balanced classes; ``widths`` as in `boosting.binning`.

    A word has a column for each level and ``spare`` ones that no training row fills; they too may be drawn by a node.
    """
    rows = cut(train.select(x.alias("x"), F.col("label").cast("double").alias("label")))
    scheme = binning(rows, widths, bins - 1)
    scheme.levels = list(widths)
    sizes, n_slots = scheme.sizes(), len(widths)
    columns = [(s, w) for s, n in enumerate(widths) for w in (range(n + spare) if n else (-1,))]

    def to_bins(batches):
        for batch in batches:
            b = scheme.bins(vectors(batch.column(0), n_slots)).astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(len(b) + 1, dtype=np.int32) * n_slots, pa.array(b.ravel()))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1)], ["b", "label"])

    cells = rows.mapInArrow(to_bins, "b array<int>, label double").groupBy("b", "label").agg(F.count("*").cast("double").alias("n"))
    cells = cut(cells.withColumn("key", F.xxhash64("b", "label")))
    sums = {r["label"]: r["n"] for r in cells.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    total = sum(sums.values())
    weights = tuple(total / (2 * sums[c]) if sums.get(c) else 0.0 for c in (0.0, 1.0))
    chosen = math.ceil(math.sqrt(len(columns))) if trees > 1 else len(columns)
    tasks = running_together(train.sparkSession)
    folder = f"{local_folder(shared_dir(train.sparkSession))}/counts-{uuid.uuid4().hex}"
    if tasks:
        os.makedirs(folder)

    def task(batches):
        parts = [(np.zeros((0, n_slots), dtype=np.int64), np.zeros(0), np.zeros(0), np.zeros(0, dtype=np.int64))]
        for batch in batches:
            parts.append((vectors(batch.column(0), n_slots), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))))
        b, label, n, key = (np.concatenate(c) for c in zip(*parts))
        own = {"bins": [np.ascontiguousarray(b[:, s]).astype(np.intp) for s in range(n_slots)], "label": label}
        exchanged = Exchange(folder) if tasks else lambda table: table
        found, gains = [], np.zeros(len(columns))
        for t in range(trees):
            drawn = poisson(n, key, seed * 100_003 + t) if trees > 1 else n
            tree, gain = grown(own, sizes, columns, drawn, weights, exchanged, depth, min_rows, chosen, [seed, t])
            found.append((tree.slot, tree.left, tree.right, tree.goes_left, tree.value, tree.cover))
            gains += gain / gain.sum() if gain.sum() else 0.0
        if not tasks or BarrierTaskContext.get().partitionId() == 0:
            yield pa.RecordBatch.from_pydict({"forest": pa.array([pickle.dumps((found, gains))], pa.binary())})

    forest = Forest(scheme, x, columns)
    if not total:
        return forest
    own = train.sparkSession.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    dealt = own.read.schema(cells.schema).parquet(*cells.inputFiles()).select("b", "label", "n", "key").repartition(max(tasks, 1), "key")
    try:
        found, gains = pickle.loads(dealt.mapInArrow(task, "forest binary", barrier=bool(tasks)).collect()[0]["forest"])
    finally:
        if tasks:
            shutil.rmtree(folder, ignore_errors=True)
    forest.trees = [Tree(*t) for t in found]
    forest.featureImportances = DenseVector(gains / gains.sum() if gains.sum() else gains)
    return forest
