"""Boosted trees from histograms of gradients.

Rows stay in their tasks as small bin numbers. A pass over them adds up first and second derivatives per
(leaf, column, bin). A tree grows in passes, always splitting the open leaves of most gain, up to a number
of leaves. Rows and columns are drawn anew for each tree, rows by a hash of their values. A tenth of the training
configurations, held apart by hash, stops the rounds when their loss has not fallen for ``patience`` rounds.

Sums are at most leaves x columns x bins whatever the number of rows. On one host the whole fit is one barrier stage:
tasks keep their rows between passes, exchange sums, and each picks the same splits. On several hosts, or where tasks
can't be sure to run together (dynamic allocation), every pass is a Spark job and the driver picks the splits.

Missing numbers, and words that the fit has not seen, take the right branch of every split.
"""

from __future__ import annotations

import os
import pickle
import shutil
import time
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut, scratch_path, shared_dir, spread

BINS = 255  # thresholds of a number; a word column with more levels is split by the order of its codes
SMOOTH = 10.0  # weight that draws the order of a rare word towards zero
SAVE_EVERY = 10  # rounds after which the margins of all rows are stored
LEAST_HESSIAN = 1e-3
LEAST_FALL = 1e-4  # share of the first held-out loss by which a round must lower the best one to count as a gain
SUM_PARTITIONS = 8  # a pass sums at most leaves x columns x bins rows
JOINT_CELLS = 1024  # slots of few bins share a code of at most so many values, so one count serves them all
MOST_TASKS = 64  # that exchange sums; each receives those of all others
LONGEST_WAIT = 3600  # seconds for the sums of another task
HISTOGRAM = "leaf int, slot int, bin int, g double, h double, n double"


@dataclass
class Binning:
    """Per slot the thresholds of a number, or the number of levels of a word column."""

    cuts: list[np.ndarray]
    levels: list[int]

    def sizes(self) -> list[int]:
        """Bins of every slot, the one of the missing included."""
        return [n + 1 if n else len(c) + 1 for c, n in zip(self.cuts, self.levels)]

    def width(self) -> int:
        return max(self.sizes())

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin of every value; the last one of a slot holds the missing and the unknown."""
        out = np.empty(x.shape, dtype=np.int16)
        for s, (cuts, levels) in enumerate(zip(self.cuts, self.levels)):
            if levels:
                code = np.nan_to_num(x[:, s], nan=levels)
                out[:, s] = np.where((code >= 0) & (code < levels), code, levels)
            else:
                out[:, s] = np.searchsorted(cuts, x[:, s], side="left")
        return out


@dataclass
class Tree:
    """Nodes in order of creation: a split has ``slot >= 0``, the bins that go left, and two children."""

    slot: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    goes_left: list[np.ndarray | None] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for column, v in zip((self.slot, self.left, self.right, self.goes_left, self.value, self.cover), (-1, -1, -1, None, value, cover)):
            column.append(v)
        return len(self.slot) - 1

    def split(self, node: int, slot: int, goes_left: np.ndarray, left: int, right: int) -> None:
        self.slot[node], self.goes_left[node], self.left[node], self.right[node] = slot, goes_left, left, right

    def steps(self) -> tuple[np.ndarray, np.ndarray, int]:
        """The tree as arrays: next node by node and bin (a leaf leads to itself), slot by node, and its depth."""
        n_nodes, width = len(self.slot), max((len(t) for t in self.goes_left if t is not None), default=1)
        step = np.repeat(np.arange(n_nodes), width).reshape(n_nodes, width)
        depth = [0] * n_nodes
        for node, slot in enumerate(self.slot):  # children come after their parent
            if slot >= 0:
                table = self.goes_left[node]
                step[node, : len(table)] = np.where(table, self.left[node], self.right[node])
                depth[self.left[node]] = depth[self.right[node]] = depth[node] + 1
        return step, np.maximum(self.slot, 0), max(depth)

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """Node that each row ends in."""
        return walked(self.steps(), bins)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.leaf_of(bins)]

    def paths(self) -> list[tuple[int, list[tuple[int, int, np.ndarray]]]]:
        """Leaves with their path: parent node and side, slot, and the bins that stay on the path."""
        out, stack = [], [(0, [])]
        while stack:
            node, path = stack.pop()
            if self.slot[node] < 0:
                out.append((node, path))
                continue
            table = self.goes_left[node]
            stack.append((self.right[node], [*path, (self.right[node], self.slot[node], ~table)]))
            stack.append((self.left[node], [*path, (self.left[node], self.slot[node], table)]))
        return out


def walked(steps: tuple[np.ndarray, np.ndarray, int], bins: np.ndarray) -> np.ndarray:
    """Node that each row ends in: all rows take one step down at a time."""
    step, slots, depth = steps
    width, flat, first = step.shape[1], np.ascontiguousarray(bins).ravel(), np.arange(len(bins)) * bins.shape[1]
    at = np.zeros(len(bins), dtype=np.int64)
    for _ in range(depth):
        # At a leaf any bin will do, so one beyond the table's width may be taken back into it.
        at = step.take(at * width + np.minimum(flat.take(first + slots.take(at)), width - 1))
    return at


@dataclass
class BoostedTrees:
    """Trees on binned slots. ``loss`` is ``log`` (failure odds) or ``square``; ``history`` the held-out loss per round."""

    binning: Binning
    base: float
    loss: str
    trees: list[Tree] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    def best(self) -> int:
        """Number of trees after which the held-out loss has fallen for the last time."""
        at = 0
        for k, loss in enumerate(self.history):
            if loss < self.history[at] - LEAST_FALL * self.history[0]:
                at = k
        return at

    def start(self, weight: float, positive: float) -> None:
        """Set the base from the weight of the rows and of their labels."""
        mean = positive / weight if weight else 0.0
        inside = min(max(mean, 1e-6), 1 - 1e-6)
        self.base = 0.0 if not weight else mean if self.loss == "square" else float(np.log(inside / (1 - inside)))

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(bins) for t in self.trees), np.zeros(len(bins)))

    def margin(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with ``_margin``, the sum of all trees on its vectors."""
        # A few hundred trees of bounded size, as arrays: executors have no classes of this package to load.
        shared = df.sparkSession.sparkContext.broadcast([(t.steps(), np.asarray(t.value)) for t in self.trees])
        scheme, base = self.binning, self.base

        @F.arrow_udf("double")
        def summed(x: pa.Array) -> pa.Array:
            bins = scheme.bins(vectors(x, len(scheme.cuts)))
            out = np.full(len(bins), base)
            for steps, value in shared.value:
                out += value[walked(steps, bins)]
            return pa.array(out)

        return df.withColumn("_margin", summed(vector_to_array(features)))


def vectors(x: pa.Array, n_slots: int) -> np.ndarray:
    """Arrow lists of equal length as a matrix."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_slots)


def binning(train: DataFrame, widths: list[int], bins: int = BINS) -> Binning:
    """Thresholds at ``bins`` quantiles of every number, in one aggregate. ``widths`` holds the levels of words, 0 for numbers."""
    by_code = [n if n < bins else 0 for n in widths]
    wanted = [s for s, n in enumerate(by_code) if not n]
    cuts: list[np.ndarray] = [np.zeros(0) for _ in widths]
    if wanted:
        x = F.col("x")
        known = lambda s: F.when(~F.isnan(x[s]), x[s])
        found = train.agg(*[
            F.percentile_approx(known(s), F.array(*[F.lit((i + 1) / bins) for i in range(bins)]), 10_000).alias(f"q{s}") for s in wanted
        ]).first()
        for s in wanted:
            cuts[s] = np.unique(np.asarray(found[f"q{s}"] or [], dtype=float))
    return Binning(cuts, by_code)


def drawn(key: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Rows of a tree: a mixed hash of row key and seed below ``share``, the same in every run of a task."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(float) / float(1 << 53) < share


def derivatives(margin: np.ndarray, label: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and second derivative of every row."""
    if loss == "square":
        return margin - label, np.ones(len(margin))
    p = 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))
    return p - label, p * (1 - p)


def losses(margin: np.ndarray, label: np.ndarray, loss: str) -> np.ndarray:
    return (margin - label) ** 2 if loss == "square" else np.logaddexp(0.0, margin) - label * margin


def sums(leaf: np.ndarray, bins: np.ndarray, slots: list[int], g: np.ndarray, h: np.ndarray, n: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """Sums of one batch per leaf, slot and bin, empty ones left out."""
    parts: dict[str, list[np.ndarray]] = {c: [] for c in ("leaf", "slot", "bin", "g", "h", "n")}
    names, dense = np.unique(leaf, return_inverse=True)
    for s in slots:
        cell = dense * width + bins[:, s]
        total = [np.bincount(cell, w, len(names) * width) for w in (g, h, n)]
        kept = np.flatnonzero(np.bincount(cell, minlength=len(names) * width))
        parts["leaf"].append(names[kept // width])
        parts["slot"].append(np.full(len(kept), s))
        parts["bin"].append(kept % width)
        for c, t in zip(("g", "h", "n"), total):
            parts[c].append(t[kept])
    return {c: np.concatenate(v) if v else np.zeros(0) for c, v in parts.items()}


def best_split(table: np.ndarray, words: bool, min_leaf: float) -> tuple[float, np.ndarray | None]:
    """Gain and left bins of the best split of one leaf by one slot; ``table`` is bins x (g, h, n).

    Words are put in the order of their mean gradient, numbers in their own. The last bin stays right.
    """
    known = np.arange(len(table) - 1)
    if words:
        known = known[table[:-1, 2] > 0]
        known = known[np.argsort(table[known, 0] / (table[known, 1] + SMOOTH), kind="stable")]
    if not len(known):
        return 0.0, None
    total, left = table.sum(axis=0), np.cumsum(table[known], axis=0)
    right = total - left
    ok = (left[:, 2] >= min_leaf) & (right[:, 2] >= min_leaf) & (left[:, 1] >= LEAST_HESSIAN) & (right[:, 1] >= LEAST_HESSIAN)
    if not ok.any():
        return 0.0, None
    score = lambda t: t[..., 0] ** 2 / np.maximum(t[..., 1], LEAST_HESSIAN)
    gain = np.where(ok, score(left) + score(right) - score(total), 0.0)
    at = int(np.argmax(gain))
    goes_left = np.zeros(len(table), dtype=bool)
    goes_left[known[: at + 1]] = True
    return float(gain[at]), goes_left


def grown(histograms, binning: Binning, slots: list[int], rate: float, leaves: int, min_leaf: float) -> Tree:
    """One tree. ``histograms(tree, open leaves)`` gives ``{leaf: {slot: bins x (g, h, n)}}``."""
    tree = Tree()
    tree.add(0.0, 0.0)
    frontier, n_leaves = [0], 1
    while frontier and n_leaves < leaves:
        tables, found = histograms(tree, frontier), []
        for leaf in frontier:
            if leaf not in tables:
                continue
            table = tables[leaf]
            if leaf == 0:
                g, h, n = table[slots[0]].sum(axis=0)
                tree.value[0], tree.cover[0] = -rate * g / max(h, LEAST_HESSIAN), n
            options = [(*best_split(table[s], binning.levels[s] > 0, min_leaf), s) for s in slots]
            # Slots that part the rows alike (two of them missing together) differ by rounding only: the first is taken.
            most = max(o[0] for o in options)
            gain, goes_left, slot = next(o for o in options if o[0] >= most * (1 - 1e-9))
            if goes_left is not None and gain > 1e-9:
                found.append((gain, leaf, slot, goes_left, table[slot]))
        frontier = []
        for gain, leaf, slot, goes_left, table in sorted(found, key=lambda f: (-f[0], f[1]))[: leaves - n_leaves]:
            sides = []
            for side in (table[goes_left].sum(axis=0), table[~goes_left].sum(axis=0)):
                sides.append(tree.add(-rate * side[0] / max(side[1], LEAST_HESSIAN), side[2]))
            tree.split(leaf, slot, goes_left, *sides)
            frontier += sides
            n_leaves += 1
    return tree


@dataclass
class Options:
    """How trees are grown, see `fit`."""

    rounds: int
    rate: float
    leaves: int
    min_leaf: float
    row_share: float
    column_share: float
    patience: int
    seed: int


def boosted(model: BoostedTrees, histograms, advance, options: Options) -> BoostedTrees:
    """All rounds. ``histograms(tree, open leaves, slots, round)`` measures the held rows when it is asked for a root;
    ``advance(tree)`` adds a tree to the margins."""
    n_slots, patience, stopped = len(model.binning.cuts), options.patience, False
    for number in range(options.rounds):
        draw = np.random.default_rng([options.seed, number])
        slots = sorted(draw.choice(n_slots, max(1, round(options.column_share * n_slots)), replace=False).tolist())
        tree = grown(lambda t, open_: histograms(t, open_, slots, number), model.binning, slots, options.rate, options.leaves, options.min_leaf)
        # The root's pass has measured the held rows under all trees before this one.
        if patience and model.history and len(model.history) - 1 - model.best() >= patience:
            stopped = True
            break
        if len(tree.slot) == 1:
            break
        model.trees.append(tree)
        advance(tree)
    if stopped or model.best() < len(model.history) - 1:
        model.trees = model.trees[: model.best()]  # entry k is the loss after k trees
    return model


class Packed:
    """Slots grouped so that the bins of a group make one joint code."""

    def __init__(self, sizes: list[int]):
        self.sizes = sizes
        self.groups: list[list[int]] = []
        for s in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
            for group in self.groups:
                if int(np.prod([sizes[o] for o in [*group, s]])) <= JOINT_CELLS:
                    group.append(s)
                    break
            else:
                self.groups.append([s])
        self.shapes = [[sizes[s] for s in g] for g in self.groups]
        self.cells = [int(np.prod(shape)) for shape in self.shapes]
        self.group_of = {s: k for k, g in enumerate(self.groups) for s in g}
        # Bin of each slot by the code of its group.
        self.bin_of = {s: np.unravel_index(np.arange(self.cells[k]), self.shapes[k])[g.index(s)] for k, g in enumerate(self.groups) for s in g}

    def codes(self, bins: np.ndarray) -> list[np.ndarray]:
        most = np.uint16 if max(self.cells, default=1) <= 1 << 16 else np.uint32
        return [np.ravel_multi_index([bins[:, s] for s in g], shape).astype(most) for g, shape in zip(self.groups, self.shapes)]


class Shard:
    """Training rows of one task, from one pass to the next: codes, derivatives, margins, and who is in which open leaf."""

    def __init__(self, packed: Packed, codes: list[np.ndarray], label: np.ndarray, w: np.ndarray, key: np.ndarray, held: np.ndarray, loss: str):
        self.packed, self.codes, self.label, self.w, self.key, self.held, self.loss = packed, codes, label, w, key, held, loss
        self.margin = np.zeros(len(label))
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def total(self) -> np.ndarray:
        """Weight of the training rows, and of their labels."""
        w = np.where(self.held, 0.0, self.w)
        return np.array([w.sum(), (w * self.label).sum()])

    def begin(self, seed: int, share: float) -> np.ndarray:
        """Draw the rows of a tree; loss and weight of the held rows under all trees so far."""
        g, h = derivatives(self.margin, self.label, self.loss)
        self.g, self.h = self.w * g, self.w * h if self.loss == "log" else self.w
        used = ~self.held & drawn(self.key, seed, share)
        self.rows = {0: (np.flatnonzero(used), np.flatnonzero(~used))}
        apart = self.held
        return np.array([(self.w[apart] * losses(self.margin[apart], self.label[apart], self.loss)).sum(), self.w[apart].sum()])

    def split(self, tree: Tree, node: int) -> None:
        """Rows of ``node`` go to its children."""
        slot = tree.slot[node]
        table, codes = tree.goes_left[node][self.packed.bin_of[slot]], self.codes[self.packed.group_of[slot]]
        sides = []
        for rows in self.rows.pop(node):
            goes = table[codes[rows]]
            sides.append((rows[goes], rows[~goes]))
        self.rows[tree.left[node]], self.rows[tree.right[node]] = zip(*sides)

    def sums(self, leaf: int, slots: list[int]) -> np.ndarray:
        """(g, h, n) per bin of every slot in turn, over the drawn rows of ``leaf``."""
        rows, wanted = self.rows[leaf][0], {}
        weights = [v[rows] for v in (self.g, self.h, self.w)]
        for k, group in enumerate(self.packed.groups):
            inside = [s for s in group if s in slots]
            if inside:
                code = self.codes[k][rows].astype(np.intp)
                cells = np.stack([np.bincount(code, w, self.packed.cells[k]) for w in weights], axis=-1).reshape(*self.packed.shapes[k], 3)
                for s in inside:
                    wanted[s] = cells.sum(axis=tuple(i for i, o in enumerate(group) if o != s))
        return np.concatenate([wanted[s] for s in slots])

    def advance(self, tree: Tree) -> None:
        """Add a finished tree to the margins."""
        for node, slot in enumerate(tree.slot):
            if slot >= 0 and node in self.rows:
                self.split(tree, node)
        for leaf, sides in self.rows.items():
            for rows in sides:
                self.margin[rows] += tree.value[leaf]


class Exchange:
    """Sums over the tasks of a barrier stage, through small files in a folder of their host; at most two a task at a time.

    The stage's own ``allGather`` takes a second a call, so it is used once, to agree on a folder for this attempt.
    """

    def __init__(self, folder: str):
        context = BarrierTaskContext.get()
        self.rank, self.turn = context.partitionId(), 0
        names = context.allGather(uuid.uuid4().hex)
        self.tasks, self.folder = len(names), f"{folder}/{names[0]}"
        os.makedirs(self.folder, exist_ok=True)

    def path(self, turn: int, rank: int) -> str:
        return f"{self.folder}/{turn}-{rank}"

    def bytes_of(self, rank: int) -> bytes:
        until = time.monotonic() + LONGEST_WAIT
        while True:
            try:
                with open(self.path(self.turn, rank), "rb") as f:
                    return f.read()
            except FileNotFoundError:
                if time.monotonic() > until:
                    raise TimeoutError(f"task {rank} brought no sums for {LONGEST_WAIT} seconds") from None
                time.sleep(0.0005)

    def __call__(self, own: np.ndarray) -> np.ndarray:
        """Sum of what all tasks bring, in the order of their partitions: the same in each."""
        mine = self.path(self.turn, self.rank)
        with open(f"{mine}.part", "wb") as f:
            f.write(own.tobytes())
        os.rename(f"{mine}.part", mine)
        total = np.sum([np.frombuffer(self.bytes_of(r)) for r in range(self.tasks)], axis=0).reshape(own.shape)
        # Who has brought this turn's sums has read those of the turn before.
        if self.turn:
            os.unlink(self.path(self.turn - 1, self.rank))
        self.turn += 1
        return total


def together(model: BoostedTrees, shard: Shard, exchanged, options: Options) -> BoostedTrees:
    """The rounds in one of the tasks that share the rows; ``model`` comes out the same in all."""
    sizes = model.binning.sizes()
    weight, positive = exchanged(shard.total())
    if not weight:
        return model
    model.start(weight, positive)
    shard.margin += model.base
    tables: dict[int, np.ndarray] = {}  # sums over all tasks: those of a parent save one child's count

    def histograms(tree: Tree, open_leaves: list[int], slots: list[int], number: int) -> dict[int, dict[int, np.ndarray]]:
        if open_leaves == [0]:
            tables.clear()
            loss = shard.begin(options.seed * 100_003 + number, options.row_share)
            found = exchanged(np.concatenate([loss, shard.sums(0, slots).ravel()]))
            if found[1]:
                model.history.append(float(found[0] / found[1]))
            fresh = {0: found[2:].reshape(-1, 3)}
        else:
            wanted = set(open_leaves)
            pairs = {node: (tree.left[node], tree.right[node]) for node in tables if tree.left[node] in wanted}
            least = {node: min(pair, key=lambda c: (tree.cover[c], c)) for node, pair in pairs.items()}
            for node in pairs:
                shard.split(tree, node)
            counted = exchanged(np.stack([shard.sums(c, slots) for c in least.values()]))
            fresh = {}
            for (node, pair), table in zip(pairs.items(), counted):
                rest = tables[node] - table
                rest[np.abs(rest[:, 2]) < 1e-9 * np.abs(tables[node][:, 2])] = 0.0  # no rows: no traces of rounding either
                for child in pair:
                    fresh[child] = table if child == least[node] else rest
        tables.clear()
        tables.update(fresh)
        ends = np.cumsum([sizes[s] for s in slots])[:-1]
        return {leaf: dict(zip(slots, np.split(t, ends))) for leaf, t in fresh.items() if t[:, 2].any()}

    return boosted(model, histograms, shard.advance, options)


def running_together(spark: SparkSession) -> int:
    """Tasks that are sure to run at the same time on one host that sees the shared folder as files, else 0."""
    sc = spark.sparkContext
    hosts, at = sc._jsc.sc().getExecutorMemoryStatus().keys().iterator(), set()
    while hosts.hasNext():
        at.add(hosts.next().rsplit(":", 1)[0])
    if len(at) != 1 or local_folder(shared_dir(spark)) is None or sc.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    profile = sc._jsc.sc().resourceProfileManager().defaultResourceProfile()
    return min(MOST_TASKS, sc._jsc.sc().maxNumConcurrentTasks(profile))


def local_folder(path: str) -> str | None:
    """Path of a folder as the system's files know it, None if it lies elsewhere."""
    parts = urlsplit(path)
    return unquote(parts.path) if parts.scheme == "file" else path if not parts.scheme and os.path.isdir(path) else None


def fit_together(keyed: DataFrame, model: BoostedTrees, options: Options, tasks: int) -> BoostedTrees:
    """The fit as one stage of ``tasks`` tasks that run at the same time."""
    scheme, loss = model.binning, model.loss
    n_slots, packed = len(scheme.cuts), Packed(scheme.sizes())
    folder = f"{local_folder(shared_dir(keyed.sparkSession))}/sums-{uuid.uuid4().hex}"
    os.makedirs(folder)

    def task(batches):
        empty = [np.zeros(0, dtype=c.dtype) for c in packed.codes(np.zeros((0, n_slots), dtype=np.int16))]
        parts = [(empty, *(np.zeros(0, dtype=d) for d in (float, float, np.int64, bool)))]
        for batch in batches:
            codes = packed.codes(scheme.bins(vectors(batch.column(0), n_slots)))
            parts.append((codes, *(batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))))
        codes, *rest = zip(*parts)
        columns = [np.concatenate(c) for c in rest]
        del parts, rest
        shard = Shard(packed, [np.concatenate(c) for c in zip(*codes)], *columns, loss)
        found = together(BoostedTrees(scheme, 0.0, loss), shard, Exchange(folder), options)
        if BarrierTaskContext.get().partitionId() == 0:
            plain = [(t.slot, t.left, t.right, t.goes_left, t.value, t.cover) for t in found.trees]
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps((found.base, plain, found.history))], pa.binary())})

    dealt = keyed.select("x", "label", "w", "key", "held").repartition(tasks, "key")
    try:
        model.base, trees, model.history = pickle.loads(dealt.mapInArrow(task, "model binary", barrier=True).collect()[0]["model"])
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    model.trees = [Tree(*t) for t in trees]
    return model


def fit_by_jobs(keyed: DataFrame, model: BoostedTrees, options: Options) -> BoostedTrees:
    """The fit with a Spark job for every pass; the driver sees sums alone."""
    scheme, loss, own = model.binning, model.loss, keyed.sparkSession
    n_slots, width, sizes = len(scheme.cuts), scheme.width(), scheme.sizes()

    def to_bins(batches):
        for pdf in batches:
            out = pdf[["label", "w", "key", "held"]].copy()
            b = scheme.bins(np.stack(pdf["x"].to_numpy())) if len(pdf) else np.zeros((0, n_slots), dtype=np.int16)
            for s in range(n_slots):
                out[f"b{s}"] = b[:, s]
            yield out

    layout = "label double, w double, key long, held boolean, " + ", ".join(f"b{s} short" for s in range(n_slots))
    path = scratch_path(own, "bins")
    spread(keyed).mapInPandas(to_bins, layout).write.parquet(path)
    binned = own.read.schema(layout).parquet(path)
    total = binned.where("not held").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("label")).alias("y")).first()
    if not total["w"]:
        return model
    model.start(total["w"], total["y"])
    columns = [f"b{s}" for s in range(n_slots)]
    state = binned.withColumn("margin", F.lit(model.base)).persist()
    since: list[Tree] = []  # trees that the stored margins lack

    def as_rows(pdf: pd.DataFrame, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
        b = pdf[columns].to_numpy(dtype=np.int16)
        return b, pdf["margin"].to_numpy() + sum((t.predict(b) for t in trees), np.zeros(len(b)))

    def pass_over(tree: Tree, open_leaves: list[int], slots: list[int], number: int) -> dict[int, dict[int, np.ndarray]]:
        trees, ask_loss = list(since), open_leaves == [0]

        def histogram(batches):
            for pdf in batches:
                b, margin = as_rows(pdf, trees)
                apart, w, label = pdf["held"].to_numpy(dtype=bool), pdf["w"].to_numpy(), pdf["label"].to_numpy()
                g, h = derivatives(margin, label, loss)
                if ask_loss and apart.any():
                    cost = losses(margin[apart], label[apart], loss)
                    yield pd.DataFrame({"leaf": [-1], "slot": [-1], "bin": [-1], "g": [float((w[apart] * cost).sum())], "h": [0.0], "n": [float(w[apart].sum())]})
                leaf = tree.leaf_of(b)
                used = ~apart & drawn(pdf["key"].to_numpy(), options.seed * 100_003 + number, options.row_share) & np.isin(leaf, open_leaves)
                yield pd.DataFrame(sums(leaf[used], b[used], slots, (w * g)[used], (w * h)[used], w[used], width))

        found = state.mapInPandas(histogram, HISTOGRAM).groupBy("leaf", "slot", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
        leaf, slot, bin_, *values = (found.column(c).to_numpy() for c in ("leaf", "slot", "bin", "g", "h", "n"))
        values = np.stack(values, axis=1)
        tables: dict[int, dict[int, np.ndarray]] = {}
        for name in np.unique(leaf).tolist():
            mine = leaf == name
            if name < 0:
                model.history.append(float(values[mine, 0].sum() / values[mine, 2].sum()))
                continue
            dense = np.zeros((n_slots, width, 3))
            dense[slot[mine], bin_[mine]] = values[mine]
            tables[name] = {s: dense[s, : sizes[s]] for s in slots}
        return tables

    def advance(tree: Tree) -> None:
        nonlocal state
        since.append(tree)
        if len(since) >= SAVE_EVERY:
            trees = list(since)

            def advanced(batches):
                for pdf in batches:
                    yield pdf.assign(margin=as_rows(pdf, trees)[1])

            later = cut(state.mapInPandas(advanced, layout + ", margin double")).persist()
            state.unpersist()
            state = later
            since.clear()

    try:
        return boosted(model, pass_over, advance, options)
    finally:
        state.unpersist()


def fit(
    train: DataFrame, widths: list[int], loss: str = "log", rounds: int = 400, rate: float = 0.1, leaves: int = 48, min_leaf: float = 25,
    row_share: float = 0.9, column_share: float = 0.9, patience: int = 40, held_share: float = 0.1, seed: int = 42,
) -> BoostedTrees:
    """Boosted trees on ``features`` (vector), ``label`` and ``_weight``; ``widths`` as in `binning`.

    Equal rows should be one row with their number as weight. Rows with equal features are held apart together. Without
    held rows, or with ``patience`` 0, all rounds are run. No rows give a model that says 0.
    """
    rows = train.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"), F.col("_weight").cast("double").alias("w"))
    path = scratch_path(train.sparkSession, "rows")
    rows.write.parquet(path)
    scheme = binning(train.sparkSession.read.schema(rows.schema).parquet(path), widths)
    share = held_share if patience else 0.0
    held = F.pmod(F.xxhash64("x", F.lit(seed)), F.lit(1000)) < int(round(share * 1000))
    # Plans are fixed up front: a session of its own leaves the caller's settings alone.
    own = train.sparkSession.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.shuffle.partitions", SUM_PARTITIONS)
    keyed = own.read.schema(rows.schema).parquet(path).select("x", "label", "w", F.xxhash64("x", "label", F.lit(seed)).alias("key"), held.alias("held"))
    model = BoostedTrees(scheme, 0.0, loss)
    options = Options(rounds, rate, leaves, min_leaf, row_share, column_share, patience, seed)
    tasks = running_together(train.sparkSession)
    return fit_together(keyed, model, options, tasks) if tasks else fit_by_jobs(keyed, model, options)
