"""The boosted model's training (M7): Spark's algorithm with the rows held as bin numbers.

Spark's booster runs two stages for every level of every tree and spends some 30 ns on a
value.  Here a fit is one job whose tasks hold their rows for all trees.  A small fit is one
task.  The tasks of a larger one (a barrier stage) hand each other their histograms, a
file a task and level in the shared folder, and all come to the same splits from the
sums.  The method, the settings and the random draws are Spark's: thresholds from the
same sample of rows, the same rows drawn for a tree, the same features drawn for a node,
the same gains; the result is a ``GBTClassificationModel``.  Trees differ from Spark's only
where splits are equal but for rounding.  What is not covered here (validation rows,
categorical features, other losses, a shared folder that is no plain path, more rows than
the tasks hold) is left to Spark.
"""

from __future__ import annotations

import json
import os
import shutil
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaserisk.session import checkpoint_dir, scratch_path

#: Rows (some 200 bytes each) up to which a fit beside others is one task, and rows of a task of a fit that has all cores.
ROWS_IN_TASK, ROWS_ALONE = 600_000, 50_000
#: Tasks of a fit at most, and rows that one of several tasks holds at most; larger fits are left to Spark.
MOST_TASKS, ROWS_HELD = 32, 3_000_000
#: Rows from which features are counted together, and the cells of a joint histogram.
JOINT_ROWS, JOINT_CELLS = 20_000, 1_024
EPSILON = 2.0 ** -52
_MASK = (1 << 64) - 1

_SPLIT = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])
_NODE = [("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
         ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("split", _SPLIT)]
NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
         "gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, "
         "numCategories: int>>")


# -- Spark's random numbers ---------------------------------------------------
def _murmur3(data: bytes, seed: int) -> int:
    h = seed & 0xFFFFFFFF
    for (k,) in struct.iter_unpack("<I", data):
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) & 0xFFFFFFFF
        h ^= k * 0x1B873593 & 0xFFFFFFFF
        h = (h << 13 | h >> 19) & 0xFFFFFFFF
        h = (h * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def _state(seed: int) -> int:
    """The state of an XORShiftRandom with this seed."""
    data = struct.pack(">Q", seed & _MASK)
    low = _murmur3(data, 0x3C074A61)
    return _murmur3(data, low) << 32 | low


def _step(s: int) -> int:
    s ^= s << 21 & _MASK
    s ^= s >> 35
    return s ^ (s << 4 & _MASK)


def _moved(m: np.ndarray, s: np.ndarray) -> np.ndarray:
    out = np.zeros_like(s)
    for bit in range(64):
        out ^= np.where(s >> np.uint64(bit) & np.uint64(1), m[bit], np.uint64(0))
    return out


LANE = 256


@cache
def _jump(power: int) -> np.ndarray:
    """Columns of the matrix that goes ``LANE`` times 2 ** ``power`` steps on."""
    if power:
        return _moved(_jump(power - 1), _jump(power - 1))
    columns = []
    for bit in range(64):
        s = 1 << bit
        for _ in range(LANE):
            s = _step(s)
        columns.append(s)
    return np.array(columns, dtype=np.uint64)


def xorshift_doubles(seed: int, n: int) -> np.ndarray:
    """The first ``n`` doubles of an XORShiftRandom.  A step is linear over bits: lanes begin ``LANE`` steps apart and go on
    side by side."""
    lanes = max(1, -(-2 * n // LANE))
    starts, filled, power = np.empty(lanes, dtype=np.uint64), 1, 0
    starts[0] = _state(seed)
    while filled < lanes:
        k = min(filled, lanes - filled)
        starts[filled:filled + k] = _moved(_jump(power), starts[:k])
        filled, power = filled + k, power + 1
    states, s = np.empty((LANE, lanes), dtype=np.uint64), starts
    for i in range(LANE):
        s = s ^ (s << np.uint64(21))
        s ^= s >> np.uint64(35)
        s ^= s << np.uint64(4)
        states[i] = s
    flat = states.T.reshape(-1)
    high, low = flat[0::2][:n] & np.uint64((1 << 26) - 1), flat[1::2][:n] & np.uint64((1 << 27) - 1)
    return ((high << np.uint64(27)) + low).astype(np.float64) * 2.0 ** -53


class _JavaRandom:
    def __init__(self, seed: int):
        self.s = (seed ^ 0x5DEECE66D) & (1 << 48) - 1

    def _next(self) -> int:
        self.s = (self.s * 0x5DEECE66D + 0xB) & (1 << 48) - 1
        v = self.s >> 16
        return v - (1 << 32) if v >> 31 else v

    def long(self) -> int:
        return ((self._next() << 32) + self._next()) & _MASK


def feature_draw(seed: int, n: int, k: int) -> np.ndarray:
    """Reservoir of ``k`` of ``n`` features, in Spark's order."""
    kept, s = list(range(k)), _state(seed)
    for i in range(k, n):
        s = _step(s)
        high = s & (1 << 26) - 1
        s = _step(s)
        at = int(((high << 27) + (s & (1 << 27) - 1)) * 2.0 ** -53 * (i + 1))
        if at < k:
            kept[at] = i
    return np.array(kept)


# -- thresholds -----------------------------------------------------------------
def thresholds(values: np.ndarray, weights: np.ndarray, expected: float, splits: int) -> np.ndarray:
    """Split points of a feature from the sampled rows; ``expected`` is the weight the sample stands for.  Values of zero are not
    counted but taken to be what the others lack, as Spark does."""
    there = values != 0.0
    if not there.any():
        return np.empty(0)
    distinct, place = np.unique(values[there], return_inverse=True)
    counts = np.bincount(place, weights[there])
    lacking = expected - counts.sum()
    if lacking > EPSILON * int(there.sum()) * 100:
        at = int(np.searchsorted(distinct, 0.0))
        distinct, counts = np.insert(distinct, at, 0.0), np.insert(counts, at, lacking)
    between = (distinct[:-1] + distinct[1:]) / 2.0
    if len(between) <= splits:
        return between
    stride, found = expected / (splits + 1), []
    target, current = stride, counts[0]
    for i in range(1, len(distinct)):
        before, current = current, current + counts[i]
        if abs(before - target) < abs(current - target):
            found.append(between[i - 1])
            target += stride
    return np.array(found)


# -- rows -----------------------------------------------------------------------
@dataclass
class Plan:
    """What a fit is told: settings, thresholds of each feature, and how features are counted together."""
    trees: int
    depth: int
    step: float
    rate: float
    per_node: int
    seed: int
    min_gain: float
    cuts: list[np.ndarray]
    joint: bool
    groups: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        self.bins = [len(c) + 1 for c in self.cuts]
        self.stride = max([JOINT_CELLS if self.joint else 1, *self.bins])
        self.first = np.concatenate([[0], np.cumsum(self.bins)]).astype(int)
        used = [f for f in np.argsort(self.bins, kind="stable")[::-1] if self.bins[f] > 1]
        room: list[int] = []
        for f in used:
            at = next((i for i, c in enumerate(room) if c * self.bins[f] <= self.stride), None) if self.joint else None
            if at is None:
                self.groups.append([int(f)])
                room.append(self.bins[f])
            else:
                self.groups[at].append(int(f))
                room[at] *= self.bins[f]


class Rows:
    """Rows as bin numbers, and where each of them is in the tree that grows."""

    def __init__(self, plan: Plan, codes: np.ndarray, label: np.ndarray, weight: np.ndarray, parts: list[tuple[int, int]], score=None):
        self.plan, self.codes, self.label, self.weight, self.parts = plan, codes, label, weight, parts
        self.score = np.zeros(len(label)) if score is None else score
        self.joint = []
        for group in plan.groups:
            code = codes[group[0]].astype(np.uint16)
            for f in group[1:]:
                code = code * np.uint16(plan.bins[f]) + codes[f]
            self.joint.append(code if len(group) > 1 else codes[group[0]])

    def begin(self, tree: int) -> None:
        plan = self.plan
        y = self.label if tree == 0 else 4.0 * self.label / (1.0 + np.exp(2.0 * self.label * self.score))
        self.sel = np.arange(len(y)) if plan.rate >= 1.0 else np.flatnonzero(
            np.concatenate([xorshift_doubles(plan.seed + tree + part + 1, n) for part, n in self.parts] or [np.empty(0)]) < plan.rate)
        w, r = self.weight[self.sel], y[self.sel]
        self.stats = [w, w * r, w * r * r]
        self.cells = [code[self.sel] for code in self.joint]
        self.node = np.zeros(len(y), dtype=np.int32)

    def look(self, moves, slot: np.ndarray, n: int, counted: bool) -> tuple[np.ndarray, np.ndarray | None]:
        if moves is not None:
            self.descend(moves)
        at = slot[self.node[self.sel]]
        there = np.where(at < 0, n, at)
        totals = np.array([*[np.bincount(there, s, n + 1)[:n] for s in self.stats], np.bincount(there, minlength=n + 1)[:n]])
        return totals, self.histograms(at, n) if counted else None

    def descend(self, moves: np.ndarray) -> None:
        """Rows of a node with (feature, cut, left, right) go right if their bin of the feature is over the cut."""
        feature, cut, left, right = moves
        live = np.flatnonzero(left[self.node] >= 0) if (left < 0).any() else np.arange(len(self.node))
        at = self.node[live]
        bins = self.codes.reshape(-1).take(feature[at] * self.codes.shape[1] + live)
        self.node[live] = np.where(bins > cut[at], right[at], left[at])

    def histograms(self, at: np.ndarray, nodes: int) -> np.ndarray:
        """(2 or 3, nodes, bins of all features): weight, sum (and sum of squares) of the drawn rows by slot ``at``."""
        plan, cells = self.plan, self.cells
        stats = self.stats[:2] if plan.joint else self.stats
        if (at < 0).any():
            kept = np.flatnonzero(at >= 0)
            at, cells, stats = at[kept], [c[kept] for c in cells], [s[kept] for s in stats]
        base = at.astype(np.int64) * plan.stride
        out = np.zeros((len(stats), nodes, plan.first[-1]))
        for group, cell in zip(plan.groups, cells):
            place, shape = base + cell, [plan.bins[f] for f in group]
            size = int(np.prod(shape))
            for k, s in enumerate(stats):
                found = np.bincount(place, s, nodes * plan.stride).reshape(nodes, plan.stride)[:, :size].reshape(nodes, *shape)
                for i, f in enumerate(group):
                    others = tuple(j + 1 for j in range(len(group)) if j != i)
                    out[k, :, plan.first[f]:plan.first[f + 1]] = found.sum(axis=others) if others else found
        return out

    def finish(self, values: np.ndarray, weight: float) -> None:
        self.score = self.score + values[self.node] * weight


def impurity(w, s, q):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(w == 0, 0.0, (q - s * s / w) / w)


# -- trees ------------------------------------------------------------------------
@dataclass
class Node:
    """``stats``: weight, sum, sum of squares and number of its drawn rows."""
    stats: np.ndarray
    gain: float = -1.0
    feature: int = -1
    cut: int = -1
    left: Node | None = None
    right: Node | None = None

    @property
    def prediction(self) -> float:
        return 0.0 if self.stats[0] == 0 else float(self.stats[1] / self.stats[0])

    @property
    def impurity(self) -> float:
        return float(impurity(*self.stats[:3]))

    def pruned(self) -> Node:
        """Without splits whose leaves say the same."""
        if self.left is None:
            return self
        left, right = self.left.pruned(), self.right.pruned()
        if left.left is None and right.left is None and left.prediction == right.prediction:
            return Node(self.stats)
        return Node(self.stats, self.gain, self.feature, self.cut, left, right)


def _best(plan: Plan, hist: np.ndarray, nodes: list[Node], draws: list[np.ndarray | None], root: bool) -> None:
    """Sets each node's best split: its gain, feature, cut, and what is left and right of it."""
    features = [f for f in range(len(plan.bins)) if plan.bins[f] > 1]
    if not features:
        return
    width = max(plan.bins) - 1
    left = np.zeros((len(hist), len(nodes), len(plan.bins), width))
    whole = np.zeros((len(hist), len(nodes), len(plan.bins)))
    there = np.zeros((len(plan.bins), width), dtype=bool)
    for f in features:
        sums = np.cumsum(hist[:, :, plan.first[f]:plan.first[f + 1]], axis=2)
        left[:, :, f, :plan.bins[f] - 1], whole[:, :, f], there[f, :plan.bins[f] - 1] = sums[:, :, :-1], sums[:, :, -1], True
    right = whole[..., None] - left
    order = [np.array([f for f in (draws[i] if draws[i] is not None else range(len(plan.bins))) if plan.bins[f] > 1], dtype=int)
             for i in range(len(nodes))]
    stats = np.array([n.stats for n in nodes])
    w, s, q = (stats[:, k, None, None] for k in range(3))
    with np.errstate(divide="ignore", invalid="ignore"):
        if plan.joint:
            gain = (left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - s * s / w) / w
        else:
            own = impurity(w, s, q)
            if root and len(order[0]):  # the first split looked at gives the root's figures
                f = order[0][0]
                own = impurity(*(left[:, 0, f, 0] + right[:, 0, f, 0]))
                nodes[0].stats[:3] = left[:, 0, f, 0] + right[:, 0, f, 0]
            both = left[0] + right[0]
            gain = own - left[0] / both * impurity(*left) - right[0] / both * impurity(*right)
    gain = np.where(there & (left[0] > 0) & (right[0] > 0) & (gain >= plan.min_gain), gain, -np.inf)
    cuts = gain.argmax(axis=2)
    tops = np.take_along_axis(gain, cuts[:, :, None], 2)[:, :, 0]
    for i, node in enumerate(nodes):
        if not len(order[i]):
            continue
        f = int(order[i][tops[i, order[i]].argmax()])
        if tops[i, f] > 0:
            node.gain, node.feature, node.cut = float(tops[i, f]), f, int(cuts[i, f])
            node.left, node.right = (Node(np.append(x[:, i, f, node.cut], [0.0] * (4 - len(x)))) for x in (left, right))


def grow(plan: Plan, tree: int, look) -> list[Node]:
    """One tree's nodes.  ``look(moves, slot, n, counted)`` takes the rows to their nodes and gives the totals of the ``n`` nodes
    with a slot and, if ``counted``, their histograms.  Nodes of a level come in Spark's order, the last one's children first."""
    random = _JavaRandom(plan.seed + tree)
    nodes, level, moves = [Node(np.zeros(4))], [0], None
    for depth in range(plan.depth + 1):
        slot = np.full(len(nodes), -1)
        slot[level] = np.arange(len(level))
        totals, hist = look(moves, slot, len(level), depth < plan.depth)
        for i, node in enumerate(level):
            if plan.joint or depth == 0:
                nodes[node].stats = totals[:, i].copy()
            else:
                nodes[node].stats[3] = totals[3, i]
        grown = [i for i, n in enumerate(level) if depth == 0 or abs(nodes[n].impurity) >= EPSILON] if depth < plan.depth else []
        if not grown:
            break
        draws = [feature_draw(random.long(), len(plan.bins), plan.per_node) if plan.per_node < len(plan.bins) else None for _ in grown]
        _best(plan, hist[:, grown], [nodes[level[i]] for i in grown], draws, depth == 0)
        moves, below = np.full((4, len(nodes)), -1), []
        for node in (level[i] for i in grown):
            own = nodes[node]
            if own.left is not None:
                moves[:, node] = own.feature, own.cut, len(nodes), len(nodes) + 1
                below += [len(nodes), len(nodes) + 1]
                nodes += [own.left, own.right]
        level = below[::-1]
        if not level:
            break
    return nodes


class Exchange:
    """Sums over the tasks of a fit, which all run at once: each writes its part, waits for the others' and adds them up in the same
    order.  A task that has read step k knows that all have read step k - 1 and deletes its part of that."""

    def __init__(self, folder: str, task: int, tasks: int):
        self.folder, self.task, self.tasks, self.step = folder, task, tasks, 0
        os.makedirs(folder, exist_ok=True)

    def _file(self, step: int, task: int) -> str:
        return f"{self.folder}/{step}-{task}"

    def __call__(self, own: np.ndarray) -> np.ndarray:
        path = self._file(self.step, self.task)
        own.tofile(f"{path}.new")
        os.replace(f"{path}.new", path)
        out = np.zeros_like(own)
        for task in range(self.tasks):
            while task != self.task and not os.path.exists(self._file(self.step, task)):
                time.sleep(0.0005)
            out += own if task == self.task else np.fromfile(self._file(self.step, task)).reshape(own.shape)
        if self.step:
            os.remove(self._file(self.step - 1, self.task))
        self.step += 1
        return out

    def close(self) -> None:
        """After a last step all have read the one before; the last task to come takes the folder."""
        self(np.zeros(1))
        if self.task == 0:
            for task in range(self.tasks):
                while os.path.exists(self._file(self.step - 2, task)):
                    time.sleep(0.0005)
            shutil.rmtree(self.folder, ignore_errors=True)


def train_here(plan: Plan, rows: Rows, sums: Exchange | None = None) -> Iterator[Node]:
    """The roots of all trees, from rows that are all here or, with ``sums``, in as many tasks."""
    def look(moves, slot, n, counted):
        totals, hist = rows.look(moves, slot, n, counted)
        if sums is None:
            return totals, hist
        both = sums(np.concatenate([totals.ravel(), hist.ravel() if counted else np.empty(0)]))
        return both[:totals.size].reshape(totals.shape), both[totals.size:].reshape(hist.shape) if counted else None

    for tree in range(plan.trees):
        rows.begin(tree)
        nodes = grow(plan, tree, look)
        rows.finish(np.array([n.prediction for n in nodes]), 1.0 if tree == 0 else plan.step)
        yield nodes[0]


def node_table(plan: Plan, tree: int, root: Node) -> pa.Table:
    """A tree as rows of Spark's model files, in preorder."""
    out: list = []

    def add(node: Node) -> int:
        at, leaf = len(out), node.left is None
        out.append(None)
        left, right = (-1, -1) if leaf else (add(node.left), add(node.right))
        split = {"featureIndex": node.feature, "leftCategoriesOrThreshold": [] if leaf else [float(plan.cuts[node.feature][node.cut])],
                 "numCategories": -1}
        out[at] = {"id": at, "prediction": node.prediction, "impurity": node.impurity, "impurityStats": [float(x) for x in node.stats[:3]],
                   "rawCount": int(node.stats[3]), "gain": node.gain, "leftChild": left, "rightChild": right, "split": split}
        return at

    add(root.pruned())
    return pa.table({"treeID": pa.array([tree] * len(out), pa.int32()), "nodeData": pa.array(out, pa.struct(_NODE))})


# -- the estimator ------------------------------------------------------------------
def read_rows(plan: Plan, batches) -> Rows:
    """The rows of a task as bin numbers."""
    label, weight, part, codes = [], [], [], []
    for b in batches:
        values = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(plan.cuts))
        codes.append(np.array([np.searchsorted(cut, values[:, f]) for f, cut in enumerate(plan.cuts)], dtype=np.uint8))
        label.append(b.column(0).to_numpy() * 2 - 1)
        weight.append(b.column(1).to_numpy())
        part.append(b.column(3).to_numpy())
    if not codes:
        return Rows(plan, np.empty((len(plan.cuts), 0), dtype=np.uint8), np.empty(0), np.empty(0), [])
    parts = np.concatenate(part)
    ends = np.append(np.flatnonzero(np.diff(parts)) + 1, len(parts))
    runs = [(int(parts[e - 1]), int(e - b)) for b, e in zip([0, *ends[:-1]], ends)]
    return Rows(plan, np.ascontiguousarray(np.concatenate(codes, axis=1)), np.concatenate(label), np.concatenate(weight), runs)


def _per_node(strategy: str, n: int) -> int | None:
    """Features drawn for a node; None for a strategy that is left to Spark."""
    try:
        share = float(strategy)
    except ValueError:
        return n if strategy in ("auto", "all") else None
    if strategy.isdigit():
        return min(int(strategy), n) or None
    return ceil(share * n) if 0 < share <= 1 else None


class BoostedTrees(GBTClassifier):
    """``GBTClassifier`` whose fit is this module's.  ``alone``: the fit may take all cores; others do not run beside it."""

    alone = True

    def _fit(self, dataset: DataFrame):
        return self._own_fit(dataset) or super()._fit(dataset)

    def _covered(self, dataset: DataFrame) -> bool:
        get, jvm = self.getOrDefault, dataset.sparkSession._jvm
        field_ = dataset._jdf.schema().apply(self.getFeaturesCol())
        return not (self.isDefined(self.validationIndicatorCol) or self.isDefined(self.thresholds) or get(self.minWeightFractionPerNode) > 0
                    or get(self.minInstancesPerNode) > 1 or get(self.lossType) != "logistic" or get(self.impurity) != "variance" or get(self.maxBins) > 256 or not 0 < get(self.maxDepth) <= 10
                    or not jvm.org.apache.spark.ml.util.MetadataUtils.getCategoricalFeatures(field_).isEmpty())

    def _tasks(self, points: DataFrame, n: int) -> int:
        """Tasks of a fit of ``n`` rows; 0 if it needs several and they cannot run side by side or share no plain folder."""
        spark = points.sparkSession
        tasks = min(ceil(n / ROWS_ALONE) if self.alone else 1 if n <= ROWS_IN_TASK else MOST_TASKS, MOST_TASKS, spark.sparkContext.defaultParallelism)
        if tasks > 1:
            plain = "://" not in checkpoint_dir(spark).removeprefix("file://")
            fixed = spark.conf.get("spark.dynamicAllocation.enabled", "false") != "true"
            tasks = min(tasks, points.rdd.getNumPartitions()) if plain and fixed else 1
        return tasks if n <= tasks * (ROWS_IN_TASK if tasks == 1 else ROWS_HELD) else 0

    def _points(self, dataset: DataFrame) -> DataFrame:
        """(label, weight, features, part) with Spark's checks; ``part`` is the partition that Spark would draw rows by."""
        jvm = dataset.sparkSession._jvm
        checks = getattr(getattr(jvm.org.apache.spark.ml.util, "DatasetUtils$"), "MODULE$")
        weight = self.isDefined(self.weightCol) and self.getWeightCol()
        return dataset.select(
            Column(checks.checkClassificationLabels(self.getLabelCol(), jvm.scala.Option.apply(2))).alias("label"),
            (Column(checks.checkNonNegativeWeights(weight)) if weight else F.lit(1.0)).alias("weight"),
            vector_to_array(Column(checks.checkNonNanVectors(self.getFeaturesCol()))).alias("features"), F.spark_partition_id().alias("part"))

    def _own_fit(self, dataset: DataFrame):
        get, spark = self.getOrDefault, dataset.sparkSession
        if not self._covered(dataset):
            return None
        points = self._points(dataset)
        n, total, least, width, most = points.agg(F.count(F.lit(1)), F.sum("weight"), F.min("weight"), F.min(F.size("features")),
                                                  F.max(F.size("features"))).first()
        per_node, tasks = _per_node(get(self.featureSubsetStrategy), width or 0), self._tasks(points, n)
        if not n or not tasks or least <= 0 or width != most or not width or per_node is None:
            return None
        seed, bins = get(self.seed), min(get(self.maxBins), n)
        share = min(1.0, max(bins * bins, 10_000) / n)
        sample = points.select("weight", "features")
        if share < 1:
            drawn = sample._jdf.toJavaRDD().sample(False, share, _first_int(seed))
            sample = DataFrame(spark._jsparkSession.createDataFrame(drawn, sample._jdf.schema()), spark)
        found = sample.toArrow()
        values = found.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        weights = found.column("weight").to_numpy()
        plan = Plan(trees=get(self.maxIter), depth=get(self.maxDepth), step=get(self.stepSize), rate=get(self.subsamplingRate), per_node=per_node,
                    seed=seed, min_gain=get(self.minInfoGain),
                    cuts=[thresholds(values[:, f], weights, share * total, bins - 1) for f in range(width)], joint=n >= JOINT_ROWS)
        folder = scratch_path(spark, "exchange").removeprefix("file://") if tasks > 1 else None

        def task(batches):
            rows, sums, first = read_rows(plan, batches), None, True
            if folder:
                context = BarrierTaskContext.get()
                first = context.partitionId() == 0
                attempt = context.allGather(uuid.uuid4().hex)[0]  # a stage that is begun again takes another folder
                sums = Exchange(f"{folder}/{attempt}", context.partitionId(), tasks)
            for tree, root in enumerate(train_here(plan, rows, sums)):
                if first:
                    yield from node_table(plan, tree, root).to_batches()
            if sums:
                sums.close()

        return self._model(spark, points.coalesce(tasks).mapInArrow(task, NODES, barrier=tasks > 1), width)

    def _model(self, spark, nodes: DataFrame, width: int) -> GBTClassificationModel:
        """Written as Spark's model files and loaded."""
        path, trees = scratch_path(spark, "boosted"), self.getMaxIter()
        nodes.write.parquet(f"{path}/data")
        meta = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
        own = {"class": "org.apache.spark.ml.classification.GBTClassificationModel", **meta, "uid": self.uid,
               "paramMap": {p.name: v for p, v in self._paramMap.items()},
               "defaultParamMap": {p.name: v for p, v in self._defaultParamMap.items()}, "numFeatures": width, "numTrees": trees}
        shared = {"labelCol", "featuresCol", "weightCol", "predictionCol", "maxDepth", "maxBins", "seed", "minInstancesPerNode", "minInfoGain", "cacheNodeIds",
                  "checkpointInterval", "impurity", "leafCol", "maxMemoryInMB", "minWeightFractionPerNode"}
        each = {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", **meta,
                **{k: {a: b for a, b in own[k].items() if a in shared} for k in ("paramMap", "defaultParamMap")}}
        spark.createDataFrame([(json.dumps(own),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        rows = [(i, json.dumps({**each, "uid": f"dtr_{uuid.uuid4().hex[:12]}"}), 1.0 if i == 0 else self.getStepSize()) for i in range(trees)]
        spark.createDataFrame(rows, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        model, files = GBTClassificationModel.load(path), spark._jvm.org.apache.hadoop.fs.Path(path)
        files.getFileSystem(spark._jsc.hadoopConfiguration()).delete(files, True)
        return self._copyValues(model)


def _first_int(seed: int) -> int:
    """The first whole number of an XORShiftRandom."""
    v = _step(_state(seed)) & 0xFFFFFFFF
    return v - (1 << 32) if v >> 31 else v
