"""Boosted trees over histograms: listwise, pairwise and pointwise objectives on query groups, trained as Spark jobs.

Feature values become one byte each, the number of a quantile bin, with a bin of its own for what is missing.  Rows are dealt by
query: one row of the stage table is one query with its candidates, so a task can take the gradients of whole lists.  A pass over
that table adds up, per task, gradient, hessian and count of every cell (leaf, feature, bin); Spark sums the cells by key, and
only those sums (leaves x features x bins, whatever the number of rows) reach the driver, which picks the splits.  Sums are whole
numbers in fixed point, so a tree is the same in any order of addition and on any number of executors.

Leaves are split best first.  A pass counts the children of all leaves that may still be split, and only the smaller child of each;
the other is its parent less that.  So a tree takes about as many passes as it is deep.  Models for all folds are trained in the
same passes: each leaves one fold of the queries out.  Scores are written to a new stage table every ``keep`` trees.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import released, staged

#: Fixed point of gradients and hessians; a row's are below 1 in size or so, so 2^38 rows fit.
SCALE = float(1 << 24)
#: Rows that a task takes at a time, and whose cells it holds before it adds them up.
HELD = 20_000


@dataclass(frozen=True)
class Settings:
    objective: str = "lambdarank"
    trees: int = 400
    leaves: int = 31
    #: Levels of a symmetric tree, which has one split a level; 0 grows leaf by leaf.
    levels: int = 0
    rate: float = 0.05
    l2: float = 10.0
    bins: int = 127
    least_rows: int = 50
    least_hessian: float = 1e-3
    truncation: int = 55
    permutations: int = 10
    decay: float = 0.99
    seed: int = 7
    keep: int = 10


# ---------------------------------------------------------------- bins


def _values(rows: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value) of all rows; what is missing or not a number is left out."""
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return rows.select(F.explode(each).alias("x")).select("x.*").where(F.col("value").isNotNull() & ~F.isnan("value"))


def bin_edges(rows: DataFrame, features: list[str], bins: int = 127) -> DataFrame:
    """(feature, place, edge): the distinct inner quantiles of each feature over all rows; a value's bin is the number of edges below it.

    Distinct values are counted, dealt into sorted ranges and summed up there, so no task holds a whole feature; a quantile lies
    between the values at the whole ranks beside its position, and only the values at such ranks go on.
    """
    counts = _values(rows, features).groupBy("feature", "value").agg(F.count("*").alias("n"))
    dealt = staged(counts.repartitionByRange("feature", "value").withColumn("part", F.spark_partition_id()), "bin-values")
    ranges = Window.partitionBy("feature")
    before = F.sum("n").over(ranges.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = dealt.groupBy("feature", "part").agg(F.sum("n").alias("n"))
    sizes = sizes.select("feature", "part", F.coalesce(before, F.lit(0)).alias("before"), (F.sum("n").over(ranges) - 1).alias("last"))
    upto = F.sum("n").over(Window.partitionBy("feature", "part").orderBy("value"))
    ranked = dealt.withColumn("upto", upto).join(sizes, ["feature", "part"]).withColumn("end", F.col("before") + F.col("upto")).withColumn("start", F.col("end") - F.col("n"))
    step = bins / F.greatest("last", F.lit(1))
    least, most = F.greatest(F.ceil((F.col("start") - 1) * step - 1e-6), F.lit(1)), F.least(F.floor(F.col("end") * step + 1e-6), F.lit(bins - 1))
    near = ranked.withColumns({"least": least, "most": most}).where("least <= most").withColumn("k", F.explode(F.sequence("least", "most")))
    near = near.withColumn("at", F.col("last") * (F.col("k") / F.lit(float(bins))))
    has = lambda rank: F.max(F.when((rank >= F.col("start")) & (rank < F.col("end")), F.col("value")))
    cuts = near.groupBy("feature", "k").agg(has(F.floor("at")).alias("low"), has(F.ceil("at")).alias("high"), F.max("at").alias("at"))
    between = (F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high")
    edge = F.round(F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between), 9)
    each = cuts.groupBy("feature").agg(F.array_sort(F.collect_set(edge)).alias("edges"))
    return each.select("feature", F.posexplode("edges").alias("place", "edge"))


def _edge_lists(edges: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Edges by feature on the driver: at most bins - 1 numbers a feature."""
    out: dict[str, list] = {f: [] for f in features}
    for r in edges.collect():
        out[r.feature].append(r.edge)
    return [np.array(sorted(out[f])) for f in features]


def encoded(values: np.ndarray, edges: list[np.ndarray], bins: int) -> np.ndarray:
    """One byte a value: its bin, or ``bins`` where it is missing."""
    out = np.empty(values.shape, np.uint8)
    for f, cut in enumerate(edges):
        v = values[:, f]
        out[:, f] = np.where(np.isnan(v), bins, np.searchsorted(cut, v, "left"))
    return out


def _coded(rows: DataFrame, keep: list[Column], features: list[str], edges: list[np.ndarray], bins: int) -> DataFrame:
    """``keep`` and the bytes of every row."""
    slim = rows.select(*keep, F.array(*[F.col(f).cast("double") for f in features]).alias("_values"))
    out = slim.drop("_values").schema.add("codes", "binary")

    def run(batches):
        for b in batches:
            values = b.column(b.num_columns - 1)
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(features))
            codes = encoded(flat, edges, bins)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([c.tobytes() for c in codes], pa.binary())], names=out.names)

    return slim.mapInArrow(run, out)


# ---------------------------------------------------------------- gradients


def _lambdarank(s: np.ndarray, y: np.ndarray, p: Settings, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of pairs of which one stands within the truncation, by the change of NDCG that swapping them makes."""
    n, g, h = len(s), np.zeros(len(s)), np.zeros(len(s))
    order = np.argsort(-s, kind="stable")
    top = min(p.truncation, n - 1)
    gain, discount = np.exp2(y) - 1, 1 / np.log2(np.arange(n) + 2)
    best = (np.sort(gain)[::-1][: p.truncation] * discount[: p.truncation]).sum()
    if top < 1 or best <= 0:
        return g, h
    ys, ss, gs = y[order], s[order], gain[order]
    i, j = np.nonzero((ys[:top, None] != ys[None, :]) & (np.arange(top)[:, None] < np.arange(n)[None, :]))
    up = np.where(ys[i] > ys[j], i, j)
    down = i + j - up
    gap = ss[up] - ss[down]
    delta = (gs[up] - gs[down]) * np.abs(discount[i] - discount[j]) / best
    if ss[0] != ss[-1]:
        delta = delta / (0.01 + np.abs(gap))
    chance = 1 / (1 + np.exp(gap))
    push, curve = delta * chance, delta * chance * (1 - chance)
    gradient = np.bincount(down, push, n) - np.bincount(up, push, n)
    hessian = np.bincount(up, curve, n) + np.bincount(down, curve, n)
    total = 2 * push.sum()
    scale = np.log2(1 + total) / total if total > 0 else 1.0
    g[order], h[order] = gradient * scale, hessian * scale
    return g, h


def _yetirank(s: np.ndarray, y: np.ndarray, p: Settings, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairwise gradients of neighbours in seeded permutations of the list, weighted by how high they stand."""
    g, h = np.zeros(len(s)), np.zeros(len(s))
    rng = np.random.default_rng(key)
    for _ in range(p.permutations):
        u = rng.uniform(1e-12, 1, len(s))
        order = np.argsort(-(s - np.log(-np.log(u))), kind="stable")
        a, b = order[:-1], order[1:]
        w = p.decay ** np.arange(len(a)) * np.abs(y[a] - y[b]) / p.permutations
        up, down = np.where(y[a] > y[b], a, b), np.where(y[a] > y[b], b, a)
        chance = 1 / (1 + np.exp(s[up] - s[down]))
        g += np.bincount(down, w * chance, len(s)) - np.bincount(up, w * chance, len(s))
        curve = w * chance * (1 - chance)
        h += np.bincount(up, curve, len(s)) + np.bincount(down, curve, len(s))
    return g, h


def _xendcg(s: np.ndarray, y: np.ndarray, p: Settings, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy between the softmax of the scores and gains with seeded noise."""
    share = np.exp(s - s.max())
    share /= share.sum()
    phi = np.exp2(y) - np.random.default_rng(key).uniform(0, 1, len(s))
    return share - phi / phi.sum(), share * (1 - share)


def _binary(s: np.ndarray, y: np.ndarray, p: Settings, key: int) -> tuple[np.ndarray, np.ndarray]:
    chance = 1 / (1 + np.exp(-s))
    return chance - y, chance * (1 - chance)


OBJECTIVES: dict[str, Callable] = {"lambdarank": _lambdarank, "yetirank": _yetirank, "xendcg": _xendcg, "binary": _binary}


def gradients(s: np.ndarray, y: np.ndarray, w: np.ndarray, p: Settings, group: str, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of one list; what is drawn depends on seed, tree and group only."""
    g, h = OBJECTIVES[p.objective](s, y, p, zlib.crc32(f"{p.seed}:{tree}:{group}".encode()))
    return g * w, h * w


# ---------------------------------------------------------------- trees


@dataclass
class Tree:
    """Nodes as lists; a leaf has feature -1.  A row goes left if its bin is at most ``bin``, or is missing and ``missing`` says so."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, cut: tuple[int, int, bool], gain: float) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.missing[node] = cut
        self.gain[node] = gain
        at = len(self.feature)
        self.left[node], self.right[node] = at, at + 1
        for _ in range(2):
            for column, blank in ((self.feature, -1), (self.bin, 0), (self.missing, False), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
                column.append(blank)
        return at, at + 1

    def leaf_of(self, codes: np.ndarray, bins: int) -> np.ndarray:
        at = np.zeros(len(codes), np.int64)
        feature, cut, missing, left, right = (np.array(x) for x in (self.feature, self.bin, self.missing, self.left, self.right))
        rows = np.arange(len(codes))
        while len(rows := rows[feature[at[rows]] >= 0]):
            k = at[rows]
            code = codes[rows, feature[k]]
            goes = np.where(code == bins, missing[k], code <= cut[k])
            at[rows] = np.where(goes, left[k], right[k])
        return at

    def predict(self, codes: np.ndarray, bins: int) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(codes, bins)]


def _gains(hist: np.ndarray, p: Settings) -> np.ndarray:
    """Gain of each cut (feature, bin, missing left) of a leaf's cells (feature, bin, 3); what is not allowed has none."""
    g, h, n = hist[..., 0] / SCALE, hist[..., 1] / SCALE, hist[..., 2]
    total = [x[0].sum() for x in (g, h, n)]
    sides = []
    for with_missing in (False, True):
        left = [x[:, : p.bins - 1].cumsum(1) + (x[:, p.bins :] if with_missing else 0) for x in (g, h, n)]
        right = [t - x for t, x in zip(total, left, strict=True)]
        gain = left[0] ** 2 / (left[1] + p.l2) + right[0] ** 2 / (right[1] + p.l2) - total[0] ** 2 / (total[1] + p.l2)
        if not p.levels:
            fits = (np.minimum(left[2], right[2]) >= p.least_rows) & (np.minimum(left[1], right[1]) >= p.least_hessian)
            gain = np.where(fits, gain, -np.inf)
        sides.append(np.where(hist[:, p.bins :, 2] > 0, gain, -np.inf) if with_missing else gain)
    return np.stack(sides, -1)


def _best(gains: np.ndarray) -> tuple[float, tuple[int, int, bool]]:
    """The greatest gain, of equal ones that of the first feature, bin and side."""
    k = int(np.argmax(gains))
    f, b, m = np.unravel_index(k, gains.shape)
    return float(gains.flat[k]), (int(f), int(b), bool(m))


def _weight(hist: np.ndarray, p: Settings) -> float:
    g, h = hist[0, :, 0].sum() / SCALE, hist[0, :, 1].sum() / SCALE
    return float(-p.rate * g / (h + p.l2)) if hist[0, :, 2].sum() else 0.0


class _Growing:
    """A tree under construction: what it still has to know, and how it goes on when it knows it."""

    def __init__(self, p: Settings):
        self.p, self.tree, self.done = p, Tree(), False
        self.cells: dict[int, np.ndarray] = {}
        self.cuts: dict[int, tuple[float, tuple[int, int, bool]]] = {}
        self.waiting: dict[int, tuple[int, int]] = {}
        self.leaves = [0]

    def wanted(self) -> list[int]:
        """Nodes whose cells the next pass has to add up."""
        if self.done:
            return []
        return [0] if not self.cells else [small for small, _ in self.waiting.values()]

    def learn(self, found: dict[int, np.ndarray]) -> None:
        self.cells |= found
        for parent, (small, large) in self.waiting.items():
            self.cells[large] = self.cells[parent] - self.cells[small]
        self.waiting = {}
        self._level() if self.p.levels else self._leaf()

    def _children(self, node: int, cut: tuple[int, int, bool], gain: float) -> None:
        f, b, missing = cut
        left, right = self.tree.split(node, cut, gain)
        counts = self.cells[node][f, :, 2]
        on_left = counts[: b + 1].sum() + (counts[self.p.bins] if missing else 0)
        self.waiting[node] = (left, right) if 2 * on_left <= counts.sum() else (right, left)

    def _leaf(self) -> None:
        """Best first over known nodes; leaves whose children are unknown are split on trial, all at once."""
        tree, p, cuts = self.tree, self.p, self.cuts
        cuts |= {k: _best(_gains(cells, p)) for k, cells in self.cells.items() if k not in cuts}
        leaves, pending = [0], False
        while len(leaves) < p.leaves:
            able = [(-cuts[k][0], k) for k in leaves if cuts[k][0] > 0]
            if not able:
                break
            node = min(able)[1]
            if tree.feature[node] < 0 or tree.left[node] not in self.cells:
                pending = True
                break
            leaves.remove(node)
            leaves += [tree.left[node], tree.right[node]]
        if pending:
            # no more leaves can be split than are still to come
            for _, node in sorted(able)[: p.leaves - len(leaves)]:
                if tree.feature[node] < 0:
                    self._children(node, cuts[node][1], cuts[node][0])
            return
        self._close(leaves)

    def _level(self) -> None:
        """One cut for all leaves of a level, the one that gains most in sum."""
        tree, p = self.tree, self.p
        gain, cut = 0.0, (0, 0, False)
        if len(self.leaves) < 1 << p.levels:
            gain, cut = _best(np.add.reduce([np.maximum(_gains(self.cells[k], p), 0.0) for k in self.leaves]))
        if gain <= 0:
            self._close(self.leaves)
            return
        for node in self.leaves:
            self._children(node, cut, gain / len(self.leaves))
        self.leaves = [k for node in self.leaves for k in (tree.left[node], tree.right[node])]

    def _close(self, leaves: list[int]) -> None:
        """Trial splits below the leaves go; what is left is renumbered from the root, level by level."""
        old, final = self.tree, Tree()
        queue = [(0, 0)]
        for node, at in queue:
            if node in leaves:
                final.value[at] = _weight(self.cells[node], self.p)
                continue
            a, b = final.split(at, (old.feature[node], old.bin[node], old.missing[node]), old.gain[node])
            queue += [(old.left[node], a), (old.right[node], b)]
        self.tree, self.done, self.cells, self.cuts = final, True, {}, {}


# ---------------------------------------------------------------- training


@dataclass
class Model:
    features: list[str]
    edges: list[np.ndarray]
    settings: Settings
    #: Trees of each fold's model, which has not seen that fold's groups.
    folds: list[list[Tree]]


def packed(rows: DataFrame, group: str, key: str, features: list[str], edges: list[np.ndarray], bins: int, label: str, weight: str | None, fold: str) -> DataFrame:
    """One row per group: its fold and, in order of key, the labels, weights and bytes of its rows."""
    keep = [F.col(group).cast("string").alias("grp"), F.col(key).alias("item"), F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.col(fold).cast("int").alias("fold")]
    each = F.array_sort(F.collect_list(F.struct("item", "y", "w", "codes")))
    lists = _coded(rows, keep, features, edges, bins).groupBy("grp").agg(F.max("fold").alias("fold"), each.alias("rows"))
    return lists.select("grp", "fold", *[F.col(f"rows.{c}").alias(c) for c in ("item", "y", "w", "codes")], F.lit(None).cast("binary").alias("scores"))


def _chunks(batch: pa.RecordBatch, n_models: int, n_features: int):
    """(groups, folds, bounds, y, w, codes, scores by model) of packed groups, about ``HELD`` rows at a time; group k has the rows from bounds[k] on."""
    ends = np.cumsum(pc.list_value_length(batch.column("y")).to_numpy())
    first = 0
    while first < batch.num_rows:
        done = ends[first - 1] if first else 0
        until = max(first + 1, int(np.searchsorted(ends, done + HELD, "right")))
        part = batch.slice(first, until - first)
        bounds = np.concatenate([[0], ends[first:until] - done])
        y, w = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(float) for c in "yw")
        codes = np.frombuffer(b"".join(part.column("codes").flatten().to_pylist()), np.uint8).reshape(len(y), n_features)
        scores = np.zeros((n_models, len(y)))
        for k, known in enumerate(part.column("scores").to_pylist()):
            if known is not None:
                scores[:, bounds[k] : bounds[k + 1]] = np.frombuffer(known).reshape(n_models, -1)
        yield part.column("grp").to_pylist(), part.column("fold").to_numpy(), bounds, y, w, codes, scores
        first = until


def _shares(spark: SparkSession) -> int:
    """Files of the stage table: its bytes are few beside the work on them, and files dealt by bytes alone would leave a pass to one task."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _pass(table: DataFrame, model: Model, since: int, growing: list[_Growing]) -> list[dict[int, np.ndarray]]:
    """Cells of the nodes that growing trees want, added up over the table."""
    p, n_features, n_models = model.settings, len(model.features), len(model.folds)
    width, number = p.bins + 1, len(model.folds[0])
    wanted = [g.wanted() for g in growing]
    trees, fresh = [g.tree for g in growing], [trees[since:] for trees in model.folds]
    slots = max(map(len, wanted))

    def run(batches):
        sums = {m: np.zeros((3, len(ks) * n_features * width), np.int64) for m, ks in enumerate(wanted) if ks}
        for b in batches:
            for groups, folds, bounds, y, w, codes, scores in _chunks(b, n_models, n_features):
                of = np.repeat(np.arange(len(groups)), np.diff(bounds))
                for m in sums:
                    # wanted nodes are leaves as yet
                    slot = np.full(len(trees[m].feature), -1, np.int64)
                    slot[wanted[m]] = np.arange(len(wanted[m]))
                    mine = np.where(folds[of] == m, -1, slot[trees[m].leaf_of(codes, p.bins)])
                    rows = np.flatnonzero(mine >= 0)
                    # a list is scored whole, but only where one of its rows is asked for
                    asked = np.unique(of[rows])
                    lists = np.flatnonzero(np.isin(of, asked))
                    s, g, h = scores[m].copy(), np.zeros(len(y)), np.zeros(len(y))
                    s[lists] += sum((t.predict(codes[lists], p.bins) for t in fresh[m]), np.zeros(len(lists)))
                    for k in asked:
                        at = slice(bounds[k], bounds[k + 1])
                        g[at], h[at] = gradients(s[at], y[at], w[at], p, groups[k], number)
                    # sums of whole numbers are exact in double precision here
                    cell = ((mine[rows, None] * n_features + np.arange(n_features)) * width + codes[rows]).ravel()
                    for k, x in enumerate((g, h)):
                        sums[m][k] += np.bincount(cell, np.repeat(np.rint(x[rows] * SCALE), n_features), sums[m].shape[1]).astype(np.int64)
                    sums[m][2] += np.bincount(cell, minlength=sums[m].shape[1])
        for m, total in sums.items():
            at = np.flatnonzero(total[2])
            yield pa.RecordBatch.from_arrays([pa.array(at + m * slots * n_features * width), *(pa.array(x[at]) for x in total)], names=["cell", "g", "h", "n"])

    cells = table.mapInArrow(run, "cell bigint, g bigint, h bigint, n bigint")
    found = cells.groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
    whole = np.zeros((len(growing) * slots * n_features * width, 3), np.int64)
    whole[found["cell"].to_numpy()] = np.stack([found[c].to_numpy() for c in "ghn"], 1)
    whole = whole.reshape(len(growing), slots, n_features, width, 3)
    return [{node: whole[m, k] for k, node in enumerate(nodes)} for m, nodes in enumerate(wanted)]


def _rescored(table: DataFrame, model: Model, since: int) -> DataFrame:
    """The table with the scores of all trees so far."""
    p, n_features, n_models = model.settings, len(model.features), len(model.folds)
    fresh = [trees[since:] for trees in model.folds]

    def run(batches):
        for b in batches:
            out = []
            for _, _, bounds, _, _, codes, scores in _chunks(b, n_models, n_features):
                for m, trees in enumerate(fresh):
                    for t in trees:
                        scores[m] += t.predict(codes, p.bins)
                out += [scores[:, i:j].tobytes() for i, j in itertools.pairwise(bounds)]
            names = b.schema.names
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if c == "scores" else b.column(k) for k, c in enumerate(names)], names=names)

    return table.mapInArrow(run, table.schema)


def train(rows: DataFrame, group: str, key: str, features: list[str], label: str, fold: str, folds: int, settings: Settings, weight: str | None = None, edges: DataFrame | None = None) -> tuple[Model, DataFrame]:
    """Models that each leave a fold out, and the stage table of all groups with the scores of all models.

    Groups are a query's candidates, whose number the pool bounds; one group is one row.  Labels that are null count as 0.
    """
    if settings.objective not in OBJECTIVES:
        raise ValueError(settings.objective)
    edges = bin_edges(rows, features, settings.bins) if edges is None else edges
    model = Model(features, _edge_lists(edges, features), settings, [[] for _ in range(folds)])
    lists = packed(rows.na.fill(0, [label]), group, key, features, model.edges, settings.bins, label, weight, fold)
    table = staged(lists.repartition(_shares(rows.sparkSession)), "boost")
    since = 0
    for k in range(settings.trees):
        growing = [_Growing(settings) for _ in range(folds)]
        while not all(g.done for g in growing):
            for g, found in zip(growing, _pass(table, model, since, growing), strict=True):
                if not g.done:
                    g.learn(found)
        for trees, g in zip(model.folds, growing, strict=True):
            trees.append(g.tree)
        if (k + 1) % settings.keep == 0 or k + 1 == settings.trees:
            after = staged(_rescored(table, model, since), "boost")
            released(table)
            table, since = after, k + 1
    return model, table


def out_of_fold(model: Model, table: DataFrame) -> DataFrame:
    """(grp, item, y, fold, score): every group by the model that has not seen it."""
    n = len(model.folds)
    out = table.select("grp", "item", "y", "fold").schema
    kind = out["item"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            scores = []
            for _, folds, bounds, _, _, _, s in _chunks(b, n, len(model.features)):
                scores += [s[fold, i:j] for fold, (i, j) in zip(folds, itertools.pairwise(bounds), strict=True)]
            at = {c: k for k, c in enumerate(b.schema.names)}
            column = lambda c: b.column(at[c])  # noqa: B023, E731
            sizes = [len(s) for s in scores]
            repeat = pa.array(np.repeat(np.arange(b.num_rows), sizes))
            flat = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([column("grp").take(repeat), column("item").flatten(), column("y").flatten(), column("fold").take(repeat), pa.array(flat)], names=["grp", "item", "y", "fold", "score"])

    return table.mapInArrow(run, f"grp string, item {kind}, y double, fold int, score double")


def score(model: Model, rows: DataFrame, keep: list[str], fold: str | None = None) -> DataFrame:
    """``keep`` and ``score`` of rows: by the model that left the row's ``fold`` out, or, without one, the mean of all models."""
    p, n_features = model.settings, len(model.features)
    at = F.lit(-1) if fold is None else F.col(fold).cast("int")
    coded = _coded(rows, [F.struct(*keep).alias("row"), at.alias("fold")], model.features, model.edges, p.bins)
    out = coded.select("row").schema.add("score", "double")

    def run(batches):
        for b in batches:
            codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, n_features)
            held, total = b.column(1).to_numpy(), np.zeros(b.num_rows)
            for m, trees in enumerate(model.folds):
                mine = np.flatnonzero((held == m) | (held < 0))
                share = np.where(held[mine] < 0, 1 / len(model.folds), 1.0)
                for t in trees if len(mine) else ():
                    total[mine] += share * t.predict(codes[mine], p.bins)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total)], names=["row", "score"])

    return coded.mapInArrow(run, out).select("row.*", "score")


def list_gradients(rows: DataFrame, group: str, key: str, scored: str, label: str, settings: Settings) -> DataFrame:
    """(grp, item, gradient, hessian) of all rows at the scores they have, list by list; equal scores stand in order of key."""
    each = F.array_sort(F.collect_list(F.struct(F.col(key).alias("item"), F.col(scored).cast("double").alias("s"), F.col(label).cast("double").alias("y"))))
    lists = rows.groupBy(F.col(group).cast("string").alias("grp")).agg(each.alias("rows")).select("grp", *[F.col(f"rows.{c}").alias(c) for c in ("item", "s", "y")])
    kind = lists.schema["item"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            found = [gradients(np.array(s, float), np.array(y, float), np.ones(len(s)), settings, grp, 0) for grp, s, y in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True)]
            repeat = pa.array(np.repeat(np.arange(b.num_rows), [len(g) for g, _ in found]))
            flat = [np.concatenate([x[k] for x in found]) if found else np.empty(0) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(repeat), b.column(1).flatten(), *map(pa.array, flat)], names=["grp", "item", "gradient", "hessian"])

    return lists.mapInArrow(run, f"grp string, item {kind}, gradient double, hessian double")


def model_table(spark: SparkSession, model: Model) -> DataFrame:
    """(model, tree, node, feature, upper, missing_left, left, right, value, gain): the trees as rows; leaves have no feature."""
    rows = []
    for m, trees in enumerate(model.folds):
        for t, tree in enumerate(trees):
            for k, f in enumerate(tree.feature):
                if f < 0:
                    rows.append((m, t, k, None, None, None, None, None, tree.value[k], None))
                else:
                    cut = model.edges[f]
                    upper = float(cut[tree.bin[k]]) if tree.bin[k] < len(cut) else float("inf")
                    rows.append((m, t, k, model.features[f], upper, tree.missing[k], tree.left[k], tree.right[k], None, tree.gain[k]))
    return spark.createDataFrame(rows, "model int, tree int, node int, feature string, upper double, missing_left boolean, left int, right int, value double, gain double")


def gain_shares(trees: DataFrame) -> DataFrame:
    """(feature, splits, gain): features of a model table by what their splits gained."""
    return trees.where("feature is not null").groupBy("feature").agg(F.count("*").alias("splits"), F.sum("gain").alias("gain"))
