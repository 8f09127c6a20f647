"""Many fits in one pass: folds, seeds, feature sets and grid points of a model are trained together.

A fit is a range of ``row_id`` to train on, the columns it may read and its parameters. Every
step (a Newton step of the logistic model, a level of a tree) is one pass over the rows for *all*
fits: tasks add up what a step needs from their own rows, Spark sums that by fit, and the driver
gets a few numbers a fit (a packed Gram matrix, the best split of each node). No fit's rows ever
meet in one task, and the number of jobs does not depend on the number of fits.

* Logistic regression minimises ``|w|^2 / 2 + sum of log losses`` over features with training medians
  for NULL, standardised by the training rows; the intercept is free.
* Boosted trees are second-order: a split gains ``GL^2/(HL+l2) + GR^2/(HR+l2) - G^2/(H+l2)``, a leaf is
  ``-rate G/(H+l2)``, and a child needs ``min_hessian`` and ``min_rows``. The first profile grows by levels
  with l2 = 1; the second splits the best leaf first, up to ``leaves``. A node's best split does not
  depend on the order of splitting, so both grow by levels and the second is then cut back.
  Cut points are quantiles of a fit's own training rows, made once. NULL sorts before all values.

A fit whose training rows are of one class scores that class's rate (kept off 0 and 1). Draws of
rows and columns are hashes of seed, tree and row, so they don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checkpointed

EDGE, MIN_GAIN = 1e-6, 1e-12
#: Margins are written every so many trees; in between, tasks add the trees that are not in them yet.
WRITE_EVERY = 10
#: Parameters of a boosted fit. ``leaves`` of 0 is no bound.
BOOSTED = {"n_estimators": 200, "max_depth": 6, "learning_rate": 0.1, "l2": 1.0, "min_hessian": 1.0, "min_rows": 1,
           "leaves": 0, "subsample": 1.0, "columns": 1.0, "bins": 64}


@dataclass(frozen=True)
class Fit:
    """Trains on ``lo <= row_id < hi`` with these columns."""

    lo: int
    hi: int
    columns: tuple[str, ...]
    params: tuple[tuple[str, float], ...] = ()
    seed: int = 42


@dataclass
class Linear:
    columns: tuple[str, ...]
    medians: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    weights: np.ndarray  # the intercept first
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (np.where(np.isnan(x), self.medians, x) - self.means) / self.deviations
        return sigmoid(self.weights[0] + z @ self.weights[1:])


@dataclass
class Tree:
    """Nodes by heap number: ``feature`` is -1 at a leaf; a row goes left if its bin is at most ``cut``."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def walk(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            right = bins[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)


@dataclass
class Boosted:
    columns: tuple[str, ...]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)
    constant: float | None = None

    def score(self, x: np.ndarray, n_trees: int | None = None) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        bins, margin = binned(x, self.edges), np.full(len(x), self.base)
        for tree in self.trees[:n_trees]:
            margin += tree.value[tree.walk(bins)]
        return sigmoid(margin)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """0 for a missing value, else 1 + the number of cut points below it."""
    out = np.zeros(x.shape, np.uint8)
    for i, e in enumerate(edges):
        known = ~np.isnan(x[:, i])
        out[known, i] = 1 + np.searchsorted(e, x[known, i], side="left")
    return out


def draw(seed: int, tree: int, rows: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each row."""
    z = rows.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def _numbers(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Columns of a batch as doubles, NULL as NaN."""
    if not columns:
        return np.zeros((batch.num_rows, 0))
    return np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float)
                            for c in columns])


def _numeric(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(F.col("row_id").cast("long").alias("row_id"), F.col("label").cast("double").alias("label"),
                       *[F.col(c).cast("double").alias(c) for c in columns])


def _ranges(rows: DataFrame, fits: list[Fit], columns: list[str], *measures) -> dict[tuple[int, int], dict]:
    """Aggregates of each distinct training range, all in one query."""
    ranges = sorted({(f.lo, f.hi) for f in fits})
    table = rows.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ranges)], "_g int, _lo long, _hi long")
    # A few ranges, known to the driver.
    inside = rows.join(F.broadcast(table), (F.col("row_id") >= F.col("_lo")) & (F.col("row_id") < F.col("_hi")))
    got = inside.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.avg("label").alias("_p"),
                                   *[m(c) for c in columns for m in measures]).collect()
    out = {ranges[r["_g"]]: r.asDict() for r in got}
    if lost := [x for x in ranges if x not in out]:
        raise ValueError(f"no training rows in {lost}")
    return out


def _constant(stats: dict) -> float | None:
    p = stats["_p"]
    return float(min(max(p, EDGE), 1 - EDGE)) if p in (0.0, 1.0) else None


# ---- logistic regression ----------------------------------------------------------------


def logistic(rows: DataFrame, fits: list[Fit], c: float = 1.0, steps: int = 30, tolerance: float = 1e-9) -> list[Linear]:
    """All fits by Newton's method: one aggregate of packed Gram matrices a step."""
    columns = sorted({x for f in fits for x in f.columns})
    rows = checkpointed(_numeric(rows, columns))
    median = _ranges(rows, fits, columns, lambda x: F.percentile(x, F.lit(0.5)).alias(f"med_{x}"))
    models = []
    for f in fits:
        s = median[f.lo, f.hi]
        med = np.array([np.nan_to_num(s[f"med_{x}"] if s[f"med_{x}"] is not None else 0.0) for x in f.columns])
        n = len(f.columns)
        models.append(Linear(f.columns, med, np.zeros(n), np.ones(n), np.zeros(n + 1), _constant(s)))
    live = [i for i, m in enumerate(models) if m.constant is None]

    def moments(f: Fit, m: Linear, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        filled = np.where(np.isnan(x), m.medians, x)
        return np.concatenate(([len(x)], filled.sum(0)))

    def spread(f: Fit, m: Linear, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return ((np.where(np.isnan(x), m.medians, x) - m.means) ** 2).sum(0)

    def newton(f: Fit, m: Linear, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.column_stack((np.ones(len(x)), (np.where(np.isnan(x), m.medians, x) - m.means) / m.deviations))
        p = sigmoid(z @ m.weights)
        gram = z.T @ (z * (p * (1 - p))[:, None])
        return np.concatenate((gram[np.triu_indices(len(gram))], z.T @ (p - y)))

    sums = _summed(rows, fits, models, live, columns, moments)
    counts = {i: s[0] for i, s in sums.items()}
    for i, s in sums.items():
        models[i].means = s[1:] / s[0]
    for i, s in _summed(rows, fits, models, live, columns, spread).items():
        deviation = np.sqrt(s / counts[i])
        # A column that does not vary carries nothing: it becomes 0 throughout.
        models[i].deviations = np.where(deviation > 1e-12 * np.maximum(1.0, np.abs(models[i].means)), deviation, 1.0)
    for _ in range(steps):
        if not live:
            break
        moved = []
        for i, s in _summed(rows, fits, models, live, columns, newton).items():
            n = len(fits[i].columns) + 1
            hessian = np.zeros((n, n))
            hessian[np.triu_indices(n)] = s[: n * (n + 1) // 2]
            hessian = hessian + np.triu(hessian, 1).T
            ridge = np.full(n, 1.0 / c)
            ridge[0] = 0.0
            move = np.linalg.solve(hessian + np.diag(ridge + 1e-12), s[n * (n + 1) // 2 :] + ridge * models[i].weights)
            models[i].weights = models[i].weights - np.clip(move, -10, 10)
            if np.abs(move).max() > tolerance:
                moved.append(i)
        live = moved
    return models


def _summed(rows: DataFrame, fits: list[Fit], models: list, live: list[int], columns: list[str], part) -> dict[int, np.ndarray]:
    """``part(fit, model, x, y)`` summed over all training rows of each live fit."""
    place = {c: i for i, c in enumerate(columns)}
    sent = rows.sparkSession.sparkContext.broadcast([(i, fits[i], models[i], [place[c] for c in fits[i].columns]) for i in live])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, at, y = _numbers(batch, columns), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, f, m, take in sent.value:
                own = (at >= f.lo) & (at < f.hi)
                if own.any():
                    s = part(f, m, x[own][:, take], y[own])
                    total[i] = total[i] + s if i in total else s
        if total:
            size = [len(s) for s in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(list(total), size), pa.int32()),
                pa.array(np.concatenate([np.arange(n) for n in size]), pa.int32()), pa.array(np.concatenate(list(total.values())))],
                ["fit", "pos", "v"])

    got = rows.mapInArrow(add, "fit int, pos int, v double").groupBy("fit", "pos").agg(F.sum("v").alias("v")).toPandas()
    return {int(i): g.sort_values("pos")["v"].to_numpy() for i, g in got.groupby("fit")}


# ---- boosted trees ----------------------------------------------------------------------


def boosted(rows: DataFrame, fits: list[Fit]) -> list[Boosted]:
    """All fits, tree by tree and level by level; see ``BOOSTED`` for the parameters."""
    params = [{**BOOSTED, **dict(f.params)} for f in fits]
    if lost := sorted({k for p in params for k in p} - set(BOOSTED)):
        raise ValueError(f"boosted trees have no parameters {lost}")
    columns = sorted({x for f in fits for x in f.columns})
    place = {c: i for i, c in enumerate(columns)}
    bins = max(int(p["bins"]) for p in params)
    if not 2 <= bins <= 255:
        raise ValueError("2 to 255 bins")
    rows = _numeric(rows, columns)
    shares = [i / bins for i in range(1, bins)]
    stats = _ranges(rows, fits, columns, lambda x: F.percentile_approx(x, shares, 10_000).alias(f"cut_{x}"))
    groups = sorted(stats)
    edges = [[np.unique(np.array(stats[g][f"cut_{c}"] or [], float)) for c in columns] for g in groups]
    group = [groups.index((f.lo, f.hi)) for f in fits]
    takes = [np.array([place[c] for c in f.columns], np.int64) for f in fits]
    models = []
    for f, g in zip(fits, group):
        p = min(max(stats[f.lo, f.hi]["_p"], EDGE), 1 - EDGE)
        models.append(Boosted(f.columns, [edges[g][place[c]] for c in f.columns], float(np.log(p / (1 - p))),
                              constant=_constant(stats[f.lo, f.hi])))
    live = [i for i, m in enumerate(models) if m.constant is None and params[i]["n_estimators"] > 0]
    context = rows.sparkSession.sparkContext
    width = len(columns)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _numbers(batch, columns)
            coded = np.stack([binned(x, e) for e in edges], axis=1)
            margin = np.repeat([m.base for m in models], batch.num_rows).reshape(len(models), -1).T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1),
                pa.array([r.tobytes() for r in coded], pa.binary()), _lists(margin)], ["row_id", "label", "bins", "margin"])

    def opened(batch: pa.RecordBatch):
        n = batch.num_rows
        coded = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, len(groups), width)
        margin = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, len(models))
        return batch.column(0).to_numpy(), batch.column(1).to_numpy(), coded, margin

    state = checkpointed(rows.mapInArrow(prepare, "row_id long, label double, bins binary, margin array<double>"))
    written = 0
    most = max((int(params[i]["n_estimators"]) for i in live), default=0)
    for number in range(most):
        growing = [i for i in live if number < params[i]["n_estimators"]]
        pending = {i: models[i].trees[written:] for i in growing}
        trees, allowed = {}, {}
        for i in growing:
            size = 2 ** (int(params[i]["max_depth"]) + 1) - 1
            trees[i] = Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))
            keep = max(1, round(params[i]["columns"] * len(takes[i])))
            lot = draw(fits[i].seed + 7, number, np.arange(len(takes[i])))
            allowed[i] = np.sort(np.argsort(lot, kind="stable")[:keep])
        gains: dict[int, dict[int, float]] = {i: {} for i in growing}
        frontier = {i: [0] for i in growing}
        depth = 0
        while frontier:
            sent = context.broadcast((frontier, trees, pending, allowed))
            draws = {i: (fits[i], params[i]["subsample"], group[i], takes[i]) for i in frontier}

            def histogram(batches: Iterator[pa.RecordBatch], sent=sent, draws=draws, number=number) -> Iterator[pa.RecordBatch]:
                front, grown, missing, columns_of = sent.value
                held: dict[int, np.ndarray] = {}
                for batch in batches:
                    at, y, coded, margin = opened(batch)
                    for i, nodes in front.items():
                        f, share, g, take = draws[i]
                        own = (at >= f.lo) & (at < f.hi)
                        if share < 1:
                            own &= draw(f.seed, number, at) < share
                        if not own.any():
                            continue
                        b = coded[own, g][:, take]
                        m = margin[own, i].copy()
                        for t in missing[i]:
                            m += t.value[t.walk(b)]
                        p = sigmoid(m)
                        node = grown[i].walk(b)
                        where = np.full(len(grown[i].feature), -1)
                        where[nodes] = np.arange(len(nodes))
                        slot = where[node]
                        here = slot >= 0
                        grad, hess, slot, b = (p - y[own])[here], (p * (1 - p))[here], slot[here], b[here]
                        size = len(nodes) * len(columns_of[i]) * 256
                        if i not in held:
                            held[i] = np.zeros((3, size))
                        for j, col in enumerate(columns_of[i]):
                            code = (slot * len(columns_of[i]) + j) * 256 + b[:, col]
                            for k, w in enumerate((grad, hess, None)):
                                held[i][k] += np.bincount(code, w, size)
                for i, sums in held.items():
                    full = np.flatnonzero(sums[2])
                    nodes, cols = front[i], columns_of[i]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), i), pa.int32()),
                        pa.array(np.asarray(nodes)[full // 256 // len(cols)], pa.int32()),
                        pa.array(cols[full // 256 % len(cols)], pa.int32()), pa.array(full % 256, pa.int32()),
                        *[pa.array(s[full]) for s in sums]], ["fit", "node", "feature", "bin", "g", "h", "n"])

            schema = "fit int, node int, feature int, bin int, g double, h double, n double"
            best = _best_splits(state.mapInArrow(histogram, schema), {i: params[i] for i in frontier})
            after: dict[int, list[int]] = {}
            for r in best:
                i, node, tree, p = r["fit"], r["node"], trees[r["fit"]], params[r["fit"]]
                leaf = lambda g, h, p=p: -p["learning_rate"] * g / (h + p["l2"]) if h + p["l2"] > 0 else 0.0
                if not depth:
                    tree.value[0] = leaf(r["gt"], r["ht"])
                if r["gain"] > MIN_GAIN and depth < p["max_depth"]:
                    tree.feature[node], tree.cut[node] = r["feature"], r["bin"]
                    tree.value[2 * node + 1] = leaf(r["gl"], r["hl"])
                    tree.value[2 * node + 2] = leaf(r["gt"] - r["gl"], r["ht"] - r["hl"])
                    gains[i][node] = r["gain"]
                    # Children at the full depth are leaves: they need no pass of their own.
                    if depth + 1 < p["max_depth"]:
                        after.setdefault(i, []).extend((2 * node + 1, 2 * node + 2))
            frontier, depth = {i: sorted(n) for i, n in after.items()}, depth + 1
        for i in growing:
            if params[i]["leaves"]:
                _cut_back(trees[i], gains[i], int(params[i]["leaves"]))
            models[i].trees.append(trees[i])
        if (number + 1) % WRITE_EVERY == 0 and number + 1 < most:
            fresh = context.broadcast({i: (models[i].trees[written:], group[i], takes[i]) for i in live})

            def advance(batches: Iterator[pa.RecordBatch], fresh=fresh) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    _, _, coded, margin = opened(batch)
                    margin = margin.copy()
                    for i, (grown, g, take) in fresh.value.items():
                        for t in grown:
                            margin[:, i] += t.value[t.walk(coded[:, g][:, take])]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(margin)], batch.schema.names)

            state = checkpointed(state.mapInArrow(advance, state.schema))
            written = number + 1
    return models


def _lists(x: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x).ravel()))


def _best_splits(parts: DataFrame, params: dict[int, dict]) -> list:
    """The best split of every node of every fit: running sums over the bins of each feature; the first feature and bin win ties."""
    table = parts.sparkSession.createDataFrame(
        [(i, float(p["l2"]), float(p["min_hessian"]), float(p["min_rows"])) for i, p in params.items()],
        "fit int, l2 double, least_h double, least_n double")
    node = ["fit", "node"]
    bins = parts.groupBy(*node, "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
    # At most 256 rows a node and feature.
    up = Window.partitionBy(*node, "feature").orderBy("bin")
    whole = Window.partitionBy(*node, "feature")
    d = bins.withColumns({f"{c}l": F.sum(c).over(up) for c in ("g", "h", "n")}).withColumns(
        {f"{c}t": F.sum(c).over(whole) for c in ("g", "h", "n")}).join(F.broadcast(table), "fit")
    right = {c: F.col(f"{c}t") - F.col(f"{c}l") for c in ("g", "h", "n")}
    part = lambda g, h: g * g / (h + F.col("l2"))
    enough = (F.col("hl") >= F.col("least_h")) & (right["h"] >= F.col("least_h")) & (F.col("nl") >= F.col("least_n")) & (
        right["n"] >= F.greatest(F.col("least_n"), F.lit(1.0)))
    gain = part(F.col("gl"), F.col("hl")) + part(right["g"], right["h"]) - part(F.col("gt"), F.col("ht"))
    # Rounded, so that sums in another order don't choose another of two equal splits.
    d = d.withColumn("gain", F.when(enough, F.round(gain, 9)))
    order = F.struct(F.coalesce(F.col("gain"), F.lit(-1.0)).alias("gain"), (-F.col("feature")).alias("f"),
                     (-F.col("bin")).alias("b"))
    best = F.max_by(F.struct("feature", "bin", "gl", "hl", "gt", "ht"), order).alias("s")
    return d.groupBy(*node).agg(F.max(order)["gain"].alias("gain"), best).select(*node, "gain", "s.*").collect()


def _cut_back(tree: Tree, gains: dict[int, float], leaves: int) -> None:
    """Keeps the splits that best-first growth would make, up to ``leaves`` leaves."""
    ready, kept = ({0} & set(gains)), set()
    while ready and len(kept) < leaves - 1:
        node = min(ready, key=lambda n: (-gains[n], n))
        ready.remove(node)
        kept.add(node)
        ready |= {2 * node + 1, 2 * node + 2} & set(gains)
    for node in set(gains) - kept:
        tree.feature[node] = -1


# ---- scores -----------------------------------------------------------------------------


def scores(rows: DataFrame, tests: list[tuple]) -> DataFrame:
    """(task, row_id, label, score) of all tests ``(model, lo, hi, n_trees or None)`` in one pass; a task is a test's place."""
    columns = sorted({c for t in tests for c in t[0].columns})
    place = {c: i for i, c in enumerate(columns)}
    sent = rows.sparkSession.sparkContext.broadcast([(*t, [place[c] for c in t[0].columns]) for t in tests])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _numbers(batch, columns), batch.column(0).to_numpy()
            for task, (model, lo, hi, n_trees, take) in enumerate(sent.value):
                own = np.flatnonzero((at >= lo) & (at < hi))
                if len(own):
                    own_x = x[own][:, take]
                    s = model.score(own_x) if isinstance(model, Linear) else model.score(own_x, n_trees)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), task), pa.int32()),
                        pa.array(at[own]), batch.column(1).take(pa.array(own)).cast(pa.int32()), pa.array(s)],
                        ["task", "row_id", "label", "score"])

    return _numeric(rows, columns).mapInArrow(run, "task int, row_id long, label int, score double")
