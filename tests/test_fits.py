"""Many fits at once, against plain loops over one fit."""

import numpy as np
import pytest

from fieldloom.operators import features, fits, models, splits
from fieldloom.plans import protocols


def data(n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[:, 1] = np.round(x[:, 1], 1)
    y = (x[:, 0] + 0.7 * x[:, 1] * (x[:, 2] > 0) + rng.normal(size=n) * 0.7 > 0.3).astype(int)
    return x, y


def frame(spark, x, y):
    rows = [(i, int(t), *[None if np.isnan(v) else float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "row_id long, label int, a double, b double, c double")


def plain_logistic(x, y, c=1.0):
    """Gradient and Hessian of one fit over all rows, to convergence."""
    med = np.nan_to_num(np.nanmedian(x, axis=0))
    x = np.where(np.isnan(x), med, x)
    s = x.std(0)
    z = np.column_stack((np.ones(len(x)), (x - x.mean(0)) / np.where(s > 0, s, 1)))
    w, ridge = np.zeros(z.shape[1]), np.r_[0, np.full(x.shape[1], 1 / c)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge), z.T @ (p - y) + ridge * w)
    return 1 / (1 + np.exp(-z @ w)), w


def test_logistic_fits_equal_single_fits(spark):
    x, y = data()
    x[::17, 2] = np.nan
    rows = frame(spark, x, y)
    asked = [fits.Fit(0, 150, ("a", "b", "c")), fits.Fit(100, 300, ("a", "b", "c")), fits.Fit(0, 300, ("b",)),
             fits.Fit(0, 150, ("c", "a"))]
    for f, m in zip(asked, fits.logistic(rows.repartition(3), asked), strict=True):
        take = ["abc".index(c) for c in f.columns]
        p, w = plain_logistic(x[f.lo : f.hi][:, take], y[f.lo : f.hi])
        assert np.allclose(m.weights, w, atol=1e-6) and np.allclose(m.score(x[f.lo : f.hi][:, take]), p, atol=1e-6)


def test_one_class_and_constant_columns(spark):
    x, y = data(60)
    y[:30], x[:, 1] = 0, 4.0
    rows = frame(spark, x, y)
    one, two = fits.logistic(rows, [fits.Fit(0, 30, ("a", "b")), fits.Fit(0, 60, ("a", "b"))])
    assert one.constant == fits.EDGE and two.constant is None and abs(two.weights[2]) < 1e-9
    tree = fits.boosted(rows, [fits.Fit(0, 30, ("a",), (("n_estimators", 2),))])[0]
    assert tree.constant == fits.EDGE and (tree.score(np.zeros((4, 1))) == fits.EDGE).all()
    with pytest.raises(ValueError):
        fits.logistic(rows, [fits.Fit(90, 95, ("a",))])
    with pytest.raises(ValueError):
        fits.boosted(rows, [fits.Fit(0, 60, ("a",), (("n_trees", 2),))])


def plain_boosted(x, y, edges, p):
    """One fit in recursive loops over rows: every split of every node by its gain."""
    bins = fits.binned(x, edges)
    margin = np.full(len(x), np.log(y.mean() / (1 - y.mean())))
    trees = []

    def leaf(g, h):
        return -p["learning_rate"] * g.sum() / (h.sum() + p["l2"])

    for _ in range(p["n_estimators"]):
        q = 1 / (1 + np.exp(-margin))
        g, h, out, found = q - y, q * (1 - q), np.zeros(len(x)), {}

        def grow(node, own, depth):
            out[own] = leaf(g[own], h[own])
            best = (fits.MIN_GAIN, None)
            for f in range(x.shape[1]):
                for cut in np.unique(bins[own, f])[:-1]:
                    l, r = own[bins[own, f] <= cut], own[bins[own, f] > cut]
                    if min(h[l].sum(), h[r].sum()) < p["min_hessian"] or min(len(l), len(r)) < p["min_rows"]:
                        continue
                    gain = round(sum(s * g[i].sum() ** 2 / (h[i].sum() + p["l2"]) for s, i in ((1, l), (1, r), (-1, own))), 9)
                    if gain > best[0]:
                        best = (gain, (f, int(cut), l, r))
            if best[1] is None or depth == p["max_depth"]:
                return
            f, cut, l, r = best[1]
            found[node] = (best[0], f, cut, own, l, r)
            grow(2 * node + 1, l, depth + 1)
            grow(2 * node + 2, r, depth + 1)

        grow(0, np.arange(len(x)), 0)
        if p["leaves"]:
            kept, ready = [], [0] if 0 in found else []
            while ready and len(kept) < p["leaves"] - 1:
                ready.sort(key=lambda n: (-found[n][0], n))
                kept.append(ready.pop(0))
                ready += [n for n in (2 * kept[-1] + 1, 2 * kept[-1] + 2) if n in found]
            for n in sorted(kept):
                for side in found[n][4:]:
                    out[side] = leaf(g[side], h[side])
            for n in sorted(set(found) - set(kept)):
                if (n - 1) // 2 in kept or n == 0:
                    out[found[n][3]] = leaf(g[found[n][3]], h[found[n][3]])
            found = {n: found[n] for n in kept}
        margin = margin + out
        trees.append({n: v[1:3] for n, v in found.items()})
    return 1 / (1 + np.exp(-margin)), trees


@pytest.mark.parametrize("more", [
    {"min_hessian": 4.0}, {"l2": 0.0, "min_hessian": 1e-3, "min_rows": 20, "leaves": 5},
])
def test_splits_and_leaves_equal_plain_loops(spark, more):
    x, y = data()
    x[::19, 0] = np.nan
    p = {**fits.BOOSTED, "n_estimators": 3, "max_depth": 3, "bins": 12, **more}
    given = tuple(sorted({k: p[k] for k in ("n_estimators", "max_depth", "bins", *more)}.items()))
    asked = [fits.Fit(0, 200, ("a", "b", "c"), given), fits.Fit(50, 300, ("a", "b", "c"), given)]
    got = fits.boosted(frame(spark, x, y).repartition(3), asked)
    for f, m in zip(asked, got, strict=True):
        own, t = x[f.lo : f.hi], y[f.lo : f.hi]
        score, trees = plain_boosted(own, t, m.edges, p)
        for tree, plain in zip(m.trees, trees, strict=True):
            assert {n: (int(tree.feature[n]), int(tree.cut[n])) for n in plain} == plain
        assert np.allclose(m.score(own), score, atol=1e-9)


def test_fits_share_their_passes(spark):
    """The number of jobs does not depend on the number of fits, and a fit does not depend on its company."""
    x, y = data(120)
    rows = frame(spark, x, y)
    given = (("bins", 8), ("max_depth", 2), ("n_estimators", 2))
    tracker = spark.sparkContext

    def jobs(asked):
        tracker.setJobGroup(f"fits {len(asked)}", "")
        out = fits.boosted(rows, asked)
        n = len(tracker.statusTracker().getJobIdsForGroup(f"fits {len(asked)}"))
        tracker.setLocalProperty("spark.jobGroup.id", None)
        return out, n

    one, few = jobs([fits.Fit(0, 80, ("a", "b"), given)])
    many, more = jobs([fits.Fit(0, 80, ("a", "b"), given)] + [fits.Fit(i, 90 + i, ("a", "c"), given) for i in range(20)])
    assert more <= few + 2
    assert np.array_equal(one[0].score(x[:, :2]), many[0].score(x[:, :2]))


def test_draws_and_staged_scores(spark):
    x, y = data(200)
    rows = frame(spark, x, y)
    given = (("bins", 8), ("columns", 0.67), ("max_depth", 2), ("n_estimators", 12), ("subsample", 0.7))
    a, b, other = (fits.boosted(r, [fits.Fit(0, 150, ("a", "b", "c"), given, s)])[0] for r, s in (
        (rows.repartition(2), 1), (rows.repartition(4), 1), (rows, 2)))
    assert np.allclose(a.score(x), b.score(x), atol=1e-9) and not np.allclose(a.score(x), other.score(x))
    assert all(len({int(f) for f in t.feature if f >= 0}) <= 2 for t in a.trees)
    fewer = fits.boosted(rows, [fits.Fit(0, 150, ("a", "b", "c"), (*given[:3], ("n_estimators", 5), given[4]), 1)])[0]
    assert np.allclose(a.score(x, 5), fewer.score(x), atol=1e-9)
    got = {(r["task"], r["row_id"]): r["score"] for r in fits.scores(rows, [(a, 150, 200, None), (a, 190, 200, 5)]).collect()}
    assert len(got) == 60 and abs(got[0, 160] - a.score(x[160:161])[0]) < 1e-12
    assert abs(got[1, 195] - fewer.score(x[195:196])[0]) < 1e-9


def test_tasks_are_scored_like_single_runs(spark):
    x, y = data(240)
    rows = frame(spark, x, y)
    folds = splits.rolling_origin(240, 3)
    small = {"n_estimators": 4, "max_depth": 2}
    specs = [models.ModelSpec("logistic"), models.ModelSpec("gbt_a", small), models.ModelSpec("gbt_b", {**small, "min_child_weight": 5})]
    got = {(r["model"], r["fold"], r["row_id"]): r["score"] for r in protocols.scored_tasks(
        rows, protocols.tasks_of(folds, specs, ["a", "b", "c"])).collect()}
    assert len(got) == 3 * sum(d - c for *_, c, d in folds)
    for fold, lo, hi, test_lo, test_hi in folds:
        _, w = plain_logistic(x[lo:hi], y[lo:hi])
        z = (x[test_lo:test_hi] - x[lo:hi].mean(0)) / x[lo:hi].std(0)
        want = 1 / (1 + np.exp(-(w[0] + z @ w[1:])))
        assert np.allclose([got["logistic", fold, r] for r in range(test_lo, test_hi)], want, atol=1e-6)


def test_seeds_that_draw_nothing_are_one_fit(spark):
    x, y = data(120)
    rows = frame(spark, x, y)
    folds = splits.rolling_origin(120, 2)
    seen = []
    real = fits.boosted

    def watched(rows, asked):
        seen.append(len(asked))
        return real(rows, asked)

    fits.boosted = watched
    try:
        fixed = models.ModelSpec("gbt_a", {"n_estimators": 2, "max_depth": 1})
        drawn = models.ModelSpec("gbt_a", {"n_estimators": 2, "max_depth": 1, "subsample": 0.5})
        a = protocols.across_seeds(rows, folds, ["a", "b"], [fixed], [1, 2, 3], rules=[])
        b = protocols.across_seeds(rows, folds, ["a", "b"], [drawn], [1, 2, 3], rules=[])
    finally:
        fits.boosted = real
    assert seen == [2, 6]
    spread = lambda r: len({round(x["roc_auc"], 9) for x in r.filter("fold = 2").collect()})
    assert a.count() == b.count() == 6 and spread(a) == 1 and spread(b) > 1


def test_selection_never_sees_the_outer_test_rows(spark):
    """Other labels and features in every outer test row change neither the chosen points nor how they were chosen."""
    x, y = data(240)
    outer = splits.rolling_origin(240, 2)
    grid = models.grid_points({"max_depth": [1, 2], "n_estimators": [2, 4], "min_child_weight": [1, 5]})
    last = outer[-1][3]
    other_x, other_y = x.copy(), y.copy()
    other_x[last:], other_y[last:] = -other_x[last:], 1 - other_y[last:]

    def run(x, y):
        return {r["fold"]: (r["selected_params"], r["pr_auc"]) for r in protocols.nested_cv(
            frame(spark, x, y), outer, "gbt_a", ["a", "b", "c"], grid, inner_k=2).collect()}

    one, two = run(x, y), run(other_x, other_y)
    assert {f: v[0] for f, v in one.items()} == {f: v[0] for f, v in two.items()} and set(one) == {1, 2}
    assert one[2][1] != two[2][1]


def test_ablation_scores_rules_once_and_trains_sets_together(spark):
    x, y = data(150)
    config = features.FeatureConfig(moisture_lags=(1,), diff_hours=(), roll_hours=(), weather_lags=(1,), weather_roll_hours=(),
        target_lags=(1,), weather=("air_temp",), require_full_window=False)
    names = sorted({c for s in features.ablation_sets(config).values() for c in s})
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, int(t), *map(float, rng.normal(size=len(names)))) for i, t in enumerate(y)],
        ", ".join(["row_id long, label int", *[f"{n} double" for n in names]]))
    folds = splits.rolling_origin(150, 2)
    got = protocols.ablation(rows, folds, config, [models.ModelSpec("logistic")], rules=["majority", "persistence"]).collect()
    sets = features.ablation_sets(config)
    for name, columns in sets.items():
        mine = {(r["model"], r["fold"]): r for r in got if r["feature_set"] == name}
        assert {m for m, _ in mine} == {"logistic", "majority"} | ({"persistence"} if "irrigation_event_lag1h" in columns else set())
        alone = protocols.evaluate(rows, folds, columns, [models.ModelSpec("logistic")], rules=["majority"]).collect()
        for r in alone:
            assert abs(mine[r["model"], r["fold"]]["brier"] - r["brier"]) < 1e-9
