"""Gap filling and drift compensation, and how well they work."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import by_time, checkpointed, clip


def interpolate(df: DataFrame, column: str, keys: list[str], out: str | None = None) -> DataFrame:
    """Linear by row position between known values; the ends take the nearest one."""
    w = by_time(keys)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    d = df.withColumn("_pos", F.row_number().over(w))
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(column).alias("v")))
    d = d.withColumn("_a", F.last(known, ignorenulls=True).over(before)).withColumn("_b",
        F.first(known, ignorenulls=True).over(after))
    share = (F.col("_pos") - F.col("_a.p")) / (F.col("_b.p") - F.col("_a.p"))
    filled = F.coalesce(F.col(column), F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share, F.col("_a.v"),
        F.col("_b.v"))
    return d.withColumn(out or column, filled).drop("_pos", "_a", "_b")


def centred_min(column: str, keys: list[str], hours: int = 24) -> Column:
    """Rolling minimum centred on the row; an even width reaches one row further back."""
    return F.min(column).over(by_time(keys).rowsBetween(-(hours // 2), hours - hours // 2 - 1))


def with_ewm(df: DataFrame, column: str, keys: list[str], span: int, out: str, chunk: int = 512) -> DataFrame:
    """Exponentially weighted mean (recursive form; the first known value starts it, gaps weigh by elapsed rows).

    A two-level affine scan: each chunk of rows folds to (weight, value) from nothing, the
    chunks' states chain in one short fold a key, and a second fold inside a chunk starts from
    the state before it. State (y, age) is the mean and the rows since the last known value.
    """
    alpha = 2.0 / (span + 1)
    w = by_time(keys)
    d = df.withColumn("_pos", F.row_number().over(w) - 1).withColumn("_c", F.floor(F.col("_pos") / chunk))
    # y is the mean so far and s the decayed old weight of it: a known x gives
    # y = (s y + alpha x) / (s + alpha) and resets s to 1; every row multiplies s by 1 - alpha.
    step = lambda state, x: F.when(
        x.isNull(), F.struct(state["y"].alias("y"), (state["s"] * (1 - alpha)).alias("s"))
    ).when(state["y"].isNull(), F.struct(x.alias("y"), F.lit(1.0).alias("s"))).otherwise(
        F.struct(((state["s"] * (1 - alpha) * state["y"] + alpha * x) / (state["s"] * (1 - alpha) + alpha)).alias("y"),
            F.lit(1.0).alias("s"))
    )
    empty = F.struct(F.lit(None).cast("double").alias("y"), F.lit(1.0).alias("s"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.col(column).cast("double").alias("x")))),
        lambda r: r["x"])
    chunks = d.groupBy(*keys, "_c").agg(ordered.alias("xs"), F.min("_pos").alias("_lo"))
    # Carry: the state at each chunk's start, folded over what the chunks before it hold.
    # What a chunk does to (y, s) is affine in y once it knows how its first value weighs.
    first = F.filter(F.transform("xs", lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda r: r["x"].isNotNull())[0]
    chunks = chunks.withColumn("_n", F.size("xs")).withColumn("_f", first["i"])
    tail = F.aggregate(F.expr("slice(xs, _f + 1, _n)"),
        F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("y"), F.lit(1.0).alias("s"), F.lit(False).alias("on")),
        lambda a, x: F.when(
        ~a["on"], F.struct(F.lit(1.0).alias("k"), F.lit(0.0).alias("y"), F.lit(1.0).alias("s"), F.lit(True).alias("on"))
    ).when(x.isNull(), F.struct(a["k"].alias("k"), a["y"].alias("y"), (a["s"] * (1 - alpha)).alias("s"),
        F.lit(True).alias("on"))).otherwise(F.struct(
        (a["k"] * a["s"] * (1 - alpha) / (a["s"] * (1 - alpha) + alpha)).alias("k"),
        ((a["s"] * (1 - alpha) * a["y"] + alpha * x) / (a["s"] * (1 - alpha) + alpha)).alias("y"),
            F.lit(1.0).alias("s"), F.lit(True).alias("on"),
    )))
    # After the chunk: y = k * y_at_first + add, with y_at_first from the state before and the first value.
    chunks = chunks.withColumn("_t", F.when(F.col("_f").isNotNull(), tail)).withColumn("_x0", first["x"])
    order = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    info = F.collect_list(F.struct("_n", "_f", "_x0", F.col("_t.k").alias("k"), F.col("_t.y").alias("add"),
        F.col("_t.s").alias("s1"))).over(order)
    carry = lambda a, c: F.when(c["_f"].isNull(), F.struct(a["y"].alias("y"),
        (a["s"] * F.pow(F.lit(1 - alpha), c["_n"])).alias("s"))).otherwise(F.struct(
        (c["k"] * F.when(a["y"].isNull(), c["_x0"]).otherwise(
            (a["s"] * F.pow(F.lit(1 - alpha), c["_f"] + 1) * a["y"] + alpha * c["_x0"])
                / (a["s"] * F.pow(F.lit(1 - alpha), c["_f"] + 1) + alpha)
        ) + c["add"]).alias("y"), c["s1"].alias("s")))
    chunks = chunks.withColumn("_state", F.aggregate(F.coalesce(info, F.array()), empty, carry))
    scan = F.aggregate("xs", F.struct(F.col("_state").alias("st"), F.array().cast("array<double>").alias("ys")),
        lambda a, x: F.struct(step(a["st"], x).alias("st"),
        F.concat(a["ys"], F.array(step(a["st"], x)["y"])).alias("ys")))
    values = chunks.select(*keys, "_lo", F.posexplode(scan["ys"]).alias("_i", out)).select(*keys,
        (F.col("_lo") + F.col("_i")).alias("_pos"), out)
    return d.join(values, [*keys, "_pos"]).drop("_pos", "_c")


def compensate_drift(df: DataFrame, column: str, keys: list[str], window_hours: int = 24,
    out: str | None = None) -> DataFrame:
    """Baseline = smoothed rolling minimum above its own lowest value; subtracted, then kept in [0, 100]."""
    d = with_ewm(df.withColumn("_min", centred_min(column, keys, window_hours)), "_min", keys, window_hours, "_base")
    floor = F.min("_base").over(Window.partitionBy(*keys))
    return d.withColumn(out or column, clip(F.col(column) - (F.col("_base") - floor), 0.0, 100.0)).drop("_min", "_base")


#: The cell index has this many of the features as axes, and about this many donors in a cell at the finest level.
AXES, PER_CELL = 3, 32


def _mask(features: list[str]) -> Column:
    """Which features a row has, as the bits of a number."""
    bits = [F.when(F.col(f).isNotNull(), F.lit(1 << i)).otherwise(0) for i, f in enumerate(features)]
    return sum(bits[1:], bits[0])


def _cell(at: Column, low: float, width: float) -> Column:
    return F.floor((at - F.lit(low)) / F.lit(width)).cast("long")


def _nearest(queries: DataFrame, donors: DataFrame, both: int, shared: list[str], scale: float, names: list[str],
    order: list[str], k: int) -> DataFrame:
    """The k nearest donors of each query that share the features ``both`` with it: a grid that gets coarser for who is not done.

    A query looks at its own cell and the cells around it. Its k-th distance is final if it is no
    more than one cell's width, because anything outside lies further off than that; else the query
    meets cells of twice the width. A query is done at the latest where its block covers all donors.
    """
    axes = shared[:AXES]
    box = donors.agg(F.count(F.lit(1)).alias("n"), *[f(f"d_{c}").alias(f"{n}_{c}") for c in axes
        for n, f in (("lo", F.min), ("hi", F.max), ("sd", F.stddev_pop))]).first()
    # All donors within one block: of the widths that double, the one at which nobody can be left over.
    reach = [max(box[f"hi_{c}"] - box[f"lo_{c}"], 0.0) for c in axes]
    fine = (PER_CELL / max(box["n"], 1)) ** (1 / len(axes))
    width = [max(2 * box[f"sd_{c}"] * fine, r / 2**20) or 1.0 for c, r in zip(axes, reach)]
    square = sum((F.pow(F.col(f"q_{f}") - F.col(f"d_{f}"), F.lit(2.0)) for f in shared), F.lit(0.0))
    own = Window.partitionBy(*names).orderBy("_d", *order)
    left, found = queries, None
    while True:
        keys = [f"_c{i}" for i in range(len(axes))]
        homes = left.withColumns({f"_h{i}": _cell(F.col(f"q_{c}"), box[f"lo_{c}"], w)
            for i, (c, w) in enumerate(zip(axes, width))})
        # Cells without donors are never asked for: donors lie between 0 and the last cell of each axis.
        last = [math.floor(r / w) for r, w in zip(reach, width)]
        around = homes
        for i, end in enumerate(last):
            lo, hi = F.greatest(F.col(f"_h{i}") - 1, F.lit(0)), F.least(F.col(f"_h{i}") + 1, F.lit(end))
            around = around.withColumn(keys[i], F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
        cells = donors.withColumns({key: _cell(F.col(f"d_{c}"), box[f"lo_{c}"], w)
            for key, c, w in zip(keys, axes, width)})
        near = around.join(cells, keys).filter(F.col("_q_has").bitwiseAND(F.col("_d_has")) == both)
        near = near.withColumn("_d", F.sqrt(square * F.lit(scale)))
        best = near.withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= k)
        whole = F.lit(True)
        for i, end in enumerate(last):
            whole = whole & (F.col(f"_h{i}") - 1 <= 0) & (F.col(f"_h{i}") + 1 >= end)
        best = checkpointed(best.select(*names, "_d", "_v", *order, whole.alias("_whole")))
        # A little less than the width, for what rounding does to cells and distances.
        sure = (F.count("_d") >= k) & (F.max("_d") <= min(width) * scale**0.5 * (1 - 1e-9)) | F.bool_or("_whole")
        done = best.groupBy(*names).agg(sure.alias("_sure")).filter("_sure").select(*names)
        part = best.join(done, names, "left_semi").drop("_whole")
        found = part if found is None else found.unionByName(part)
        left = checkpointed(left.join(done, names, "left_anti"))
        # Who stands apart from all donors has met none of them: the next block is twice as wide.
        if not left.limit(1).count():
            return found
        width = [2 * w for w in width]


def knn_impute(df: DataFrame, target: str, features: list[str], ident: list[str], k: int = 5) -> DataFrame:
    """Mean of the k nearest donors on the co-present features (distance rescaled by their share; ties by ``ident``).

    Rows are compared through a cell index, one for each set of features that some query and donor
    share, so a missing feature costs no full comparison and the result stays exact. Of donors
    with equal features only the first k can ever be among the nearest: the others go first.
    """
    names, order = [f"q_{c}" for c in ident], [f"d_{c}" for c in ident]
    q = df.filter(F.col(target).isNull()).select(_mask(features).alias("_q_has"),
        *[F.col(c).alias(f"q_{c}") for c in ident], *[F.col(f).cast("double").alias(f"q_{f}") for f in features])
    d = df.filter(F.col(target).isNotNull()).select(_mask(features).alias("_d_has"), F.col(target).alias("_v"),
        *[F.col(c).alias(f"d_{c}") for c in ident], *[F.col(f).cast("double").alias(f"d_{f}") for f in features])
    alike = Window.partitionBy(*[f"d_{f}" for f in features]).orderBy(*order)
    d = checkpointed(d.withColumn("_r", F.row_number().over(alike)).filter(F.col("_r") <= k).drop("_r"))
    q = checkpointed(q)
    have = lambda x, c: [r[c] for r in x.select(c).distinct().collect()]
    pairs = [(mine, other) for mine in have(q, "_q_has") for other in have(d, "_d_has")]
    near = None
    for both in sorted({a & b for a, b in pairs} - {0}):
        ours, theirs = ({p[side] for p in pairs if p[0] & p[1] == both} for side in (0, 1))
        shared = [f for i, f in enumerate(features) if both & 1 << i]
        part = _nearest(q.filter(F.col("_q_has").isin(*ours)), d.filter(F.col("_d_has").isin(*theirs)), both, shared,
            len(features) / len(shared), names, order, k)
        near = part if near is None else near.unionByName(part)
    if near is None:
        return df
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy(*names).orderBy("_d", *order)))
    means = best.filter(F.col("_r") <= k).groupBy(*names).agg(F.avg("_v").alias("_v")).select(
        *[F.col(n).alias(c) for n, c in zip(names, ident)], "_v")
    return df.join(means, ident, "left").withColumn(target, F.coalesce(target, "_v")).drop("_v")


def evidence_ridge(n: float, gram: np.ndarray, products: np.ndarray, square: float, steps: int = 300,
    tolerance: float = 1e-3) -> np.ndarray:
    """Coefficients of a ridge regression whose noise and weight precisions maximise the evidence.

    It needs centred second moments only: ``gram`` of the features, ``products`` with the target and the target's
    ``square``. One eigen-decomposition serves all steps. Both precisions have a vague gamma prior of 1e-6.
    """
    prior = 1e-6
    values, vectors = np.linalg.eigh(gram)
    values = np.maximum(values, 0.0)
    turned = vectors.T @ products
    noise, weight = 1.0 / (square / n + np.finfo(float).eps), 1.0
    solve = lambda: vectors @ (turned / (values + weight / noise))
    before = None
    for _ in range(steps):
        beta = solve()
        rest = max(square - 2 * beta @ products + beta @ gram @ beta, 0.0)
        used = (noise * values / (weight + noise * values)).sum()
        weight = (used + 2 * prior) / (beta @ beta + 2 * prior)
        noise = (n - used + 2 * prior) / (rest + 2 * prior)
        if before is not None and np.abs(before - beta).sum() < tolerance:
            break
        before = beta
    return solve()


def mice_impute(df: DataFrame, columns: list[str], rounds: int = 10, tolerance: float = 1e-3) -> DataFrame:
    """Chained equations: each column is regressed on the others by an evidence-maximised ridge, fewest gaps first.

    Gaps start at the column's mean. A column and round cost one distributed aggregate of second moments; the driver
    decomposes a matrix as wide as the column list and nothing else. Known cells never change. Rounds end early when no
    cell moves by more than ``tolerance`` times the largest known value. Each round ends with a checkpoint, so the
    plan does not grow. A column without any known value stays NULL and tells the others nothing.
    """
    first = df.agg(*[F.avg(c).alias(c) for c in columns], *[F.count_if(F.col(c).isNull()).alias(f"_n_{c}") for c in columns],
        *[F.max(F.abs(F.col(c))).alias(f"_m_{c}") for c in columns]).first()
    known = [c for c in columns if first[c] is not None]
    filled = {c: f"_f_{c}" for c in known}
    gappy = sorted((c for c in known if first[f"_n_{c}"]), key=lambda c: first[f"_n_{c}"])
    largest = max((float(first[f"_m_{c}"]) for c in known), default=0.0)
    d = df.select("*", *[F.coalesce(F.col(c), F.lit(first[c])).cast("double").alias(n) for c, n in filled.items()])
    for _ in range(rounds if gappy and len(known) > 1 else 0):
        d = d.withColumns({f"_was_{c}": F.col(filled[c]) for c in gappy})
        for c in gappy:
            others = [o for o in known if o != c]
            # Values less their first means, so that the moments keep their digits.
            x = [*[F.col(filled[o]) - F.lit(float(first[o])) for o in others], F.col(c) - F.lit(float(first[c]))]
            pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
            sums = d.filter(F.col(c).isNotNull()).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"s{i}") for i,
                v in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i, j in pairs]).first()
            n, totals = sums["n"], np.array([sums[f"s{i}"] for i in range(len(x))])
            moments = np.zeros((len(x), len(x)))
            for i, j in pairs:
                moments[i, j] = moments[j, i] = sums[f"g{i}_{j}"]
            moments -= np.outer(totals, totals) / n
            beta = evidence_ridge(n, moments[:-1, :-1], moments[:-1, -1], max(moments[-1, -1], 0.0))
            level = float(first[c]) + (totals[-1] - beta @ totals[:-1]) / n
            guess = sum((F.lit(float(b)) * v for b, v in zip(beta, x)), F.lit(float(level)))
            d = d.withColumn(filled[c], F.when(F.col(c).isNotNull(), F.col(c)).otherwise(guess))
        d = checkpointed(d)
        change = d.agg(F.greatest(F.lit(0.0), *[F.max(F.abs(F.col(filled[c]) - F.col(f"_was_{c}")))
            for c in gappy])).first()[0]
        if change < tolerance * largest:
            break
    return d.select(*[(F.coalesce(F.col(c), F.col(filled[c])).alias(c) if c in filled else F.col(c))
        for c in df.columns])


def signal_quality(variants: DataFrame, reference: str, column: str, on: list[str]) -> DataFrame:
    """Each variant against the reference on rows that both know: correlation, MAE, RMSE, missing and compared rows."""
    ref = variants.filter(F.col("variant") == reference).select(*on, F.col(column).alias("_ref"))
    j = variants.join(ref, on, "left")
    x, r = F.col(column), F.col("_ref")
    both = x.isNotNull() & r.isNotNull()
    d = F.when(both, x - r)
    s = j.groupBy("variant").agg(
        F.corr(F.when(both, x), F.when(both, r)).alias("corr"), F.avg(F.abs(d)).alias("mae"),
            F.sqrt(F.avg(d * d)).alias("rmse"), F.count_if(x.isNull()).alias("n_missing"),
            F.count_if(both).alias("n_compared")
    )
    enough = F.col("n_compared") >= 2
    return s.select("variant", *[F.when(enough, F.col(c)).alias(c) for c in ("corr", "mae", "rmse")], "n_missing",
        "n_compared")


def healing_quality(clean: DataFrame, corrupted: DataFrame, healed: DataFrame, column: str, on: list[str]) -> DataFrame:
    """MAE, RMSE and R2 at corrupted rows. ``n_corrupted`` counts them before rows without truth or healing are left out."""
    named = lambda d, n: d.select(*on, F.col(column).alias(n))
    j = named(clean, "x").join(named(corrupted, "c"), on).join(named(healed, "h"), on)
    hit = F.col("c").isNull() | (F.abs(F.col("c") - F.col("x")) > 1e-6)
    ok = hit & F.col("x").isNotNull() & F.col("h").isNotNull()
    x, e = F.when(ok, F.col("x")), F.when(ok, F.col("h") - F.col("x"))
    s = j.agg(F.count_if(hit).alias("n_corrupted"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("_sse"), (F.var_pop(x) * F.count(x)).alias("_sst"))
    return s.withColumn("r2", F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst"))).drop("_sse", "_sst")


def common_rows(variants: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the keys that every variant has."""
    n = variants.select("variant").distinct().count()
    shared = variants.groupBy(*on).agg(F.count_distinct("variant").alias("_n")).filter(F.col("_n") == n).select(*on)
    return variants.join(shared, on, "left_semi")
