"""Classifiers: rule models that score all folds in one query, and pyspark.ml models."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: fitted rates are kept off 0 and 1 by this much.
EDGE = 1e-6
KEPT = ("fold", "row_id", "label", "score", "predicted")


def _rate(c):
    return F.greatest(F.least(c, F.lit(1 - EDGE)), F.lit(EDGE))


def require_column(df: DataFrame, column: str, model: str) -> None:
    if column not in df.columns:
        raise ValueError(f"{model} needs the column {column!r}; there are {df.columns}")


# ---- rule models: ``rows`` are assigned to folds (fold, role, row_id, label, features) ----


def majority(rows: DataFrame) -> DataFrame:
    """The training rate of each fold as score; its class where it is over a half."""
    prior = F.broadcast(rows.filter("role = 'train'").groupBy("fold").agg(F.avg("label").alias("_p")))  # one row a fold
    return rows.filter("role = 'test'").join(prior, "fold").withColumn("score",
        _rate(F.col("_p"))).withColumn("predicted", (F.col("_p") > 0.5).cast("int")).select(*KEPT)


def persistence(rows: DataFrame, lag_feature: str = "irrigation_event_lag1h") -> DataFrame:
    """The last state as prediction; the training rate after that state as score (the prior if never seen)."""
    require_column(rows, lag_feature, "persistence")
    state = (F.col(lag_feature) > 0.5).alias("_state")
    train = rows.filter("role = 'train'")
    after = train.groupBy("fold", state).agg(F.avg("label").alias("_after"))
    prior = train.groupBy("fold").agg(F.avg("label").alias("_p"))
    test = rows.filter("role = 'test'").withColumn("_state", state)
    j = test.join(F.broadcast(after), ["fold", "_state"], "left").join(F.broadcast(prior),
        "fold")  # two rows and one row a fold
    return j.withColumn("score", _rate(F.coalesce("_after", "_p"))).withColumn("predicted",
        F.col("_state").cast("int")).select(*KEPT)


def best_threshold(rows: DataFrame, feature: str, candidates: int = 200) -> DataFrame:
    """(fold, threshold, f1): the first of up to ``candidates`` distinct training quantiles with the best F1 of ``x < c``.

    Each row is counted once, by the first candidate above it; running sums over the candidates
    then give the confusion cells of all of them.
    """
    train = rows.filter("role = 'train'").select("fold", F.col(feature).alias("x"),
        F.col("label").alias("y")).filter("x is not null")
    share = F.array(*[F.lit(i / (candidates - 1)) for i in range(candidates)])
    cuts = train.groupBy("fold").agg(F.array_sort(F.array_distinct(F.percentile("x", share))).alias("cuts"),
        F.sum("y").alias("_pos"))
    # A row belongs to the first candidate above it: as many candidates lie at or below it.
    at = train.join(F.broadcast(cuts.select("fold", "cuts")), "fold").withColumn("k",
        F.size(F.filter("cuts", lambda c: c <= F.col("x"))))  # one row a fold
    binned = at.groupBy("fold", "k").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    grid = cuts.select("fold", "_pos", F.posexplode("cuts").alias("k", "threshold"))
    w = Window.partitionBy("fold").orderBy("k")
    run = grid.join(binned, ["fold", "k"], "left").withColumn("tp",
        F.sum(F.coalesce("p", F.lit(0))).over(w)).withColumn("all", F.sum(F.coalesce("n", F.lit(0))).over(w))
    f1 = F.when(F.col("all") + F.col("_pos") > 0, 2 * F.col("tp") / (F.col("all") + F.col("_pos"))).otherwise(0.0)
    scored = run.withColumn("f1", f1)
    return scored.groupBy("fold").agg(F.min_by("threshold", F.struct(-F.col("f1"), "k")).alias("threshold"),
        F.max("f1").alias("f1"))


def moisture_threshold(rows: DataFrame, feature: str = "soil_moisture_lag1h", candidates: int = 200) -> DataFrame:
    """Predicts ON below the best training threshold; the score is a one-feature logistic fit of the fold."""
    require_column(rows, feature, "moisture_threshold")
    cut = best_threshold(rows, feature, candidates)
    fits = logistic_1d(rows.filter("role = 'train'"), "fold", feature)
    j = rows.filter("role = 'test'").join(F.broadcast(cut), "fold").join(F.broadcast(fits),
        "fold")  # one row a fold each
    p = F.lit(1.0) / (1.0 + F.exp(-(F.col("b0") + F.col("b1") * F.col(feature))))
    return j.withColumn("predicted", (F.col(feature) < F.col("threshold")).cast("int")).withColumn("score",
        _rate(F.when(F.col("constant").isNotNull(), F.col("constant")).otherwise(p))).select(*KEPT)


def logistic_1d(train: DataFrame, key: str, feature: str, steps: int = 12) -> DataFrame:
    """(key, b0, b1, constant) of a logistic fit by Newton's method, one aggregate a step for all keys together; ``constant`` if a key has one class."""
    x = train.select(key, F.col(feature).cast("double").alias("x"),
        F.col("label").cast("double").alias("y")).filter("x is not null")
    stats = x.groupBy(key).agg(F.avg("y").alias("p"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"),
        F.count(F.lit(1)).alias("n")).collect()
    state = {r[key]: [0.0, 0.0] for r in stats}
    info = {r[key]: r for r in stats}
    spark = train.sparkSession
    for _ in range(steps):
        rows = [(k, info[k]["m"], info[k]["s"] or 1.0, b[0], b[1]) for k, b in state.items()]
        if not rows:
            break
        at = F.broadcast(spark.createDataFrame(rows, f"{key} int, _m double, _s double, _b0 double, _b1 double"))
        z = (F.col("x") - F.col("_m")) / F.col("_s")
        p = 1 / (1 + F.exp(-(F.col("_b0") + F.col("_b1") * z)))
        w = p * (1 - p)
        g = x.join(at, key).groupBy(key).agg(*[F.sum(e).alias(n) for n,
            e in (("g0", p - F.col("y")), ("g1", (p - F.col("y")) * z), ("h00", w), ("h01", w * z),
            ("h11", w * z * z))]).collect()
        move = 0.0
        for r in g:
            b = state[r[key]]
            g0, g1, h00, h01, h11 = r["g0"], r["g1"] + b[1], r["h00"] + 1e-9, r["h01"], r[
                "h11"] + 1.0  # unit ridge on the slope
            det = h00 * h11 - h01 * h01
            d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
            b[0], b[1] = b[0] - d0, b[1] - d1
            move = max(move, abs(d0), abs(d1))
        if move < 1e-9:
            break
    out = []
    for k, (b0, b1) in state.items():
        s, m, p = info[k]["s"] or 1.0, info[k]["m"], info[k]["p"]
        one = p in (0.0, 1.0)
        out.append((k, b0 - b1 * m / s, b1 / s, p if one else None))
    return spark.createDataFrame(out, f"{key} int, b0 double, b1 double, constant double")


RULES: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "majority": (majority, ()),
    "persistence": (persistence, ("irrigation_event_lag1h",)),
    "moisture_threshold": (moisture_threshold, ("soil_moisture_lag1h",)),
}


def available_rules(names: list[str]) -> list[str]:
    """Rule models whose columns are among the features."""
    return [m for m, (_, needs) in RULES.items() if set(needs) <= set(names)]


def skipped_rules(names: list[str]) -> dict[str, list[str]]:
    """Rule models that are left out, with the columns that they lack."""
    return {m: sorted(set(needs) - set(names)) for m, (_, needs) in RULES.items() if not set(needs) <= set(names)}


# ---- pyspark.ml models ------------------------------------------------------------------


#: Parameters of two profiles of boosted trees, greedy and exact, or binned finely with larger leaves and a draw of rows and features.
DEFAULTS = {"n_estimators": 200, "max_depth": 6, "learning_rate": 0.1}
PROFILES = {
    "gbt_a": {"min_child_weight": 1, "subsample": 1.0, "features": "all", "bins": 32},
    "gbt_b": {"min_child_samples": 20, "subsample": 0.9, "features": "0.8", "bins": 128},
}


#: What the two profiles set besides, when trees are grown by second-order gains.
SECOND_ORDER = {
    "gbt_a": {"min_child_weight": 1.0, "l2": 1.0, "leaves": 0, "subsample": 1.0, "columns": 1.0, "bins": 64},
    "gbt_b": {"min_child_samples": 20, "l2": 0.0, "leaves": 31, "subsample": 1.0, "columns": 1.0, "bins": 255},
}


def translated(name: str, params: dict) -> dict:
    """Shared parameter names as the model's own: the least weight of a child has another name in the second profile."""
    own = {"min_child_weight": "min_child_samples"} if name == "gbt_b" else {}
    return {own.get(k, k): v for k, v in params.items()}


@dataclass(frozen=True)
class ModelSpec:
    """A model by name with parameters; ``fit`` returns a fitted pipeline."""

    name: str
    params: dict = field(default_factory=dict)
    seed: int = 42

    def __post_init__(self):
        if self.name not in ("logistic", "gbt_a", "gbt_b"):
            raise ValueError(f"no model {self.name!r}")

    def estimator(self, n_train: int):
        """An unfitted estimator: L2 with C = 1 as 1/n, or boosted trees in one of two profiles."""
        if self.name == "logistic":
            return LogisticRegression(maxIter=int(self.params.get("max_iter", 1000)), regParam=1.0 / max(n_train, 1),
                elasticNetParam=0.0, standardization=False)
        p = {**DEFAULTS, **PROFILES[self.name], **translated(self.name, self.params)}
        if lost := sorted(set(p) - {*DEFAULTS, *PROFILES[self.name]}):
            raise ValueError(f"{self.name} has no parameters {lost}")
        least = p["min_child_weight" if self.name == "gbt_a" else "min_child_samples"]
        return GBTClassifier(
            maxIter=p["n_estimators"], maxDepth=min(p["max_depth"], 30), stepSize=p["learning_rate"],
                minInstancesPerNode=least,
            subsamplingRate=p["subsample"], featureSubsetStrategy=p["features"], maxBins=p["bins"], seed=self.seed,
        )


    def fit_parameters(self) -> tuple[str, tuple, int | None, bool]:
        """For ``fits``: the kind, its parameters, the number of trees, and whether anything is drawn.

        The first profile bounds a child's hessian sum and has an L2 of 1; the second bounds a child's rows,
        has no L2 and splits the best leaf first, up to 31 leaves.
        """
        if self.name == "logistic":
            if lost := sorted(set(self.params) - {"c", "max_iter"}):
                raise ValueError(f"logistic has no parameters {lost}")
            return "logistic", (("c", float(self.params.get("c", 1.0))),), None, False
        p = {**DEFAULTS, **SECOND_ORDER[self.name], **translated(self.name, self.params)}
        if lost := sorted(set(p) - {*DEFAULTS, *SECOND_ORDER[self.name]}):
            raise ValueError(f"{self.name} has no parameters {lost}")
        trees = int(p.pop("n_estimators"))
        if self.name == "gbt_a":
            p["min_hessian"] = p.pop("min_child_weight")
        else:
            p["min_rows"], p["min_hessian"] = p.pop("min_child_samples"), 1e-3
        return "boosted", tuple(sorted(p.items())), trees, p["subsample"] < 1 or p["columns"] < 1


@dataclass
class Fitted:
    """A fitted model, or the training rate where only one class was seen (``degenerate``)."""

    names: list[str]
    scale: dict[str, tuple[float, float, float]]
    model: PipelineModel | None
    constant: float | None

    @property
    def degenerate(self) -> bool:
        return self.model is None

    def prepared(self, rows: DataFrame) -> DataFrame:
        if not self.scale:
            return rows
        return rows.select(*[c for c in rows.columns if c not in self.scale],
            *[((F.coalesce(F.col(n).cast("double"), F.lit(med)) - mean) / std).alias(n) for n,
            (med, mean, std) in self.scale.items()])

    def transform(self, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
        if self.model is None:
            return rows.withColumn("score", F.lit(self.constant)).withColumn("predicted",
                F.lit(int(self.constant > 0.5)))
        out = self.model.transform(self.prepared(rows))
        return out.withColumn("score", vector_to_array("probability")[1]).withColumn("predicted",
            (F.col("score") >= threshold).cast("int")).drop("features", "rawPrediction", "probability", "prediction")


def fit(spec: ModelSpec, train: DataFrame, names: list[str]) -> Fitted:
    """Fits on training rows only; the linear model gets medians for NULL and standardised features."""
    stats = train.agg(F.count(F.lit(1)).alias("_n"), F.avg("label").alias("_p"),
        *[F.percentile(n, F.lit(0.5)).alias(f"med_{n}") for n in names]).first()
    if not stats["_n"]:
        raise ValueError("no training rows")
    if stats["_p"] in (0.0, 1.0):
        return Fitted(names, {}, None, float(min(max(stats["_p"], EDGE), 1 - EDGE)))
    scale = {}
    if spec.name == "logistic":
        filled = {n: F.coalesce(F.col(n).cast("double"), F.lit(stats[f"med_{n}"] or 0.0)) for n in names}
        m = train.agg(*[F.avg(c).alias(f"m_{n}") for n, c in filled.items()],
            *[F.stddev_pop(c).alias(f"s_{n}") for n, c in filled.items()]).first()
        scale = {n: (float(stats[f"med_{n}"] or 0.0), m[f"m_{n}"], m[f"s_{n}"] or 1.0) for n in names}
    fitted = Fitted(names, scale, None, None)
    stages = [VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep"), spec.estimator(stats["_n"])]
    fitted.model = Pipeline(stages=stages).fit(fitted.prepared(train))
    return fitted


def grid_points(grid: dict[str, list]) -> list[dict]:
    """All combinations, in a fixed order."""
    return [dict(zip(grid, v)) for v in product(*grid.values())]


#: The grid of the nested selection, 12 points, in the shared names of parameters.
GRID = {"max_depth": [2, 4, 6], "n_estimators": [100, 200], "min_child_weight": [1, 5]}
