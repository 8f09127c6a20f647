"""More registered queries: several sites, another causal shift, files, protocols of rule models, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import checkpointed, shared_folder
from ..operators import attribution, features, models, reports, splits, stats
from . import protocols
from .adapter import KEYS, events, merged
from .queries import (
    _COLS, _CONTRIB_SQL, _EDGES, _MT_SQL, ASSIGNED_SQL, MERGED_SQL, NARROW, SCORED_SQL, SMALL_TREES, SUPERVISED_SQL, TRAINED,
        _cut_sql,
        _feature_sql, _folds_sql, _ml_rows, _newton_sql, _r, _summary_sql, _variants, _VARIANTS_SQL,
    assigned_rows, contributions, narrow_rows, query, results,
)


def scratch(spark: SparkSession) -> str:
    """A new folder for files that a query writes and reads back."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


# ---- several sites, another shift -------------------------------------------------------

SITES_SQL = """
se AS (SELECT CAST(user_id % 10 AS INT) AS site, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, event_type AS k,
  value AS v FROM events),
sb AS (SELECT site, ts, avg(v) FILTER (WHERE k = 'view') AS soil_moisture,
  avg(v) FILTER (WHERE k = 'signup') AS air_temp, avg(v) FILTER (WHERE k = 'purchase') AS humidity,
  CAST(avg(v) FILTER (WHERE k = 'error') > 55 AS INT) AS irrigation_event, sum(v) FILTER (WHERE k = 'click') AS c
  FROM se GROUP BY ALL),
sf AS (SELECT site, ts, sum(c) OVER (PARTITION BY site ORDER BY ts) AS flow_l_cumulative FROM sb WHERE c IS NOT NULL),
sg AS (SELECT site, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM sb
  WHERE soil_moisture IS NOT NULL GROUP BY site),
sj AS (SELECT sg.site, sg.ts, soil_moisture, air_temp, humidity, air_temp / 2 AS wind_speed,
  humidity / 30 * 277.78 AS solar_radiation, irrigation_event, flow_l_cumulative,
  lag(flow_l_cumulative) OVER (PARTITION BY sg.site ORDER BY sg.ts) AS l FROM sg LEFT JOIN sb USING (site, ts) LEFT
  JOIN sf USING (site, ts)),
smerged AS (SELECT * EXCLUDE (l), CASE WHEN flow_l_cumulative IS NOT NULL AND l IS NOT NULL THEN
  greatest(flow_l_cumulative - l, 0) END AS flow_l FROM sj)"""


@query("merged_by_site",
    f"WITH {SITES_SQL} SELECT site, ts, {_r(_COLS)}, CAST(irrigation_event AS BIGINT) AS irrigation_event FROM smerged")
def _(spark, d):
    return merged(spark, d, by_user=True)


_SITE_CONFIG = features.FeatureConfig(moisture_lags=(1, 3), diff_hours=(1,), roll_hours=(6,), weather_lags=(1,),
    weather_roll_hours=(6,), target_lags=(1,), weather=("air_temp", "humidity"), causal_shift=2,
    require_full_window=False)
_SITE_NAMES = [n for part in features.blocks(_SITE_CONFIG).values() for n in part]


def _matrix_sql(source: str, config: features.FeatureConfig, names: list[str]) -> str:
    sql = _feature_sql(config, "site")
    exprs = ", ".join(f"round(CAST({sql[n]} AS DOUBLE), 6) + 0 AS {n}" for n in names)
    return f"SELECT site, ts, {exprs} FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts) AS rn FROM {source})"


@query("design_matrix_by_site", f"WITH {SITES_SQL} {_matrix_sql('smerged', _SITE_CONFIG, _SITE_NAMES)}")
def _(spark, d):
    f, _named = features.build_features(merged(spark, d, by_user=True), KEYS, _SITE_CONFIG)
    return f.select("site", "ts", *[F.col(n).cast("double").alias(n) for n in _SITE_NAMES])


_SHIFT3 = features.FeatureConfig(causal_shift=3)
_SHIFTED = [n for n in (x for part in features.blocks().values() for x in part) if "_diff" in n or "_roll" in n
    or n.startswith("hours_since")]


@query("causal_shift_3", f"WITH {MERGED_SQL} {_matrix_sql('merged', _SHIFT3, _SHIFTED)}")
def _(spark, d):
    f, _named = features.build_features(merged(spark, d), KEYS, _SHIFT3)
    return f.select("site", "ts", *[F.col(n).cast("double").alias(n) for n in _SHIFTED])


_SITE_NARROW = ["soil_moisture_lag1h", "hour_sin"]
_SITE_SUP_SQL = f"""{SITES_SQL}, sm AS (SELECT site, ts, irrigation_event AS label,
  lag(soil_moisture) OVER (PARTITION BY site ORDER BY ts) AS soil_moisture_lag1h,
  sin(2 * pi() * hour(ts) / 24) AS hour_sin FROM smerged),
sup AS (SELECT *, row_number() OVER (ORDER BY ts, site) - 1 AS row_id FROM sm
  WHERE label IS NOT NULL AND soil_moisture_lag1h IS NOT NULL)"""


def _site_rows(spark, d) -> DataFrame:
    f, _named = features.build_features(merged(spark, d, by_user=True), KEYS)
    return features.supervised(f, _SITE_NARROW, KEYS)


@query("supervised_by_site",
    f"WITH {_SITE_SUP_SQL} SELECT site, ts, CAST(label AS BIGINT) AS label, row_id, {_r(', '.join(_SITE_NARROW))} FROM sup")
def _(spark, d):
    return _site_rows(spark, d)


_SITE_ASS_SQL = f"{_SITE_SUP_SQL}, {_folds_sql(5)}, ass AS (SELECT sup.*, fold, CASE WHEN row_id < train_hi THEN 'train' ELSE 'test' END AS role FROM sup JOIN fo ON (row_id >= train_lo AND row_id < train_hi) OR (row_id >= test_lo AND row_id < test_hi))"


@query(
    "fold_table_by_site",
    f"""WITH {_SITE_ASS_SQL}, t AS (SELECT fold, count_if(role = 'train') AS n_train,
  count_if(role = 'test') AS n_test, count_if(role = 'train' AND label = 1) AS train_positive,
  count_if(role = 'test' AND label = 1) AS test_positive,
min(ts) FILTER (WHERE role = 'train') AS train_start, max(ts) FILTER (WHERE role = 'train') AS train_end,
  min(ts) FILTER (WHERE role = 'test') AS test_start, max(ts) FILTER (WHERE role = 'test') AS test_end FROM ass
  GROUP BY fold)
SELECT *, round(train_positive / n_train, 6) AS train_rate, round(test_positive / n_test, 6) AS test_rate,
  train_positive >= 5 AND test_positive >= 5 AS sufficient_positives FROM t""",
)
def _(spark, d):
    rows = _site_rows(spark, d)
    return splits.describe(splits.assign(rows, splits.folds_frame(spark, splits.rolling_origin(rows.count(), 5))))


# ---- files ------------------------------------------------------------------------------

_LOGS = (("moisture", "view", "soil_moisture"), ("valve", "error", "irrigation_event"),
    ("flow", "click", "flow_l_cumulative"))


def _written_logs(spark, d) -> list[str]:
    """The three channels as two-column text logs, the value first in one of them."""
    root, files = scratch(spark), []
    for i, (word, kind, _) in enumerate(_LOGS):
        time, value = F.date_format("ts", "dd-MMM-yyyy HH:mm:ss").alias(" time_stamp"), F.col("value").cast(
            "string").alias("reading ")
        path = f"{root}/Station {word}.{'txt' if i == 1 else 'csv'}"
        events(spark, d, kind).select(*((value, time) if i == 0 else (time, value))).write.csv(path, header=True)
        files.append(path)
    return files


@query(
    "log_scan",
    "SELECT channel, date_trunc('second', ts) AS ts, round(value, 6) AS value FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS channel, ts, value FROM events WHERE event_type = '{k}'" for _, k,
        c in _LOGS) + ")",
)
def _(spark, d):
    """Logs routed by file name, with roles of columns and formats of time inferred."""
    got = sources.read_channels(spark, _written_logs(spark, d))
    return protocols.union([f.select(F.lit(c).alias("channel"), "ts", F.col(c).alias("value")) for c, f in got.items()])


@query(
    "bulk_log_scan",
    "SELECT channel, CAST(count(DISTINCT site) AS BIGINT) AS n_logs, count(*) AS n_rows, "
    "min(date_trunc('second', ts)) AS first_ts, max(date_trunc('second', ts)) AS last_ts, round(sum(value), 3) AS total FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS channel, user_id % 10 AS site, ts, value FROM events WHERE event_type = '{k}'"
            for _, k, c in _LOGS) + ") GROUP BY channel",
)
def _(spark, d):
    """The logs of ten sites, a folder each, in one read."""
    root = scratch(spark)
    for i, (word, kind, _) in enumerate(_LOGS):
        time, value = F.date_format("ts", "dd-MMM-yyyy HH:mm:ss").alias("time_stamp"), F.col("value").cast("string")
        logs = events(spark, d, kind, by_user=True)
        for site in range(10):
            logs.filter(F.col("site") == site).select(*((value, time) if i == 0 else (time, value))).write.csv(
                f"{root}/site {site} {word}.csv", header=True)
    got = sources.scan_logs(spark, f"{root}/*.csv")
    return got.groupBy("channel").agg(F.count_distinct("log").alias("n_logs"), F.count(F.lit(1)).alias("n_rows"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.sum("value"), 3).alias("total"))


@query("table_round_trip",
    f"WITH {MERGED_SQL} SELECT kind, ts, {_r(_COLS)}, CAST(irrigation_event AS BIGINT) AS irrigation_event FROM merged, (SELECT unnest(['csv', 'parquet']) AS kind)")
def _(spark, d):
    rows, root = merged(spark, d).drop("site"), scratch(spark)
    read = {k: sources.read_merged(spark, sources.write_table(rows, f"{root}/merged.{k}", k)) for k in ("csv",
        "parquet")}
    return protocols.union([f.withColumn("kind", F.lit(k)) for k, f in read.items()])


@query(
    "exported",
    f"WITH {MERGED_SQL} SELECT 'documents' AS name, count(*) AS n, round(sum(soil_moisture), 4) AS total FROM merged UNION ALL SELECT 'merged', count(*), round(sum(soil_moisture), 4) FROM merged",
)
def _(spark, d):
    """All sinks at once, each read back: a table, and one JSON document a row."""
    rows = merged(spark, d)
    paths = sources.export_all({"merged": rows}, {"documents": rows.select("ts", "soil_moisture")}, scratch(spark))
    read = {"merged": spark.read.parquet(paths["merged"]),
        "documents": spark.read.schema("ts string, soil_moisture double").json(paths["documents"])}
    return protocols.union([f.agg(F.count(F.lit(1)).alias("n"),
        F.round(F.sum("soil_moisture"), 4).alias("total")).withColumn("name", F.lit(k)) for k, f in read.items()])


# ---- protocols of rule models -----------------------------------------------------------

_RULES_SQL = """mj AS (SELECT fold, avg(label) AS p FROM ass WHERE role = 'train' GROUP BY fold),
pt AS (SELECT *, irrigation_event_lag1h > 0.5 AS s FROM ass), pa AS (SELECT fold, s, avg(label) AS q FROM pt
  WHERE role = 'train' GROUP BY ALL)"""
_MAJORITY = f"SELECT 'majority' AS model, fold, row_id, label, {_EDGES.format('p')} AS score, CAST(p > 0.5 AS INT) AS predicted FROM ass JOIN mj USING (fold) WHERE role = 'test'"
_PERSISTENCE = f"SELECT 'persistence' AS model, fold, row_id, label, {_EDGES.format('coalesce(q, p)')} AS score, CAST(s AS INT) AS predicted FROM pt LEFT JOIN pa USING (fold, s) JOIN mj USING (fold) WHERE role = 'test'"


def _metrics_sql(source: str, by: str) -> str:
    """All metrics of scored rows, one row a group, as ``res``."""
    return f"""zs AS (SELECT {by}, score, sum(label) AS p, sum(1 - label) AS n FROM {source} GROUP BY ALL),
  zc AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp
  FROM zs WINDOW w AS (PARTITION BY {by} ORDER BY score DESC)),
zr AS (SELECT {by}, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(n * (tp - p / 2.0)) / (sum(p) * sum(n)) END AS
  roc_auc, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * tp / (tp + fp)) / sum(p) END AS pr_auc FROM zc
  GROUP BY ALL),
zf AS (SELECT {by}, count_if(label = 1 AND predicted = 1) AS tp, count_if(label = 0 AND predicted = 1) AS fp,
  count_if(label = 1 AND predicted = 0) AS fn, avg(pow(score - label, 2)) AS brier, count(*) AS n_test,
  count_if(label = 1) AS n_positive FROM {source} GROUP BY ALL),
res AS (SELECT zf.*, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, roc_auc, pr_auc
  FROM zf JOIN zr USING ({by}))"""


_M = "pr_auc, roc_auc, f1, brier"
_SEEDS_SQL = f"{ASSIGNED_SQL}, {_RULES_SQL}, pred AS ({_MAJORITY} UNION ALL {_PERSISTENCE}), {_metrics_sql('pred', 'model, fold')}, seeded AS (SELECT res.*, CAST(seed AS BIGINT) AS seed FROM res, range(0, 10) AS r(seed))"


def _seeded(spark, d) -> DataFrame:
    rows = narrow_rows(spark, d)
    return protocols.across_seeds(rows, splits.rolling_origin(rows.count(), 5), NARROW, [], list(range(10)),
        rules=["majority", "persistence"])


@query("across_seeds", f"WITH {_SEEDS_SQL} SELECT model, seed, fold, {_r(_M)}, n_test, n_positive FROM seeded")
def _(spark, d):
    return _seeded(spark, d).select("model", "seed", "fold", *_M.split(", "), "n_test", "n_positive")


@query(
    "logistic_one_feature",
    f"""WITH RECURSIVE {ASSIGNED_SQL}, {_newton_sql('soil_moisture_lag1h')} SELECT 'logistic' AS model, fold, row_id,
  CAST(label AS BIGINT) AS label, round(1 / (1 + exp(-(b0 + b1 * soil_moisture_lag1h))), 6) AS score
  FROM ass JOIN fit USING (fold) WHERE role = 'test'""",
)
def _(spark, d):
    """Out-of-fold scores of the logistic model on one column, all folds fitted together, against a recursive query."""
    rows = narrow_rows(spark, d)
    folds = splits.rolling_origin(rows.count(), 5)
    tasks = protocols.tasks_of(folds, [models.ModelSpec("logistic")], ["soil_moisture_lag1h"])
    return protocols.scored_tasks(rows, tasks).select("model", "fold", "row_id", "label", "score")


@query(
    "nested_parameters",
    f"""WITH {SCORED_SQL}, n0 AS (SELECT model, fold, pr_auc AS value, 'depth=' || (fold % 3) AS sp FROM res
  WHERE seed = 1), s AS ({_summary_sql('n0', 'model')}), c AS (SELECT model,
  string_agg(fold || ': ' || sp, ' | ' ORDER BY fold) AS params_by_fold FROM n0 GROUP BY model)
SELECT model, n, degenerate, {_r("mean, std, half_width, ci_low, ci_high")}, params_by_fold FROM s JOIN c USING (model)""",
)
def _(spark, d):
    """The summary of a nested selection, with the parameters chosen in each fold."""
    chosen = F.concat(F.lit("depth="), (F.col("fold") % 3).cast("string"))
    return protocols.nested_summary(results(spark, d).filter("seed = 1").withColumn("selected_params", chosen))


@query("seeds_trained")
def _(spark, d):
    """Trees that draw rows and columns, under ten seeds: fifty fits in the passes of one."""
    rows = narrow_rows(spark, d)
    drawn = models.ModelSpec("gbt_a", {**SMALL_TREES, "subsample": 0.8, "columns": 0.6})
    return stats.aggregate_runs(protocols.across_seeds(rows, splits.rolling_origin(rows.count(), 5), NARROW, [drawn],
        list(range(10)), rules=["majority"]))


@query("wide_summary",
    f"WITH {_SEEDS_SQL} SELECT model, {', '.join(f'round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std' for m in _M.split(', '))} FROM seeded GROUP BY model")
def _(spark, d):
    return stats.wide_summary(_seeded(spark, d), ["model"], tuple(_M.split(", ")))


@query("paired_scores",
    f"WITH {ASSIGNED_SQL}, {_RULES_SQL}, pm AS ({_MAJORITY}), pp AS ({_PERSISTENCE}) SELECT row_id, CAST(pm.label AS BIGINT) AS label, round(pm.score, 6) AS a, round(pp.score, 6) AS b FROM pm JOIN pp USING (row_id)")
def _(spark, d):
    rows = assigned_rows(spark, d)
    return protocols.paired(models.majority(rows), models.persistence(rows))


_ABLATION = features.FeatureConfig(
    moisture_lags=(1,), diff_hours=(1,), roll_hours=(6,), weather_lags=(1,), weather_roll_hours=(6,), target_lags=(1,),
        weather=("air_temp", "humidity"), require_full_window=False
)
_SETS = features.ablation_sets(_ABLATION)


def _complete_sql(config: features.FeatureConfig, names: list[str], source: str = "merged", where: str = "true") -> str:
    """Complete rows of a design matrix with their folds, as ``sup``, ``fo`` and ``ass``."""
    sql = _feature_sql(config, "site")
    exprs = ", ".join(f"CAST({sql[n]} AS DOUBLE) AS {n}" for n in names)
    known = " AND ".join(f"{n} IS NOT NULL" for n in names)
    return f"""fm AS (SELECT site, ts, irrigation_event AS label, {exprs} FROM (SELECT *,
  row_number() OVER (PARTITION BY site ORDER BY ts) AS rn FROM {source})),
sup AS (SELECT *, row_number() OVER (ORDER BY ts, site) - 1 AS row_id FROM fm
  WHERE label IS NOT NULL AND {where} AND {known}), {_folds_sql(5)},
ass AS (SELECT sup.*, fold, CASE WHEN row_id < train_hi THEN 'train' ELSE 'test' END AS role FROM sup
  JOIN fo ON (row_id >= train_lo AND row_id < train_hi) OR (row_id >= test_lo AND row_id < test_hi))"""


_ABLATION_SQL = f"""{MERGED_SQL}, {_complete_sql(_ABLATION, _SETS['D'])}, {_RULES_SQL}, pred AS ({_MAJORITY}
  UNION ALL {_PERSISTENCE}), {_metrics_sql('pred', 'model, fold')},
ab AS (SELECT s.feature_set, s.n_features, res.* FROM res
  JOIN (VALUES {", ".join(f"('{n}', {len(c)}, {'irrigation_event_lag1h' in c})" for n, c in _SETS.items())}) AS
  s(feature_set, n_features, has_state) ON model = 'majority' OR has_state)"""


def _ablation(spark, d) -> DataFrame:
    f, _named = features.build_features(merged(spark, d), KEYS, _ABLATION)
    rows = checkpointed(features.supervised(f, _SETS["D"], KEYS))
    return protocols.ablation(rows, protocols.rolling_folds(rows), _ABLATION, [],
        rules=["majority", "persistence"])


@query("ablation", f"WITH {_ABLATION_SQL} SELECT feature_set, CAST(n_features AS BIGINT) AS n_features, model, fold, {_r(_M)}, n_test FROM ab")
def _(spark, d):
    return _ablation(spark, d).select("feature_set", "n_features", "model", "fold", *_M.split(", "), "n_test")


@query("ablation_trained")
def _(spark, d):
    """Logistic and boosted models on every set of features: all sets, models and folds in the passes of one."""
    f, _named = features.build_features(merged(spark, d), KEYS, _ABLATION)
    rows = checkpointed(features.supervised(f, _SETS["D"], KEYS))
    return protocols.ablation_summary(protocols.ablation(rows, protocols.rolling_folds(rows), _ABLATION, TRAINED,
        rules=["majority", "persistence"]))


_S = "mean, std, half_width, ci_low, ci_high"


@query(
    "ablation_summary",
    f"WITH {_ABLATION_SQL}, lv AS (SELECT feature_set, model, n_features, pr_auc AS value FROM ab), s AS ({_summary_sql('lv', 'feature_set, model, n_features')}), z AS (SELECT feature_set, model, sum(n_test) AS n_rows FROM ab GROUP BY ALL) "
    f"SELECT feature_set, model, CAST(n_features AS BIGINT) AS n_features, n, degenerate, {_r(_S)}, CAST(n_rows AS BIGINT) AS n_rows FROM s JOIN z USING (feature_set, model)",
)
def _(spark, d):
    return protocols.ablation_summary(_ablation(spark, d))


_ONSET_NAMES = [n for n in _SETS["D"] if n != "irrigation_event_lag1h"]
_ONSET_CTES = (
    f"{MERGED_SQL}, {_complete_sql(_ABLATION, _SETS['D'], where='irrigation_event_lag1h = 0')}, {_cut_sql('soil_moisture_lag1h')}, {_newton_sql('soil_moisture_lag1h')}, mj AS (SELECT fold, avg(label) AS p FROM ass WHERE role = 'train' GROUP BY fold), "
    f"pred AS ({_MAJORITY} UNION ALL SELECT 'moisture_threshold', * FROM ({_MT_SQL.format(f='soil_moisture_lag1h', src='ass')})), {_metrics_sql('pred', 'model, fold')}"
)


@query(
    "onset_protocol",
    f"""WITH RECURSIVE {_ONSET_CTES}, lo AS (UNPIVOT (SELECT model, {_M}
  FROM res) ON {_M} INTO NAME metric VALUE value), s AS ({_summary_sql('lo', 'model, metric')}),
z AS (SELECT model, CAST(sum(n_test) AS BIGINT) AS n_rows, count(DISTINCT fold) AS n_folds,
  CAST(sum(n_positive) AS BIGINT) AS n_onsets FROM res GROUP BY model)
SELECT model, metric, n AS n_folds_scored, degenerate, {_r(_S)}, n_rows, n_folds, n_onsets FROM s
  JOIN z USING (model)""",
)
def _(spark, d):
    return protocols.onset_protocol(merged(spark, d), KEYS, _ABLATION, [])


@query("onset_trained")
def _(spark, d):
    return protocols.onset_protocol(merged(spark, d), KEYS, _ABLATION, TRAINED)


_VARIANT = features.FeatureConfig(moisture_lags=(1,), diff_hours=(), roll_hours=(), weather_lags=(),
    weather_roll_hours=(), target_lags=(1,), weather=())
_VARIANT_NAMES = [n for part in features.blocks(_VARIANT).values() for n in part]


def _variant_sql(common: bool) -> str:
    """Rule metrics of each variant's own complete rows, or of those that all share."""
    sql = _feature_sql(_VARIANT, "variant")
    exprs = ", ".join(f"CAST({sql[n]} AS DOUBLE) AS {n}" for n in _VARIANT_NAMES)
    known = " AND ".join(f"{n} IS NOT NULL" for n in _VARIANT_NAMES)
    shared = "SEMI JOIN (SELECT ts FROM ok GROUP BY ts HAVING count(*) = 3) USING (ts)" if common else ""
    return f"""vm AS (SELECT variant, vr.ts, x AS soil_moisture, irrigation_event,
  row_number() OVER (PARTITION BY variant ORDER BY vr.ts) AS rn FROM vr JOIN merged USING (ts)),
vf AS (SELECT variant, ts, irrigation_event AS label, {exprs} FROM vm), ok AS (SELECT * FROM vf
  WHERE label IS NOT NULL AND {known}),
vs AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY ts) - 1 AS row_id,
  count(*) OVER (PARTITION BY variant) AS n FROM ok {shared}),
ass0 AS (SELECT variant, fold, row_id, label, irrigation_event_lag1h, n, n - (5 - fold + 1) * (n // 6) AS lo,
  n - (5 - fold) * (n // 6) AS hi FROM vs, range(1, 6) AS r(fold)),
assv AS (SELECT *, CASE WHEN row_id < lo THEN 'train' ELSE 'test' END AS role FROM ass0 WHERE row_id < hi),
vj AS (SELECT variant, fold, avg(label) AS p FROM assv WHERE role = 'train' GROUP BY ALL), vp AS (SELECT *,
  irrigation_event_lag1h > 0.5 AS s FROM assv), va AS (SELECT variant, fold, s, avg(label) AS q FROM vp
  WHERE role = 'train' GROUP BY ALL),
pred AS (SELECT 'majority' AS model, variant, n AS n_rows, fold, label, {_EDGES.format('p')} AS score,
  CAST(p > 0.5 AS INT) AS predicted FROM assv JOIN vj USING (variant, fold) WHERE role = 'test'
UNION ALL SELECT 'persistence', variant, n, fold, label, {_EDGES.format('coalesce(q, p)')}, CAST(s AS INT) FROM vp
  LEFT JOIN va USING (variant, fold, s) JOIN vj USING (variant, fold) WHERE role = 'test'),
  {_metrics_sql('pred', 'model, variant, n_rows, fold')}"""


def _evaluated(spark, d, common: bool, specs: list = []) -> DataFrame:
    state = merged(spark, d).select("site", "ts", "irrigation_event")
    every = _variants(spark, d).join(state, ["site", "ts"])
    return protocols.evaluate_variants(every, KEYS, _VARIANT, specs, common=common, rules=["majority", "persistence"])


@query("variants_trained")
def _(spark, d):
    specs = [models.ModelSpec("logistic"), models.ModelSpec("gbt_a", {"n_estimators": 5, "max_depth": 3})]
    return stats.summarise(_evaluated(spark, d, True, specs), ["variant", "model"], value="pr_auc")


for _name, _common in (("variants_as_available", False), ("variants_on_common_rows", True)):

    @query(
        _name,
        f"WITH {MERGED_SQL}, {_VARIANTS_SQL}, {_variant_sql(_common)} SELECT variant, n_rows, model, fold, {_r(_M)}, n_test, '{'common_rows' if _common else 'as_available'}' AS comparison FROM res",
    )
    def _(spark, d, common=_common):
        return _evaluated(spark, d, common).select("variant", F.col("n_rows").cast("long").alias("n_rows"), "model",
            "fold", *_M.split(", "), "n_test", "comparison")


@query(
    "variant_summary",
    f"WITH {MERGED_SQL}, {_VARIANTS_SQL}, {_variant_sql(False)}, lv AS (SELECT 'as_available' AS comparison, variant, n_rows, pr_auc AS value FROM res), s AS ({_summary_sql('lv', 'comparison, variant, n_rows')}) SELECT comparison, variant, n_rows, n, degenerate, {_r(_S)} FROM s",
)
def _(spark, d):
    return protocols.variant_summary(_evaluated(spark, d, False)).withColumn("n_rows", F.col("n_rows").cast("long"))


# ---- reports ----------------------------------------------------------------------------


@query(
    "baseline_table",
    f"""WITH {SCORED_SQL}, s AS (SELECT model, metric, avg(value) AS mean FROM lng GROUP BY ALL), b AS (SELECT metric,
  arg_max(model, (CASE WHEN metric = 'brier' THEN -mean ELSE mean END, model)) AS best_model, arg_max(mean,
  (CASE WHEN metric = 'brier' THEN -mean ELSE mean END, model)) AS best_mean FROM s WHERE model <> 'tax'
  GROUP BY metric),
r AS (UNPIVOT (SELECT CAST(0.5 AS DOUBLE) AS roc_auc, avg(label) AS pr_auc, avg(label) * (1 - avg(label)) AS brier
  FROM sc) ON roc_auc, pr_auc, brier INTO NAME metric VALUE no_skill)
SELECT model, metric, round(mean, 6) AS mean, best_model, round(best_mean, 6) AS best_mean, round(mean - best_mean,
  6) AS delta, round(no_skill, 6) AS no_skill, round(mean - no_skill, 6) AS above_no_skill FROM s JOIN b USING (metric)
  LEFT JOIN r USING (metric) WHERE model = 'tax'""",
)
def _(spark, d):
    from ..operators import metrics
    from .adapter import scored

    s = stats.summarise(stats.unpivot(results(spark, d), ["model", "seed", "fold"]),
        ["model", "metric"]).select("model", "metric", "mean")
    none = metrics.reference_points(scored(spark, d), []).unpivot([], ["roc_auc", "pr_auc", "brier"], "metric",
        "no_skill")
    return reports.baseline_table(s, none, ["tax"])


@query("master_summary",
    f"WITH {SCORED_SQL} SELECT model, metric, round(avg(value), 6) AS mean, CASE model WHEN 'tax' THEN 'a baseline' END AS note FROM lng GROUP BY model, metric")
def _(spark, d):
    s = stats.summarise(stats.unpivot(results(spark, d), ["model", "seed", "fold"]),
        ["model", "metric"]).select("model", "metric", "mean")
    return reports.master_summary(s, {"tax": "a baseline"})


@query(
    "annotated_waterfall",
    f"""WITH {_CONTRIB_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(contribution) DESC,
  feature) AS k FROM ct), w AS (SELECT row_id, least(k, 3) AS place, min(feature) AS f, count(*) AS n,
  sum(contribution) AS c, min(value) AS v FROM r GROUP BY row_id, least(k, 3)),
md AS ({" UNION ALL ".join(f"SELECT '{n}' AS f, quantile_cont({n}, 0.5) AS median FROM sup" for n in NARROW)})
SELECT row_id, place, CASE WHEN place <= 2 THEN printf('%s = %.2f (median %.2f)', f, round(v, 6) + sign(v) * 1e-9,
  round(median, 6) + sign(median) * 1e-9) ELSE n || ' other features' END AS label, round(c, 6) AS contribution FROM w
  LEFT JOIN md USING (f)""",
)
def _(spark, d):
    values, medians = contributions(spark, d), attribution.column_medians(narrow_rows(spark, d), NARROW)
    return attribution.annotated_waterfall(values.withColumn("value", F.round("value", 6)),
        medians.withColumn("median", F.round("median", 6)), 2)


@query("tree_attribution")
def _(spark, d):
    """Shapley values of a boosted model on the last fold's test rows; their sum and the base give the raw score."""
    rows, folds = _ml_rows(spark, d)
    _, lo, hi, test_lo, test_hi = folds[-1]
    fitted = models.fit(models.ModelSpec("gbt_a", {"n_estimators": 20, "max_depth": 4}),
        rows.filter(F.col("row_id").between(lo, hi - 1)), NARROW)
    return attribution.fitted_contributions(fitted, rows.filter(F.col("row_id").between(test_lo, test_hi - 1)), NARROW, scratch(spark))
