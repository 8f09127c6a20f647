import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fieldloom import sources
from fieldloom.functions import expected_peak_hour, student_t_critical
from fieldloom.operators import episodes, features, quality, timegrid

START = dt.datetime(2022, 7, 12, 4)
K = ["site"]
COLUMNS = "site int, ts timestamp_ntz, soil_moisture double, air_temp double, humidity double, wind_speed double, solar_radiation double, irrigation_event int"


def hour(i):
    return START + dt.timedelta(hours=i)


def frame(spark, n=60, target=None, moisture=None):
    rows = [
        (s, hour(i), moisture(i) if moisture else 50 + 10 * math.sin(i / 12), 20.0 + i % 24, 50.0, 3.0, 100.0,
            (target[i] if target else int(i % 7 < 2)))
        for s in (0, 1)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, COLUMNS)


def by_ts(df, *cols, site=0):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]]
        for r in df.filter(F.col("site") == site).orderBy("ts").collect()]


def test_runs_break_at_unknown_and_touch_both_ends(spark):
    t = [1, 1, None, 1, 0, 0, 1]
    got = episodes.episodes(frame(spark, 7, t), K).filter("site = 0").orderBy("episode").collect()
    assert [(r["start_index"], r["end_index"], r["length_hours"]) for r in got] == [(0, 1, 2), (3, 3, 1), (6, 6, 1)]
    assert by_ts(frame(spark, 7, t).withColumn("o", episodes.onset(K)), "o") == [None, 0, None, None, 0, 0, 1]
    assert by_ts(episodes.with_labels(frame(spark, 7, t), K), "episode") == [0, 0, None, 1, None, None, 2]


def test_no_episode_gives_zero_and_null(spark):
    row = episodes.episode_summary(frame(spark, 5, [0] * 5), K).filter("site = 0").first()
    assert (row["n_episodes"], row["on_hours"], row["max_hours"]) == (0, 0, None)
    assert episodes.bin_labels() == ["1", "2", "3-5", "6-11", "12-23", "24-47", "48-95", "96+"]


def test_features_never_see_their_own_hour_or_later(spark):
    base = frame(spark).filter("site = 0")
    cut = hour(40)
    for damaged in (
        base.withColumn("soil_moisture", F.when(F.col("ts") < cut,
            F.col("soil_moisture"))).withColumn("irrigation_event",
            F.when(F.col("ts") < cut, F.col("irrigation_event"))),
        base.withColumn("soil_moisture", F.when(F.col("ts") != cut, F.col("soil_moisture"))),
    ):
        a, named = features.build_features(base, K)
        b, _ = features.build_features(damaged, K)
        names = [n for part in named.values() for n in part]
        assert len(names) == 40
        rows = lambda d: d.filter(F.col("ts") <= cut).select(*names).orderBy(*names).collect()
        assert rows(a) == rows(b)


def test_rolling_diff_and_hours_since(spark):
    df, _ = features.build_features(frame(spark, 12, [0, 0, 1, 0, 0, 0, None, 1, 1, 0, 0, 0], lambda i: float(i)), K,
        features.FeatureConfig(roll_hours=(6,)))
    assert by_ts(df, "soil_moisture_roll6h_mean")[5:8] == [None, 2.5, 3.5]
    assert by_ts(df, "soil_moisture_diff3h")[3:6] == [None, 3.0, 3.0]
    assert by_ts(df, "hours_since_last_irrigation") == [None, None, None, 1, 2, 3, 4, 5, 1, 1, 2, 3]


def test_guards(spark):
    with pytest.raises(ValueError):
        features.FeatureConfig(causal_shift=0)
    with pytest.raises(ValueError):
        features.assert_allowed(["flow_l_lag1h"])
    with pytest.raises(ValueError):
        features.build_features(frame(spark).drop("humidity"), K)
    with pytest.raises(ValueError):
        timegrid.to_utc(frame(spark), 2, "nope")


def test_grid_is_dense_and_meter_steps_are_clipped(spark):
    rows = [(0, hour(0), 1.0), (0, hour(0) + dt.timedelta(minutes=20), 3.0), (0, hour(3), 9.0)]
    d = spark.createDataFrame(rows, "site int, ts timestamp_ntz, v double")
    assert by_ts(timegrid.on_grid(timegrid.hourly(d, K, "v", "mean"), K), "v") == [2.0, None, None, 9.0]
    assert by_ts(timegrid.hourly(d, K, "v", "last"), "v") == [3.0, 9.0]
    m = spark.createDataFrame([(0, hour(i), x) for i, x in enumerate([5.0, 7.0, 2.0, None, 4.0])],
        "site int, ts timestamp_ntz, c double")
    assert by_ts(m.withColumn("s", timegrid.positive_difference("c", K)), "s") == [None, 2.0, 0.0, None, None]
    assert by_ts(timegrid.to_utc(m, 5.5), "ts")[0] == hour(0) - dt.timedelta(hours=5, minutes=30)


def test_validation_lists_everything_at_once(spark):
    bad = frame(spark, 5).withColumn("air_temp", F.lit(None).cast("double")).withColumn("soil_moisture",
        F.lit(120.0)).withColumn("irrigation_event", F.lit(3))
    with pytest.raises(quality.ValidationError) as e:
        quality.validate(bad)
    for word in ("air_temp", "soil_moisture", "irrigation_event", "flow_l: missing"):
        assert word in str(e.value)


def test_diurnal_peak(spark):
    sun = frame(spark, 48).withColumn("solar_radiation",
        F.greatest(F.lit(0.0), 800 * F.cos((F.hour("ts") - 7) * math.pi / 12)))
    assert quality.validate_alignment(sun, 5.0) == 0
    with pytest.raises(quality.ValidationError):
        quality.validate_alignment(sun, -5.0)
    assert expected_peak_hour(14) == 22


def test_logs_and_weather(spark, tmp_path):
    (tmp_path / "a_Moisture.csv").write_text(
        " moisture , time_stamp\n74.29,12-Jul-2022 00:03:51\n,12-Jul-2022 00:23:51\n")
    (tmp_path / "valve.txt").write_text("time_stamp,relay\n12-Jul-2022 00:00:00,1\n")
    (tmp_path / "flow.csv").write_text("litres,time_stamp\n4,12-Jul-2022 00:00:00\n")
    files = [str(p) for p in tmp_path.iterdir()]
    got = sources.read_channels(spark, files)
    assert [(r["ts"].minute, r["soil_moisture"]) for r in got["soil_moisture"].orderBy("ts").collect()] == [(3, 74.29),
        (23, None)]
    with pytest.raises(ValueError):
        sources.read_channels(spark, files[:1])
    w = tmp_path / "w.json"
    w.write_text('{"properties": {"parameter": {"T2M": {"2022071200": 20.5, "2022071201": -999.0}, "RH2M": {"2022071200": 40}}}}')
    rows = sources.read_weather(spark, str(w), ["T2M", "RH2M"]).orderBy("ts").collect()
    assert [(r["T2M"], r["RH2M"]) for r in rows] == [(20.5, 40.0), (None, None)]
    out = sources.export_all({"t": got["flow_l_cumulative"]}, {"d": got["flow_l_cumulative"]}, str(tmp_path / "out"))
    assert spark.read.parquet(out["t"]).count() == 1 and "litres" not in spark.read.text(out["d"]).first()[0]


def test_t_values():
    assert [round(student_t_critical(0.95, d), 3) for d in (1, 4, 9)] == [12.706, 2.776, 2.262]


def test_stream_matches_batch(spark, tmp_path):
    from fieldloom.streaming import hourly_means

    rows = [(0, hour(i // 3) + dt.timedelta(minutes=20 * (i % 3)), float(i)) for i in range(12)]
    d = spark.createDataFrame(rows, "site int, ts timestamp_ntz, v double")
    d.write.parquet(str(tmp_path / "in"))
    s = hourly_means(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), K, "v")
    q = s.writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("means").collect())) == sorted(map(tuple,
        timegrid.hourly(d, K, "v", "mean").collect()))
