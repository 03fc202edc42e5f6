import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.functions import columns as C
from phasegrid.functions import waves as w
from phasegrid.operators import scale, series, signal
from phasegrid.plans import study
from phasegrid.sources import recordings as R


def test_filters_keep_and_remove():
    t = np.arange(0, 20, 0.01)
    slow, fast = np.sin(2 * np.pi * t), np.sin(2 * np.pi * 20 * t)
    assert np.abs(w.filtered(slow + fast, 100, "low", (5.0,), 4) - slow)[100:-100].max() < 0.02
    assert np.abs(w.filtered(slow + fast, 100, "high", (5.0,), 4) - fast)[100:-100].max() < 0.02
    h = np.abs(w.response(np.array([5.0]), 100, "low", (5.0,), 3))
    assert h[0] == pytest.approx(np.sqrt(0.5), rel=1e-6)
    band = np.abs(w.response(np.array([0.5, 10.0, 45.0]), 100, "band", (5.0, 15.0), 2))
    assert band[0] < 0.02 and band[1] > 0.9 and band[2] < 0.05


def test_polynomial_smoother_keeps_cubics():
    x = np.linspace(-1, 1, 101)
    assert w.savitzky_golay(x**3 - x, 21) == pytest.approx(x**3 - x, abs=1e-9)


def test_peaks_respect_distance_and_prominence():
    x = np.array([0, 1, 0, 3, 0, 2.9, 0, 1, 1, 0.5, 4, 0])
    assert w.peaks(x).tolist() == [1, 3, 5, 7, 10]
    assert w.peaks(x, distance=3).tolist() == [3, 7, 10]
    assert w.peaks(x, prominence=1.5).tolist() == [3, 5, 10]


def test_spectrum_and_resampling():
    t = np.arange(0, 300, 0.25)
    f, p = w.welch(np.sin(2 * np.pi * 0.1 * t), 4.0)
    assert w.band_power(f, p, 0.04, 0.15) > 20 * w.band_power(f, p, 0.15, 0.4)
    assert w.fourier_resample(np.cos(2 * np.pi * np.arange(40) / 40), 10) == pytest.approx(np.cos(2 * np.pi * np.arange(10) / 10))


@pytest.fixture(scope="module")
def heart(spark):
    fs, rows = 100, []
    t = np.arange(0, 70, 1 / fs)
    beats = np.cumsum(0.8 + 0.05 * np.sin(np.arange(84) / 3))
    x = sum(np.exp(-((t - b) ** 2) / (2 * 0.012**2)) for b in beats) + 0.05 * np.sin(2 * np.pi * 0.3 * t)
    rows = [(1, "AB", float(a), float(b)) for a, b in zip(t, x)] + [(2, "AB", float(i), 0.0) for i in range(3)]
    return spark.createDataFrame(rows, "subject int, condition string, t_sec double, value double"), beats


def test_beats_and_measures(heart):
    df, beats = heart
    found = signal.r_peaks(df)
    assert found.where("subject = 2").first()["status"] != "ok"
    n = found.where("subject = 1").count()
    assert abs(n - (beats < 70).sum()) <= 3
    rr = signal.intervals(found)
    got = signal.heart_minutes(rr, minutes=2).orderBy("minute").collect()
    assert got[0]["hr"] == pytest.approx(75, abs=3) and got[1]["minute"] == 2
    assert signal.heart_spectrum(rr).where("subject = 1").first()["lf"] is not None
    q = signal.quality(df).where("subject = 1").first()
    assert q["fs"] == 100 and q["kurtosis"] > 3 and q["filter_class"] in ("standard", "medium", "strong", "reject")


def test_skin_parts(spark):
    t = np.arange(0, 60, 0.05)
    x = 0.02 * t + sum(np.where(t > b, np.exp(-(t - b) / 2), 0) for b in (10, 30, 45))
    df = spark.createDataFrame([(1, "AB", float(a), float(b)) for a, b in zip(t, x)], "subject int, condition string, t_sec double, value double")
    assert signal.skin_parts(df, convex=False).first()["method"] == "low 0.5 Hz"
    got = signal.skin_parts(df)
    assert got.first()["method"] == "convex"
    m = signal.skin_measures(got).first()
    assert m["tonic_slope"] is not None and m["phasic_max"] > 0.05
    assert signal.resampled(df, ["subject", "condition"], 1.0).count() == 60
    assert signal.long_enough(df, ["subject"], 5000).first()["status"].startswith("shorter")


def test_moving_average_edges_match_numpy(spark):
    x = np.random.default_rng(0).normal(size=30)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "k int, i int, v double")
    for width in (4, 5):
        got = [r["smooth"] for r in series.moving_average_edges(df, ["k"], ["i"], "v", width).orderBy("i").collect()]
        assert got == pytest.approx(w.moving_average(x, width))


def test_exports(spark, tmp_path):
    good = "﻿sec\tCH1\tCH2\n\tECG one\tSKT A\n0\t1.5\t30\n0.1\t-\t31\nbroken line\n0.2\t2.5\t32\n"
    (tmp_path / "s01_kim_AB.txt").write_text(good, encoding="utf-8")
    (tmp_path / "s02_lee_cd.txt").write_text("no header\n1\t2\n")
    (tmp_path / "other.csv").write_text("x")
    got = R.read_exports(spark, str(tmp_path)).cache()
    ecg = R.channel(got, "ECG").orderBy("t_sec").collect()
    assert [(r["subject"], r["condition"], r["t_sec"], r["value"]) for r in ecg] == [("s01", "AB", 0.0, 1.5), ("s01", "AB", 0.1, None), ("s01", "AB", 0.2, 2.5)]
    bad = got.where("status <> 'ok'").collect()
    assert [(r["subject"], r["condition"]) for r in bad] == [("s02", "CD")]


def test_halves(spark):
    a = spark.createDataFrame([(0.0, 1.0), (601.0, 2.0)], "t_sec double, v double")
    assert [r[0] for r in R.joined_halves(a, a).orderBy("t_sec").collect()] == [0.0, 600.0]
    with pytest.raises(ValueError):
        R.joined_halves(a, a.select("t_sec"))


def test_sheets_and_sinks(spark, tmp_path):
    (tmp_path / "in.csv").write_text("﻿NO,Time (min),Score\n1,5,3\n-,5,4\n,10,1\n2,20,n/a\n", encoding="utf-8")
    df = R.read_sheet(spark, str(tmp_path / "in.csv"))
    assert df.columns == ["id", "time_min", "score"] and [r["id"] for r in df.orderBy("id").collect()] == [1, 2]
    R.write_tables({"t": df}, str(tmp_path / "out"), "tsv")
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out/t")).count() == 2
    for k in (1, 2):
        R.append_row(spark, str(tmp_path / "m"), {"run": f"r{k}", "created_at": f"2024-0{k}"}, "run string, created_at string")
    assert R.latest(spark.read.parquet(str(tmp_path / "m")), "run").first()["run"] == "r2"
    assert R.merged_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 5}}) == {"a": {"b": 5, "c": 2}}
    assert len(R.config_hash({"x": 1})) == 10
    with pytest.raises(ImportError):
        R.read_excel("x.xlsx")


def test_encoders(spark):
    df = spark.createDataFrame([("ａ ".replace("ａ", "Ａ"), "남"), ("HG", "F"), ("?", "x"), (None, None)], "e string, s string")
    got = df.select(C.condition(F.col("e")).alias("c"), C.direction(F.col("e")).alias("d"), C.sex(F.col("s")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("AB", -1, 1), ("GH", -1, 0), (None, None, None), (None, None, None)]
    assert C.normal_name(" Time (min)") == "time_min" and C.minute_columns(spark.createDataFrame([(1, 2, 3)], "st_mean_2 int, st_mean_1 int, st int"), "st_mean") == {1: "st_mean_1", 2: "st_mean_2"}
    assert C.scenario_name("hr_static_mean") == "hr_scenario_mean"
    row = spark.createDataFrame([("49", "50", "—", "1e3", "NaN")], "a string, b string, c string, d string, e string").select(*(C.number(F.col(x)).alias(x) for x in "abcde")).first()
    assert tuple(row) == (49.0, 50.0, None, 1000.0, None)


def test_study_end_to_end(spark, tmp_path):
    r = random.Random(1)
    ids = range(36)
    minute = [(i, env, f, m, (3 if i % 2 and m > 10 else 0) * "ABCDEFGH".index(env[0]) + r.random()) for i in ids for env in ("AB", "CD", "EF") for f in ("hr", "eda", "st", "pulse") for m in (1, 5, 12, 20)]
    survey = [(i, seg, t, float(r.randint(-3, 3)), float(r.randint(-3, 3)), r.random(), r.random()) for i in ids for seg in "ABCDEF" for t in (0, 10, 20)]
    load = [(i, seg, r.random()) for i in ids for seg in "ABCDEF"]
    traits = [(i, None if k == 0 and i % 3 == 0 else r.random(), r.random(), k) for i in ids for k in range(2)]
    make = spark.createDataFrame
    f = study.long_features(make(minute, "id int, env string, feature string, minute int, value double"), make(survey, "id int, env string, time_min int, tsv double, tcv double, p double, m double"), make(load, "id int, env string, score double"), make(traits, "id int, m double, p double, row int"))
    config = study.Config(structure="PHY PSY", ks=(2,), kinds=("diag",), n_init=2, mixture_init=2, seed_runs=3, subsample_runs=4, n_perm=40)
    other = make([(i, float(i % 2) + r.random(), r.random(), float((i % 2) ^ (i == 5))) for i in ids], "id int, one double, two double, flag double")
    got = study.run(spark, f, other, str(tmp_path), config, "2024-01-01", axes=("flag",))
    best = got["candidates"].first()
    assert best["sizes"] == "C0:18, C1:18" and len(study.report(got["candidates"]).splitlines()) == 3
    assert got["tests"].where("feature = 'one'").first()["p_holm"] < 0.01
    assert spark.read.parquet(f"{tmp_path}/manifest").count() == 1 and got["matrix"].count() == 36
    # Agreement is known for every candidate, and decides what is usable.
    rows = got["candidates"].collect()
    assert all(x["seed_ari"] is not None and x["ari"] is not None and x["n_pairs"] == 6 for x in rows)
    assert all(x["usable"] == (x["min_size"] >= 10 and x["ari"] >= 0.60) for x in rows)
    assert {x["mode"]: x["p"] <= 2 / 41 for x in got["global"].collect()} == {"continuous": True, "binary": True}
    assert got["binary_tests"].first()["p_holm"] < 0.01 and got["binary_pairs"].first()["p_holm"] < 0.01 and got["binary_tables"].agg(F.sum("n")).first()[0] == 36
    assert got["distances"].count() == 36 * 35 // 2 and got["embedding"].columns == ["id", "cluster", "pc1", "pc2"]
    assert got["coclustering"].where("row = col").count() == 36 and len(study.posthoc_report(got).splitlines()) == 5
    assert {x["model"] for x in R.label_sets(got["labels"]).collect()} == {"kmeans", "ward", "gmm"}
    text = study.total_report(got)
    assert all(f"{k}: score" in text for k in (x["key"] for x in rows)) and "component 1: eigenvalue" in text and "small clusters\n" in text
    assert got["scree"].agg(F.sum("share")).first()[0] == pytest.approx(1.0) and got["loadings"].where("place = 1").count() == got["scree"].count()
    mark = R.latest_run(spark, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/run_metrics").where(f"run = '{mark}' and name = 'best_silhouette'").count() == 1
    assert spark.read.parquet(f"{tmp_path}/{mark}/interpretation").count() == 2


def test_entry_points(spark, tmp_path):
    from phasegrid.__main__ import config_of, main

    r = random.Random(3)
    make, ids = spark.createDataFrame, range(24)
    folder = str(tmp_path / "tables")
    make([(i, f"{n}_sd", 4.0 * (i % 2) + r.random()) for i in ids for n in ("tsv", "tcv")], "id int, feature string, value double").write.parquet(f"{folder}/features")
    make([(i, i % 2 + r.random()) for i in ids], "id int, one double").write.parquet(f"{folder}/people")
    (tmp_path / "c.json").write_text('{"ks": [2], "kinds": ["diag"], "n_init": 2}')
    common = ["--config", str(tmp_path / "c.json"), "--tables", folder, "--out", str(tmp_path / "out")]
    assert main(["cluster", *common, "--no-stability", "structure=PSY", "mixture_init=1", "n_perm=20", "pair_tables=false"], spark) == 0
    assert main(["posthoc", *common, "n_perm=20"], spark) == 0
    mark = R.latest_run(spark, str(tmp_path / "out"))
    assert spark.read.parquet(f"{tmp_path}/out/{mark}/posthoc/global").first()["p"] <= 1 / 21 + 1e-9
    with pytest.raises(KeyError):
        config_of({"colour": 1})


def test_lookup_tables(spark):
    groups = R.variable_groups(spark, {"PHY": ["hr", "eda"], "PSY": ["tsv"]})
    assert {(x.feature, x.block) for x in groups.collect()} == {("hr", "PHY"), ("eda", "PHY"), ("tsv", "PSY")}
    with pytest.raises(ValueError):
        R.variable_groups(spark, {"A": ["x"], "B": ["x"]})
    manifest = spark.createDataFrame([("SUR", "a.csv"), ("EUP", "b.csv")], "block string, path string")
    assert R.block_file(manifest, " sur") == "a.csv"
    with pytest.raises(KeyError):
        R.block_file(manifest, "none")
    assert R.feature_metadata(spark, {"hr": ("ECG", "rate", "mean")}).first()["representing"] == "rate"
    assert R.read_config(None, ["a.b=3", "c=x", "a.d=[1]"], {"a": {"e": 1}}) == {"a": {"e": 1, "b": 3, "d": [1]}, "c": "x"}


def test_guards_and_limits(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "id int, x double")
    with pytest.raises(Exception, match="nulls remain"):
        scale.require_complete(df, ["x"]).select("id").collect()
    with pytest.raises(KeyError):
        scale.require_columns(df, ["y"])
    assert scale.STRUCTURES["reactivity_only"] == ("PHY", "PSY", "TLX")
    row = spark.createDataFrame([(-1.0, 5.0, float("nan"))], "a double, b double, c double").select(*(C.clipped(F.col(x), 0, 3).alias(x) for x in "abc")).first()
    assert tuple(row) == (0.0, 3.0, None)
    assert [x[0] for x in spark.createDataFrame([("남자",), ("woman",)], "s string").select(C.sex(F.col("s"))).collect()] == [1, 0]


def test_streams(spark, tmp_path):
    from phasegrid.streaming import minutes as S

    t0 = dt.datetime(2024, 1, 1)
    rows = [(u, t0 + dt.timedelta(seconds=20 * k), float(k)) for u in (1, 2) for k in range(60)]
    spark.createDataFrame(rows, "user_id int, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id int, ts timestamp, value double").parquet(str(tmp_path / "in"))

    def drained(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.table(name)

    got = drained(S.minute_features(stream, ["user_id"], late="1 minute"), "minutes_out")
    assert got.count() > 0 and {r["n"] for r in got.collect()} == {3}
    gaps = drained(S.running_gaps(stream, "user_id"), "gaps_out")
    assert gaps.count() == 120 and gaps.where("gap_s = 20").count() == 118
