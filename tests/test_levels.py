import random

import numpy as np
import pytest

from phasegrid.operators import cluster
from phasegrid.plans import levels

ROW = "id int, env string, feature string, value double"
NAMES = ["st_mean", "st_delta_dynamic_minus_static", "HR_mean", "LF_HF_sd", "eda_max", "other"]


def tables(spark, n=40):
    r = random.Random(5)
    signals = [(i, env, f, (4.0 if i % 2 else 0.0) * (k % 3) + r.gauss(0, 1) if r.random() < 0.95 else None) for i in range(n) for env in ("AB", " cd", "ＥＦ", "XX") for k, f in enumerate(NAMES)]
    survey = [(i, seg, f, r.gauss(i % 2, 1)) for i in range(n) for seg in "ABCDQ" for f in ("tsv", "tcv")] + [(None, "A", "tsv", 1.0)]
    scenes = [(i, seg, pair, ph, f, r.gauss(3 * (i % 2), 1)) for i in range(n // 2) for seg, pair, ph in (("A", "AB", "static"), ("B", "AB", "dynamic")) for f in ("st_mean", "HR_mean", "odd")]
    return spark.createDataFrame(signals, ROW), spark.createDataFrame(survey, ROW), spark.createDataFrame(scenes, "id int, segment string, pair string, phase string, feature string, value double")


STUDIES = [("person", f"F{i}") for i in range(6)] + [(x, "all") for x in levels.LEVELS[1:]]


def test_features_of_levels_and_sets(spark):
    rows = levels.study_rows(*tables(spark), STUDIES)
    got = {}
    for r in rows.select("study", "feature").distinct().collect():
        got.setdefault(STUDIES[r.study], set()).add(r.feature)
    change = levels.CHANGE
    assert got["person", "F0"] == set(NAMES) - {"other"} and got["person", "F1"] == {f"st_{change}"} and got["person", "F2"] == {"st_mean", f"st_{change}"}
    assert got["person", "F3"] == {"HR_mean", "LF_HF_sd"} and got["person", "F4"] == {"eda_max"} and got["person", "F5"] == {f"st_{change}", f"tsv_{change}", f"tcv_{change}"}
    assert all(got[x, "all"] == {"st_mean", "HR_mean", "odd"} for x in levels.LEVELS[1:])
    n = {STUDIES[r.study]: r.n for r in rows.groupBy("study").agg({"id": "count"}).withColumnRenamed("count(id)", "n").collect()}
    assert n["scenario_all", "all"] == 2 * n["scenario_static", "all"] == 2 * n["scenario_dynamic", "all"]
    for bad in ([("person", "F9")], [("crowd", "F1")]):
        with pytest.raises(ValueError):
            levels.study_rows(*tables(spark, 2), bad)


def test_preparation_as_plain_numpy(spark):
    rows = levels.study_rows(*tables(spark), [("person", "F0"), ("person", "F2")])
    ready = levels.prepare(rows, 3)
    held = {(r.study, r.id, r.feature): r.value for r in rows.collect()}
    for s in (0, 1):
        ids = sorted({i for t, i, _ in held if t == s})
        x = np.array([[held.get((s, i, f), np.nan) for f in ready.features[s]] for i in ids])
        x = np.where(np.isnan(x), np.nanmedian(x, 0), x)
        iqr = np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)
        x = (x - np.median(x, 0)) / np.where(iqr == 0, 1, iqr)
        scaled = {r.id: r.x for r in ready.scaled.where(f"study = {s}").collect()}
        assert np.allclose([scaled[i] for i in ids], x)
        _, sv, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
        want = (x - x.mean(0)) @ v[: ready.used[s]].T
        got = {r.id: [r[c] for c in ready.columns] for r in ready.projected.where(f"study = {s}").collect()}
        assert np.allclose(np.abs([got[i][: ready.used[s]] for i in ids]), np.abs(want)) and np.allclose([got[i][ready.used[s] :] for i in ids], 0)


def test_studies_together_equal_studies_apart(spark, tmp_path):
    config = levels.Grid(ks=(2, 3), kinds=("diag", "full"), components=2, n_init=2, restarts=3, rounds=60)
    studies = [("person", "F0"), ("scenario_static", "all"), ("person", "F4")]
    given = tables(spark)
    both = levels.run_levels(levels.study_rows(*given, studies), studies, config)
    metrics = {(r.level, r.set): r.asDict() for r in both["metrics"].collect()}
    assert set(metrics) == set(studies) and all(m["n_pairs"] == 3 and m["silhouette"] is not None for m in metrics.values())
    assert metrics["person", "F0"]["n"] == 40 and metrics["scenario_static", "all"]["n"] == 20 and metrics["person", "F4"]["n_used"] == 1
    grid = {(r.level, r.set, r.k, r.kind): r.bic for r in both["grid"].collect()}
    for study in studies[:2]:
        apart = levels.run_levels(levels.study_rows(*given, [study]), [study], config)
        alone = apart["metrics"].first().asDict()
        for name, v in alone.items():
            assert metrics[study][name] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v), name
    # One study as a plain call of the mixtures.
    ready = levels.prepare(levels.study_rows(*given, studies[:1]), 2)
    for s in cluster.mixtures(ready.projected, "id", ready.columns, [(k, kind) for k in (2, 3) for kind in ("diag", "full")], 2, config.seed, rounds=60):
        assert grid["person", "F0", s.k, s.extra["kind"]] == pytest.approx(s.extra["bic"], abs=1e-6)
    assert both["interpretation"].where("level = 'person' and set = 'F0'").count() == metrics["person", "F0"]["k"]
    assert both["clusters"].count() == 100 and both["embedding"].columns == ["level", "set", "id", "cluster", "c0", "c1"]


def test_one_command(spark, tmp_path, capsys):
    from phasegrid.__main__ import main

    for name, df in zip(("signals", "survey", "scenes"), tables(spark, 24)):
        df.write.parquet(f"{tmp_path}/t/{name}")
    got = main(["levels", "--tables", f"{tmp_path}/t", "--out", f"{tmp_path}/o", "--studies", "person/F3,scenario_dynamic/all", "ks=[2]", "kinds=[\"diag\"]", "components=2", "n_init=1", "restarts=2", "rounds=20"], spark)
    assert got == 0 and len(capsys.readouterr().out.splitlines()) == 2
    assert spark.read.parquet(f"{tmp_path}/o/levels/clusters").count() == 24 + 12
