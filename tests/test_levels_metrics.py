"""Metrics alone are those of the whole study, and equal rows of a silhouette are compared once."""

import numpy as np
import pytest

from phasegrid.operators import validity
from phasegrid.plans import levels
from tests.test_levels import tables


def test_metrics_alone_equal_those_of_all_tables(spark, monkeypatch):
    config = levels.Grid(ks=(2, 3), kinds=("diag",), components=2, n_init=1, restarts=2, rounds=30)
    studies, given = [("person", "F0"), ("scenario_static", "all")], tables(spark)
    rows = levels.study_rows(*given, studies)
    whole = levels.run_levels(rows, studies, config)["metrics"]
    seen, indices = [], validity.indices
    monkeypatch.setattr(validity, "indices", lambda labelled, *a: seen.append(labelled.select("run").distinct().count()) or indices(labelled, *a))
    alone = levels.run_levels(rows, studies, config, only_metrics=True)
    assert set(alone) == {"metrics"} and alone["metrics"].columns == whole.columns and seen == [2]
    a, b = (df.orderBy("level").toPandas() for df in (whole, alone["metrics"]))
    for c in a.columns:
        assert a[c].tolist() == (b[c].tolist() if a[c].dtype == object else pytest.approx(b[c].tolist(), abs=1e-9))


def test_copies_are_compared_once_and_count_each(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.repeat(np.round(rng.normal(0, 1, (40, 2)), 3), 25, 0)
    c = np.repeat(np.arange(40) % 3, 25)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(1000):
        a, b = d[i, c == c[i]].sum() / ((c == c[i]).sum() - 1), min(d[i, c == k].mean() for k in range(3) if k != c[i])
        want.append((b - a) / max(a, b))
    df = spark.createDataFrame([(f"i{i}", int(c[i]), x[i].tolist()) for i in range(1000)], "id string, cluster int, x array<double>")
    asked, rivals = [], validity.rivals

    def count(rows, *a):
        asked.append(rows.count())
        return rivals(rows, *a)

    monkeypatch.setattr(validity, "rivals", count)
    got = validity.silhouette(df, "id").first()
    assert got.silhouette == pytest.approx(np.mean(want), abs=1e-9) and got.n == 1000 and asked == [40]


def test_lone_rows_and_single_clusters(spark):
    df = spark.createDataFrame([(0, 0, [0.0]), (1, 0, [0.0]), (2, 1, [3.0])], "id int, cluster int, x array<double>")
    got = validity.silhouette(df, "id").first()
    assert got.silhouette == pytest.approx(2 / 3) and got.n == 3
    one = validity.silhouette(df.where("cluster = 0"), "id").first()
    assert one.silhouette is None and one.n == 0
