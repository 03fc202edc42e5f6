"""Pairs are compared in blocks of rows; no pair is shuffled, nulls and strings are as in plain SQL."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.operators import validity


def test_coclustering_without_a_shuffle_of_pairs(spark):
    g = np.random.default_rng(1)
    rows = [(run, f"i{i:02d}", None if g.random() < 0.1 else int(g.integers(3))) for run in range(6) for i in range(40) if g.random() < 0.7]
    df = spark.createDataFrame(rows, "run int, id string, cluster int")
    of = {}
    for run, i, c in rows:
        of.setdefault(i, {})[run] = c
    for wanted in (None, F.col("id") < "i05"):
        out = validity.coclustering(df, wanted=wanted)
        got = {(r.id_a, r.id_b): (r.together, r.n_runs) for r in out.collect()}
        want = {}
        for a, b in itertools.product(of, of):
            both = of[a].keys() & of[b].keys()
            if both and (a <= b if wanted is None else a < "i05"):
                sure = [of[a][r] == of[b][r] for r in both if of[a][r] is not None and of[b][r] is not None]
                want[a, b] = (np.mean(sure) if sure else None, len(both))
        assert got.keys() == want.keys() and all(got[p][1] == n and got[p][0] == (None if t is None else pytest.approx(t)) for p, (t, n) in want.items())
        assert "HashAggregate" not in out._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_distances_with_null_vectors(spark):
    rows = [(i, None if i == 3 else [float(i), None if i == 4 else 2.0 * i]) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    out = validity.distances(df, "id", F.col("id") % 3 == 0)
    got = {(r.id_a, r.id_b): r.distance for r in out.collect()}
    assert got.keys() == {(a, b) for a in (0, 3, 6) for b in range(8) if a != b}
    assert all(v is None if {3, 4} & {a, b} else v == pytest.approx(5**0.5 * abs(a - b)) for (a, b), v in got.items())
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_a_silhouette_do_not_grow_with_the_rows(spark):
    got = spark.range(1).select(*(validity.blocks_of(F.lit(n), 512).alias(f"b{n}") for n in (1, 513, 8192, 1_000_000, 2_000_000))).first()
    assert list(got) == [1, 2, 16, 16, 31]


def test_silhouette_of_many_dimensions_with_copies_far_from_the_origin(spark):
    g = np.random.default_rng(8)
    x = 1e4 + np.round(g.standard_normal((90, 12)) + 3 * (np.arange(90) % 3)[:, None], 2)
    x[30:60] = x[:30]
    c = np.arange(90) % 3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(90):
        a, b = d[i, c == c[i]].sum() / ((c == c[i]).sum() - 1), min(d[i, c == k].mean() for k in range(3) if k != c[i])
        want.append((b - a) / max(a, b))
    df = spark.createDataFrame([(i, int(c[i]), x[i].tolist()) for i in range(90)], "id int, cluster int, x array<double>")
    assert validity.silhouette(df, "id").first().silhouette == pytest.approx(np.mean(want), abs=1e-9)
