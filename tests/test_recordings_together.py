"""Recordings are measured many at a time: each as if alone, and the parts of skin signals are made once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.functions import convex
from phasegrid.operators import signal


def test_signals_side_by_side_equal_each_alone():
    y = np.clip(np.random.default_rng(2).random((7, 70)) ** 2, 0.001, 0.999)
    y[3, 5] = np.nan
    together = convex.decompose_many(y, 4.0)
    for r, got in enumerate(together):
        if r == 3:
            assert isinstance(got, ArithmeticError)
            continue
        alone = convex.decompose(y[r], 4.0)
        assert all(np.array_equal(got[k], alone[k]) for k in ("phasic", "tonic", "driver"))
    assert all(isinstance(x, ValueError) for x in convex.decompose_many(y[:, :5], 4.0))
    with pytest.raises(ArithmeticError):
        convex.decompose(y[3], 4.0)


def test_each_part_is_made_once_and_no_group_is_a_call(spark):
    rows = spark.range(2000).select((F.col("id") % 20).alias("subject"), F.lit("AB").alias("condition"), (F.floor(F.col("id") / 20) / 4).alias("t_sec"), F.sin(F.col("id") / 7.0).alias("value"))
    made = signal.skin_measures(signal.skin_parts(rows, target=4.0), last=float("inf"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "FlatMapGroupsInArrow" not in plan
    got = made.collect()
    assert len(got) == 20 and all(r["phasic_max"] is not None for r in got)


def test_recordings_of_any_length_keep_their_rows_and_reasons(spark, monkeypatch):
    monkeypatch.setattr(signal, "SAMPLES", 64)
    sizes = {0: 1, 1: 30, 2: 200, 3: 64, None: 5}
    rows = [(s, "AB", float(n - i), None if i % 9 == 8 else float(i)) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "subject int, condition string, t_sec double, value double")

    def kernel(t, x):
        if len(x) < 5:
            raise ValueError("too few")
        assert (np.diff(t) > 0).all()
        return {"n": len(x), "first": float(x[0])}

    got = {r.subject: (r.n, r["first"], r.status) for r in signal.per_recording(df, ["subject", "condition"], "n long, first double", kernel).collect()}
    known = lambda n: [i for i in range(n) if i % 9 != 8]
    assert got == {s: ((len(known(n)), float(known(n)[-1]), "ok") if len(known(n)) >= 5 else (None, None, "too few")) for s, n in sizes.items()}
