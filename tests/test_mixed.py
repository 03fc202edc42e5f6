import math

import numpy as np
import pytest

from phasegrid.operators import linear, mixed


def pairs(spark, r, n=20_000, seed=1):
    g = np.random.default_rng(seed)
    z = g.standard_normal((n, 2))
    x, y = z[:, 0], r * z[:, 0] + math.sqrt(1 - r * r) * z[:, 1]
    return spark.createDataFrame([(int(np.digitize(a, [-0.8, 0.3, 1.1])), int(np.digitize(b, [-0.2, 0.9])), float(a), float(3 * b - 7), 0) for a, b in zip(x, y)], "u int, v int, x double, y double, n int")


@pytest.mark.parametrize("r", [0.6, -0.35, 0.0])
def test_cut_normal_variables_give_their_correlation_back(spark, r):
    df = pairs(spark, r)
    for likelihood in (False, True):
        got = {(x["a"], x["b"]): x["r"] for x in mixed.mixed_correlation(df, ["u", "v"], ["y"], likelihood)}
        assert got["u", "y"] == pytest.approx(r, abs=0.02) and got["u", "v"] == pytest.approx(r, abs=0.02)
    assert linear.polychoric(df, "u", "v") == pytest.approx(got["u", "v"], abs=1e-12)


def test_two_levels_are_biserial_and_two_by_two_tetrachoric(spark):
    # Half and half: the tetrachoric correlation is sin(pi/2 * (share alike - share unlike)).
    counts = np.array([[30.0, 10.0], [10.0, 30.0]])
    assert mixed.polychoric_of(counts) == pytest.approx(math.sin(math.pi / 2 * 0.5), abs=1e-6)
    y = np.array([0.0, 1.0, 2.0, 5.0])
    got = mixed.polyserial_of(np.array([2.0, 2.0]), np.array([1.0, 7.0]), np.array([1.0, 29.0]))
    assert got == pytest.approx((3.5 - 0.5) / y.std() * 0.25 * math.sqrt(2 * math.pi))


def test_bins_do_not_move_the_likelihood(spark):
    df = pairs(spark, 0.5, 4000, 3)
    rows = df.select("u", "y").toPandas()
    z = ((rows.y - rows.y.mean()) / rows.y.std(ddof=0)).to_numpy()
    exact = mixed.polyserial_likelihood(np.array([[float(u == k) for u in rows.u] for k in range(4)]), z)
    assert mixed.polyserial_long(df, ["u"], ["y"], likelihood=True)[0]["r"] == pytest.approx(exact, abs=2e-4)


def test_collinear_block_becomes_positive(spark):
    df = spark.createDataFrame([(i % 3, (i % 3) + 1, float(i % 3), float(i % 7)) for i in range(210)], "a int, b int, c double, d double")
    raw = mixed.mixed_matrix(df, ["a", "b"], ["c", "d"], smooth=False)
    r = mixed.mixed_matrix(df, ["a", "b"], ["c", "d"])
    assert np.linalg.eigvalsh(raw).min() < 0 <= np.linalg.eigvalsh(r).min() + 1e-12
    assert np.allclose(np.diag(r), 1) and np.allclose(r, r.T) and np.abs(r).max() <= 1 + 1e-12
    assert abs(linear.components_of(r)["values"].sum() - 4) < 1e-6
    assert mixed.smoothed(np.eye(3)) is not None and np.array_equal(mixed.smoothed(np.eye(3)), np.eye(3))
    with pytest.raises(ValueError):
        mixed.smoothed(np.array([[1, np.nan], [np.nan, 1]]))


def test_nulls_one_level_many_levels_and_no_rows(spark):
    shape = "u int, v int, y double, pair int, x string"
    df = spark.createDataFrame([(1, 1, 2.0, 0, ""), (1, None, None, 0, ""), (1, 2, float("nan"), 0, ""), (1, 3, 4.0, 0, "")], shape)
    got = {(x["a"], x["b"]): x for x in mixed.mixed_correlation(df, ["u", "v"], ["y"], likelihood=True)}
    assert math.isnan(got["u", "y"]["r"]) and math.isnan(got["u", "v"]["r"]) and got["v", "y"]["n"] == 2
    for likelihood in (False, True):
        none = mixed.mixed_correlation(spark.createDataFrame([], shape), ["u", "v"], ["y"], likelihood)
        assert [x["n"] for x in none] == [0, 0, 0] and all(math.isnan(x["r"]) for x in none)
    many = spark.range(1000).selectExpr("cast(id as int) as u", "cast(id % 2 as int) as v", "rand(1) as y")
    for f in (lambda: mixed.polychoric_long(many, ["u", "v"]), lambda: mixed.polyserial_long(many, ["u"], ["y"])):
        with pytest.raises(ValueError):
            f()
