"""Closed forms and brute force for tests, matrices and runs that SQL can't state."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.operators import cluster, inference, linear, order, validity


def chi2(table, yates):
    t = np.array(table, float)
    e = t.sum(1)[:, None] * t.sum(0)[None] / t.sum()
    gap = np.abs(t - e)
    gap = gap - np.minimum(0.5, gap) if yates else gap
    return (gap**2 / e).sum()


@pytest.fixture(scope="module")
def people(spark):
    r = random.Random(2)
    rows = [(i, i % 3, float(r.random() < (0.2, 0.5, 0.9)[i % 3]), None if i % 7 == 0 else float(r.random() < 0.5), 1.0) for i in range(90)]
    return rows, spark.createDataFrame(rows, "id int, g int, a double, b double, c double").cache()


def test_summed_chi2_is_that_of_the_tables(people):
    rows, df = people
    want = 0.0
    for j in (2, 3):
        known = [(x[1], x[j]) for x in rows if x[j] is not None]
        want += chi2([[sum(1 for k, v in known if k == g and v == y) for y in (0, 1)] for g in range(3)], False)
    assert inference.summed_chi2(df, "g", ["a", "b", "c"]).first()["chi2"] == pytest.approx(want)
    two = df.where("g < 2")
    table = [[sum(1 for x in rows if x[1] == g and x[2] == y) for y in (0, 1)] for g in range(2)]
    assert inference.summed_chi2(two, "g", ["a"]).first()["chi2"] == pytest.approx(chi2(table, True))


def test_binary_permutation_tells_signal_from_noise(people):
    _, df = people
    assert inference.binary_permutation(df, "id", "g", ["a"], 60)["p"] <= 2 / 61
    halves = df.withColumn("h", F.xxhash64("id") % 2 == 0)
    known = [(x["h"], x["b"]) for x in halves.collect()]

    def stat(hs):
        pairs = [(h, b) for h, (_, b) in zip(hs, known) if b is not None]
        return chi2([[sum(1 for h, b in pairs if h == i and b == j) for j in (0, 1)] for i in (False, True)], True)

    seen, r = stat([h for h, _ in known]), np.random.default_rng(1)
    p = np.mean([stat(r.permutation([h for h, _ in known])) >= seen - 1e-9 for _ in range(600)])
    assert inference.binary_permutation(halves, "id", "h", ["b"], 500)["p"] == pytest.approx(p, abs=0.04)


def test_binary_tests_and_pairs(people):
    rows, df = people
    got = inference.binary_tests(df, "g", ["a", "b", "c"])
    tests = {x["axis"]: x for x in got["tests"].collect()}
    known = [(x[1], x[3]) for x in rows if x[3] is not None]
    assert tests["b"]["chi2"] == pytest.approx(chi2([[sum(1 for k, v in known if k == g and v == y) for y in (0, 1)] for g in range(3)], False)) and tests["b"]["n"] == len(known)
    assert tests["a"]["p_holm"] < 0.001 and tests["a"]["p"] < tests["b"]["p"] and tests["c"]["p_holm"] == 1.0
    n = {g: [sum(1 for x in rows if x[1] == g and x[2] == y) for y in (0, 1)] for g in range(3)}
    for x in got["pairs"].where("axis = 'a'").collect():
        (x1, y1), (x2, y2) = n[x["a"]], n[x["b"]]
        p = (x1 + x2) / (x1 + y1 + x2 + y2)
        if x["test"] == "z":
            assert x["z"] == pytest.approx((x1 / (x1 + y1) - x2 / (x2 + y2)) / np.sqrt(p * (1 - p) * (1 / (x1 + y1) + 1 / (x2 + y2))))
    strong = {k for k, v in tests.items() if v["p_holm"] < 0.05}
    assert {x["axis"] for x in got["pairs"].collect()} == strong and got["pairs"].count() == 3 * len(strong)


def ranks(v):
    o = sorted(v)
    return np.array([(o.index(x) + len(o) - 1 - o[::-1].index(x)) / 2 for x in v])


def test_spearman_matrix(spark):
    r = random.Random(5)
    rows = [(i, r.randint(0, 9), None if i % 5 == 0 else r.randint(0, 9), i % 4) for i in range(60)]
    got = {(x["a"], x["b"]): x for x in linear.spearman_matrix(spark.createDataFrame(rows, "id int, u int, v int, w int"), "id", ["u", "v", "w"]).collect()}
    for (i, a), (j, b) in itertools.combinations(enumerate("uvw", 1), 2):
        both = [(x[i], x[j]) for x in rows if x[i] is not None and x[j] is not None]
        rho = np.corrcoef(ranks([x for x, _ in both]), ranks([y for _, y in both]))[0, 1]
        assert got[a, b]["rho"] == pytest.approx(rho) and got[a, b]["n"] == len(both)
        assert got[a, b]["p"] == pytest.approx(linear.correlation_p(rho, len(both)))


def test_quantiles_and_places(spark):
    r = np.random.default_rng(6)
    v = r.normal(size=301)
    df = spark.createDataFrame([(int(i % 3), float(x)) for i, x in enumerate(v)] + [(7, None)], "g int, v double")
    got = {(x["g"], x["q"]): x["at"] for x in order.quantiles(df, "v", [0.0, 0.1, 0.5, 1.0], ["g"]).collect()}
    for g in range(3):
        for q in (0.0, 0.1, 0.5, 1.0):
            assert got[g, q] == pytest.approx(np.quantile(v[g::3], q))
    placed = order.places_in_group(df.where("v is not null"), ["g"], ["v"]).collect()
    assert all(x["place"] == 1 + sum(y < x["v"] for y in v[x["g"] :: 3]) for x in placed)


def test_runs_on_subsamples_equal_fits_of_these_rows(spark):
    r = np.random.default_rng(7)
    x = spark.createDataFrame([(i, *map(float, r.normal(0, 0.3, 2) + 3 * (i % 2))) for i in range(60)], "id int, a double, b double").cache()
    limits = cluster.subsample_limits(x, "id", 3, 0.8)
    picks = cluster.Picks("id", 42, {r: limits[r] for r in range(3)})
    labels = cluster.kmeans_runs(x, "id", ["a", "b"], {r: (2, 5) for r in range(4)}, 3, subsamples=picks)
    sizes = {row["run"]: row["count"] for row in labels.groupBy("run").count().collect()}
    assert sizes == {0: 48, 1: 48, 2: 48, 3: 60}
    kept = validity.subsamples(x, "id", 3, 0.8)
    assert labels.join(kept, ["run", "id"]).count() == 3 * 48
    mixed = cluster.mixture_runs(x, "id", ["a", "b"], {r: (2, "diag", 5) for r in range(4)}, 2, subsamples=picks)
    for runs in (labels, mixed):
        assert {round(p["ari"], 6) for p in validity.run_agreement(runs, "id", 1).collect()} == {1.0}
        assert runs.withColumn("odd", F.col("id") % 2).groupBy("run", "cluster").agg(F.count_distinct("odd").alias("n")).where("n > 1").count() == 0


def test_model_runs(spark):
    r = np.random.default_rng(8)
    rows = [(g, float(e), "xyz"[k % 3], float(1 + 2 * e + (k % 3 == 1) + u + r.normal(0, 0.1))) for g in range(20) for u in [r.normal(0, 0.5)] for k, e in enumerate(r.normal(size=6))]
    got = linear.model_runs(spark.createDataFrame(rows, "id int, e double, kind string, y double"), "id", {"raw": ["y", "lost"]}, {"cont": ["e", "kind", "absent"]}, ("kind",)).collect()
    terms = {x["term"]: x["coef"] for x in got if x["target"] == "y"}
    assert set(terms) == {"intercept", "e", "kind_y", "kind_z"} and terms["e"] == pytest.approx(2, abs=0.05) and terms["kind_y"] == pytest.approx(1, abs=0.1) and abs(terms["kind_z"]) < 0.1
    assert [x["status"] for x in got if x["target"] == "lost"] == ["fewer than 30 observations"]


def test_block_diagnostics(spark):
    r = np.random.default_rng(9)
    m = r.normal(size=(80, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0], [0, 0, 2.0]])
    df = spark.createDataFrame([tuple(map(float, x)) for x in m], "a double, b double, c double")
    one, two = linear.block_diagnostics(df, {"ab": ["a", "b"], "c": ["c"]})
    c = np.corrcoef(m[:, 0], m[:, 1])[0, 1]
    value = np.linalg.eigvalsh(np.cov(m[:, :2].T))
    assert one["mean_abs_r"] == pytest.approx(abs(c)) and one["pc1"] == pytest.approx(value[1] / value.sum()) and two["pc1"] == 1.0 and two["pc2"] is None
    assert one["mean_norm"] == pytest.approx(np.linalg.norm(m[:, :2], axis=1).mean())


def test_label_order_and_words(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "id int, cluster int")
    x = spark.createDataFrame([(1, [0.0]), (2, [3.0]), (3, [1.0])], "id int, x array<double>")
    got = sorted((r["row"], r["col"], r["distance"]) for r in validity.label_ordered(validity.distances(x, "id"), labels, "distance").collect())
    assert got == [(1, 3, 2.0), (2, 1, 3.0), (2, 3, 1.0)]
    p = spark.createDataFrame([(0, "a", 1.5), (0, "b", -2.0), (0, "c", 0.1)], "cluster int, feature string, z_value double")
    assert validity.interpretation(p, 1).first()["text"] == "high: a (+1.50); low: b (-2.00)"


def test_relabelling_keeps_sizes_and_shuffles_evenly(people):
    rows, df = people
    frames = list(inference._relabelled(df.where("id < 60"), "id", "g", ["a"], 300, 7, batch=200, bits=3))
    each = [f.groupBy("_run", "_g").count().collect() for f in frames]
    assert {r["count"] for e in each for r in e} == {20} and sum(len(e) for e in each) == 900
    means = [r["m"] for f in frames for r in f.where("_g = 0").groupBy("_run").agg(F.avg("a").alias("m")).collect()]
    whole = np.mean([x[2] for x in rows[:60]])
    assert np.mean(means) == pytest.approx(whole, abs=0.02)
    assert np.std(means) == pytest.approx(np.sqrt(whole * (1 - whole) / 20 * 40 / 59), rel=0.15)
