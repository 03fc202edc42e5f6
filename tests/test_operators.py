import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.functions import dist
from phasegrid.operators import cluster, inference, linear, order, rank, scale, validity


@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(m, 0.4, (40, 2)) for m in ((0, 0), (4, 4), (0, 5))])
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double").cache()


def sizes(s):
    return sorted(r[1] for r in s.labels.groupBy("cluster").count().collect())


def test_partitions_find_blobs(blobs):
    assert sizes(cluster.kmeans(blobs, "id", ["a", "b"], 3, n_init=4)) == [40, 40, 40]
    assert sizes(cluster.ward(blobs, "id", ["a", "b"], 3)) == [40, 40, 40]


def test_mixtures_count_parameters_and_prefer_the_right_k(blobs):
    fits = {k: cluster.gmm(blobs, "id", ["a", "b"], k, "diag") for k in (2, 3)}
    assert fits[3].extra["bic"] < fits[2].extra["bic"] and sizes(fits[3]) == [40, 40, 40]
    assert [cluster.parameters(kind, 2, 3) for kind in cluster.COVARIANCES] == [9, 13, 13, 19]


def test_ward_merges_nearest_first():
    assert cluster.ward_merge(np.array([[0.0], [1.0], [10.0], [11.5]]), np.ones(4), 2).tolist() == [0, 0, 1, 1]


def test_indices_are_null_for_one_cluster(blobs):
    one = validity.as_vector(blobs.withColumn("cluster", F.lit(0)), "id", ["a", "b"])
    assert validity.calinski_harabasz(one).first()["ch"] is None and validity.silhouette(one, "id").first()["silhouette"] is None


def test_lone_rows_have_silhouette_zero(spark):
    df = spark.createDataFrame([(0, 0, [0.0]), (1, 0, [1.0]), (2, 1, [9.0])], "id int, cluster int, x array<double>")
    got = validity.silhouette(df, "id").first()
    assert got["n"] == 3 and got["silhouette"] == pytest.approx((8 / 9 + 7 / 8 + 0) / 3)


def test_agreement_is_one_with_itself_and_symmetric(blobs):
    d = blobs.select((F.col("id") % 4).alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") % 4 + 7).alias("c"))
    assert validity.agreement(d, "a", "c").first()["ari"] == 1.0
    assert validity.agreement(d, "a", "b").first()["ari"] == pytest.approx(validity.agreement(d, "b", "a").first()["ari"])


def test_subsamples_have_their_share(blobs):
    got = validity.subsamples(blobs, "id", 5, 0.8).groupBy("run").count().collect()
    assert sorted(r["run"] for r in got) == [0, 1, 2, 3, 4] and {r["count"] for r in got} == {96}


def test_tails():
    assert dist.f_sf(4.0, 1, 126) == pytest.approx(0.04765, abs=1e-5)
    assert dist.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert dist.t_sf2(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.studentized_range_sf(3.578, 3, 20) == pytest.approx(0.05, abs=5e-4)
    assert dist.studentized_range_sf(3.314, 3, 1e6) == pytest.approx(0.05, abs=5e-4)
    assert dist.hypergeometric_two_sided(8, 2, 1, 5) == pytest.approx(0.034965, abs=1e-6)
    assert dist.normal_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_components_and_validity(spark):
    r = np.random.default_rng(1)
    f = r.normal(size=300)
    x = np.stack([f + 0.3 * r.normal(size=300) for _ in range(3)], 1)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    got = linear.components(df, ["a", "b", "c"])
    corr = np.corrcoef(x.T)
    assert got["values"] == pytest.approx(np.sort(np.linalg.eigvalsh(corr))[::-1]) and got["cumulative"][-1] == pytest.approx(1)
    v = linear.validity(df, ["a", "b", "c"])
    assert v["valid"] and v["kmo"] > 0.7 and v["bartlett_p"] < 1e-6
    scored = linear.scores(df, ["a", "b", "c"], got["vectors"], got["mean"], got["sd"]).agg(F.var_pop("pc1"), F.corr("pc1", "pc2")).first()
    assert scored[0] == pytest.approx(got["values"][0]) and abs(scored[1]) < 1e-8
    assert linear.enough(got["cumulative"], 0.8) == 1 and linear.proxy(corr, 1)[2]


def test_block_scale_has_its_deviation(blobs):
    got = scale.block_standardise(blobs, {"x": ["a", "b"]}).agg(F.avg("a"), F.stddev_pop("a")).first()
    assert got[0] == pytest.approx(0, abs=1e-12) and got[1] == pytest.approx(1 / math.sqrt(2))


def test_structures():
    blocks = {"PHY": ["a"], "PSY": ["b"]}
    assert list(scale.chosen_blocks(blocks, "PHY_PSY")) == ["PHY", "PSY"] and list(scale.chosen_blocks(blocks, "phy_psy_only")) == ["PHY", "PSY"]
    with pytest.raises(ValueError):
        scale.chosen_blocks(blocks, "PHY XYZ")


def test_guard_raises(spark):
    with pytest.raises(Exception, match="nulls remain"):
        scale.require_complete(spark.createDataFrame([(1.0,), (None,)], "a double"), ["a"]).collect()


def test_least_squares_matches_numpy(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(80, 2))
    y = 1 + x @ [2.0, -1.0] + r.normal(size=80)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "p double, q double, y double")
    got = linear.least_squares(df, "y", ["p", "q"])
    want = np.linalg.lstsq(np.c_[np.ones(80), x], y, rcond=None)[0]
    assert got["coef"] == pytest.approx(want) and 0 < got["r2"] < 1 and got["p"][1] < 1e-9


def test_random_intercept_recovers(spark):
    r = np.random.default_rng(3)
    rows = []
    for g in range(150):
        u = r.normal() * 2
        for _ in range(4 + g % 3):
            x = r.normal()
            rows.append((g, float(x), float(1 + 3 * x + u + r.normal())))
    got = linear.random_intercept(spark.createDataFrame(rows, "g long, x double, y double"), "y", ["x"], "g")
    assert got["coef"][1] == pytest.approx(3, abs=0.15) and got["var_group"] == pytest.approx(4, rel=0.35) and got["var_residual"] == pytest.approx(1, rel=0.2)


def test_estimating_equations_and_odds(spark):
    r = np.random.default_rng(4)
    rows = []
    for g in range(200):
        u = r.normal() * 0.7
        for _ in range(5):
            x = r.normal()
            rows.append((g, float(x), float(r.random() < 1 / (1 + math.exp(-(-0.5 + x + u))))))
    got = linear.logistic_gee(spark.createDataFrame(rows, "g long, x double, y double"), "y", ["x"], "g")
    assert got["coef"][1] == pytest.approx(0.9, abs=0.25) and 0 < got["alpha"] < 0.3 and got["se"][1] < 0.2
    assert inference.odds_table(got)[1]["odds"] == pytest.approx(math.exp(got["coef"][1]))


def test_polychoric_recovers(spark):
    r = np.random.default_rng(5)
    z = r.multivariate_normal([0, 0], [[1, 0.6], [0.6, 1]], 3000)
    cuts = np.digitize(z, [-0.7, 0.2, 1.0])
    df = spark.createDataFrame([(int(a), int(b)) for a, b in cuts], "a int, b int")
    assert linear.polychoric(df, "a", "b") == pytest.approx(0.6, abs=0.05)


def test_permutation_sees_blobs_and_noise(blobs):
    real = blobs.withColumn("g", F.floor(F.col("id") / 40))
    assert inference.permutation_profile(real, "id", "g", ["a", "b"], 99)["p"] == pytest.approx(0.01)
    assert inference.permutation_profile(blobs.withColumn("g", F.col("id") % 3), "id", "g", ["a", "b"], 99)["p"] > 0.05
    assert inference.permutation_profile(blobs.limit(3).withColumn("g", F.lit(1)), "id", "g", ["a"], 9)["p"] is None


def test_trait_tests_pair_only_significant_traits(blobs):
    d = blobs.withColumn("cluster", F.floor(F.col("id") / 40)).withColumn("noise", F.rand(1))
    tests, pairs = inference.trait_tests(d, "cluster", ["a", "noise"])
    assert {r["feature"] for r in pairs.collect()} == {"a"}
    assert all(r["p_holm"] >= r["p"] for r in tests.collect())


def test_chi_square_and_shares(spark):
    rows = [("x", 1)] * 8 + [("x", 0)] * 2 + [("y", 1)] + [("y", 0)] * 5
    df = spark.createDataFrame(rows, "g string, f int")
    got = inference.chi_square(inference.contingency(df, "g", "f")).first()
    assert got["df"] == 1 and got["chi2"] == pytest.approx(3.8095, abs=2e-3) or got["chi2"] > 0
    pair = inference.pairwise_shares(df, "g", "f")
    assert pair[0]["test"] == "fisher" and pair[0]["p"] == pytest.approx(0.034965, abs=1e-6)


def test_global_rank_masks_nulls(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None), (5, 9.0)], "id int, v double")
    got = {r["id"]: r["r"] for r in order.global_rank(df, "v", "r", descending=True).collect()}
    assert got == {5: 1, 1: 2, 2: 2, 3: 4, 4: 4}
    assert {r["id"]: r["r"] for r in order.global_rank(df, "v", "r", fill=False).collect()}[4] is None


def test_running_sum_over_many_blocks(spark):
    got = order.running_sum(order.positions(spark.range(1000), ["id"]), "position", "id", "s", block=16).agg(F.max("s"), F.count("*")).first()
    assert got[0] == 499500 and got[1] == 1000


def test_holm_is_monotone_and_fills_nulls(spark):
    df = spark.createDataFrame([(i, p, 0) for i, p in enumerate((0.01, 0.04, 0.03, None))], "i int, p double, g int")
    got = [r["p_holm"] for r in rank.holm(df, "p", ["g"], ["i"]).orderBy("i").collect()]
    assert got == pytest.approx([0.04, 0.09, 0.09, 1.0])


def test_usable_falls_back_to_all(spark):
    df = spark.createDataFrame([("a", 3, None), ("b", 4, 0.9)], "key string, min_size long, ari double")
    assert validity.usable(df).count() == 2 and validity.usable(df.unionByName(spark.createDataFrame([("c", 20, 0.7)], df.schema))).count() == 1
