import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.operators import inference, order, series


def test_quantiles_of_groups_by_refinement(spark):
    r = random.Random(3)
    groups = {"hot": [r.lognormvariate(0, 3) for _ in range(4000)], "ties": [float(r.randint(0, 3)) for _ in range(500)], "one": [2.5], None: [r.gauss(0, 1) for _ in range(40)], "wide": [-1e300, 0.0, 1e-300, 1e300], "same": [7.0] * 300}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("empty", None), ("one", float("inf"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for buckets, most in ((1024, 4096), (4, 10)):
        got = {(x.k, x.q): x.at for x in order.group_quantiles(df, ["k"], "v", [0.25, 0.5, 0.9], buckets, most).collect()}
        assert set(got) == {(k, q) for k in groups for q in (0.25, 0.5, 0.9)}
        for (k, q), at in got.items():
            assert at == pytest.approx(np.quantile(groups[k], q), rel=1e-12), (k, q)


@pytest.mark.parametrize("sent, most", [(0, 60), (50_000, 60), (50_000, 4096)])
def test_fence_and_intervals_with_half_of_the_rows_on_one_key(spark, monkeypatch, sent, most):
    monkeypatch.setattr(order, "MOST_SENT", sent)  # 0: every join is salted
    r = random.Random(4)
    rows = [(0 if i % 2 else i % 40, r.gauss(800, 60) if i % 50 else 5000.0) for i in range(3000)] + [(99, -1.0), (98, None)]
    df = spark.createDataFrame(rows, "k int, rr double")
    q = df.where("rr >= 0").groupBy("k").agg(F.expr("percentile(rr, 0.25)").alias("a"), F.expr("percentile(rr, 0.75)").alias("b"))
    ok = (F.col("rr") >= 0) & ((F.col("a") == F.col("b")) | F.col("rr").between(F.col("a") - 3 * (F.col("b") - F.col("a")), F.col("b") + 3 * (F.col("b") - F.col("a"))))
    want = df.join(q, "k", "left").withColumn("fenced", F.when(ok, F.col("rr"))).select("k", "rr", "fenced")
    key = lambda d: sorted(map(tuple, d.select("k", "rr", "fenced").collect()), key=str)
    assert key(series.fence(df, ["k"], "rr")) == key(want)
    kept = {}
    for k, rr in ((x.k, x.rr) for x in series.clean_intervals(df, ["k"], most=most).collect()):
        kept.setdefault(k, []).append(rr)
    for k in {k for k, _ in rows}:
        own = np.array([v for j, v in rows if j == k and v is not None])
        inside = own[(own >= 300) & (own <= 2000)]
        if len(own) == 0 or len(inside) < 0.6 * len(own):
            inside = own[(own >= 250) & (own <= 2500)]
        if not len(inside):
            assert k not in kept
            continue
        far = np.abs(inside - np.median(inside))
        near = inside[far <= 3 * 1.4826 * np.median(far)]
        assert sorted(kept[k]) == pytest.approx(sorted(near if len(near) >= 10 else inside))


def test_trait_sets_are_families_of_their_own(spark):
    r = random.Random(6)
    rows = [(i, i % 3, *(r.gauss((i % 3) * s, 1) for s in (0.5, 0.3, 0.0, 0.2))) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, g int, a double, b double, c double, d double")
    sets = {"first": ["a", "b"], "second": ["b", "c", "d"], "none": []}
    got = inference.posthoc(df, "id", "g", sets, [], n_perm=60)
    assert [x.mode for x in got["global"].orderBy("mode").collect()] == ["first", "second"]
    for mode in ("first", "second"):
        apart = inference.posthoc(df, "id", "g", sets[mode], [], n_perm=60)
        same = {(x.feature, c): x[c] for x in apart["tests"].collect() for c in ("p", "p_holm")}
        assert {(x.feature, c): x[c] for x in got["tests"].where(F.col("mode") == mode).collect() for c in ("p", "p_holm")} == pytest.approx(same)
        pairs = {(x.feature, x.a, x.b): x.p_holm for x in apart["pairs"].collect()}
        assert {(x.feature, x.a, x.b): x.p_holm for x in got["pairs"].where(F.col("mode") == mode).collect()} == pytest.approx(pairs)
        assert got["global"].where(F.col("mode") == mode).first().p == apart["global"].first().p
    with pytest.raises(ValueError):
        inference.pairwise_shares(spark.range(1200).selectExpr("id as g", "1 as f"), "g", "f")
