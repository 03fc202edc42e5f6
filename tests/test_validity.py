import itertools
import random

import numpy as np
import pytest

from phasegrid.operators import validity


def plain_silhouette(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        own = (c == c[i]) & (np.arange(len(x)) != i)
        foreign = [d[i, c == k].mean() for k in set(c.tolist()) - {c[i]}]
        if foreign:
            a, b = (d[i, own].mean() if own.any() else None), min(foreign)
            out.append(0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
    return np.mean(out) if out else None


@pytest.mark.parametrize("block", [4, 512])
def test_silhouette_equals_all_pairs_for_several_runs(spark, block):
    g = np.random.default_rng(2)
    rows, want = [], {}
    for run, (n, k, gap) in enumerate([(90, 5, 6.0), (60, 3, 0.5), (40, 1, 1.0), (12, 12, 1.0), (30, 2, 0.0)]):
        c = np.arange(n) % k
        x = np.round(g.standard_normal((n, 3)) * (gap > 0) + gap * c[:, None], 2)
        want[run] = plain_silhouette(x, c)
        rows += [(run, i, int(c[i]), x[i].tolist(), 7) for i in range(n)]
    df = spark.createDataFrame(rows, "run int, id int, cluster int, x array<double>, size int")
    got = {r.run: r.silhouette for r in validity.silhouette(df, "id", ["run"], block).collect()}
    assert got.keys() == want.keys()
    for run, v in want.items():
        assert got[run] == (None if v is None else pytest.approx(v, abs=1e-9))
    one = validity.silhouette(df.where("run = 0"), "id", block=block).first()
    assert one.silhouette == pytest.approx(want[0], abs=1e-9) and one.n == 90


def test_most_foreign_clusters_are_never_compared(spark):
    g = np.random.default_rng(3)
    rows = [(i, i % 20, (1e5 + g.standard_normal(2) + 50 * np.array([i % 20 // 5, i % 5])).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, cluster int, x array<double>")
    asks, _ = validity.rivals(df.withColumnRenamed("id", "_k"), [], 512)
    assert asks.where("_own").count() == 400 and asks.count() < 4 * 400  # of 20 clusters
    x, c = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    assert validity.silhouette(df, "id").first().silhouette == pytest.approx(plain_silhouette(x, c), abs=1e-9)


def plain_ari(a, b):
    two = lambda n: n * (n - 1) / 2
    cells = {}
    for x, y in zip(a, b):
        cells[x, y] = cells.get((x, y), 0) + 1
    c, r, q = sum(map(two, cells.values())), sum(two(a.count(x)) for x in set(a)), sum(two(b.count(y)) for y in set(b))
    e, top = r * q / two(len(a)), (r + q) / 2
    return 1.0 if e == top else (c - e) / (top - e)


def test_agreement_of_runs_without_a_join_of_runs(spark):
    r = random.Random(4)
    labels = {(g, run): {i: r.randrange(2 + run % 3) for i in range(60) if r.random() < 0.8} for g in ("p", "q") for run in range(5)}
    rows = [(g, run, i, c) for (g, run), v in labels.items() for i, c in v.items()] + [("p", 0, 1000, None)]
    df = spark.createDataFrame(rows, "key string, run int, id int, cluster int").repartition(7)
    pairs = validity.run_agreement(df, "id", 1, ["key"])
    got = {(x.key, x.run_a, x.run_b): (x.ari, x.n) for x in pairs.collect()}
    for g in ("p", "q"):
        for a, b in itertools.combinations(range(5), 2):
            both = sorted(labels[g, a].keys() & labels[g, b].keys())
            ari, n = got.pop((g, a, b))
            assert n == len(both) and ari == pytest.approx(plain_ari([labels[g, a][i] for i in both], [labels[g, b][i] for i in both]))
    assert not got
    alone = validity.run_agreement(df.where("key = 'p'").drop("key"), "id", 1).collect()
    assert len(alone) == 10
    assert validity.run_agreement(df.limit(0), "id", 1, ["key"]).collect() == []
