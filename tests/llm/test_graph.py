"""Components as a plain union of links, in few jobs: the driver keeps something of every job."""

import random

from pyspark.sql import functions as F

from phasegrid.llm import graph


def plain(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    return {x: top(x) for x in list(up)}


def test_components_of_chains_stars_and_noise_in_few_jobs(spark):
    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 400)] + [(1000, 1000 + i) for i in range(1, 300)] + [(r.randrange(2000, 2600), r.randrange(2000, 2600)) for _ in range(280)] + [(5, 5), (-7, 3000)]
    pairs = [p if r.random() < 0.5 else p[::-1] for p in pairs]
    r.shuffle(pairs)
    want = plain([p for p in pairs if p[0] != p[1]])
    links = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    at = jobs()
    found = graph.components(links)
    assert jobs() - at < 70  # rounds of stars alone take more
    got = [(x["node"], x["root"]) for x in found.collect()]
    assert len(got) == len(set(got)) and dict(got) == want
    assert graph.components(links.limit(0)).collect() == []
    assert {(x["node"], x["root"]) for x in graph.components(links.where(F.col("a") == -7)).collect()} <= {(3000, -7), (-7, -7)}
