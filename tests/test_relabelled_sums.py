"""Sums of relabelled groups, without a row for each run, are those of the rows dealt out."""

import pytest
from pyspark.sql import functions as F

from phasegrid.operators import inference


def test_sums_equal_those_of_rows_dealt_out(spark):
    df = spark.range(-20, 300).select((F.col("id") * 7919).alias("id"), F.pmod("id", F.lit(3)).alias("g"), F.sin("id").alias("a")).repartition(3)
    names = [r["g"] for r in df.select("g").distinct().orderBy("g").collect()]
    want = {(r["_run"], names.index(r["_g"])): (r["n"], r["a"]) for f in inference._relabelled(df, "id", "g", ["a"], 25, 7, batch=20, bits=3) for r in f.groupBy("_run", "_g").agg(F.count("*").alias("n"), F.sum("a").alias("a")).collect()}
    got = {}
    for at, f in enumerate(inference._relabelled_sums(df, "id", "g", ["a"], 25, 7, batch=20, bits=3)):
        got |= {(20 * at + r["_run"], r["_g"]): (r["n"], r["a"]) for r in f.collect()}
    assert len(want) == 75 and got.keys() == want.keys()
    assert all(got[k] == (want[k][0], pytest.approx(want[k][1])) for k in want)
