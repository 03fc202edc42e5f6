"""Recordings of the queries are bounded segments, and no event is left out."""

from pyspark.sql import functions as F

from phasegrid.plans import catalogue


def test_every_segment_is_measured(spark):
    events = spark.range(5000).select(F.col("id").alias("event_id"), F.lit(7).alias("user_id"), F.timestamp_seconds(F.col("id") * 3).alias("ts"), (F.sin(F.col("id") / 9.0) * 5 + F.col("id") % 13).alias("value"))
    t = lambda name: events
    segments = catalogue.recordings(t).groupBy("subject", "segment").count().orderBy("segment").collect()
    assert [r["count"] for r in segments] == [2400, 2400, 200]
    for query in (catalogue.signal_quality, catalogue.skin_measures, catalogue.interval_spectrum):
        got = query(t).toPandas()
        assert len(got) >= 3 and got["segment"].nunique() == len(got)
    resampled = catalogue.fourier_resample(t).groupBy("segment").count().orderBy("segment").collect()
    assert [r["count"] for r in resampled] == [600, 600, 50]
