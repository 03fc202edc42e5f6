"""The same features over streams of (subject, env, ts, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minute_features(stream: DataFrame, keys: list[str], time: str = "ts", value: str = "value", late: str = "10 minutes", length: str = "1 minute") -> DataFrame:
    """Count, mean and deviation of each tumbling window; rows later than the watermark are dropped, a window is given out once it closes."""
    got = stream.withWatermark(time, late).groupBy(*keys, F.window(time, length).alias("w")).agg(F.count(value).alias("n"), F.avg(value).alias("mean_value"), F.stddev_pop(value).alias("sd"))
    return got.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_value", "sd")


def sessions(stream: DataFrame, keys: list[str], gap: str, time: str = "ts", value: str = "value", late: str = "10 minutes") -> DataFrame:
    """Count and mean of each run of rows without a pause of `gap`."""
    got = stream.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count(value).alias("n"), F.avg(value).alias("mean_value"))
    return got.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_value")


def running_gaps(stream: DataFrame, key: str, time: str = "ts"):
    """(key, ts, gap_s): seconds since the subject's last row, kept as state across micro-batches. Rows older than the last one give no gap."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = dict(stream.dtypes)[key]

    def step(k, frames, state):
        last = state.get[0] if state.exists else None
        ts = pd.concat([f[time] for f in frames]).sort_values()
        gaps = []
        for t in ts:
            now = t.timestamp()
            gaps.append(now - last if last is not None and now >= last else None)
            last = now if last is None else max(last, now)
        state.update((last,))
        yield pd.DataFrame({key: k[0], "ts": ts.to_numpy(), "gap_s": gaps})

    return stream.select(key, F.col(time).cast("timestamp").alias(time)).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, gap_s double", "last double", "append", GroupStateTimeout.NoTimeout)
