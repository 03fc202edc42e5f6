"""Windows over ordered series: differences, moving averages with edges, gaps, buckets, quarters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def difference(value: Column, keys: list[str], order: list[str]) -> Column:
    return value - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))


def moving_average_edges(df: DataFrame, keys: list[str], order: list[str], value: str, width: int, out: str = "smooth") -> DataFrame:
    """Centred mean of `width` values, the series continued by its end values on either side."""
    w = Window.partitionBy(*keys).orderBy(*order)
    left, right = width // 2, width - width // 2 - 1
    frame = w.rowsBetween(-left, right)
    whole = Window.partitionBy(*keys)
    place, n = F.row_number().over(w), F.count(F.lit(1)).over(whole)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    short = F.greatest(F.lit(left) - (place - 1), F.lit(0)) * first + F.greatest(F.lit(right) - (n - place), F.lit(0)) * last
    return df.withColumn(out, (F.sum(value).over(frame) + short) / width)


def rolling_mean_filled(df: DataFrame, keys: list[str], order: list[str], value: str, width: int, out: str = "smooth") -> DataFrame:
    """Centred mean where the whole window exists; the rest takes the next mean, or else the last."""
    w = Window.partitionBy(*keys).orderBy(*order)
    frame = w.rowsBetween(-(width // 2), width - width // 2 - 1)
    df = df.withColumn("_mean", F.when(F.count(value).over(frame) == width, F.avg(value).over(frame)))
    after = F.first("_mean", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    before = F.last("_mean", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.coalesce(after, before)).drop("_mean")


def interpolated(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "filled") -> DataFrame:
    """Gaps filled on the line between their neighbours by position; at the ends by the nearest value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_i", F.row_number().over(w))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v")))
    df = df.withColumn("_b", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_a", F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col("_i") - F.col("_b.i")) / (F.col("_a.i") - F.col("_b.i"))
    return df.withColumn(out, F.coalesce(F.col(value), line, F.col("_b.v"), F.col("_a.v"))).drop("_i", "_b", "_a")


def quarter_means(df: DataFrame, keys: list[str], order: list[str], value: str, parts: int = 4) -> DataFrame:
    """Means of `parts` consecutive runs, the first ones longer by one where it doesn't divide; null for series with fewer rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("quarter", F.ntile(parts).over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return df.groupBy(*keys, "quarter").agg(F.when(F.max("_n") >= parts, F.avg(value)).alias("mean_value"), F.count(F.lit(1)).alias("n"))


def minute_grid(df: DataFrame, keys: list[str], second: Column, value: str, minutes: int = 20) -> DataFrame:
    """Mean and count for each minute 1..minutes of each series, also of minutes without rows."""
    minute = (F.floor(second / 60) + 1).cast("int")
    got = df.withColumn("minute", minute).where(F.col("minute").between(1, minutes)).groupBy(*keys, "minute").agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))
    grid = df.select(*keys).distinct().withColumn("minute", F.explode(F.sequence(F.lit(1), F.lit(minutes))))
    return grid.join(got, [*keys, "minute"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def within_group_z(value: Column, keys: list[str]) -> Column:
    """(value - mean) / population deviation in the group; 0 if that is 0."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    return F.when(sd == 0, 0.0).otherwise((value - F.avg(value).over(w)) / F.when(sd > 0, sd))


def clean_intervals(df: DataFrame, keys: list[str], value: str = "rr", most: int = 4096) -> DataFrame:
    """Intervals (ms) in 300..2000, or in 250..2500 where fewer than 60 % are; then within three scaled median deviations, unless that leaves fewer than ten.

    Groups of at most `most` rows give their limits in one aggregate, larger ones by refined histograms, and rows of a key are dealt over
    salts, so a key may hold most rows.
    """
    from .order import beside_groups, cut

    x = F.col(value)
    wide = F.when(F.col("_share") >= 0.6, x.between(300, 2000)).otherwise(x.between(250, 2500))
    share = F.avg(F.when(x.between(300, 2000), 1.0).otherwise(0.0)).alias("_share")
    large = cut(df.groupBy(*keys).agg(share, F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).drop("_n"))
    some = not large.isEmpty()
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    small = beside_groups(df, large.select(*keys), keys, x, "left_anti") if some else df
    held = small.groupBy(*keys).agg(share, F.sort_array(F.collect_list(x)).alias("_all"))  # `most` values at most
    usual = F.col("_share") >= 0.6
    held = held.withColumn("_all", F.filter("_all", lambda v: F.when(usual, v.between(300, 2000)).otherwise(v.between(250, 2500)))).withColumn("_med", middle(F.col("_all")))
    held = held.withColumn("_all", F.sort_array(F.transform("_all", lambda v: F.abs(v - F.col("_med"))))).withColumn("_limit", 3 * 1.4826 * middle(F.col("_all")))
    limits = held.withColumn("_n", F.size(F.filter("_all", lambda d: d <= F.col("_limit")))).select(*keys, "_share", "_med", "_limit", "_n")
    if some:
        limits = limits.unionByName(_interval_limits(df, keys, value, large, wide))
    return beside_groups(df, limits, keys, x).where(wide & ((F.abs(x - F.col("_med")) <= F.col("_limit")) | (F.col("_n") < 10))).drop("_share", "_med", "_limit", "_n")


def _interval_limits(df: DataFrame, keys: list[str], value: str, groups: DataFrame, wide: Column) -> DataFrame:
    """(keys, _share, _med, _limit, _n) of clean_intervals() for groups of any size."""
    from .order import beside_groups, cut, group_quantiles, large_groups

    x = F.col(value)
    rows = cut(beside_groups(df.select(*keys, value), groups, keys, x).where(wide))
    large = large_groups(rows, keys, value)
    middle = group_quantiles(rows, keys, value, [0.5], large=large).select(*keys, F.col("at").alias("_med"))
    far = beside_groups(rows, middle, keys, x).withColumn("_far", F.abs(x - F.col("_med")))
    limit = group_quantiles(far, keys, "_far", [0.5], large=large).select(*keys, (3 * 1.4826 * F.col("at")).alias("_limit"))
    far = beside_groups(far, limit, keys, x)
    return far.groupBy(*keys, "_share", "_med", "_limit").agg(F.sum((F.col("_far") <= F.col("_limit")).cast("int")).alias("_n"))


def fence(df: DataFrame, keys: list[str], value: str, times: float = 3.0, out: str = "fenced") -> DataFrame:
    """Null for negative values and those beyond `times` interquartile ranges from the quartiles of what remains (no limits where that range is 0).

    Quartiles come from refined histograms and rows of a key are dealt over salts, so a key may hold most rows.
    """
    from .order import beside_groups, group_quantiles

    at = lambda q: F.max(F.when(F.col("q") == q, F.col("at")))
    q = group_quantiles(df.where(F.col(value) >= 0), keys, value, [0.25, 0.75]).groupBy(*keys).agg(at(0.25).alias("_q1"), at(0.75).alias("_q3"))
    iqr = F.col("_q3") - F.col("_q1")
    ok = (F.col(value) >= 0) & ((iqr == 0) | F.col(value).between(F.col("_q1") - times * iqr, F.col("_q3") + times * iqr))
    return beside_groups(df, q, keys, F.col(value), "left").withColumn(out, F.when(ok, F.col(value))).drop("_q1", "_q3")


def variability(df: DataFrame, keys: list[str], order: list[str], value: str = "rr") -> DataFrame:
    """Rate, mean, SDNN, RMSSD and pNN50 of intervals in ms; null for fewer than five."""
    d = difference(F.col(value), keys, order)
    out = df.withColumn("_d", d).groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean_rr"), F.stddev_pop(value).alias("sdnn"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmssd"), (100 * F.avg(F.when(F.abs("_d") > 50, 1.0).when(F.col("_d").isNotNull(), 0.0))).alias("pnn50"))
    out = out.withColumn("hr", 60000 / F.col("mean_rr"))
    return out.select(*keys, "n", *(F.when(F.col("n") >= 5, F.col(c)).alias(c) for c in ("hr", "mean_rr", "sdnn", "rmssd", "pnn50")))


def sampling_rate(df: DataFrame, keys: list[str], time: str = "t_sec", default: float | None = None) -> DataFrame:
    """round(1 / mean step); `default` where a series has no step."""
    rate = F.when((F.count(time) > 1) & (F.max(time) > F.min(time)), F.round((F.count(time) - 1) / (F.max(time) - F.min(time))))
    return df.groupBy(*keys).agg((F.coalesce(rate, F.lit(default)) if default is not None else rate).alias("fs"))


def running_share(value: Column, keys: list[str], order: list) -> Column:
    w = Window.partitionBy(*keys)
    return F.sum(value).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(value).over(w)


def group_z(df: DataFrame, value: str, keys: list[str], out: str = "z") -> DataFrame:
    """df with the population z-score of value inside its group of keys, 0 without spread; by one aggregate, so that large groups are no single task's work."""
    at = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.when(F.col("_s") == 0, 0.0).otherwise((F.col(value) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")))
    return df.join(at, keys).withColumn(out, z).drop("_m", "_s")
