"""Global order without one big task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, kept in the shared checkpoint folder of the session (a temporary one only where none is set)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def positions(df: DataFrame, by: list, out: str = "position") -> DataFrame:
    """df with the 1-based place of each row in the order of `by`: ranges are sorted side by side, only one count for each reaches the driver."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    kept = cut(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(out, F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(F.col(out), 33)
    counts = dict(kept.groupBy(part.alias("_p")).agg(F.count(F.lit(1))).collect())
    before, total = [], 0
    for p in range(max(counts, default=0) + 1):
        before.append(total)
        total += counts.get(p, 0)
    starts = F.array(*(F.lit(x).cast("long") for x in before))
    return kept.withColumn(out, F.element_at(starts, (part + 1).cast("int")) + F.col(out).bitwiseAND((1 << 33) - 1) + 1)


def global_rank(df: DataFrame, column: str, out: str, descending: bool = False, fill: bool = True) -> DataFrame:
    """Least rank of ties over all rows; nulls come last and are unranked, or with fill take the worst rank given."""
    value = F.col(column)
    ranks = positions(df.where(value.isNotNull()).groupBy(value.alias("_v")).agg(F.count(F.lit(1)).alias("_c")), [F.desc("_v") if descending else F.asc("_v")], "_i")
    ranks = running_sum(ranks, "_i", "_c", "_before")
    ranks = cut(ranks.select("_v", (F.col("_before") - F.col("_c") + 1).alias(out)))
    joined = df.join(ranks, value == F.col("_v"), "left").drop("_v")
    if not fill:
        return joined
    worst = ranks.agg(F.max(out)).first()[0]
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(worst).cast("long")))


def running_sum(df: DataFrame, position: str, value: str, out: str, block: int = 4096, _depth: int = 0) -> DataFrame:
    """Sum of value up to each position: within blocks of positions by a window, before them by sums of blocks."""
    from pyspark.sql import Window

    own, total, upto, inside, base = (f"_{x}{_depth}" for x in ("block", "sum", "upto", "in", "base"))
    df = df.withColumn(own, F.floor((F.col(position) - 1) / block))
    sums = df.groupBy(own).agg(F.sum(value).alias(total))
    if sums.count() > block:
        sums = running_sum(sums.withColumn("_at", F.col(own) + 1), "_at", total, upto, block, _depth + 1)
    else:  # a bounded number of rows
        sums = sums.withColumn(upto, F.sum(total).over(Window.partitionBy(F.lit(0)).orderBy(own).rowsBetween(Window.unboundedPreceding, 0)))
    here = F.sum(value).over(Window.partitionBy(own).orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(inside, here).join(sums.select(own, (F.col(upto) - F.col(total)).alias(base)), own).withColumn(out, F.col(base) + F.col(inside)).drop(own, inside, base)


def places_in_group(df: DataFrame, keys: list[str], by: list, out: str = "place") -> DataFrame:
    """df with the 1-based place of each row inside its group of keys, in the order of `by`; a group may hold most rows."""
    placed = positions(df, [*keys, *by], "_at")
    first = placed.groupBy(*keys).agg(F.min("_at").alias("_first"))
    return placed.join(first, keys).withColumn(out, F.col("_at") - F.col("_first") + 1).drop("_at", "_first")


def quantiles(df: DataFrame, value: str, shares: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, q, at): exact quantiles by linear interpolation, from places in the global order, so that no task holds a group's values. Groups of no value are missing."""
    keys = keys or []
    placed = positions(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), [*keys, "_v"], "_at")
    of = placed.groupBy(*keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).withColumn("q", F.explode(F.array(*(F.lit(float(x)) for x in shares))))
    place = (F.col("_n") - 1) * F.col("q")
    ends = F.explode(F.array(F.struct((F.col("_first") + F.floor(place)).alias("at"), (1 - (place - F.floor(place))).alias("w")), F.struct((F.col("_first") + F.ceil(place)).alias("at"), (place - F.floor(place)).alias("w")))).alias("_e")
    asked = of.where("_n > 0").select(*keys, "q", ends).select(*(F.col(k).alias(f"_k_{k}") for k in keys), "q", F.col("_e.at").alias("_at"), F.col("_e.w").alias("_w"))
    got = placed.select("_at", "_v").join(asked, "_at").groupBy(*(f"_k_{k}" for k in keys), "q").agg(F.sum(F.when(F.col("_w") > 0, F.col("_v") * F.col("_w")).otherwise(0.0)).alias("at"))
    return got.select(*(F.col(f"_k_{k}").alias(k) for k in keys), "q", "at")


#: Rows of a group table, at most, that are sent to every task.
MOST_SENT = 50_000


def beside_groups(df: DataFrame, groups: DataFrame, keys: list[str], spread_by, how: str = "inner", salts: int = 32) -> DataFrame:
    """df joined with a table of groups on keys (null equals null). Up to MOST_SENT groups, which are counted, go to every task; beyond that the rows of a group are dealt over salts by `spread_by`, and its rows in `groups` copied to each."""
    groups = cut(groups)
    if groups.limit(MOST_SENT + 1).count() <= MOST_SENT:
        right = groups.select(*(F.col(k).alias(f"_g_{k}") for k in keys), *(c for c in groups.columns if c not in keys))
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
        return df.join(F.broadcast(right), on, how).drop(*(f"_g_{k}" for k in keys))
    left = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    right = groups.select(*(F.col(k).alias(f"_g_{k}") for k in keys), *(c for c in groups.columns if c not in keys), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_g_salt"))
    on = F.col("_salt") == F.col("_g_salt")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    return left.join(right, on, how).drop("_salt", "_g_salt", *(f"_g_{k}" for k in keys))


def _numbers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(*keys, v.alias("_v"))


def large_groups(df: DataFrame, keys: list[str], value: str, most: int = 4096) -> DataFrame:
    """(keys, _n): the groups of more than `most` finite values, kept in the checkpoint folder."""
    return cut(_numbers(df, keys, value).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most))


def group_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], buckets: int = 1024, most: int = 4096, large: DataFrame | None = None) -> DataFrame:
    """(keys, q, at): exact quantiles of each group by linear interpolation, without more than `most` of a group's values in one task.

    Groups of at most `most` values are one aggregate. In larger ones (large_groups(), if the caller has them) counts of equally wide buckets
    between the extremes show which bucket holds a place; only that bucket is divided again, until it holds one value or at most `most`
    rows. Nulls, NaN and infinities take no part; groups of no value are missing; a null key is a group.
    """
    rows = _numbers(df, keys, value)
    large = large_groups(df, keys, value, most) if large is None else large
    some = not large.isEmpty()
    small = beside_groups(rows, large.select(*keys), keys, F.col("_v"), "left_anti") if some else rows
    wanted = F.percentile("_v", [float(s) for s in shares])
    pairs = F.explode(F.arrays_zip(F.array(*(F.lit(float(s)) for s in shares)).alias("q"), F.col("_at").alias("at"))).alias("_e")
    out = small.groupBy(*keys).agg(wanted.alias("_at")).select(*keys, pairs).select(*keys, F.col("_e.q").alias("q"), F.col("_e.at").alias("at"))
    return out.unionByName(_refined(beside_groups(rows, large.select(*keys), keys, F.col("_v")), keys, shares, buckets, most)) if some else out


def _refined(rows: DataFrame, keys: list[str], shares: list[float], buckets: int, most: int) -> DataFrame:
    """The part of group_quantiles() for large groups."""
    from pyspark.sql import Window

    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).withColumn("q", F.explode(F.array(*(F.lit(float(s)) for s in shares))))
    place = (F.col("_n") - 1) * F.col("q")
    both = F.explode(F.array(F.struct(F.floor(place).alias("r"), (1 - (place - F.floor(place))).alias("w")), F.struct(F.ceil(place).alias("r"), (place - F.floor(place)).alias("w")))).alias("_e")
    asked = cut(ends.select(*keys, "q", both, "_lo", "_hi", "_n").select(*keys, "q", "_e.r", "_e.w", "_lo", "_hi", "_n").where("w > 0 or r = floor((_n - 1) * q)"))
    state = asked.select(*keys, "r", "_lo", "_hi", F.col("_n").alias("_size"), F.lit(0).cast("long").alias("_before")).distinct()
    span = [*keys, "_lo", "_hi"]
    done = None
    while True:
        state = cut(state)
        settled = state.where(F.col("_lo") == F.col("_hi")).select(*keys, "r", F.col("_lo").alias("at"))
        small = state.where((F.col("_lo") < F.col("_hi")) & (F.col("_size") <= most))
        inside = beside_groups(rows, small.select(*span).distinct(), keys, F.col("_v")).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        held = inside.groupBy(*span).agg(F.sort_array(F.collect_list("_v")).alias("_all"))  # `most` values at most
        found = _null_safe(small, held, span).select(*keys, "r", F.element_at("_all", (F.col("r") - F.col("_before") + 1).cast("int")).alias("at"))
        done = settled.unionByName(found) if done is None else done.unionByName(settled).unionByName(found)
        large = state.where((F.col("_lo") < F.col("_hi")) & (F.col("_size") > most))
        if large.isEmpty():
            break
        near = beside_groups(rows, large.select(*span).distinct(), keys, F.col("_v")).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        bucket = F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * buckets), F.lit(buckets - 1))
        cells = near.groupBy(*span, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        upto = F.sum("_c").over(Window.partitionBy(*span).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))  # over `buckets` rows at most
        cells = cells.withColumn("_upto", upto)
        met = _null_safe(large, cells, span).where((F.col("r") >= F.col("_before") + F.col("_upto") - F.col("_c")) & (F.col("r") < F.col("_before") + F.col("_upto")))
        state = met.select(*keys, "r", F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), F.col("_c").alias("_size"), (F.col("_before") + F.col("_upto") - F.col("_c")).alias("_before"))
    got = _null_safe(asked, done.distinct(), [*keys, "r"])
    return got.groupBy(*keys, "q").agg(F.sum(F.col("at") * F.col("w")).alias("at"))


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys, null equal to null."""
    b = b.select(*(F.col(c).alias(f"_j_{c}") if c in keys else F.col(c) for c in b.columns))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_j_{k}"))
    return a.join(b, on).drop(*(f"_j_{k}" for k in keys))
