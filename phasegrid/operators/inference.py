"""Group comparisons from group moments, contingency tests and permutation tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dist import chi2_sf, f_sf, hypergeometric_two_sided, normal_sf, studentized_range_sf, t_sf2


def group_moments(df: DataFrame, group: str, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, group, n, mean, var) over known values."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & F.col(group).isNotNull()).groupBy(*(by or []), group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))


def welch(groups: DataFrame, by: list[str]) -> DataFrame:
    """(by, f, df1, df2): Welch's F of group_moments' rows; groups of one row or without variance are left out."""
    ok = groups.where("n > 1 and var > 0").withColumn("w", F.col("n") / F.col("var"))
    total = ok.groupBy(*by).agg(F.sum("w").alias("all_w"), (F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias("all_mean"), F.count(F.lit(1)).alias("k"))
    j = ok.join(total, by) if by else ok.crossJoin(F.broadcast(total))
    got = j.groupBy(*by, "k").agg(F.sum(F.col("w") * (F.col("mean") - F.col("all_mean")) ** 2).alias("s"), F.sum((1 - F.col("w") / F.col("all_w")) ** 2 / (F.col("n") - 1)).alias("t"))
    k = F.col("k")
    return got.where("k > 1").select(*by, (F.col("s") / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * F.col("t"))).alias("f"), (k - 1).alias("df1"), ((k * k - 1) / (3 * F.col("t"))).alias("df2"))


def eta_squared(groups: DataFrame, by: list[str]) -> DataFrame:
    """(by, eta2) of group_moments' rows."""
    n, m = F.col("n"), F.col("mean")
    between = F.sum(n * m * m) - F.sum(n * m) * F.sum(n * m) / F.sum(n)
    within = F.sum((n - 1) * F.coalesce("var", F.lit(0.0)))
    return groups.groupBy(*by).agg((between / (between + within)).alias("eta2"))


def games_howell(groups: DataFrame, group: str, by: list[str]) -> DataFrame:
    """(by, a, b, diff, q, df): pairs of groups; q is to be held against the studentised range."""
    ok = groups.where("n > 1 and var > 0")
    b = ok.select(*by, F.col(group).alias("b"), F.col("n").alias("nb"), F.col("mean").alias("mb"), F.col("var").alias("vb"))
    a = ok.withColumnRenamed(group, "a")
    pairs = (a.join(b, by) if by else a.join(b, F.lit(True))).where("a < b")
    sa, sb = F.col("var") / F.col("n"), F.col("vb") / F.col("nb")
    return pairs.select(*by, "a", "b", (F.col("mean") - F.col("mb")).alias("diff"), (F.abs(F.col("mean") - F.col("mb")) / F.sqrt((sa + sb) / 2)).alias("q"), ((sa + sb) ** 2 / (sa**2 / (F.col("n") - 1) + sb**2 / (F.col("nb") - 1))).alias("df"))


def pseudo_f(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(f, n, k): between over within sums of squares of all columns together."""
    from .rank import long_features

    cell = long_features(df.where(F.col(group).isNotNull()).dropna(subset=columns), [group], columns).groupBy("feature", group).agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q"), F.count(F.lit(1)).alias("n"))
    dim = cell.groupBy("feature").agg((F.sum(F.col("s") ** 2 / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")).alias("b"), (F.sum("q") - F.sum(F.col("s") ** 2 / F.col("n"))).alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    return dim.agg(F.sum("b").alias("b"), F.sum("w").alias("w"), F.max("n").alias("n"), F.max("k").alias("k")).select(((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("f"), "n", "k")


def contingency(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by, a, b, n) with the empty cells, and the margins."""
    by = by or []
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cell = known.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    rows = cell.groupBy(*by, a).agg(F.sum("n").alias("n_row"))
    cols = cell.groupBy(*by, b).agg(F.sum("n").alias("n_col"))
    total = cell.groupBy(*by).agg(F.sum("n").alias("n_all"), F.count_distinct(a).alias("k_row"), F.count_distinct(b).alias("k_col"))
    grid = rows.join(cols, by).join(total, by) if by else rows.join(cols, F.lit(True)).join(total, F.lit(True))
    return grid.join(cell, [*by, a, b], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def chi_square(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, chi2, df, least_expected): of contingency's rows; a table of two by two is corrected for continuity."""
    expected = F.col("n_row") * F.col("n_col") / F.col("n_all")
    gap = F.abs(F.col("n") - expected)
    df_ = (F.col("k_row") - 1) * (F.col("k_col") - 1)
    gap = F.when(df_ == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    return table.groupBy(*(by or [])).agg(F.sum(gap * gap / expected).alias("chi2"), F.max(df_).alias("df"), F.min(expected).alias("least_expected"))


def two_proportions(n1: Column, x1: Column, n2: Column, x2: Column) -> Column:
    """Pooled z of two shares."""
    p = (x1 + x2) / (n1 + n2)
    return (x1 / n1 - x2 / n2) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))


def pairwise_shares(df: DataFrame, group: str, flag: str) -> list[dict]:
    """For each pair of groups: Fisher's exact p where an expected count is below 5, else the z test. A few groups' counts reach the driver."""
    rows = df.where(F.col(flag).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(flag).alias("x")).orderBy(group).limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups: use binary_tests")
    out = []
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            n, x = a["n"] + b["n"], a["x"] + b["x"]
            least = min(a["n"], b["n"]) * min(x, n - x) / n
            if least < 5:
                p, test = hypergeometric_two_sided(int(a["x"]), int(a["n"] - a["x"]), int(b["x"]), int(b["n"] - b["x"])), "fisher"
            else:
                s = x / n
                p, test = 2 * normal_sf(abs(a["x"] / a["n"] - b["x"] / b["n"]) / math.sqrt(s * (1 - s) * (1 / a["n"] + 1 / b["n"]))), "z"
            out.append({"a": a[group], "b": b[group], "test": test, "p": p})
    return out


MOST_GROUPS = 1000


def _relabelled(df: DataFrame, key: str, group: str, columns: list[str], n_perm: int, seed: int, batch: int = 500, bits: int = 10) -> Iterator[DataFrame]:
    """Batches of (_run, _g, columns), the labels of df dealt out anew in each run. key is unique; more than MOST_GROUPS groups raise.

    Permutation r ranks the rows by hash(seed, r, key) and gives the first n_1 places the first label, the next n_2 the second, and so on. Only
    the hashes at the borders are looked up, in the one of 2**bits buckets that holds each, so nothing is sorted or joined row by row.
    """
    from pyspark.sql import Window

    from .order import cut

    rows = cut(df.select(key, *columns))
    sizes = df.groupBy(group).count().orderBy(group).limit(MOST_GROUPS + 1).collect()
    if len(sizes) > MOST_GROUPS:
        raise ValueError(f"{group} has more than {MOST_GROUPS} groups")
    borders, at = [], 0
    for r in sizes[:-1]:
        at += r["count"]
        borders.append(at)
    names = F.array(*(F.lit(r[group]) for r in sizes))
    for first in range(0, n_perm, batch):
        runs = df.sparkSession.range(first, min(first + batch, n_perm)).select(F.col("id").alias("_run"))
        mixed = rows.join(F.broadcast(runs), F.lit(True)).withColumn("_h", F.xxhash64(F.lit(seed), "_run", key))
        if not borders:
            yield mixed.withColumn("_g", F.element_at(names, 1)).drop("_h", key)
            continue
        mixed = mixed.withColumn("_b", F.shiftright("_h", 64 - bits))
        upto = mixed.groupBy("_run", "_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_u", F.sum("_c").over(Window.partitionBy("_run").orderBy("_b")))
        wanted = F.explode(F.filter(F.array(*(F.lit(x).cast("long") for x in borders)), lambda t: (t > F.col("_u") - F.col("_c")) & (t <= F.col("_u")))).alias("_t")
        wanted = upto.select("_run", "_b", (F.col("_u") - F.col("_c")).alias("_before"), wanted)  # batch * groups rows at most
        place = F.row_number().over(Window.partitionBy("_run", "_t").orderBy("_h")) + F.col("_before")
        limits = mixed.select("_run", "_b", "_h").join(F.broadcast(wanted), ["_run", "_b"]).withColumn("_i", place).where("_i = _t").groupBy("_run").agg(F.collect_list("_h").alias("_limits"))
        dealt = mixed.join(F.broadcast(cut(limits)), "_run")
        yield dealt.withColumn("_g", F.element_at(names, F.size(F.filter("_limits", lambda x: x < F.col("_h"))) + 1)).drop("_h", "_b", "_limits", key)


def _hash_long(key: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs after columns whose hash is the seed."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    h = (seed + p5 + np.uint64(8)) ^ (turn(key * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _relabelled_sums(rows: DataFrame, key: str, group: str, columns: list[str], n_perm: int, seed: int, batch: int = 500, bits: int = 10) -> Iterator[DataFrame]:
    """Batches of (_run, _g, n, columns): sizes and sums of the groups that _relabelled() deals out, for a key of type long.

    Tasks hash their rows for one run after another and send counts, the hashes at the borders, and sums; no row is copied for each run.
    """
    import pyarrow as pa
    from pyspark.sql import Window

    from .order import cut

    spark = rows.sparkSession
    sizes = rows.groupBy(group).count().orderBy(group).limit(MOST_GROUPS + 1).collect()
    if len(sizes) > MOST_GROUPS:
        raise ValueError(f"{group} has more than {MOST_GROUPS} groups")
    borders = np.cumsum([r["count"] for r in sizes[:-1]]).astype(np.int64)
    own = rows.select(F.col(key).alias("_k"), *columns)
    for first in range(0, n_perm, batch):
        seeds = [(r["id"], r["s"]) for r in spark.range(first, min(first + batch, n_perm)).select("id", F.xxhash64(F.lit(seed), "id").alias("s")).collect()]
        start = np.array([s for _, s in seeds], np.int64).view(np.uint64)

        def hashes(batches, start=start):
            for part in batches:
                k = np.asarray(part.column("_k")).astype(np.int64).view(np.uint64)
                for i, s in enumerate(start):
                    yield part, i, _hash_long(k, s)

        def count(batches):
            total = np.zeros((len(start), 1 << bits), np.int64)
            for _, i, h in hashes(batches):
                total[i] += np.bincount((h >> (64 - bits)) + (1 << (bits - 1)), minlength=1 << bits)
            i, b = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(b), pa.array(total[i, b])], names=["i", "b", "c"])

        limits = np.zeros((len(start), 0), np.int64)
        if len(borders):
            upto = own.select("_k").mapInArrow(count, "i long, b long, c long").groupBy("i", "b").agg(F.sum("c").alias("c")).withColumn("u", F.sum("c").over(Window.partitionBy("i").orderBy("b")))
            wanted = F.explode(F.filter(F.array(*(F.lit(int(x)).cast("long") for x in borders)), lambda t: (t > F.col("u") - F.col("c")) & (t <= F.col("u")))).alias("t")
            asked = upto.select("i", "b", (F.col("u") - F.col("c")).alias("before"), wanted).collect()  # batch * groups rows at most
            buckets: dict[int, set] = {}
            for r in asked:
                buckets.setdefault(r["i"], set()).add(r["b"])

            def near(batches):
                for _, i, h in hashes(batches):
                    b = (h >> (64 - bits)) + (1 << (bits - 1))
                    at = np.flatnonzero(np.isin(b, list(buckets.get(i, ()))))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(b[at]), pa.array(h[at])], names=["i", "b", "h"])

            told = spark.createDataFrame([(r["i"], r["b"], r["before"], r["t"]) for r in asked], "i long, b long, before long, t long")
            place = F.row_number().over(Window.partitionBy("i", "t").orderBy("h")) + F.col("before")
            found = own.select("_k").mapInArrow(near, "i long, b long, h long").join(F.broadcast(told), ["i", "b"]).withColumn("p", place).where("p = t").select("i", "t", "h").collect()
            limits = np.zeros((len(start), len(borders)), np.int64)
            for r in found:
                limits[r["i"], int(np.searchsorted(borders, r["t"]))] = r["h"]

        def add(batches, limits=limits):
            total = np.zeros((len(start), len(sizes), 1 + len(columns)))
            for part, i, h in hashes(batches):
                g = np.searchsorted(limits[i], h, "left")
                for c, w in enumerate((None, *(np.asarray(part.column(n), float) for n in columns))):
                    total[i, :, c] += np.bincount(g, w, len(sizes))
            i, g = np.nonzero(total[:, :, 0])
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(g), *(pa.array(total[i, g, c]) for c in range(1 + len(columns)))], names=["_run", "_g", "n", *columns])

        shape = ", ".join(["_run long, _g long, n double", *(f"`{c}` double" for c in columns)])
        yield own.mapInArrow(add, shape).groupBy("_run", "_g").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns))


def permutation_profile(df: DataFrame, key: str, group: str, columns: list[str], n_perm: int = 999, seed: int = 42) -> dict:
    """(observed pseudo-F, p): p = (number of relabellings at least as high + 1) / (n_perm + 1). Null below five rows.

    Each permutation is a share of one distributed aggregate, in batches; only counts come back.
    """
    from .order import cut

    rows = cut(df.where(F.col(group).isNotNull()).dropna(subset=columns).select(key, group, *(F.col(c).cast("double").alias(c) for c in columns)))
    n = rows.count()
    if n < 5:
        return {"f": None, "p": None, "n": n}
    observed = pseudo_f(rows, group, columns).first()["f"]
    total = rows.agg(sum((F.sum(F.col(c) ** 2) for c in columns), F.lit(0.0)), sum((F.sum(c) ** 2 / F.count(F.lit(1)) for c in columns), F.lit(0.0))).first()
    at_least = 0
    if dict(rows.dtypes)[key] == "bigint":
        cells = _relabelled_sums(rows, key, group, columns, n_perm, seed)
    else:
        cells = (mixed.groupBy("_run", "_g").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in columns)) for mixed in _relabelled(rows, key, group, columns, n_perm, seed))
    for cell in cells:
        between = cell.groupBy("_run").agg(F.sum(sum((F.col(c) ** 2 for c in columns), F.lit(0.0)) / F.col("n")).alias("b"), F.count(F.lit(1)).alias("k"))
        f = ((F.col("b") - total[1]) / (F.col("k") - 1)) / ((total[0] - F.col("b")) / (n - F.col("k")))
        at_least += between.where(f >= observed * (1 - 1e-12)).count()
    return {"f": observed, "p": (at_least + 1) / (n_perm + 1), "n": n}


def summed_chi2(df: DataFrame, group: str, axes: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, chi2): sum over 0/1 axes of chi-square against the group, over rows where the axis is known.

    Axes of one level or one group add nothing; two groups are corrected for continuity.
    """
    by = by or []
    cell = df.groupBy(*by, group).agg(*(F.count(a).alias(f"n_{i}") for i, a in enumerate(axes)), *(F.sum(F.col(a).cast("double")).alias(f"x_{i}") for i, a in enumerate(axes)))
    rows = cell.select(*by, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"n_{i}").alias("n"), F.col(f"x_{i}").alias("x")) for i in range(len(axes))))).alias("_c")).select(*by, "_c.*").where("n > 0")
    whole = rows.groupBy(*by, "i").agg(F.sum("n").alias("all_n"), F.sum("x").alias("all_x"), F.count(F.lit(1)).alias("groups"))
    share, n = F.col("all_x") / F.col("all_n"), F.col("n")
    gap = F.abs(F.col("x") - n * share)
    gap = F.when(F.col("groups") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    each = rows.join(whole, [*by, "i"]).where("groups > 1 and all_x > 0 and all_x < all_n").groupBy(*by).agg(F.sum(gap * gap / (n * share) + gap * gap / (n * (1 - share))).alias("chi2"))
    return df.select(*by).distinct().join(each, by, "left").withColumn("chi2", F.coalesce("chi2", F.lit(0.0))) if by else each.select(F.coalesce("chi2", F.lit(0.0)).alias("chi2"))


def binary_permutation(df: DataFrame, key: str, group: str, axes: list[str], n_perm: int = 5000, seed: int = 42) -> dict:
    """(n, chi2, p) of the summed chi-square of 0/1 axes: p = (number of relabellings at least as high + 1) / (n_perm + 1)."""
    from .order import cut

    rows = cut(df.where(F.col(group).isNotNull()).select(key, group, *axes))
    observed = (summed_chi2(rows, group, axes).first() or {"chi2": 0.0})["chi2"]
    at_least = sum(summed_chi2(mixed, "_g", axes, ["_run"]).where(F.col("chi2") >= observed - 1e-9).count() for mixed in _relabelled(rows, key, group, axes, n_perm, seed))
    return {"n": rows.count(), "chi2": observed, "p": (at_least + 1) / (n_perm + 1)}


def binary_tests(df: DataFrame, group: str, axes: list[str], alpha: float = 0.05) -> dict[str, DataFrame]:
    """tests (axis, chi2, df, n, p, p_holm), pairs of groups for axes that stay significant (Fisher's exact test where an expected
    count is below 5, else z; corrected inside each axis), and the contingency tables (axis, group, level, n), null levels included."""
    from .order import cut
    from .rank import holm, long_features

    rows = cut(long_features(df.where(F.col(group).isNotNull()), [group], axes).withColumnRenamed("feature", "axis"))
    known = cut(contingency(rows, group, "value", ["axis"]))
    tests = chi_square(known, ["axis"]).join(rows.groupBy("axis").agg(F.count("value").alias("n")), "axis").withColumn("df", F.col("df").cast("double"))
    tests = with_tail(tests.withColumn("chi2", F.when(F.col("df") > 0, F.col("chi2"))), "chi2", ["chi2", "df"])
    tests = cut(holm(tests.withColumn("_all", F.lit(1)), "p", ["_all"], ["axis"]).drop("_all", "least_expected"))
    # The first level in order is the one that is counted.
    first = known.groupBy("axis").agg(F.min("value").alias("level"))
    counts = known.join(first, "axis").where(F.col("value") == F.col("level")).select("axis", F.col(group).alias("a"), F.col("n_row").alias("n1"), F.col("n").alias("x1"))
    other = counts.select("axis", F.col("a").alias("b"), F.col("n1").alias("n2"), F.col("x1").alias("x2"))
    pairs = counts.join(other, "axis").where("a < b").join(tests.where(F.col("p_holm") < alpha).select("axis"), "axis", "left_semi")
    n, x = F.col("n1") + F.col("n2"), F.col("x1") + F.col("x2")
    least = F.least("n1", "n2") * F.least(x, n - x) / n
    pairs = pairs.withColumn("test", F.when(least < 5, "fisher").otherwise("z"))
    z = two_proportions(*(F.col(c).cast("double") for c in ("n1", "x1", "n2", "x2")))
    pairs = pairs.withColumn("z", F.when(F.col("test") == "z", z))
    pairs = holm(with_tail(pairs, "share", ["z", "x1", "n1", "x2", "n2"]), "p", ["axis"], ["a", "b"])
    return {"tests": tests, "pairs": pairs, "tables": rows.groupBy("axis", group, F.col("value").alias("level")).agg(F.count(F.lit(1)).alias("n"))}


def posthoc(df: DataFrame, key: str, group: str, traits: list[str] | dict[str, list[str]], axes: list[str], n_perm: int = 5000, seed: int = 42, alpha: float = 0.05) -> dict[str, DataFrame]:
    """All tables of both analyses: the global permutation tests first, then tests, pairs and contingency tables.

    traits: a list, or named sets {mode: traits}, each with its own global test and its own family of corrected tests (columns mode);
    a trait may stand in several sets. A set without traits is left out.
    """
    spark, out, head = df.sparkSession, {}, []
    sets = {m: list(t) for m, t in (traits.items() if isinstance(traits, dict) else [("continuous", traits)]) if t}
    for mode, names in sets.items():
        g = permutation_profile(df, key, group, names, n_perm, seed)
        head.append((mode, g["n"], g["f"], g["p"]))
    if sets:
        out["tests"], out["pairs"] = trait_set_tests(df, group, sets, alpha) if isinstance(traits, dict) else trait_tests(df, group, sets["continuous"], alpha)
    if axes:
        g = binary_permutation(df, key, group, axes, n_perm, seed)
        head.append(("binary", g["n"], g["chi2"], g["p"]))
        out |= {f"binary_{k}": v for k, v in binary_tests(df, group, axes, alpha).items()}
    return {"global": spark.createDataFrame(head, "mode string, n long, statistic double, p double")} | out


def _share_p(z: float | None, x1: int, n1: int, x2: int, n2: int) -> float:
    return hypergeometric_two_sided(int(x1), int(n1 - x1), int(x2), int(n2 - x2)) if z is None else 2 * normal_sf(abs(z))


def with_tail(df: DataFrame, test: str, columns: list[str], out: str = "p") -> DataFrame:
    """df with the tail probability of a statistic: test "f" (f, df1, df2), "chi2" (x, df), "t" (t, df), "range" (q, k, df), "share" (z or null for the exact test, x1, n1, x2, n2). One small result row at a time."""
    tails = {"f": f_sf, "chi2": chi2_sf, "t": t_sf2, "range": lambda q, k, d: studentized_range_sf(q, int(k), d), "share": _share_p}
    tail = tails[test]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in columns))
            p = [float(tail(*r)) if test == "share" else None if any(x is None for x in r) else float(tail(*map(float, r))) for r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, out])

    return df.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"{out} double"]))


def trait_tests(df: DataFrame, group: str, traits: list[str], alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(tests, pairs): Welch's test of each trait with Holm's correction, then Games-Howell for traits that stay significant, corrected inside each."""
    from .order import cut
    from .rank import holm, long_features

    moments = cut(group_moments(long_features(df, [group], traits), group, "value", ["feature"]))
    tests = with_tail(welch(moments, ["feature"]), "f", ["f", "df1", "df2"]).join(eta_squared(moments, ["feature"]), "feature")
    tests = cut(holm(tests.withColumn("_all", F.lit(1)), "p", ["_all"], ["feature"]).drop("_all"))
    k = moments.where("n > 1 and var > 0").groupBy("feature").agg(F.count(F.lit(1)).cast("double").alias("k"))
    pairs = games_howell(moments, group, ["feature"]).join(k, "feature").join(tests.where(F.col("p_holm") < alpha).select("feature"), "feature", "left_semi")
    return tests, holm(with_tail(pairs, "range", ["q", "k", "df"]), "p", ["feature"], ["a", "b"])


def trait_set_tests(df: DataFrame, group: str, sets: dict[str, list[str]], alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """trait_tests of several sets {mode: traits}, with a column mode: one aggregate over all traits, then Holm's correction inside each set."""
    from .order import cut
    from .rank import holm, long_features

    every = sorted({t for names in sets.values() for t in names})
    of = F.broadcast(df.sparkSession.createDataFrame([(m, t) for m, names in sets.items() for t in dict.fromkeys(names)], "mode string, feature string"))
    moments = cut(group_moments(long_features(df, [group], every), group, "value", ["feature"]))
    tests = with_tail(welch(moments, ["feature"]), "f", ["f", "df1", "df2"]).join(eta_squared(moments, ["feature"]), "feature").join(of, "feature")
    tests = cut(holm(tests, "p", ["mode"], ["feature"]))
    k = moments.where("n > 1 and var > 0").groupBy("feature").agg(F.count(F.lit(1)).cast("double").alias("k"))
    told = tests.where(F.col("p_holm") < alpha).select("mode", "feature")
    pairs = with_tail(games_howell(moments, group, ["feature"]).join(k, "feature"), "range", ["q", "k", "df"]).join(told, "feature")
    return tests, holm(pairs, "p", ["mode", "feature"], ["a", "b"])


def odds_table(model: dict) -> list[dict]:
    """Odds ratios with limits and notes of a logistic model."""
    note = lambda r, se: "not estimable" if not se > 0 else "large effect" if r >= 2 or r <= 0.5 else ""
    return [{"term": t, "odds": float(o), "low": float(a) if s > 0 else None, "high": float(b) if s > 0 else None, "p": p, "note": note(o, s)} for t, o, a, b, p, s in zip(model["names"], model["odds"], model["low"], model["high"], model["p"], model["se"])]
