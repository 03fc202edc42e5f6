"""Moments by one aggregate, and what follows from them: correlation, components, validity, regression."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dist import chi2_sf, normal_cdf, t_sf2


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, population covariance) of the complete rows. p * (p + 1) / 2 sums reach the driver."""
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    got = rows.agg(F.count(F.lit(1)), *(F.avg(c) for c in columns), *(F.covar_pop(a, b) for a, b in pairs)).first()
    p = len(columns)
    cov = np.zeros((p, p))
    for (a, b), v in zip(pairs, got[1 + p :]):
        i, j = columns.index(a), columns.index(b)
        cov[i, j] = cov[j, i] = np.nan if v is None else v
    return got[0], np.array([np.nan if x is None else x for x in got[1 : 1 + p]]), cov


def pearson_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r, n) of each unordered pair, over rows where both are known."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r"), F.col(f"n{k}").alias("n")) for k, (a, b) in enumerate(pairs)))
    got = df.agg(*(F.corr(F.when(both(a, b), F.col(a).cast("double")), F.when(both(a, b), F.col(b).cast("double"))).alias(f"r{k}") for k, (a, b) in enumerate(pairs)), *(F.count(F.when(both(a, b), 1)).alias(f"n{k}") for k, (a, b) in enumerate(pairs)))
    return got.select(F.explode(cells).alias("_c")).select("_c.*")


def average_ranks(df: DataFrame, key: str, column: str, out: str) -> DataFrame:
    """(key, out): ranks with ties averaged, by counts of each value."""
    from .order import positions, running_sum

    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranks = running_sum(positions(values, ["_v"], "_i"), "_i", "_c", "_upto")
    ranks = ranks.select("_v", (F.col("_upto") - (F.col("_c") - 1) / 2).alias(out))
    return df.select(key, F.col(column).alias("_v")).join(ranks, "_v").select(key, out)


def spearman(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(a, b, rho, n): over rows where both are known; key is unique."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, a, b)
    ranks = average_ranks(both, key, a, "_x").join(average_ranks(both, key, b, "_y"), key)
    return ranks.agg(F.corr("_x", "_y").alias("rho"), F.count(F.lit(1)).alias("n")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "rho", "n")


def spearman_matrix(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(a, b, rho, n, p) of each unordered pair, over rows where both are known; p is null below three rows or without spread.

    Long form throughout: one global order of (pair, side, value) ranks all pairs at once.
    """
    from .order import positions, running_sum

    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for k, (a, b) in enumerate(pairs)))).alias("_c")
    rows = df.select(F.col(key).alias("_k"), cells).select("_k", "_c.*").where("x is not null and y is not null")
    long = rows.select("_k", "pair", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("v")), F.struct(F.lit(1).alias("side"), F.col("y").alias("v")))).alias("_s")).select("_k", "pair", "_s.*")
    values = long.groupBy("pair", "side", "v").agg(F.count(F.lit(1)).alias("_c"))
    upto = running_sum(positions(values, ["pair", "side", "v"], "_i"), "_i", "_c", "_upto").select("pair", "side", "v", (F.col("_upto") - (F.col("_c") - 1) / 2).alias("rank"))
    base = upto.groupBy("pair", "side").agg(F.min("rank").alias("_b"))  # a constant inside a pair and side leaves the correlation as it is
    ranked = long.join(upto.join(base, ["pair", "side"]).withColumn("rank", F.col("rank") - F.col("_b")), ["pair", "side", "v"])
    both = ranked.groupBy("pair", "_k").agg(F.max(F.when(F.col("side") == 0, F.col("rank"))).alias("x"), F.max(F.when(F.col("side") == 1, F.col("rank"))).alias("y"))
    names = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))
    got = both.groupBy("pair").agg(F.corr("x", "y").alias("rho"), F.count(F.lit(1)).alias("n")).withColumn("_n", F.element_at(names, F.col("pair") + 1))
    return with_p(got.select("_n.a", "_n.b", "rho", "n"), "rho", "n")


def with_p(df: DataFrame, r: str, n: str, out: str = "p") -> DataFrame:
    """df with the two-sided p of a correlation. A few result rows."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            p = [correlation_p(x, m) for x, m in zip(b.column(r).to_pylist(), b.column(n).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, out])

    return df.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"{out} double"]))


def block_diagnostics(df: DataFrame, blocks: dict[str, list[str]]) -> list[dict]:
    """For each block: mean and greatest |r| inside it, shares of its first two components, mean and deviation of its rows' norms."""
    out = []
    for name, columns in blocks.items():
        row: dict = {"block": name, "n_features": len(columns), "mean_abs_r": None, "max_abs_r": None, "pc1": 1.0, "pc2": None}
        if len(columns) > 1:
            _, _, cov = moments(df, columns)
            r = np.abs(correlation(cov)[np.triu_indices(len(columns), 1)])
            share = np.linalg.eigvalsh(cov)[::-1] / np.trace(cov)
            row |= {"mean_abs_r": float(np.nanmean(r)), "max_abs_r": float(np.nanmax(r)), "pc1": float(share[0]), "pc2": float(share[1])}
        out.append(row | row_energy(df, columns).first().asDict())
    return out


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation; null below three pairs or without spread."""
    if r is None or n < 3 or math.isnan(r):
        return None
    return 0.0 if abs(r) >= 1 else t_sf2(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def correlation(cov: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diag(cov))
    return cov / np.outer(d, d)


def components_of(corr: np.ndarray) -> dict[str, np.ndarray]:
    """Eigenvalues (falling, above 1e-8), vectors (largest weight positive), loadings, shares."""
    value, vector = np.linalg.eigh(corr)
    order = np.argsort(-value)
    order = order[value[order] > 1e-8]
    value, vector = value[order], vector[:, order]
    vector = vector * np.sign(vector[np.abs(vector).argmax(0), np.arange(len(order))])
    share = value / np.trace(corr)
    return {"values": value, "vectors": vector, "loadings": vector * np.sqrt(value), "share": share, "cumulative": np.cumsum(share)}


def components(df: DataFrame, columns: list[str]) -> dict[str, np.ndarray]:
    """Of the standardised complete rows, with their number, means and deviations."""
    n, mean, cov = moments(df, columns)
    return components_of(correlation(cov)) | {"n": np.array(n), "mean": mean, "sd": np.sqrt(np.diag(cov))}


def scores(df: DataFrame, columns: list[str], weights: np.ndarray, mean: np.ndarray, sd: np.ndarray, prefix: str = "pc") -> DataFrame:
    """df with pc1.. = weighted sums of the standardised columns; null where one of them is."""
    z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(columns, mean, sd)]
    return df.withColumns({f"{prefix}{k + 1}": sum((x * float(w) for x, w in zip(z, weights[:, k])), F.lit(0.0)) for k in range(weights.shape[1])})


def enough(cumulative: np.ndarray, share: float) -> int:
    """Components needed for this share of the variance."""
    return int((cumulative < share - 1e-12).sum()) + 1


def kmo(corr: np.ndarray) -> tuple[float, np.ndarray]:
    """Sampling adequacy, overall and for each variable."""
    inverse = np.linalg.pinv(corr)
    d = np.sqrt(np.diag(inverse))
    partial = -inverse / np.outer(d, d)
    r2, p2 = corr**2, partial**2
    np.fill_diagonal(r2, 0)
    np.fill_diagonal(p2, 0)
    with np.errstate(invalid="ignore"):
        return float(r2.sum() / (r2.sum() + p2.sum())), r2.sum(0) / (r2.sum(0) + p2.sum(0))


def bartlett(corr: np.ndarray, n: int) -> tuple[float, float, float]:
    """(chi2, degrees, p) of the test that the variables are uncorrelated."""
    p = len(corr)
    stat, df = -(n - 1 - (2 * p + 5) / 6) * np.linalg.slogdet(corr)[1], p * (p - 1) / 2
    return float(stat), df, chi2_sf(float(stat), df)


def validity(df: DataFrame, columns: list[str]) -> dict:
    """Whether a block suits component analysis, with the reasons against it."""
    n, _, cov = moments(df, columns)
    out: dict = {"n": n, "p": len(columns), "reasons": []}
    if len(columns) < 2 or n < 10:
        return out | {"kmo": None, "bartlett_p": None, "valid": False, "reasons": ["fewer than 2 variables or 10 rows"]}
    corr = correlation(cov)
    levels = df.agg(*(F.count_distinct(c) for c in columns)).first()
    out |= {"kmo": kmo(corr)[0], "bartlett_p": bartlett(corr, n)[2], "mean_abs_r": float(np.abs(corr[np.triu_indices(len(corr), 1)]).mean()), "binary_like": sum(x <= 2 for x in levels), "ordinal_like": sum(3 <= x <= 7 for x in levels)}
    out["reasons"] = ["KMO below 0.5"] * (out["kmo"] < 0.5) + ["Bartlett p 0.10 or more"] * (out["bartlett_p"] >= 0.10)
    return out | {"valid": not out["reasons"]}


def proxy(corr: np.ndarray, retained: int) -> tuple[int, float, bool]:
    """(variable, R2, good): the one variable that explains most of the retained components' variance; good from 0.70."""
    c = components_of(corr)
    share = c["values"][:retained] / c["values"][:retained].sum()
    r2 = (c["loadings"][:, :retained] ** 2 * share).sum(1)
    best = int(r2.argmax())
    return best, float(r2[best]), bool(r2[best] >= 0.70)


def cronbach_alpha(df: DataFrame, items: list[str]) -> DataFrame:
    """(alpha, n, k) over complete rows."""
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in items)).dropna()
    total = sum((F.col(c) for c in items), F.lit(0.0))
    k = len(items)
    parts = sum((F.var_samp(c) for c in items), F.lit(0.0))
    return rows.agg((k / (k - 1) * (1 - parts / F.var_samp(total))).alias("alpha"), F.count(F.lit(1)).alias("n"), F.lit(k).alias("k"))


def least_squares(df: DataFrame, target: str, predictors: list[str]) -> dict:
    """Coefficients (intercept first), errors, t, p, R2 and adjusted R2 from the moments of the complete rows."""
    n, mean, cov = moments(df, [*predictors, target])
    p = len(predictors)
    sxx, sxy, syy = cov[:p, :p] * n, cov[:p, p] * n, cov[p, p] * n
    inverse = np.linalg.pinv(sxx)
    slope = inverse @ sxy
    rest = max(syy - slope @ sxy, 0.0)
    df_ = n - p - 1
    var = rest / df_ if df_ > 0 else np.nan
    se = np.sqrt(np.r_[var * (1 / n + mean[:p] @ inverse @ mean[:p]), var * np.diag(inverse)])
    coef = np.r_[mean[p] - slope @ mean[:p], slope]
    r2 = 1 - rest / syy
    return {"n": n, "names": ["intercept", *predictors], "coef": coef, "se": se, "t": coef / se, "p": [t_sf2(float(t), df_) for t in coef / se], "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / df_}


MOST_LEVELS = 200


def treatment_coded(df: DataFrame, column: str, levels: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """df with a 0/1 column for each level but the first; a null value gives nulls. Levels are found if not given; more than MOST_LEVELS raise."""
    if levels is None:
        found = df.select(column).distinct().dropna().limit(MOST_LEVELS + 1).collect()
        if len(found) > MOST_LEVELS:
            raise ValueError(f"{column} has more than {MOST_LEVELS} levels")
        levels = sorted(r[0] for r in found)
    names = [f"{column}_{v}" for v in levels[1:]]
    return df.withColumns({n: (F.col(column) == v).cast("double") for n, v in zip(names, levels[1:])}), names


def design(df: DataFrame, predictors: list[str], categorical: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """df and the names of the predictors, those that are categorical replaced by their treatment-coded columns; predictors that df lacks are left out."""
    names: list[str] = []
    for c in dict.fromkeys(predictors):
        if c not in df.columns:
            continue
        if c in categorical:
            df, own = treatment_coded(df, c)
            names += own
        else:
            names.append(c)
    return df, names


def model_runs(df: DataFrame, group: str, targets: dict[str, list[str]], predictors: dict[str, list[str]], categorical: tuple[str, ...] = (), least: int = 30) -> DataFrame:
    """(set, coding, target, term, coef, se, z, n, status): a random-intercept model for each target of each set (raw, pattern, mismatch) with each coding
    of the person's traits (continuous, binary). Sets of fewer than `least` complete rows, or that cannot be solved, have a status and no terms."""
    out = []
    for kind, ys in targets.items():
        for coding, xs in predictors.items():
            coded, names = design(df, xs, categorical)
            for y in ys:
                n = coded.select(group, y, *names).dropna().count() if y in df.columns else 0
                try:
                    if n < least:
                        raise ValueError(f"fewer than {least} observations")
                    g = random_intercept(coded, y, names, group)
                    out += [(kind, coding, y, t, float(c), float(s), float(z), n, "ok") for t, c, s, z in zip(g["names"], g["coef"], g["se"], g["z"])]
                except (ValueError, np.linalg.LinAlgError) as e:
                    out.append((kind, coding, y, None, None, None, None, n, str(e)))
    return df.sparkSession.createDataFrame(out, "set string, coding string, target string, term string, coef double, se double, z double, n long, status string")


def subject_models(df: DataFrame, key: str, targets: list[str], predictors: list[str], categorical: tuple[str, ...] = ()) -> DataFrame:
    """(target, term, coef, se, p, r2, adj_r2, n): least squares over one row a subject, the first by order of all columns where ids repeat."""
    from .rank import first_per_key

    rows, names = design(first_per_key(df, [key], [F.col(c) for c in df.columns if c != key]), predictors, categorical)
    out = []
    for y in targets:
        g = least_squares(rows, y, names)
        out += [(y, t, float(c), float(s), float(p), float(g["r2"]), float(g["adj_r2"]), int(g["n"])) for t, c, s, p in zip(g["names"], g["coef"], g["se"], g["p"])]
    return df.sparkSession.createDataFrame(out, "target string, term string, coef double, se double, p double, r2 double, adj_r2 double, n long")


def random_intercept(df: DataFrame, target: str, predictors: list[str], group: str) -> dict:
    """Maximum likelihood of y = Xb + u_group + e: each group gives cross-products, one aggregate sums them for each group size."""
    names = ["_one", *predictors]
    rows = df.select(F.col(group).alias("_g"), F.lit(1.0).alias("_one"), *(F.col(c).cast("double").alias(c) for c in predictors), F.col(target).cast("double").alias("_y")).dropna()
    cols = [*names, "_y"]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    each = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"s_{c}") for c in cols), *(F.sum(F.col(a) * F.col(b)).alias(f"x{k}") for k, (a, b) in enumerate(pairs)))
    by_size = each.groupBy("_n").agg(F.count(F.lit(1)).alias("m"), *(F.sum(f"x{k}").alias(f"x{k}") for k in range(len(pairs))), *(F.sum(F.col(f"s_{a}") * F.col(f"s_{b}")).alias(f"z{k}") for k, (a, b) in enumerate(pairs))).collect()
    q = len(cols)

    def matrix(row, kind: str) -> np.ndarray:
        m = np.zeros((q, q))
        for k, (a, b) in enumerate(pairs):
            i, j = cols.index(a), cols.index(b)
            m[i, j] = m[j, i] = row[f"{kind}{k}"]
        return m

    sizes = [(r["_n"], r["m"], matrix(r, "x"), matrix(r, "z")) for r in by_size]
    total = sum(n * m for n, m, _, _ in sizes)

    def solve(ratio: float) -> tuple[float, np.ndarray, float, np.ndarray]:
        s, logs = np.zeros((q, q)), 0.0
        for n, m, x, z in sizes:
            s += x - ratio / (1 + n * ratio) * z
            logs += m * math.log(1 + n * ratio)
        beta = np.linalg.solve(s[:-1, :-1], s[:-1, -1])
        var = (s[-1, -1] - beta @ s[:-1, -1]) / total
        return -0.5 * (total * math.log(2 * math.pi * var) + total + logs), beta, var, s

    lo, hi = -12.0, 8.0
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(120):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        lo, hi = (lo, b) if solve(math.exp(a))[0] > solve(math.exp(b))[0] else (a, hi)
    ratio = max((math.exp((lo + hi) / 2), 0.0), key=lambda x: solve(x)[0])
    fit, beta, var, s = solve(ratio)
    se = np.sqrt(np.diag(np.linalg.inv(s[:-1, :-1])) * var)
    return {"names": ["intercept", *predictors], "coef": beta, "se": se, "z": beta / se, "loglik": fit, "var_group": ratio * var, "var_residual": var, "n": total}


def logistic_gee(df: DataFrame, target: str, predictors: list[str], group: str, rounds: int = 25) -> dict:
    """Logistic estimating equations with exchangeable correlation in groups, and sandwich errors; each round is one aggregate by group."""
    from .order import cut

    cols = ["_one", *predictors]
    rows = cut(df.select(F.col(group).alias("_g"), F.lit(1.0).alias("_one"), *(F.col(c).cast("double").alias(c) for c in predictors), F.col(target).cast("double").alias("_y")).dropna())
    beta, alpha, p = np.zeros(len(cols)), 0.0, len(cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def sums(beta: np.ndarray, alpha: float) -> tuple:
        mu = 1 / (1 + F.exp(-sum((F.col(c) * float(b) for c, b in zip(cols, beta)), F.lit(0.0))))
        r = rows.withColumn("_mu", mu).withColumn("_sd", F.sqrt(F.col("_mu") * (1 - F.col("_mu")))).withColumn("_r", (F.col("_y") - F.col("_mu")) / F.col("_sd"))
        d = [F.col("_sd") * F.col(c) for c in cols]  # rows of D scaled by the deviations
        each = r.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.sum("_r").alias("r"), F.sum(F.col("_r") ** 2).alias("rr"), *(F.sum(x).alias(f"d{i}") for i, x in enumerate(d)), *(F.sum(x * F.col("_r")).alias(f"u{i}") for i, x in enumerate(d)), *(F.sum(d[i] * d[j]).alias(f"h{i}_{j}") for i, j in pairs))
        c = F.lit(float(alpha)) / (1 + (F.col("n") - 1) * float(alpha))
        k = 1 / (1 - float(alpha))
        u = [k * (F.col(f"u{i}") - c * F.col(f"d{i}") * F.col("r")) for i in range(p)]
        got = each.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("np"), F.sum((F.col("r") ** 2 - F.col("rr")) / 2).alias("cross"), F.sum("n").alias("n"), F.sum("rr").alias("rr"), *(F.sum(x).alias(f"u{i}") for i, x in enumerate(u)), *(F.sum(k * (F.col(f"h{i}_{j}") - c * F.col(f"d{i}") * F.col(f"d{j}"))).alias(f"h{i}_{j}") for i, j in pairs), *(F.sum(u[i] * u[j]).alias(f"m{i}_{j}") for i, j in pairs)).first()
        square = lambda kind: np.array([[got[f"{kind}{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        scale = got["rr"] / (got["n"] - p)
        new = got["cross"] / ((got["np"] - p) * scale) if got["np"] > p else 0.0
        return np.array([got[f"u{i}"] for i in range(p)]), square("h"), square("m"), min(max(new, -0.5), 0.95)

    for _ in range(rounds):
        u, h, m, new = sums(beta, alpha)
        step = np.linalg.pinv(h) @ u
        beta, done = beta + step, np.abs(step).max() < 1e-8 and abs(new - alpha) < 1e-8
        alpha = new
        if done:
            break
    _, h, m, _ = sums(beta, alpha)
    bread = np.linalg.pinv(h)
    se = np.sqrt(np.maximum(np.diag(bread @ m @ bread), 0))
    z = beta / np.where(se > 0, se, np.nan)
    return {"names": ["intercept", *predictors], "coef": beta, "se": se, "z": z, "p": [2 * normal_cdf(-abs(x)) if np.isfinite(x) else None for x in z], "alpha": alpha, "odds": np.exp(beta), "low": np.exp(beta - 1.959964 * se), "high": np.exp(beta + 1.959964 * se)}


def polychoric(df: DataFrame, a: str, b: str) -> float:
    """Correlation of the normal variables behind two ordered ones; see mixed.polychoric_long for many at once."""
    from .mixed import polychoric_long

    return polychoric_long(df, [a, b])[0]["r"]


def lower_triangle(pairs: DataFrame, order: list[str]) -> DataFrame:
    """(row, col, r) with row after col in `order`, of pearson_long's rows."""
    place = lambda c: F.array_position(F.lit(order), F.col(c))
    turn = place("a") > place("b")
    return pairs.select(F.when(turn, F.col("a")).otherwise(F.col("b")).alias("row"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("col"), "r")


def row_energy(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation of the rows' L2 norms."""
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0)))
    return df.agg(F.avg(norm).alias("mean_norm"), F.stddev_pop(norm).alias("sd_norm"))
