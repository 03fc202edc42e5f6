"""Imputation and scaling. Parameters come from one aggregate of a row, and are joined back as literals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, terms: dict) -> dict:
    return df.agg(*(c.alias(n) for n, c in terms.items())).first().asDict()


def _lit(x):
    return F.lit(x).cast("double")


def _quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, dict[float, float]]:
    """{column: {share: quantile}}, exact, of all columns in one global order of (column, value)."""
    from .order import quantiles
    from .rank import long_features

    out: dict[str, dict[float, float]] = {c: {} for c in columns}
    for r in quantiles(long_features(df, [], columns), "value", shares, ["feature"]).collect():  # a row for each column and share
        out[r["feature"]][r["q"]] = r["at"]
    return out


def impute(df: DataFrame, columns: list[str], how: str = "mean") -> DataFrame:
    """Nulls become the column's mean or exact median."""
    at = _row(df, {c: F.avg(c) for c in columns}) if how == "mean" else {c: q.get(0.5) for c, q in _quantiles(df, columns, [0.5]).items()}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), _lit(at[c])) for c in columns})


def standardise(df: DataFrame, columns: list[str], sample: bool = False) -> DataFrame:
    """(x - mean) / deviation, nulls kept; columns without spread stay as they are."""
    sd = F.stddev_samp if sample else F.stddev_pop
    at = _row(df, {f"m_{c}": F.avg(c) for c in columns} | {f"s_{c}": sd(c) for c in columns})
    return df.withColumns({c: (F.col(c) - at[f"m_{c}"]) / at[f"s_{c}"] for c in columns if at[f"s_{c}"]})


def block_standardise(df: DataFrame, blocks: dict[str, list[str]]) -> DataFrame:
    """Columns of a block of p get mean 0 and population deviation 1 / sqrt(p), so that blocks weigh alike; columns without spread become 0."""
    columns = [c for b in blocks.values() for c in b]
    at = _row(df, {f"m_{c}": F.avg(c) for c in columns} | {f"s_{c}": F.stddev_pop(c) for c in columns})
    out = {}
    for b in blocks.values():
        for c in b:
            m, s = at[f"m_{c}"], at[f"s_{c}"]
            out[c] = (F.col(c) - m) / (s * len(b) ** 0.5) if s else F.when(F.col(c).isNotNull(), 0.0)
    return df.withColumns(out)


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / (q75 - q25) with exact quantiles; a range of 0 counts as 1."""
    at = _quantiles(df, columns, [0.25, 0.5, 0.75])
    return df.withColumns({c: (F.col(c) - at[c][0.5]) / ((at[c][0.75] - at[c][0.25]) or 1.0) for c in columns if at[c]})


def informative(df: DataFrame, columns: list[str], least: int = 3, share: float = 0.3) -> list[str]:
    """Columns with more than one value, and values in max(least, share * n) rows at least."""
    at = _row(df, {"n": F.count(F.lit(1))} | {f"c_{c}": F.count(c) for c in columns} | {f"a_{c}": F.min(c) for c in columns} | {f"b_{c}": F.max(c) for c in columns})
    return [c for c in columns if at[f"c_{c}"] >= max(least, share * at["n"]) and at[f"a_{c}"] != at[f"b_{c}"]]


def missing_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n_null, n_rows, pct_null)."""
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).isNull().cast("int").alias("gap")) for c in columns))
    return df.select(F.explode(pairs).alias("_p")).groupBy("_p.feature").agg(F.sum("_p.gap").alias("n_null"), F.count(F.lit(1)).alias("n_rows")).withColumn("pct_null", 100 * F.col("n_null") / F.col("n_rows"))


def require_complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, which fails when read, whatever columns are read, if one of these holds a null."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return df.where(F.when(bad, F.raise_error("nulls remain in the matrix").cast("boolean")).otherwise(True))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df; raises KeyError at once if columns are missing."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise KeyError(f"missing columns {lacking}")
    return df


#: Named subsets of blocks.
STRUCTURES = {"full": ("PHY", "PSY", "BHR", "TLX", "EUP"), "no_tlx": ("PHY", "PSY", "BHR", "EUP"), "no_eup": ("PHY", "PSY", "BHR", "TLX"), "phy_psy_only": ("PHY", "PSY"), "reactivity_only": ("PHY", "PSY", "TLX")}


def chosen_blocks(blocks: dict[str, list[str]], structure: str) -> dict[str, list[str]]:
    """Blocks of a named structure, or of names split at comma, blank, plus and underscore; unknown ones raise."""
    import re

    names = STRUCTURES.get(structure) or tuple(x for x in re.split(r"[,\s_+]+", structure) if x)
    if unknown := [x for x in names if x not in blocks]:
        raise ValueError(f"unknown blocks {unknown}")
    return {x: blocks[x] for x in names}
