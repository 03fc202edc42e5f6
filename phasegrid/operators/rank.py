"""Ranks, order and sets with nulls last and unranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_min(value: Column, keys: list[str], descending: bool = False) -> Column:
    """Least rank of ties inside a group of keys; nulls are unranked. Over all rows see order.global_rank."""
    return F.when(value.isNotNull(), F.rank().over(Window.partitionBy(*keys).orderBy(value.desc_nulls_last() if descending else value.asc_nulls_last())))


def filled_rank(df: DataFrame, column: str, out: str, keys: list[str], descending: bool = False) -> DataFrame:
    """rank_min, and for nulls the worst rank given in the group."""
    df = df.withColumn("_r", rank_min(F.col(column), keys, descending))
    return df.withColumn(out, F.coalesce("_r", F.max("_r").over(Window.partitionBy(*keys)))).drop("_r")


def nulls_last(*columns: str | Column) -> list[Column]:
    """Order terms with nulls last; a name with a leading minus falls."""
    return [F.col(c[1:]).desc_nulls_last() if isinstance(c, str) and c.startswith("-") else F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in columns]


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, out: str = "place") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1, "_place").drop("_place")


def long_features(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, feature, value)."""
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.feature", "_p.value")


def extreme_features(df: DataFrame, keys: list[str], columns: list[str], n: int = 3, lowest: bool = False) -> DataFrame:
    """The n largest (or smallest) columns of each row; ties by name."""
    value = F.col("value").asc_nulls_last() if lowest else F.col("value").desc_nulls_last()
    return top_per_group(long_features(df, keys, columns), keys, [value, F.col("feature")], n)


def composite_rank(df: DataFrame, up: list[str], down: list[str], keys: list[str], only: dict[str, Column] | None = None, penalty: Column | None = None, out: str = "score") -> DataFrame:
    """Sum of the filled ranks of columns inside each group of keys (greater is better in `up`, smaller in `down`); those in `only` count where the test holds."""
    names = []
    for columns, falling in ((up, True), (down, False)):
        for c in columns:
            df = filled_rank(df, c, f"_rank_{c}", keys, falling)
            names.append(c)
    terms = [F.coalesce(F.when((only or {}).get(c, F.lit(True)), F.col(f"_rank_{c}")), F.lit(0)) for c in names]
    total = sum(terms, F.lit(0)).cast("double") + (penalty if penalty is not None else F.lit(0.0))
    return df.withColumn(out, total).drop(*(f"_rank_{c}" for c in names))


def holm(df: DataFrame, p: str, keys: list[str], order: list[str], out: str = "p_holm") -> DataFrame:
    """Step-down correction inside each group of keys; a null p counts as 1. `order` breaks ties."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("_p", F.coalesce(F.col(p), F.lit(1.0)))
    turn = w.orderBy("_p", *order)
    df = df.withColumn("_s", (F.count(F.lit(1)).over(w) - F.row_number().over(turn) + 1) * F.col("_p"))
    return df.withColumn(out, F.least(F.lit(1.0), F.max("_s").over(turn.rowsBetween(Window.unboundedPreceding, 0)))).drop("_p", "_s")


def same_columns(*frames: DataFrame) -> DataFrame:
    """All rows of the frames; columns that one lacks are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
