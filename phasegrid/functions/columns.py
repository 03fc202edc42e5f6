"""Column expressions: coercion, encoders, labels. All stay in the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes of the domain.
MISSING = ("-", "—", "–", "", "#n/a", "#na", "n/a", "na")
CONDITION_OF = {"A": "AB", "B": "AB", "C": "CD", "D": "CD", "E": "EF", "F": "EF", "G": "GH", "H": "GH", "AB": "AB", "CD": "CD", "EF": "EF", "GH": "GH", "HG": "GH"}
PHASE_OF = {"A": "static", "C": "static", "E": "static", "G": "static", "B": "dynamic", "D": "dynamic", "F": "dynamic", "H": "dynamic"}
DIRECTION_OF = {"AB": -1, "GH": -1, "CD": 1, "EF": 1}
STATIC_TIMES, DYNAMIC_TIMES = (0, 5, 10), (10, 15, 20)
SEX_OF = {"m": 1, "male": 1, "man": 1, "남": 1, "남자": 1, "1": 1, "f": 0, "female": 0, "woman": 0, "여": 0, "여자": 0, "0": 0}
RENAMES = {"no": "id", "time_min_": "time_min", "time_min": "time_min"}


def normal_name(name: str, style: str = "snake") -> str:
    """A column name made regular: "snake" (NFKC, lower, other signs to _), "lower" or "upper" (trimmed)."""
    name = unicodedata.normalize("NFKC", name).strip()
    if style == "upper":
        return name.upper()
    name = name.lower()
    return name if style == "lower" else re.sub(r"_+", "_", re.sub(r"\W", "_", name)).strip("_")


def normal_names(df: DataFrame, style: str = "snake", renames: dict[str, str] | None = None) -> DataFrame:
    """df with regular, canonical and distinct column names: later ones of a name get a number."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        n = normal_name(c, style)
        n = (renames or RENAMES).get(n, n)
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n] - 1}")
    return df.toDF(*out)


def find_column(df: DataFrame, *names: str) -> str:
    """The first column that has one of the names, whatever the case; KeyError if none has."""
    own = {c.lower(): c for c in df.columns}
    for n in names:
        if n.lower() in own:
            return own[n.lower()]
    raise KeyError(f"none of {names} in {df.columns}")


def existing(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def with_missing(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """df with null columns for names that it lacks."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def minute_columns(df: DataFrame, prefix: str) -> dict[int, str]:
    """{minute: column} for columns `<prefix>_<minute>`, in order; prefixes may hold underscores."""
    found = ((re.fullmatch(rf"{re.escape(prefix)}_(\d+)", c), c) for c in df.columns)
    return dict(sorted((int(m[1]), c) for m, c in found if m))


def by_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def number(x: Column) -> Column:
    """The value as a double; missing tokens, text that is no number, NaN and infinities become null."""
    text = F.trim(x.cast("string"))
    value = F.when(F.lower(text).isin(*MISSING), None).otherwise(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def not_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def clipped(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """The value kept within [low, high]; nulls and NaN become null."""
    out = not_nan(x)
    out = F.when(out < low, F.lit(float(low))).otherwise(out) if low is not None else out
    return F.when(out > high, F.lit(float(high))).otherwise(out) if high is not None else out


def whole_id(x: Column) -> Column:
    return number(x).cast("long")


def environment(x: Column) -> Column:
    """Trimmed upper-case code, full-width A..H read as A..H."""
    return F.translate(F.upper(F.trim(x)), "ＡＢＣＤＥＦＧＨ", "ABCDEFGH")


def _lookup(x: Column, table: dict) -> Column:
    out = F.lit(None)
    for value in dict.fromkeys(table.values()):
        out = F.when(x.isin(*[k for k, v in table.items() if v == value]), value).otherwise(out)
    return out


def condition(x: Column) -> Column:
    return _lookup(environment(x), CONDITION_OF)


def segment_phase(x: Column) -> Column:
    return _lookup(environment(x), PHASE_OF)


def direction(x: Column) -> Column:
    return _lookup(condition(x), DIRECTION_OF)


def sex(x: Column) -> Column:
    return _lookup(F.lower(F.trim(x.cast("string"))), SEX_OF)


def minute_phase(minute: Column, last_static: int = 10, last: int = 20) -> Column:
    return F.when(minute.between(1, last_static), "static").when(minute.between(last_static + 1, last), "dynamic")


def survey_phase(time: Column) -> Column:
    """A time in both lists counts as static."""
    return F.when(time.isin(*STATIC_TIMES), "static").when(time.isin(*DYNAMIC_TIMES), "dynamic")


def at_least(x: Column, limit: float = 50, null_as_zero: bool = True) -> Column:
    out = F.when(x >= limit, 1.0).when(x < limit, 0.0)
    return F.coalesce(out, F.lit(0.0)) if null_as_zero else out


def two_sided(x: Column, high: float, low: float, first: str, second: str, ties: str = "drop") -> Column:
    """first from high up, second up to low; what lies between goes by `ties`: "drop" (null), "first" or "second"."""
    if ties not in ("drop", "first", "second"):
        raise ValueError(f"unknown tie policy {ties!r}")
    tie = {"drop": F.lit(None), "first": F.lit(first), "second": F.lit(second)}[ties]
    return F.when(x >= high, first).when(x <= low, second).when(x.isNotNull(), tie)


def flag(test: Column) -> Column:
    """1 where the test holds; 0 where it fails or is null."""
    return F.when(F.coalesce(test, F.lit(False)), 1).otherwise(0)


def row_mean(*xs: Column) -> Column:
    """Mean of the values that are not null; null if all are."""
    values = F.filter(F.array(*xs), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))


def products(names: list[str]) -> dict[str, Column]:
    """The product of each pair of columns, as {a_x_b: column}."""
    return {f"{a}_x_{b}": F.col(a) * F.col(b) for i, a in enumerate(names) for b in names[i + 1 :]}


def p_band(p: Column, rho: Column) -> Column:
    """Display band of a correlation: none unless p < 0.05, else by strength."""
    return F.when(p.isNull() | rho.isNull() | (p >= 0.05), "none").when(rho >= 0.6, "strong positive").when(rho >= 0.4, "positive").when(rho <= -0.6, "strong negative").when(rho <= -0.4, "negative").otherwise("weak")


def effect_size(eta2: Column) -> Column:
    return F.when(eta2 >= 0.14, "large").when(eta2 >= 0.06, "medium").when(eta2 >= 0.01, "small").when(eta2.isNotNull(), "negligible")


def scenario_name(name: str) -> str:
    """A feature name without its phase: static and dynamic means are both scenario means."""
    name = re.sub(r"_(static|dynamic)(_mean|_slope|_auc|_sd)?$", lambda m: "_scenario" + (m[2] or ""), name)
    return re.sub(r"baseline_[12]$", "baseline", name)
