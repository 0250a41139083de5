"""Transform and scale numeric columns (M4).

Scalers are split in a fit and ``apply`` (a projection), so the parameters can be fitted on one slice (e.g. a
training period) and applied to another.  :func:`robust_params` and :func:`standard_params` are scalar subqueries of
the plan that uses them: no job is run for them, and pruning drops the fit of a column that is not read.
``fit_*`` run a job and give plain numbers, to be kept or applied elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fits
from .stats import exact_quantiles


def log1p(col) -> Column:
    """ln(1 + x); NULL at x <= -1."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c > -1, F.log1p(c))


@dataclass(frozen=True)
class RobustParams:
    center: float | Column | None
    scale: float | Column


@dataclass(frozen=True)
class StandardParams:
    mean: float | Column | None
    scale: float | Column


def robust_fit(df: DataFrame, col: str, q_range=(0.25, 0.75), approx: bool = False) -> Column:
    """Scalar subquery: the lower, middle and upper quantile."""
    lo, hi = q_range
    return exact_quantiles(df, col, [lo, 0.5, hi], approx=approx).select(F.array("q0", "q1", "q2")).scalar()


def robust_params(df: DataFrame, col: str, q_range=(0.25, 0.75), approx: bool = False, fitted: Column | None = None) -> RobustParams:
    """Median and inter-quartile range (0 -> 1) as columns of any plan; ``fitted`` gives the three quantiles from elsewhere."""
    fitted = robust_fit(df, col, q_range, approx) if fitted is None else fitted
    iqr = fitted[2] - fitted[0]
    return RobustParams(fitted[1], F.when(iqr == 0, F.lit(1.0)).otherwise(iqr))


def standard_params(df: DataFrame, col: str, fitted: Column | None = None) -> StandardParams:
    """Mean and population standard deviation (0 or none -> 1) as columns of any plan."""
    m = fits.moments(df, col) if fitted is None else fitted
    return StandardParams(m["mean"], F.when(m["std"] != 0, m["std"]).otherwise(F.lit(1.0)))


def fit_robust(df: DataFrame, col: str, q_range=(0.25, 0.75), approx: bool = False) -> RobustParams:
    """Median and inter-quartile range with linear quantiles; IQR 0 -> 1."""
    lo, hi = q_range
    row = exact_quantiles(df, col, [lo, 0.5, hi], approx=approx).first()
    if row is None or row["q1"] is None:
        return RobustParams(None, 1.0)
    iqr = row["q2"] - row["q0"]
    return RobustParams(row["q1"], iqr if iqr != 0 else 1.0)


def apply_robust(col: str, p: RobustParams) -> Column:
    if p.center is None:
        return F.lit(None).cast("double")
    return (F.col(f"`{col}`") - F.lit(p.center)) / F.lit(p.scale)


def fit_scalers(df: DataFrame, robust_cols, standard_cols, q_range=(0.25, 0.75)):
    """Parameters of every scaler as numbers: the quartiles of the robust columns, the moments of all
    standard columns from one aggregation.  Returns ({col: RobustParams}, {col: StandardParams})."""
    lo, hi = q_range
    robust_cols, standard_cols = list(robust_cols), list(standard_cols)
    robust = {c: RobustParams(None, 1.0) for c in robust_cols}
    if robust_cols:
        row = df.sparkSession.range(1).select(*[fits.quantiles(df, c, [lo, 0.5, hi]).alias(f"c{i}") for i, c in enumerate(robust_cols)]).first()
        for i, c in enumerate(robust_cols):
            if row[i] is not None:
                iqr = row[i][2] - row[i][0]
                robust[c] = RobustParams(row[i][1], iqr if iqr != 0 else 1.0)
    standard = {}
    if standard_cols:
        row = df.agg(*[f(F.col(f"`{c}`")).alias(f"{n}{i}") for i, c in enumerate(standard_cols)
                       for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        for i, c in enumerate(standard_cols):
            sd = row[f"s{i}"]
            standard[c] = StandardParams(row[f"m{i}"], sd if sd not in (None, 0.0) else 1.0)
    return robust, standard


def fit_standard(df: DataFrame, col: str) -> StandardParams:
    """Mean and population standard deviation; std 0 -> 1."""
    row = df.agg(F.avg(F.col(col)).alias("m"), F.stddev_pop(F.col(col)).alias("s")).first()
    s = row["s"]
    return StandardParams(row["m"], s if s not in (None, 0.0) else 1.0)


def apply_standard(col: str, p: StandardParams) -> Column:
    if p.mean is None:
        return F.lit(None).cast("double")
    return (F.col(f"`{col}`").cast("double") - F.lit(p.mean)) / F.lit(p.scale)


def robust_scale(df: DataFrame, col: str, out: str | None = None, approx: bool = False) -> DataFrame:
    """(x - median) / IQR."""
    fitted = df.withColumn("__fit", robust_fit(df, col, approx=approx))
    scaled = apply_robust(col, robust_params(df, col, fitted=F.col("__fit")))
    return fitted.withColumn(out or f"{col.replace(' ', '_')}_Scaled", scaled).drop("__fit")


def standard_scale(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """(x - mean) / population std."""
    return df.withColumn(out or f"{col.replace(' ', '_')}_Scaled", apply_standard(col, standard_params(df, col)))


def scale(df: DataFrame, approx: bool = False, fitted: dict[str, Column] | None = None) -> DataFrame:
    """M4 (+B6): keep originals, log the target, robust-scale gap and ratio,
    standard-scale the vehicle number.  All parameters are fitted on ``df`` inside the plan, or taken from ``fitted``
    (column -> quartiles or moments, a fit store)."""
    columns = [c for c in ("Min Gap", "Delay_Ratio", "Vehicle") if c in df.columns]
    given = {c: (fitted or {}).get(c) for c in columns}
    fit = lambda c: fits.moments(df, c) if c == "Vehicle" else robust_fit(df, c, approx=approx)
    # each fit stands in the plan once, as a column that the scaled one reads
    out = df.withColumns({f"__fit {c}": fit(c) if g is None else g for c, g in given.items()}) if columns else df
    cols = {}
    if "Min Delay" in df.columns:
        cols |= {"Min_Delay_Original": F.col("Min Delay"), "Min_Delay_Log": log1p("Min Delay")}
    if "Min Gap" in df.columns:
        cols |= {"Min_Gap_Original": F.col("Min Gap")}
    for c in columns:
        params = (standard_params if c == "Vehicle" else robust_params)(df, c, fitted=F.col(f"`__fit {c}`"))
        cols[f"{c.replace(' ', '_')}_Scaled"] = (apply_standard if c == "Vehicle" else apply_robust)(c, params)
    return out.withColumns(cols).drop(*[f"__fit {c}" for c in columns])
