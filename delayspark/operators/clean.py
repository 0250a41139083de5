"""Missing-value report and repair of the unified incident table (M2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import UNKNOWN, UNKNOWN_FILL_COLUMNS
from .stats import fill_maps, fill_with_group_stats


def missing_profile(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """E1 (+C3): per column the NULL count, its share of rows in percent and
    the column type; by default only columns with NULLs, most missing first.

    One aggregation pass computes every count; the wide row is unpivoted
    afterwards (a handful of rows)."""
    cols = df.columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).cast("bigint").alias(f"c{i}") for i, c in enumerate(cols)],
                    F.count(F.lit(1)).alias("__n"))
    names = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(f"c{i}"), F.lit(c))])
    types = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    long = counts.unpivot(["__n"], [f"c{i}" for i in range(len(cols))], "__k", "Missing_Count")
    out = long.select(
        names[F.col("__k")].alias("Column"),
        F.col("Missing_Count"),
        (F.try_divide(F.col("Missing_Count"), F.col("__n")) * 100.0).alias("Missing_Percentage"),
    ).withColumn("Data_Type", types[F.col("Column")])
    if only_missing:
        out = out.where(F.col("Missing_Count") > 0)
    return out.orderBy(F.col("Missing_Count").desc(), F.col("Column"))


def missing_total(df: DataFrame) -> DataFrame:
    """Total NULL cells and their share of all cells in percent."""
    n_cols = len(df.columns)
    total = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0)).cast("bigint")
    return df.agg(total.alias("Total_Missing"), F.count(F.lit(1)).alias("Rows")).select(
        "Total_Missing", "Rows", F.lit(n_cols).cast("bigint").alias("Columns"),
        (F.try_divide(F.col("Total_Missing"), F.col("Rows") * n_cols) * 100.0).alias("Missing_Percentage"))


def fill_unknown(df: DataFrame, columns: Sequence[str] = UNKNOWN_FILL_COLUMNS,
                 value: str = UNKNOWN) -> DataFrame:
    """Categorical NULLs to 'Unknown' (only the listed columns that exist)."""
    present = [c for c in columns if c in df.columns]
    return df.na.fill(value, subset=present) if present else df


def fill_vehicle_mode(df: DataFrame, col: str = "Vehicle", key: str = "Vehicle_Type") -> DataFrame:
    """I16: NULL vehicle -> most frequent vehicle of the same type (ties: the
    smallest; a type with no vehicle at all: 0)."""
    return fill_with_group_stats(df, modes=[col], key=key)


def fill_median(df: DataFrame, columns: Sequence[str] = ("Min Delay", "Min Gap"),
                key: str = "Vehicle_Type", approx: bool = False) -> DataFrame:
    """NULL -> interpolated median of the same type; a type with only
    NULLs stays NULL.  Medians are fitted on the input, before any filling;
    all columns share one fit pass (``approx`` takes the medians from
    fixed-size sketches instead)."""
    return fill_with_group_stats(df, medians=list(columns), key=key, approx=approx)


def drop_null_date(df: DataFrame, col: str = "Date") -> DataFrame:
    """Rows without a date cannot be placed in time and are dropped."""
    return df.dropna(subset=[col])


def clean(df: DataFrame, approx: bool = False, fitted: dict[str, Column] | None = None) -> DataFrame:
    """M2: fill categorical, vehicle and numeric NULLs, then drop undated rows.

    The categorical fills come first; the vehicle mode and the two medians are fitted on the input inside the plan, each
    reading its own column and the type (the order of the reference's fills does not change them), or taken from ``fitted``
    (column -> map of types, a fit store); undated rows are dropped last."""
    columns = {c: [x for x in names if x in df.columns] for c, names in (("medians", ["Min Delay", "Min Gap"]), ("modes", ["Vehicle"]))}
    fitted = fill_maps(df, **columns, approx=approx) if fitted is None else fitted
    return fill_with_group_stats(drop_null_date(fill_unknown(df)), **columns, fitted=fitted)
