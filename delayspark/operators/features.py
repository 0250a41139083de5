"""Feature engineering of the incident table (M3) and the category code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features as fx
from ..functions import temporal as tx
from ..session import cut_lineage
from . import fits
from .stats import checked_broadcast


def add_temporal(df: DataFrame, date_col: str = "Date", time_col: str = "Time") -> DataFrame:
    """Calendar parts of Date, Hour and Minute of a strict H:M:S Time."""
    cols = tx.temporal_columns(date_col)
    t = tx.parse_time(F.col(time_col)) if time_col in df.columns else F.lit(None).cast("timestamp")
    cols["Hour"] = F.hour(t)
    cols["Minute"] = F.minute(t)
    return df.withColumns(cols)


def add_cyclical(df: DataFrame) -> DataFrame:
    """sin/cos of Hour (24), DayOfWeek (7) and Month (12)."""
    out = {}
    for name, period in (("Hour", 24), ("DayOfWeek", 7), ("Month", 12)):
        s, c = fx.cyclical(name, period)
        out[f"{name}_sin"], out[f"{name}_cos"] = s, c
    return df.withColumns(out)


def add_flags(df: DataFrame) -> DataFrame:
    """Weekend, rush, peak and night flags (NULL hour gives 0)."""
    return df.withColumns({
        "IsWeekend": fx.is_weekend("DayOfWeek"),
        "IsRushHour": fx.is_rush_hour("Hour"),
        "IsPeakHour": fx.is_peak_hour("Hour"),
        "IsNight": fx.is_night("Hour"),
    })


def category_code(col: str, values: Column) -> Column:
    """Place of the value in the sorted ``values``, from 0; NULL gets -1."""
    return F.coalesce(F.array_position(values, F.col(f"`{col}`")) - 1, F.lit(-1)).cast("int")


def category_codes(df: DataFrame, col: str = "Vehicle_Type", alias: str | None = None, lookup: str = "map",
                   fitted: Column | None = None) -> DataFrame:
    """code of each value in alphabetical order from 0; NULL gets -1.

    The sorted distinct values are a bounded list of the plan (a scalar subquery, or ``fitted``), so that nothing is
    fitted for a code that is not read.  With ``lookup="join"``, for any number of values, they are ranked by a
    range-partitioned sort and joined through a checked broadcast.  The big table is not sorted."""
    alias = alias or f"{col}_Encoded"
    if lookup == "map":
        return df.withColumn(alias, category_code(col, fits.sorted_values(df, col) if fitted is None else fitted))
    values = cut_lineage(df.select(F.col(col).alias("__cat")).where(F.col("__cat").isNotNull()).distinct()
                         .sort("__cat").withColumn("__id", F.monotonically_increasing_id()))
    # the sort is range-partitioned: position in the partition plus the rows of those before
    part = F.shiftright("__id", 33)
    before = (values.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
              .withColumn("__before", F.coalesce(F.sum("__n").over(
                  Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    codes = (values.withColumn("__part", part).join(F.broadcast(before), "__part")
             .select("__cat", (F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before")).alias("__code")))
    small = checked_broadcast(codes)
    out = df.join(small, F.col(col) == F.col("__cat"), "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns],
                      F.coalesce(F.col("__code"), F.lit(-1)).cast("int").alias(alias))


def add_features(df: DataFrame, include_zero_delay: bool = False, encode: bool = True, fitted: Column | None = None) -> DataFrame:
    """M3: temporal, cyclical, flags, Season, Delay_Ratio, Vehicle_Type_Encoded
    and Delay_Category in one projection, as far as their inputs are there; ``fitted`` gives the sorted
    vehicle types from elsewhere."""
    out = add_calendar(df)
    rows = amount_features(df.columns, include_zero_delay)
    out = out.withColumns(rows) if rows else out
    return category_codes(out, "Vehicle_Type", fitted=fitted) if encode else out


def add_calendar(df: DataFrame) -> DataFrame:
    """The features of date and time: calendar parts, cyclical encodings, flags, Season."""
    return add_flags(add_cyclical(add_temporal(df))).withColumns({"Season": fx.season("Month")})


def amount_features(columns, include_zero_delay: bool = False) -> dict[str, Column]:
    """Delay_Category and Delay_Ratio, as far as their inputs are among ``columns``."""
    rows = {}
    if "Min Delay" in columns:
        rows["Delay_Category"] = fx.delay_category("Min Delay", include_zero_delay)
        if "Min Gap" in columns:
            rows["Delay_Ratio"] = fx.delay_ratio()
    return rows
