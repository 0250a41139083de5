"""Schema conform, union, year filter and ordering of raw delay frames (M1)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.temporal import parse_date
from ..schema import MISSING_TEXTS, INCIDENT_SCHEMA, RAW_RENAMES, RENAMED_TYPES, STANDARD_COLUMNS, YEAR_RANGE


def select_available(df: DataFrame, columns: Sequence[str] = STANDARD_COLUMNS) -> DataFrame:
    """Ordered projection of the listed columns that exist."""
    return df.select(*[F.col(c) for c in columns if c in df.columns])


def drop_id(df: DataFrame) -> DataFrame:
    """B2: drop ``_id`` if present (no-op otherwise)."""
    return df.drop("_id")


def route_fallback(df: DataFrame) -> DataFrame:
    """A frame with ``Route`` but no ``Line`` gets Line = Route."""
    if "Line" not in df.columns and "Route" in df.columns:
        return df.withColumn("Line", F.col("Route"))
    return df


def conform(df: DataFrame, vehicle_type: str, typed: bool = False, fallback: bool = False) -> DataFrame:
    """B1: rename the workbook names (bus, streetcar), drop ``_id``, add the
    upper-cased type and keep the available standard columns in order.

    With ``typed`` the columns are also cast to the standard types with
    ``try_cast`` (bad values become NULL; Date is parsed from text)."""
    out = df
    if vehicle_type.lower() in RENAMED_TYPES:
        out = out.withColumnsRenamed({k: v for k, v in RAW_RENAMES.items() if k in out.columns})
    out = drop_id(out)
    if fallback:
        out = route_fallback(out)
    out = out.withColumn("Vehicle_Type", F.lit(vehicle_type.upper()))
    out = select_available(out)
    if typed:
        out = cast_standard(out)
    return out


def cast_standard(df: DataFrame) -> DataFrame:
    """Cast the present standard columns to the standard types (try_cast).

    Texts that mean "no value" (``MISSING_TEXTS``) are NULL in every column, and so are numbers that
    are not finite."""
    types = {f.name: f.dataType for f in INCIDENT_SCHEMA.fields}
    text = [f.name for f in df.schema.fields if f.name in types and isinstance(f.dataType, T.StringType)]
    df = df.withColumns({c: F.when(~F.trim(F.col(f"`{c}`")).isin(MISSING_TEXTS), F.col(f"`{c}`")) for c in text})
    cols = []
    for f in df.schema.fields:
        want = types.get(f.name)
        if want is None or f.dataType == want:
            cols.append(F.col(f"`{f.name}`"))
        elif f.name == "Date":
            cols.append(parse_date(F.col(f.name), dtype=f.dataType).alias(f.name))
        elif isinstance(want, T.StringType):
            cols.append(F.col(f.name).cast("string").alias(f.name))
        elif isinstance(want, T.LongType) and isinstance(f.dataType, T.StringType):
            # "8001.0" (an integer column exported with NaNs) is still 8001
            c = F.col(f"`{f.name}`")
            cols.append(F.coalesce(c.try_cast(want), c.try_cast("double").try_cast(want)).alias(f.name))
        else:
            c = F.col(f"`{f.name}`").try_cast(want)
            cols.append((_finite(c) if isinstance(want, T.DoubleType) else c).alias(f.name))
    return df.select(*cols)


def _finite(c):
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def schema_profile(spark, frames: dict[str, DataFrame], standard: Sequence[str] = STANDARD_COLUMNS) -> DataFrame:
    """Column list and type of every source, and the standard name each
    column maps to (NULL when it is dropped).  Built from the frames'
    schemas only - no data is read."""
    rows = []
    for source, df in frames.items():
        renames = RAW_RENAMES if source.lower() in RENAMED_TYPES else {}
        for i, f in enumerate(df.schema.fields):
            target = renames.get(f.name, f.name)
            rows.append((source, i, f.name, f.dataType.simpleString(), target if target in standard else None))
    return spark.createDataFrame(rows, "source string, position int, column string, dtype string, standard string")


def union_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    """H1: row concatenation by column name; absent columns are NULL and the
    column order is that of first appearance."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), list(frames))


def scan_split_period(df: DataFrame, year: int, date_col: str = "Date") -> DataFrame:
    """A4: a file spanning several years contributes only ``year`` rows.

    Written as a date range so it prunes row groups / partitions."""
    d = parse_date(F.col(date_col), dtype=df.schema[date_col].dataType)
    return df.where((d >= F.make_date(F.lit(year), F.lit(1), F.lit(1))) &
                    (d < F.make_date(F.lit(year + 1), F.lit(1), F.lit(1))))


def filter_year_range(df: DataFrame, lo: int = YEAR_RANGE[0], hi: int = YEAR_RANGE[1],
                      date_col: str = "Date") -> DataFrame:
    """Keep rows whose date falls in [lo, hi] (inclusive years); NULL dates
    drop out.  Expressed as a date range so Parquet statistics can prune."""
    d = F.col(date_col)
    return df.where((d >= F.make_date(F.lit(lo), F.lit(1), F.lit(1))) &
                    (d < F.make_date(F.lit(hi + 1), F.lit(1), F.lit(1))))


def sort_by_date(df: DataFrame, date_col: str = "Date") -> DataFrame:
    """G1: global order by date; remaining columns break ties so the output is
    deterministic (a range-partitioned sort, no single-task step)."""
    rest = [F.col(c).asc_nulls_first() for c in df.columns if c != date_col]
    return df.orderBy(F.col(date_col).asc_nulls_first(), *rest)


def unify(frames: dict[str, DataFrame | list[DataFrame]], lo: int = YEAR_RANGE[0],
          hi: int = YEAR_RANGE[1], split_period: dict[str, int] | None = None,
          sort: bool = True) -> DataFrame:
    """M1: conform every frame to the 11-column schema, union, parse dates,
    keep [lo, hi] years and sort by date.

    ``frames`` maps a vehicle type to one frame or a list of yearly frames;
    ``split_period`` maps a type to a year whose frames keep only that year
    (filter applied per frame, below the union)."""
    parts = []
    for vtype, items in frames.items():
        for f in (items if isinstance(items, list) else [items]):
            g = conform(f, vtype, typed=True, fallback=True)
            if split_period and vtype in split_period:
                g = scan_split_period(g, split_period[vtype])
            parts.append(g)
    out = filter_year_range(union_by_name(parts), lo, hi)
    return sort_by_date(out) if sort else out
