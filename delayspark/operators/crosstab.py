"""Year x vehicle-type imbalance reports.

The big table is aggregated once into (row key, column key, count) - at most
years x types rows - and every crosstab variant reshapes that small table.
The wide forms take their column values explicitly (nothing is collected to
find them); the long form needs none.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALL = "All"


def pair_counts(df: DataFrame, rows: str = "Year", cols: str = "Vehicle_Type") -> DataFrame:
    """(rows, cols, n) for non-null keys - the only pass over the big table."""
    return (df.where(F.col(rows).isNotNull() & F.col(cols).isNotNull())
              .groupBy(rows, cols).agg(F.count(F.lit(1)).alias("n")))


def _values(values: Sequence[str] | None) -> list[str]:
    if values is None:
        raise ValueError("name the column values, or use crosstab_long")
    return list(values)


def crosstab_counts(df: DataFrame, rows: str = "Year", cols: str = "Vehicle_Type",
                    values: Sequence[str] | None = None) -> DataFrame:
    """One row per row key, one count column per column value, 0 when empty."""
    pc = pair_counts(df, rows, cols)
    vals = _values(values)
    wide = pc.groupBy(rows).pivot(cols, vals).agg(F.sum("n"))
    return wide.na.fill(0, subset=vals).orderBy(rows)


def crosstab_margins(df: DataFrame, rows: str = "Year", cols: str = "Vehicle_Type",
                     values: Sequence[str] | None = None) -> DataFrame:
    """E10 plus an ``All`` column (row sums) and an ``All`` row (column
    sums); the row key becomes text so the margin row can be labelled."""
    pc = pair_counts(df, rows, cols)
    vals = _values(values)
    body = pc.groupBy(F.col(rows).cast("string").alias(rows)).pivot(cols, vals).agg(F.sum("n"))
    total = pc.groupBy().pivot(cols, vals).agg(F.sum("n")).select(F.lit(ALL).alias(rows), *vals)
    out = body.unionByName(total).na.fill(0, subset=vals)
    out = out.withColumn(ALL, reduce(lambda a, b: a + b, [F.col(v) for v in vals]))
    return out.orderBy(F.when(F.col(rows) == ALL, 1).otherwise(0), rows)


def crosstab_row_pct(df: DataFrame, rows: str = "Year", cols: str = "Vehicle_Type",
                     values: Sequence[str] | None = None) -> DataFrame:
    """Each row divided by its sum, in percent."""
    counts = crosstab_counts(df, rows, cols, values)
    vals = [c for c in counts.columns if c != rows]
    tot = reduce(lambda a, b: a + b, [F.col(v) for v in vals])
    return counts.select(rows, *[(F.col(v) / tot * 100.0).alias(v) for v in vals])


def crosstab_long(df: DataFrame, rows: str = "Year", cols: str = "Vehicle_Type") -> DataFrame:
    """Long form of E10/E12: (rows, cols, count, row_pct) for present pairs."""
    pc = pair_counts(df, rows, cols)
    return pc.select(rows, cols, F.col("n").alias("count"),
                     (F.col("n") / F.sum("n").over(Window.partitionBy(rows)) * 100.0).alias("row_pct"))


def cv_by_year(df: DataFrame, rows: str = "Year", cols: str = "Vehicle_Type", alias: str = "cv") -> DataFrame:
    """Per row key, sample std / mean of the counts of the column values
    present in that row (one value only: NULL)."""
    pc = pair_counts(df, rows, cols)
    return (pc.groupBy(rows).agg(F.try_divide(F.stddev_samp("n"), F.avg("n")).alias(alias))
              .orderBy(rows))
