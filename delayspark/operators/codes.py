"""Delay code dimension (A8 data, D6, I33).

The code lists are small per vehicle type but are joined through a checked
broadcast like every other dimension, never by an unchecked hint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.catalogue import repair_mojibake
from .stats import checked_broadcast


def code_dimension(lists: dict[str, DataFrame], repair: bool = True) -> DataFrame:
    """(Vehicle_Type, Code, Description) from per-type code lists
    (_id, CODE, DESCRIPTION); repeated codes keep the lowest ``_id`` and
    double-encoded descriptions are repaired."""
    parts = []
    for vtype, df in lists.items():
        d = df.groupBy(F.trim("CODE").alias("Code")).agg(F.min_by("DESCRIPTION", "_id").alias("Description"))
        if repair:
            d = d.withColumn("Description", repair_mojibake("Description"))
        parts.append(d.select(F.lit(vtype.upper()).alias("Vehicle_Type"), "Code", "Description"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def describe_code(incidents: DataFrame, codes: DataFrame) -> DataFrame:
    """Attach the code description for the incident's vehicle type
    (NULL when the code is unknown)."""
    small = checked_broadcast(codes.select("Vehicle_Type", "Code", "Description"))
    return incidents.join(small, ["Vehicle_Type", "Code"], "left")
