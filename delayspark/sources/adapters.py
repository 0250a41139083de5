"""Adapters from the driver's tables to the delay data model.

The driver ships TPC-H-like tables, not delay files, so two projections map
them onto the raw shapes the delay jobs expect.  They read every row and
overwrite no value.  The tables hold no NULLs; those of the incident table
come from fields that do not parse or look up: a delay is a text with two
decimals, a gap has two digits, a stop and a vehicle number have at least
two, a bound is one of four codes, and a time on the full minute is written
without seconds.  ``delayspark.oracle`` states the same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: shapes of the fields ---------------------------------------
DELAY_TEXT = r"^(\d+\.\d\d)$"
GAP_TEXT = r"(\d\d)"
STOP_TEXT = r"(\d\d)$"
VEHICLE_TEXT = r"^(\d\d+)$"
ORDER_GAP_TEXT = r"^(\d)\d{5}\."
BOUND_CODES = {"1": "N", "3": "S", "7": "E", "9": "W"}
ORDER_YEAR_SHIFT = 21
BOUNDS = ["N", "S", "E", "W"]
ORDER_TYPES = {"F": "bus", "O": "streetcar", "P": "subway"}


def _part(text: Column, pattern: str) -> Column:
    """First group of the pattern, NULL when the text does not have it."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _bound(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(b) for b in BOUNDS]), (key % 4 + 1).cast("int"))


def incidents_events(events: DataFrame) -> DataFrame:
    """``events`` -> the 11-column standard incident table (one month of data)."""
    user = F.col("user_id").cast("string")
    gap = _part(F.col("props"), GAP_TEXT)
    codes = F.create_map(*[F.lit(x) for kv in BOUND_CODES.items() for x in kv])
    return events.select(
        F.upper(F.col("event_type")).alias("Vehicle_Type"),
        F.to_date(F.col("ts")).alias("Date"),
        user.alias("Line"),
        F.when(F.second("ts") == 0, F.date_format("ts", "HH:mm"))
         .otherwise(F.date_format("ts", "HH:mm:ss")).alias("Time"),
        F.date_format("ts", "EEEE").alias("Day"),
        F.concat(F.lit("Stop "), _part(user, STOP_TEXT)).alias("Station"),
        F.upper(F.substring(F.col("event_type"), 1, 4)).alias("Code"),
        _part(F.col("value").cast("string"), DELAY_TEXT).cast("double").alias("Min Delay"),
        gap.cast("double").alias("Min Gap"),
        F.try_element_at(codes, F.regexp_extract(F.col("props"), r"(\d)\D*$", 1)).alias("Bound"),
        _part(user, VEHICLE_TEXT).cast("bigint").alias("Vehicle"),
    )


def _order_time(k: Column, c: Column) -> Column:
    # H:mm:ss with one-digit hours before 10, as raw delay files have them.
    return F.concat((k % 24).cast("string"), F.lit(":"),
                    F.lpad((c % 60).cast("string"), 2, "0"), F.lit(":"),
                    F.lpad(((k * 7) % 60).cast("string"), 2, "0"))


def raw_delay_frames(orders: DataFrame) -> dict[str, DataFrame]:
    """``orders`` -> raw yearly delay frames per vehicle type.

    Status F/O/P become bus/streetcar/subway.  Bus and streetcar use the raw
    workbook names (Report Date, Route, Location, Incident, Direction); the
    subway frame is already aligned and carries an ``_id`` column like the
    CSV exports.  Dates arrive as text and are shifted by 21 years so the
    seven order years land around the 2017-2025 window.
    """
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    date_txt = F.date_format(F.add_months(F.to_date("o_orderdate"), 12 * ORDER_YEAR_SHIFT), "yyyy-MM-dd")
    day = F.date_format(F.add_months(F.to_date("o_orderdate"), 12 * ORDER_YEAR_SHIFT), "EEEE")
    common = {
        "date": date_txt,
        "line": F.col("o_orderpriority"),
        "time": _order_time(k, c),
        "day": day,
        "station": F.concat(F.lit("Stn "), (c % 100).cast("string")),
        "code": F.concat(F.lit("C"), (k % 50).cast("string")),
        "delay": F.round(F.col("o_totalprice") / 10000.0, 2),
        "gap": _part(F.col("o_totalprice").cast("string"), ORDER_GAP_TEXT).cast("double"),
        "bound": _bound(k),
        "vehicle": _part(c.cast("string"), VEHICLE_TEXT).cast("bigint"),
    }
    workbook_names = {"date": "Report Date", "line": "Route", "time": "Time", "day": "Day",
                      "station": "Location", "code": "Incident", "delay": "Min Delay", "gap": "Min Gap",
                      "bound": "Direction", "vehicle": "Vehicle"}
    aligned_names = {"date": "Date", "line": "Line", "time": "Time", "day": "Day", "station": "Station",
                     "code": "Code", "delay": "Min Delay", "gap": "Min Gap", "bound": "Bound",
                     "vehicle": "Vehicle"}
    out = {}
    for status, vtype in ORDER_TYPES.items():
        part = orders.where(F.col("o_orderstatus") == status)
        if vtype == "subway":
            out[vtype] = part.select(k.alias("_id"), *[common[x].alias(n) for x, n in aligned_names.items()])
        else:
            out[vtype] = part.select(*[common[x].alias(n) for x, n in workbook_names.items()])
    return out
