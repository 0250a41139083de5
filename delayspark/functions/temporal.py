"""Date and time column functions (all JVM-side, codegen friendly).

ANSI mode is on by default in Spark 4, so every parse goes through the
``try_`` variants: a bad value becomes NULL instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Formats tried in order when a date arrives as text (first match wins).
DATE_FORMATS = [
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd-MMM-yy",
]

# Strict H:M:S: one-digit hours pass, HH:MM, fractions and 24:00:00 do not.
TIME_FORMAT = "H:m:s"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_date(col, formats: list[str] | None = None, dtype: T.DataType | None = None) -> Column:
    """Parse to DATE; unparseable or empty gives NULL.

    If the column is already a date/timestamp (``dtype`` given), it is only
    truncated to a date.
    """
    c = _c(col)
    if dtype is not None and not isinstance(dtype, T.StringType):
        return F.to_date(c)
    s = F.nullif(F.trim(c.cast("string")), F.lit(""))
    parsed = [F.try_to_timestamp(s, F.lit(f)) for f in (formats or DATE_FORMATS)]
    return F.to_date(F.coalesce(*parsed))


def parse_time(col, fmt: str = TIME_FORMAT) -> Column:
    """Parse a time-of-day string to a timestamp (date part meaningless)."""
    return F.try_to_timestamp(_c(col).cast("string"), F.lit(fmt))


def hour_of(col, fmt: str = TIME_FORMAT) -> Column:
    return F.hour(parse_time(col, fmt))


def minute_of(col, fmt: str = TIME_FORMAT) -> Column:
    return F.minute(parse_time(col, fmt))


def parses(col, fmt: str | None = None) -> Column:
    """1.0 when the value parses as a date (or with ``fmt``), else 0.0."""
    parsed = parse_time(col, fmt) if fmt else parse_date(col)
    return F.when(parsed.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))


def temporal_columns(date_col: str = "Date") -> dict[str, Column]:
    """Calendar parts of a date: Year, Month, DayOfWeek (0 = Monday), DayName,
    DayOfMonth and ISO WeekOfYear."""
    d = F.col(date_col)
    return {
        "Year": F.year(d),
        "Month": F.month(d),
        "DayOfWeek": F.weekday(d),
        "DayName": F.date_format(d, "EEEE"),
        "DayOfMonth": F.dayofmonth(d),
        "WeekOfYear": F.weekofyear(d),
    }
