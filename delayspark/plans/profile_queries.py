"""The whole profile (M5) as one job over the event incidents: all reports in long form, fits shared through a store."""

from __future__ import annotations

from ..registry import ORACLE, register
from ..schema import CORR_APPENDIX, CORR_FEATURES, NORMALISATION_FEATURES, PROCESSED_COLUMNS
from ..sources import sinks as SK
from . import incident_queries as IQ
from . import pipelines as PL


def _long(report: str, body: str, keys: list[str], numbers: list[str]) -> str:
    """Rows (report, item, figure, value) of a report's SQL."""
    item = " || '|' || ".join(f"coalesce(CAST(\"{k}\" AS VARCHAR), '-')" for k in keys) or "''"
    return " UNION ALL ".join(
        f"SELECT '{report}' AS report, {item} AS item, '{n}' AS figure, "
        + (f'round(CAST("{n}" AS DOUBLE) * 1e6) / 1e6 + 0.0' if n else "CAST(NULL AS DOUBLE)") + f" AS value FROM ({body})"
        for n in numbers or [""])


def _on_proc(select: str) -> str:
    return IQ.sql(["proc"], select)


_TYPE = {"i": "int", "d": "double", "s": "string"}
_NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"Column\", '{ {'Vehicle': 'bigint', 'Date': 'date'}.get(c, _TYPE[IQ.O.PROC_KINDS[c]]) }' AS \"Data_Type\", "
    f'count(*) FILTER ("{c}" IS NULL) AS mc, count(*) AS n FROM proc' for c in PROCESSED_COLUMNS)
_PAIRS = '(SELECT "Year", "Vehicle_Type", count(*) AS n FROM proc WHERE "Year" IS NOT NULL AND "Vehicle_Type" IS NOT NULL GROUP BY 1, 2)'
_CROSS = _on_proc(f'SELECT "Year", "Vehicle_Type", n AS "count", n / sum(n) OVER (PARTITION BY "Year") * 100.0 AS row_pct FROM {_PAIRS}')
_SIZES = '(SELECT "Year", count(*) AS n FROM proc WHERE "Year" IS NOT NULL GROUP BY 1)'
_MEANS = {"by_month": ("mean_delay_by_month", "Month"), "by_day": ("reindex_days", "DayName"), "by_hour": ("mean_delay_by_hour", "Hour"),
          "by_type": ("mean_delay_by_type", "Vehicle_Type")}
_REPORTS = [
    ("describe_target", ORACLE["describe_target"], ["statistic"], ["value"]),
    ("delay_categories", ORACLE["value_counts_cat"], ["Delay_Category"], ["count"]),
    ("delay_category_pct", ORACLE["value_pct_nonnull"], ["Delay_Category"], ["count", "pct"]),
    ("vehicle_types", ORACLE["value_counts"], ["Vehicle_Type"], ["count"]),
    ("vehicle_type_pct", ORACLE["value_pct_rows"], ["Vehicle_Type"], ["count", "pct"]),
    ("normalisation", IQ._norm_sql(NORMALISATION_FEATURES, "proc"), ["Feature", "Needs_Normalization"], ["Mean", "Std", "Min", "Max", "Range", "CV"]),
    ("crosstab", _CROSS, ["Year", "Vehicle_Type"], ["count", "row_pct"]),
    ("crosstab_pct", _CROSS, ["Year", "Vehicle_Type"], ["count", "row_pct"]),
    ("year_sizes", _on_proc(f'SELECT "Year", n AS "count" FROM {_SIZES}'), ["Year"], ["count"]),
    ("extremes", _on_proc('SELECT max(n) AS max_count, min(n) AS min_count, max(n) * 1.0 / min(n) AS max_min_ratio, arg_max("Year", n * 100000 - "Year") '
                          f'AS key_of_max, arg_min("Year", n * 100000 + "Year") AS key_of_min FROM {_SIZES}'), [],
     ["max_count", "min_count", "max_min_ratio", "key_of_max", "key_of_min"]),
    ("growth", _on_proc('SELECT "Year", n AS "count", (n - lag(n) OVER (ORDER BY "Year")) / lag(n) OVER (ORDER BY "Year") * 100.0 AS growth_pct '
                        f'FROM {_SIZES}'), ["Year"], ["count", "growth_pct"]),
    ("cv_by_year", _on_proc(f'SELECT "Year", stddev_samp(n) / avg(n) AS cv FROM {_PAIRS} GROUP BY 1'), ["Year"], ["cv"]),
    ("correlation", IQ._corr_sql(CORR_FEATURES, "proc"), ["feature_a", "feature_b"], ["corr"]),
    ("correlation_target", IQ._corr_sql(CORR_FEATURES, "proc", "Min Delay"), ["feature"], ["corr"]),
    ("correlation_appendix", IQ._corr_sql(CORR_APPENDIX, "proc"), ["feature_a", "feature_b"], ["corr"]),
    *[(report, ORACLE[query], [key], ["mean_delay"]) for report, (query, key) in _MEANS.items()],
    ("histogram", ORACLE["histogram"], ["bin"], ["bin_lo", "bin_hi", "count"]),
    ("date_range", _on_proc('SELECT min("Date") AS min_date, max("Date") AS max_date FROM proc'), ["min_date", "max_date"], []),
    ("missing", _on_proc(f'SELECT "Column", "Data_Type", mc AS "Missing_Count", mc / n * 100.0 AS "Missing_Percentage" FROM ({_NULLS}) WHERE mc > 0'),
     ["Column", "Data_Type"], ["Missing_Count", "Missing_Percentage"]),
]


@register("profile", " UNION ALL ".join(_long(*r) for r in _REPORTS))
def q_profile(spark, sf):
    """M5: all reports over the processed table, as long rows; every fit is run once, into a store."""
    return PL.profile_figures(IQ.events_unified(spark, sf), SK.scratch_path(spark, "fits"))
