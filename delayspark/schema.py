"""Schemas and fixed values of the delay and catalogue data model.

The lists below are fixed values: results depend on them being exactly these
names, labels and numbers, in this order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: standard incident schema (column order matters) ---------
STANDARD_COLUMNS = [
    "Vehicle_Type", "Date", "Line", "Time", "Day", "Station",
    "Code", "Min Delay", "Min Gap", "Bound", "Vehicle",
]

# --- fixed values: bus / streetcar raw names -> standard names -------------
RAW_RENAMES = {
    "Report Date": "Date",
    "Route": "Line",
    "Location": "Station",
    "Incident": "Code",
    "Direction": "Bound",
}
RENAMED_TYPES = ("bus", "streetcar")

# --- fixed values: texts that mean "no value" in a CSV export ---------------
MISSING_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                 "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# --- fixed values: columns of the saved processed table, in order ----------
PROCESSED_COLUMNS = [
    "Vehicle_Type", "Date", "Time", "Day", "Line", "Station", "Code", "Bound", "Vehicle",
    "Min Delay", "Min Gap",
    "Year", "Month", "DayOfWeek", "DayName", "DayOfMonth", "WeekOfYear", "Hour", "Minute",
    "Hour_sin", "Hour_cos", "DayOfWeek_sin", "DayOfWeek_cos", "Month_sin", "Month_cos",
    "IsWeekend", "IsRushHour", "IsPeakHour", "IsNight",
    "Season", "Delay_Ratio",
    "Min_Delay_Log", "Min_Gap_Scaled", "Vehicle_Scaled", "Delay_Ratio_Scaled",
    "Vehicle_Type_Encoded", "Delay_Category",
]

# --- fixed values: delay category bins (left-open, right-closed) and labels --
DELAY_BINS = [0.0, 5.0, 15.0, 30.0, float("inf")]
DELAY_LABELS = ["Low (0-5min)", "Medium (5-15min)", "High (15-30min)", "Very High (30+min)"]

# --- fixed values: hour windows (inclusive) of the time-of-day flags -------
RUSH_HOURS = [(7, 9), (17, 19)]
PEAK_HOURS = [(6, 10), (15, 20)]
NIGHT_HOURS = [(22, 23), (0, 5)]

# --- fixed values: seasons by month (inclusive); every other month is Winter
SEASONS = [("Spring", 3, 5), ("Summer", 6, 8), ("Fall", 9, 11)]
DEFAULT_SEASON = "Winter"

# --- fixed values: weekday order used for day-name reports -----------------
DAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# --- fixed values: numeric columns of the profile reports ------------------
NORMALISATION_FEATURES = ["Min Delay", "Min Gap", "Vehicle", "Hour", "Delay_Ratio"]
NORMALISATION_FEATURES_SHORT = ["Min Delay", "Min Gap", "Vehicle", "Hour"]
CORR_FEATURES = [
    "Min Delay", "Min_Delay_Log", "Min_Gap_Scaled", "Delay_Ratio_Scaled",
    "Hour_sin", "Hour_cos", "DayOfWeek_sin", "DayOfWeek_cos",
    "IsWeekend", "IsRushHour", "IsPeakHour", "IsNight", "Year", "Month",
]
CORR_APPENDIX = ["Min Delay", "Min Gap", "Year", "Month", "DayOfWeek", "Hour", "Vehicle"]
UNKNOWN_FILL_COLUMNS = ["Bound", "Line", "Station"]
UNKNOWN = "Unknown"
YEAR_RANGE = (2017, 2025)

# --- fixed values: catalogue defaults ---------------------------------------
PORTAL_BASE = "https://open.toronto.ca"
DEFAULT_DATASET_TYPE = "Table"
LIST_SEPARATOR = " | "
REFRESH_KEYS = ["refresh_rate", "update_frequency", "frequency"]
MODIFIED_KEYS = ["date_modified", "metadata_modified"]
LAST_REFRESHED_FORMAT = "MMM dd, yyyy"

# --- fixed values: link and file-name rules ----------------------------------
STRICT_LINK_WORDS = ["xlsx", "csv", "json", "xml", "dataset"]
LENIENT_LINK_WORDS = ["xlsx", "csv", "json", "xml", "dataset", "format", "kb", "mb"]
DATA_EXTENSIONS = ["xlsx", "csv", "json", "xml"]
DEFAULT_EXTENSION = "xlsx"
FILENAME_PATTERN = r"(?i)Download\s+(.+?)\s+(?:dataset|in)"
FILENAME_PATTERN_DATASET = r"(?i)Download\s+(.+?)\s+dataset"

# --- fixed values: quality panel labels --------------------------------------
QUALITY_LABELS = ["Freshness", "Metadata", "Accessibility", "Completeness", "Usability"]
OVERALL_LABEL = "Overall score"
PERCENT_AFTER = r"[:\s]+(\d+)%"
GRADE = r"Grade[:\s]+([A-Za-z]+)"
LAST_REFRESHED = r"Last refreshed[:\s]+([^\n]+)"
FIRST_PERCENT = r"(\d+)%"

# --- fixed values: catalogue card labels --------------------------------------
CARD_LABELS = {
    "refresh_rate": "Refresh Rate",
    "last_refreshed": "Last Refreshed",
    "publisher": "Publisher",
    "type": "Type",
    "formats": "Formats",
    "topics": "Topics",
}

INCIDENT_SCHEMA = T.StructType([
    T.StructField("Vehicle_Type", T.StringType(), False),
    T.StructField("Date", T.DateType()),
    T.StructField("Line", T.StringType()),
    T.StructField("Time", T.StringType()),
    T.StructField("Day", T.StringType()),
    T.StructField("Station", T.StringType()),
    T.StructField("Code", T.StringType()),
    T.StructField("Min Delay", T.DoubleType()),
    T.StructField("Min Gap", T.DoubleType()),
    T.StructField("Bound", T.StringType()),
    T.StructField("Vehicle", T.LongType()),
])

# Schema of one landed CKAN search page (package_search result).
CKAN_DATASET = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("metadata_modified", T.StringType()),
    T.StructField("license_title", T.StringType()),
    T.StructField("license_id", T.StringType()),
    T.StructField("organization", T.StructType([T.StructField("title", T.StringType())])),
    T.StructField("groups", T.ArrayType(T.StructType([T.StructField("title", T.StringType())]))),
    T.StructField("tags", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
    T.StructField("extras", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))),
    T.StructField("resources", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("last_modified", T.StringType()),
        T.StructField("created", T.StringType()),
    ]))),
])
CKAN_PAGE = T.StructType([
    T.StructField("success", T.BooleanType()),
    T.StructField("result", T.StructType([
        T.StructField("count", T.LongType()),
        T.StructField("results", T.ArrayType(CKAN_DATASET)),
    ])),
])

FIELD_STRUCT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("info", T.StructType([T.StructField("notes", T.StringType())])),
])
