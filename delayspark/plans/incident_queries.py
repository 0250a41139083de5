"""Registered queries of the delay pipeline (sections A-I of the inventory).

Inputs: ``events`` (one month of incidents) and ``orders`` (seven years of
incidents over three vehicle types), both through the adapters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import oracle as O
from ..functions import temporal as tx
from ..functions import features as fx
from ..operators import clean as C
from ..operators import conform as B
from ..operators import crosstab as X
from ..operators import profile as P
from ..operators import scaling as S
from ..operators.features import add_features, category_codes
from ..registry import register
from ..schema import CORR_APPENDIX, CORR_FEATURES, NORMALISATION_FEATURES, PROCESSED_COLUMNS
from ..session import read_table
from . import pipelines as PL
from ..sources import files as FS
from ..sources.adapters import incidents_events, raw_delay_frames

TYPES = ["BUS", "STREETCAR", "SUBWAY"]


# --- layers -------------------------------------------------------------------
def events_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return incidents_events(read_table(spark, sf, "events"))


def events_unified(spark, sf):
    return B.filter_year_range(events_incidents(spark, sf))


def events_clean(spark, sf):
    return C.clean(events_unified(spark, sf))


def events_features(spark, sf):
    return PL.clean_and_feature(events_unified(spark, sf))


def events_processed(spark, sf, *columns):
    """The processed table, or those of its columns that a report reads."""
    return PL.processed_table(events_unified(spark, sf), columns=columns or PROCESSED_COLUMNS)


def events_raw_features(spark, sf):
    """Row-wise features only: no report on them reads the category code."""
    return add_features(events_unified(spark, sf), encode=False)


def order_frames(spark, sf):
    return raw_delay_frames(read_table(spark, sf, "orders"))


def orders_union(spark, sf):
    """Conformed, typed union of the three raw frames (no date filter)."""
    return B.union_by_name([B.conform(f, t, typed=True) for t, f in order_frames(spark, sf).items()])


def orders_unified(spark, sf):
    return B.unify(order_frames(spark, sf), sort=False)


def orders_with_year(spark, sf):
    return orders_unified(spark, sf).withColumn("Year", F.year("Date"))


def sql(layers, final, extra=None):
    return O.with_layers(layers, final, extra)


def out(cols, src, tail=""):
    return O.select_out(cols, src, tail)


STD = list(O.STD_KINDS)
STD_COLS = O.cols_of(STD, O.STD_KINDS)


# --- E17 / D5: mean delay by key -----------------------------------------------
def _mean_by_sql(key, kind, src="proc"):
    return sql([src], out([(key, kind), ("mean_delay", "d")],
                          f'(SELECT "{key}", round(avg("Min Delay"), 9) AS mean_delay FROM {src} '
                          f'WHERE "{key}" IS NOT NULL GROUP BY 1)'))


@register("mean_delay_by_hour", _mean_by_sql("Hour", "i"))
def q_mean_by_hour(spark, sf):
    """Mean delay per hour of the processed table (the flagship)."""
    return P.mean_by_key(events_processed(spark, sf, "Hour", "Min Delay"), "Hour")


@register("mean_delay_by_month", _mean_by_sql("Month", "i"))
def q_mean_by_month(spark, sf):
    return P.mean_by_key(events_processed(spark, sf, "Month", "Min Delay"), "Month")


@register("mean_delay_by_type", _mean_by_sql("Vehicle_Type", "s"))
def q_mean_by_type(spark, sf):
    return P.mean_by_key(events_processed(spark, sf, "Vehicle_Type", "Min Delay"), "Vehicle_Type")


_DAYS = ", ".join(f"('{d}', {i})" for i, d in enumerate(
    ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]))


@register("reindex_days", sql(["proc"], out([("DayName", "s"), ("mean_delay", "d")],
          f'(SELECT d."DayName", m.mean_delay FROM (VALUES {_DAYS}) d("DayName", o) LEFT JOIN '
          f'(SELECT "DayName", round(avg("Min Delay"), 9) AS mean_delay FROM proc WHERE "DayName" IS NOT NULL '
          f'GROUP BY 1) m ON d."DayName" = m."DayName")')))
def q_reindex_days(spark, sf):
    """D5 (+E17): mean delay Monday..Sunday; absent days NULL."""
    return P.reindex_days(P.mean_by_key(events_processed(spark, sf, "DayName", "Min Delay"), "DayName"))


# --- M2-M4 / A10 / B4: processed table -----------------------------------------
@register("processed_table", sql(["proc"], out(O.cols_of(PROCESSED_COLUMNS, O.PROC_KINDS), "proc")))
def q_processed(spark, sf):
    """M2+M3+M4 and B4: the 37-column processed incident table."""
    return events_processed(spark, sf)


_FEAT_SAVED = [c for c in PROCESSED_COLUMNS if c in O.FEAT_KINDS]


@register("select_available", sql(["rfeat"], out(O.cols_of(_FEAT_SAVED, O.FEAT_KINDS), "rfeat")))
def q_select_available(spark, sf):
    """Ordered projection of the saved columns that exist (no scaled ones yet)."""
    return B.select_available(add_features(events_unified(spark, sf)), PROCESSED_COLUMNS)


# --- E1 / E2: missing values ------------------------------------------------------
_SPARK_TYPES = {"Vehicle_Type": "string", "Date": "date", "Line": "string", "Time": "string",
                "Day": "string", "Station": "string", "Code": "string", "Min Delay": "double",
                "Min Gap": "double", "Bound": "string", "Vehicle": "bigint"}
_MISS_UNION = " UNION ALL ".join(
    f"SELECT '{c}' AS \"Column\", count(*) FILTER (WHERE \"{c}\" IS NULL) AS mc, count(*) AS n, "
    f"'{t}' AS \"Data_Type\" FROM uni" for c, t in _SPARK_TYPES.items())


@register("missing_profile", sql(["uni"], out(
    [("Column", "s"), ("Missing_Count", "i", "mc"), ("Missing_Percentage", "d", "mc / n * 100.0"),
     ("Data_Type", "s")], f"({_MISS_UNION})", "WHERE mc > 0")))
def q_missing_profile(spark, sf):
    """E1 + C3: columns with NULLs, count, percent, type."""
    return C.missing_profile(events_unified(spark, sf))


_MISS_TOTAL = " + ".join(f'count(*) FILTER (WHERE "{c}" IS NULL)' for c in _SPARK_TYPES)


@register("missing_total", sql(["uni"], out(
    [("Total_Missing", "i", "tm"), ("Rows", "i", "n"), ("Columns", "i", "11"),
     ("Missing_Percentage", "d", "tm / (n * 11) * 100.0")],
    f"(SELECT {_MISS_TOTAL} AS tm, count(*) AS n FROM uni)")))
def q_missing_total(spark, sf):
    """Total NULL cells and their share."""
    return C.missing_total(events_unified(spark, sf))


# --- E3 / E4 / D1 / I15-I17 / C2: cleaning -------------------------------------------
@register("mode_by_type", sql(["uni", "vmode"], out([("Vehicle_Type", "s"), ("mode", "i")],
          '(SELECT t."Vehicle_Type", coalesce(v.vm, 0) AS mode FROM (SELECT DISTINCT "Vehicle_Type" FROM uni) t '
          'LEFT JOIN vmode v ON t."Vehicle_Type" = v."Vehicle_Type")')))
def q_mode_by_type(spark, sf):
    """Most frequent vehicle per type (ties: smallest; none: 0)."""
    from ..operators.stats import mode_by_type
    return mode_by_type(events_unified(spark, sf), "Vehicle", "Vehicle_Type")


@register("median_by_type", sql(["uni", "meds"], out(
    [("Vehicle_Type", "s"), ("median_delay", "d", "md"), ("median_gap", "d", "mg")], "meds")))
def q_median_by_type(spark, sf):
    """Interpolated medians of Min Delay and Min Gap per type."""
    from ..operators.stats import median_by_type
    df = events_unified(spark, sf)
    return (median_by_type(df, "Min Delay", alias="median_delay")
            .join(median_by_type(df, "Min Gap", alias="median_gap"), "Vehicle_Type"))


@register("fill_unknown", sql(["fill1"], out(STD_COLS, "fill1")))
def q_fill_unknown(spark, sf):
    """Bound, Line, Station NULL -> 'Unknown'."""
    return C.fill_unknown(events_unified(spark, sf))


@register("fill_vehicle_mode", sql(["uni", "vmode"], out(
    [c if c[0] != "Vehicle" else ("Vehicle", "i", 'coalesce(u."Vehicle", v.vm, 0)') for c in
     [(n, k, f'u."{n}"') for n, k in STD_COLS]],
    'uni u LEFT JOIN vmode v ON u."Vehicle_Type" = v."Vehicle_Type"')))
def q_fill_vehicle_mode(spark, sf):
    """I16 (E3 + D1): NULL vehicle -> mode of its type."""
    return C.fill_vehicle_mode(events_unified(spark, sf))


_MED_FILL = {"Min Delay": 'coalesce(u."Min Delay", m.md)', "Min Gap": 'coalesce(u."Min Gap", m.mg)'}


@register("fill_median", sql(["uni", "meds"], out(
    [(n, k, _MED_FILL.get(n, f'u."{n}"')) for n, k in STD_COLS],
    'uni u LEFT JOIN meds m ON u."Vehicle_Type" = m."Vehicle_Type"')))
def q_fill_median(spark, sf):
    """I17 (E4 + D1): NULL Min Delay / Min Gap -> median of its type."""
    return C.fill_median(events_unified(spark, sf))


@register("fill_from_group_stat", sql(["uni"], out(
    [(n, k, f'u."{n}"' if n != "Min Gap" else 'coalesce(u."Min Gap", m.g)') for n, k in STD_COLS],
    'uni u LEFT JOIN (SELECT "Vehicle_Type", avg("Min Gap") AS g FROM uni GROUP BY 1) m '
    'ON u."Vehicle_Type" = m."Vehicle_Type"')))
def q_fill_from_group_stat(spark, sf):
    """NULL Min Gap -> mean gap of its type (generic group-statistic fill)."""
    from ..operators.stats import fill_from_group_stat
    df = events_unified(spark, sf)
    stat = df.groupBy("Vehicle_Type").agg(F.avg("Min Gap").alias("stat"))
    return fill_from_group_stat(df, "Min Gap", stat)


@register("clean", sql(["cln"], out(STD_COLS, "cln")))
def q_clean(spark, sf):
    """M2: the cleaned incident table."""
    return events_clean(spark, sf)


@register("drop_null_date", sql(["ordinc"], out(STD_COLS, "ordinc", 'WHERE "Date" IS NOT NULL')))
def q_drop_null_date(spark, sf):
    """Rows with an unparseable date removed."""
    return C.drop_null_date(orders_union(spark, sf))


# --- E5-E9: target and category distributions ----------------------------------------
@register("describe_target", sql(["proc"], out([("statistic", "s"), ("value", "d")], """(
  SELECT 'count' AS statistic, CAST(count("Min Delay") AS DOUBLE) AS value FROM proc
  UNION ALL SELECT 'mean', avg("Min Delay") FROM proc
  UNION ALL SELECT 'std', stddev_samp("Min Delay") FROM proc
  UNION ALL SELECT 'min', min("Min Delay") FROM proc
  UNION ALL SELECT 'max', max("Min Delay") FROM proc
  UNION ALL SELECT '25%', quantile_cont("Min Delay", 0.25) FROM proc
  UNION ALL SELECT '50%', quantile_cont("Min Delay", 0.5) FROM proc
  UNION ALL SELECT '75%', quantile_cont("Min Delay", 0.75) FROM proc)""")))
def q_describe_target(spark, sf):
    """E5 + E27: summary statistics of Min Delay."""
    return P.describe(events_processed(spark, sf, "Min Delay"), "Min Delay")


@register("value_counts", sql(["proc"], out([("Vehicle_Type", "s"), ("count", "i", "n")],
          '(SELECT "Vehicle_Type", count(*) AS n FROM proc WHERE "Vehicle_Type" IS NOT NULL GROUP BY 1)')))
def q_value_counts(spark, sf):
    """Rows per vehicle type."""
    return P.value_counts(events_processed(spark, sf, "Vehicle_Type"), "Vehicle_Type")


_CATS = ", ".join(f"('{c}')" for c in ["Low (0-5min)", "Medium (5-15min)", "High (15-30min)",
                                        "Very High (30+min)"])


@register("value_counts_cat", sql(["proc"], out([("Delay_Category", "s"), ("count", "i", "coalesce(n, 0)")],
          f'(SELECT c."Delay_Category", n FROM (VALUES {_CATS}) c("Delay_Category") LEFT JOIN '
          f'(SELECT "Delay_Category", count(*) AS n FROM proc GROUP BY 1) m '
          f'ON c."Delay_Category" = m."Delay_Category")')))
def q_value_counts_cat(spark, sf):
    """Rows per delay category, empty categories listed with 0."""
    return P.value_counts_cat(events_processed(spark, sf, "Delay_Category"), "Delay_Category")


@register("value_pct_nonnull", sql(["proc"], out(
    [("Delay_Category", "s"), ("count", "i", "n"), ("pct", "d", "n / sum(n) OVER () * 100.0")],
    '(SELECT "Delay_Category", count(*) AS n FROM proc WHERE "Delay_Category" IS NOT NULL GROUP BY 1)')))
def q_value_pct_nonnull(spark, sf):
    """Share of categorised rows per category."""
    return P.value_pct_nonnull(events_processed(spark, sf, "Delay_Category"), "Delay_Category")


@register("value_pct_rows", sql(["proc"], out(
    [("Vehicle_Type", "s"), ("count", "i", "n"), ("pct", "d", "round_even(CAST(n AS DOUBLE) / t * 100.0 * 100.0, 0) / 100.0")],
    '(SELECT "Vehicle_Type", count(*) AS n, (SELECT count(*) FROM proc) AS t FROM proc '
    'WHERE "Vehicle_Type" IS NOT NULL GROUP BY 1)')))
def q_value_pct_rows(spark, sf):
    """Share of all rows per vehicle type, 2 decimals."""
    return P.value_pct_rows(events_processed(spark, sf, "Vehicle_Type"), "Vehicle_Type")


# --- E16: normalisation assessment ----------------------------------------------------------
def _norm_sql(features, src):
    parts = []
    for i, f in enumerate(features):
        c = f'CAST("{f}" AS DOUBLE)'
        parts.append(f"SELECT '{f}' AS \"Feature\", avg({c}) AS m, stddev_samp({c}) AS s, "
                     f"min({c}) AS lo, max({c}) AS hi FROM {src}")
    inner = "(" + " UNION ALL ".join(parts) + ")"
    cv = "CASE WHEN m <> 0 THEN s / m END"
    needs = (f"(coalesce(m = 0, false) OR coalesce(abs({cv}) > 1, false) OR coalesce(hi - lo > 100, false))")
    return sql([src], out([("Feature", "s"), ("Mean", "d", "m"), ("Std", "d", "s"), ("Min", "d", "lo"),
                           ("Max", "d", "hi"), ("Range", "d", "hi - lo"), ("CV", "d", cv),
                           ("Needs_Normalization", "b", needs)], inner))


@register("normalisation_assessment", _norm_sql(NORMALISATION_FEATURES, "feat"))
def q_normalisation(spark, sf):
    """mean/std/min/max/range/CV per numeric feature and the flag."""
    return P.normalisation_assessment(events_processed(spark, sf, *NORMALISATION_FEATURES), NORMALISATION_FEATURES)


@register("normalisation_assessment_processed", _norm_sql(["Min Delay", "Min Gap", "Vehicle", "Hour"], "proc"))
def q_normalisation_processed(spark, sf):
    """E16 rerun: the four-feature assessment on the processed table."""
    from ..schema import NORMALISATION_FEATURES_SHORT
    return P.normalisation_assessment(events_processed(spark, sf, *NORMALISATION_FEATURES_SHORT), NORMALISATION_FEATURES_SHORT)


# --- E18 / E19: correlations ---------------------------------------------------------------
def _corr_sql(features, src, target=None):
    aggs, cells = [], []
    for i, a in enumerate(features):
        for j, b in enumerate(features):
            if j < i:
                continue
            both = f'"{a}" IS NOT NULL AND "{b}" IS NOT NULL'
            xa = f'CASE WHEN {both} THEN CAST("{a}" AS DOUBLE) END'
            xb = f'CASE WHEN {both} THEN CAST("{b}" AS DOUBLE) END'
            aggs.append(f"covar_pop({xa}, {xb}) / NULLIF(stddev_pop({xa}) * stddev_pop({xb}), 0) AS r{i}_{j}")
            cells.append((a, b, f"r{i}_{j}"))
            if i != j:
                cells.append((b, a, f"r{i}_{j}"))
    extra = [("w", f"SELECT {', '.join(aggs)} FROM {src}")]
    if target is not None:
        rows = " UNION ALL ".join(f"SELECT '{b}' AS feature, {r} AS c FROM w" for a, b, r in cells if a == target)
        return sql([src], out([("feature", "s"), ("corr", "d", "c")], f"({rows})"), extra)
    rows = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r} AS c FROM w"
                              for a, b, r in cells)
    return sql([src], out([("feature_a", "s"), ("feature_b", "s"), ("corr", "d", "c")], f"({rows})"), extra)


@register("correlation_matrix", _corr_sql(CORR_FEATURES, "proc"))
def q_corr(spark, sf):
    """Pearson matrix of the 14 processed features (long format)."""
    return P.correlation_matrix(events_processed(spark, sf, *CORR_FEATURES), CORR_FEATURES)


@register("correlation_appendix", _corr_sql(CORR_APPENDIX, "proc"))
def q_corr_appendix(spark, sf):
    """E18 (appendix): Pearson matrix of the 7 raw numeric features."""
    return P.correlation_matrix(events_processed(spark, sf, *CORR_APPENDIX), CORR_APPENDIX)


@register("correlation_with_target", _corr_sql(CORR_FEATURES, "proc", "Min Delay"))
def q_corr_target(spark, sf):
    """Correlations with Min Delay, strongest first."""
    return P.correlation_target(events_processed(spark, sf, *CORR_FEATURES), CORR_FEATURES)


# --- E20-E23: ranges, histogram, parse rates, shape ------------------------------------------
_EDGE = "CASE WHEN {k} >= 50 THEN hi ELSE lo + CAST({k} AS DOUBLE) * ((hi - lo) / 50.0) END"
_I0 = 'CAST(least(floor((CAST("Min Delay" AS DOUBLE) - lo) * (50.0 / (hi - lo))), 49) AS BIGINT)'
_HIST_EXTRA = [
    ("r", """SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
               CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi
        FROM (SELECT min(CAST("Min Delay" AS DOUBLE)) AS lo0, max(CAST("Min Delay" AS DOUBLE)) AS hi0 FROM proc)"""),
    ("x0", f"""SELECT CAST("Min Delay" AS DOUBLE) AS v, lo, hi, {_I0} AS i0 FROM proc, r WHERE "Min Delay" IS NOT NULL"""),
    ("x1", f"""SELECT v, lo, hi, CASE WHEN v < {_EDGE.format(k='i0')} THEN i0 - 1 ELSE i0 END AS i1 FROM x0"""),
    ("c", f"""SELECT CASE WHEN v >= {_EDGE.format(k='(i1 + 1)')} AND i1 <> 49 THEN i1 + 1 ELSE i1 END AS b,
               count(*) AS n FROM x1 GROUP BY 1"""),
    ("e", "SELECT CAST(range AS BIGINT) AS b FROM range(50)"),
]


@register("histogram", sql(["proc"], out(
    [("bin", "i", "e.b"), ("bin_lo", "d", _EDGE.format(k="e.b")),
     ("bin_hi", "d", _EDGE.format(k="(e.b + 1)")), ("count", "i", "coalesce(c.n, 0)")],
    "e LEFT JOIN c ON e.b = c.b, r"), _HIST_EXTRA))
def q_histogram(spark, sf):
    """50 equal-width bins of Min Delay."""
    return P.histogram(events_processed(spark, sf, "Min Delay"), "Min Delay", 50)


@register("date_range", sql(["ouni"], 'SELECT min("Date") AS min_date, max("Date") AS max_date FROM ouni'))
def q_date_range(spark, sf):
    """First and last incident date of the unified table."""
    return P.date_range(orders_unified(spark, sf))


@register("parse_rate", sql(["ordraw"], out(
    [("source", "s"), ("date_parse_rate", "d", "dr"), ("time_parse_rate", "d", "tr")],
    "(SELECT CASE st WHEN 'F' THEN 'bus' WHEN 'O' THEN 'streetcar' WHEN 'P' THEN 'subway' END AS source, "
    "avg(CASE WHEN try_strptime(d_txt, '%Y-%m-%d') IS NOT NULL THEN 1.0 ELSE 0.0 END) AS dr, "
    "avg(CASE WHEN try_strptime(tm, '%H:%M:%S') IS NOT NULL THEN 1.0 ELSE 0.0 END) AS tr "
    "FROM ordraw WHERE st IN ('F', 'O', 'P') GROUP BY 1)")))
def q_parse_rate(spark, sf):
    """Share of parseable dates and H:M:S times per raw source."""
    parts = []
    for t, f in order_frames(spark, sf).items():
        dcol = "Report Date" if "Report Date" in f.columns else "Date"
        parts.append(f.agg(F.avg(tx.parses(F.col(dcol))).alias("date_parse_rate"),
                           F.avg(tx.parses(F.col("Time"), tx.TIME_FORMAT)).alias("time_parse_rate"))
                      .select(F.lit(t).alias("source"), "date_parse_rate", "time_parse_rate"))
    return B.union_by_name(parts)


@register("shape", sql(["ouni"], out([("rows", "i", "count(*)"), ("columns", "i", "11")], "ouni")))
def q_shape(spark, sf):
    """Rows and columns of the unified table."""
    return P.shape(orders_unified(spark, sf))


@register("rows_per_source", sql(["ordraw"], out([("source", "s"), ("rows", "i", "n")],
          "(SELECT CASE st WHEN 'F' THEN 'bus' WHEN 'O' THEN 'streetcar' WHEN 'P' THEN 'subway' END AS source, "
          "count(*) AS n FROM ordraw WHERE st IN ('F', 'O', 'P') GROUP BY 1)")))
def q_rows_per_source(spark, sf):
    """Rows per raw input frame."""
    return P.rows_per_source(order_frames(spark, sf))


# --- M1 / B / C1 / G / H1 / A4: unify ------------------------------------------------------------
@register("unify", sql(["ouni"], out(STD_COLS, "ouni")))
def q_unify(spark, sf):
    """M1: conform, union, parse, 2017-2025 filter, date sort."""
    return B.unify(order_frames(spark, sf))


@register("conform", sql(["ordinc"], out(STD_COLS, "ordinc")))
def q_conform(spark, sf):
    """B1-B2: every raw frame conformed to the standard schema."""
    return B.union_by_name([B.conform(f, t, typed=True) for t, f in order_frames(spark, sf).items()])


@register("union_by_name", sql(["ordinc"], out(STD_COLS, "ordinc")))
def q_union(spark, sf):
    """H1: conformed frames unioned by name."""
    return orders_union(spark, sf)


@register("filter_year_range", sql(["ouni"], out(STD_COLS, "ouni")))
def q_filter_year(spark, sf):
    """Keep 2017-2025 (inclusive) of the union."""
    return B.filter_year_range(orders_union(spark, sf))


@register("sort_by_date", sql(["ordinc"], out(STD_COLS, "ordinc")))
def q_sort(spark, sf):
    """G1: the union ordered by date (ties by the other columns)."""
    return B.sort_by_date(orders_union(spark, sf))


_ORDER_ALL = ", ".join(f'"{c}" ASC NULLS FIRST' for c in ["Date"] + [c for c in STD if c != "Date"])


@register("head", sql(["ouni"], out(STD_COLS, f"(SELECT * FROM ouni ORDER BY {_ORDER_ALL} LIMIT 5)")))
def q_head(spark, sf):
    """First five rows of the date-sorted unified table (a top-k)."""
    return B.unify(order_frames(spark, sf)).limit(5)


@register("scan_split_period", sql(["ordinc"], out(STD_COLS, "ordinc",
          "WHERE \"Vehicle_Type\" = 'SUBWAY' AND year(\"Date\") = 2017")))
def q_split(spark, sf):
    """A4: a multi-year subway file keeps only its 2017 rows."""
    return B.scan_split_period(B.conform(order_frames(spark, sf)["subway"], "subway", typed=True), 2017)


@register("route_fallback", sql(["ordinc"], out(STD_COLS, "ordinc")))
def q_route_fallback(spark, sf):
    """A frame with Route but no Line takes Line from Route (every frame)."""
    frames = {t: f.withColumnRenamed("Line", "Route") for t, f in order_frames(spark, sf).items()}
    return B.union_by_name([B.conform(f, t, typed=True, fallback=True) for t, f in frames.items()])


@register("scan_sample", sql([], out(STD_COLS, "inc").replace(
    "FROM inc", "FROM (" + O.LAYERS["inc"][1].replace("FROM events", "FROM (SELECT * FROM events LIMIT 10)") + ")")))
def q_scan_sample(spark, sf):
    """A5: the first 10 incidents in file order (a schema preview)."""
    return incidents_events(FS.scan_sample(read_table(spark, sf, "events"), 10))


# --- E10-E15 / F1: imbalance ----------------------------------------------------------------------
_TYPE_SUMS = ", ".join(f"sum(CASE WHEN \"Vehicle_Type\" = '{t}' THEN 1 ELSE 0 END) AS \"{t}\"" for t in TYPES)


@register("crosstab_counts", sql(["oyear"], out([("Year", "i")] + [(t, "i") for t in TYPES],
          f'(SELECT "Year", {_TYPE_SUMS} FROM oyear GROUP BY 1)')))
def q_crosstab(spark, sf):
    """Year x vehicle type counts."""
    return X.crosstab_counts(orders_with_year(spark, sf), "Year", "Vehicle_Type", TYPES)


@register("crosstab_margins", sql(["oyear"], out(
    [("Year", "s")] + [(t, "i") for t in TYPES] + [("All", "i", " + ".join(f'"{t}"' for t in TYPES))],
    f'(SELECT CAST("Year" AS VARCHAR) AS "Year", {_TYPE_SUMS} FROM oyear GROUP BY 1 '
    f"UNION ALL SELECT 'All', {_TYPE_SUMS} FROM oyear)")))
def q_crosstab_margins(spark, sf):
    """Crosstab with All row and column."""
    return X.crosstab_margins(orders_with_year(spark, sf), "Year", "Vehicle_Type", TYPES)


@register("crosstab_row_pct", sql(["oyear"], out(
    [("Year", "i")] + [(t, "d", f'CAST("{t}" AS DOUBLE) / ({" + ".join(chr(34) + x + chr(34) for x in TYPES)}) * 100.0')
                       for t in TYPES],
    f'(SELECT "Year", {_TYPE_SUMS} FROM oyear GROUP BY 1)')))
def q_crosstab_pct(spark, sf):
    """Row-normalised crosstab in percent."""
    return X.crosstab_row_pct(orders_with_year(spark, sf), "Year", "Vehicle_Type", TYPES)


_YEAR_SIZES = '(SELECT "Year", count(*) AS n FROM oyear GROUP BY 1)'


@register("group_size", sql(["oyear"], out([("Year", "i"), ("count", "i", "n")], _YEAR_SIZES)))
def q_group_size(spark, sf):
    """Rows per year."""
    return P.group_size(orders_with_year(spark, sf), "Year")


@register("extremes_of_counts", sql(["oyear"], out(
    [("max_count", "i", "max(n)"), ("min_count", "i", "min(n)"),
     ("max_min_ratio", "d", "max(n) * 1.0 / min(n)"),
     ("key_of_max", "i", 'arg_max("Year", n * 100000 - "Year")'),
     ("key_of_min", "i", 'arg_min("Year", n * 100000 + "Year")')], _YEAR_SIZES)))
def q_extremes(spark, sf):
    """max/min ratio of yearly counts and the years holding them."""
    return P.extremes_of_counts(P.group_size(orders_with_year(spark, sf), "Year"))


@register("cv_by_year", sql(["oyear"], out([("Year", "i"), ("cv", "d", "stddev_samp(n) / avg(n)")],
          '(SELECT "Year", "Vehicle_Type", count(*) AS n FROM oyear GROUP BY 1, 2)', 'GROUP BY "Year"')))
def q_cv(spark, sf):
    """Coefficient of variation of type counts within each year."""
    return X.cv_by_year(orders_with_year(spark, sf))


@register("yoy_growth", sql(["oyear"], out(
    [("Year", "i"), ("count", "i", "n"),
     ("growth_pct", "d", '(n - lag(n) OVER (ORDER BY "Year")) / lag(n) OVER (ORDER BY "Year") * 100.0')],
    _YEAR_SIZES)))
def q_yoy(spark, sf):
    """year-over-year growth of record counts in percent."""
    return P.yoy_growth(P.group_size(orders_with_year(spark, sf), "Year"))


# --- F3 / I1-I14: features ------------------------------------------------------------------------
@register("category_codes", sql(["ouni"], out(
    STD_COLS + [("Vehicle_Type_Encoded", "i", 'dense_rank() OVER (ORDER BY "Vehicle_Type") - 1')], "ouni")))
def q_codes(spark, sf):
    """alphabetical code of the vehicle type."""
    return category_codes(orders_unified(spark, sf), "Vehicle_Type")


@register("parse_date", sql(["ordraw"], out(
    [("Report Date", "s", "d_txt"), ("Date", "s", "CAST(try_strptime(d_txt, '%Y-%m-%d') AS DATE)")],
    "ordraw", "WHERE st IN ('F', 'O', 'P')")))
def q_parse_date(spark, sf):
    """Text dates of every raw frame parsed with the format list."""
    dates = [f.select(F.col("Report Date" if "Report Date" in f.columns else "Date").alias("Report Date"))
             for f in order_frames(spark, sf).values()]
    return B.union_by_name(dates).select("Report Date", tx.parse_date(F.col("Report Date")).alias("Date"))


@register("parse_time", sql(["ordinc"], out(
    [("Time", "s"), ("Hour", "i", "hour(try_strptime(\"Time\", '%H:%M:%S'))"),
     ("Minute", "i", "minute(try_strptime(\"Time\", '%H:%M:%S'))")], "ordinc")))
def q_parse_time(spark, sf):
    """Hour and Minute of strict H:M:S times (one-digit hours accepted)."""
    return orders_union(spark, sf).select("Time", tx.hour_of("Time").alias("Hour"),
                                          tx.minute_of("Time").alias("Minute"))


_TEMPORAL = ["Date", "Year", "Month", "DayOfWeek", "DayName", "DayOfMonth", "WeekOfYear"]


@register("temporal_features", sql(["ouni"], out(
    [("Date", "s"), ("Year", "i", 'year("Date")'), ("Month", "i", 'month("Date")'),
     ("DayOfWeek", "i", 'isodow("Date") - 1'), ("DayName", "s", "strftime(\"Date\", '%A')"),
     ("DayOfMonth", "i", 'day("Date")'), ("WeekOfYear", "i", 'weekofyear("Date")')], "ouni")))
def q_temporal(spark, sf):
    """Calendar parts of the incident date."""
    return orders_unified(spark, sf).select("Date", *[c.alias(n) for n, c in tx.temporal_columns().items()])


_CYC = ["Hour", "DayOfWeek", "Month", "Hour_sin", "Hour_cos", "DayOfWeek_sin", "DayOfWeek_cos",
        "Month_sin", "Month_cos"]


@register("cyclical", sql(["rfeat"], out(O.cols_of(_CYC, O.FEAT_KINDS), "rfeat")))
def q_cyclical(spark, sf):
    """sin/cos encodings of hour, weekday and month."""
    return events_raw_features(spark, sf).select(*_CYC)


_FLAGS = ["DayOfWeek", "Hour", "IsWeekend", "IsRushHour", "IsPeakHour", "IsNight"]


@register("time_flags", sql(["rfeat"], out(O.cols_of(_FLAGS, O.FEAT_KINDS), "rfeat")))
def q_flags(spark, sf):
    """Weekend, rush, peak and night flags."""
    return events_raw_features(spark, sf).select(*_FLAGS)


@register("season", sql(["ouni"], out(
    [("Month", "i", 'month("Date")'),
     ("Season", "s", """CASE WHEN month("Date") BETWEEN 3 AND 5 THEN 'Spring'
        WHEN month("Date") BETWEEN 6 AND 8 THEN 'Summer' WHEN month("Date") BETWEEN 9 AND 11 THEN 'Fall'
        ELSE 'Winter' END""")], "ouni")))
def q_season(spark, sf):
    """Season of the incident month."""
    df = orders_unified(spark, sf).select(F.month("Date").alias("Month"))
    return df.withColumn("Season", fx.season("Month"))


@register("delay_ratio", sql(["uni"], out(
    [("Min Delay", "d"), ("Min Gap", "d"),
     ("Delay_Ratio", "d", 'CASE WHEN "Min Gap" + 1 <> 0 THEN "Min Delay" / ("Min Gap" + 1) END')], "uni")))
def q_ratio(spark, sf):
    """Min Delay / (Min Gap + 1)."""
    return events_unified(spark, sf).select("Min Delay", "Min Gap", fx.delay_ratio().alias("Delay_Ratio"))


@register("delay_category", sql(["rfeat"], out([("Min Delay", "d"), ("Delay_Category", "s")], "rfeat")))
def q_category(spark, sf):
    """Delay bins; zero delay is uncategorised."""
    return events_unified(spark, sf).select("Min Delay", fx.delay_category().alias("Delay_Category"))


@register("log_transform", sql(["uni"], out(
    [("Min Delay", "d"), ("Min_Delay_Log", "d", 'CASE WHEN "Min Delay" > -1 THEN ln(1 + "Min Delay") END')],
    "uni")))
def q_log(spark, sf):
    """log(1 + Min Delay)."""
    return events_unified(spark, sf).select("Min Delay", S.log1p("Min Delay").alias("Min_Delay_Log"))


@register("robust_scale", sql(["uni"], out(
    [("Min Gap", "d"), ("Min_Gap_Scaled", "d", '("Min Gap" - q50) / CASE WHEN q75 - q25 = 0 THEN 1 ELSE q75 - q25 END')],
    'uni, (SELECT quantile_cont("Min Gap", 0.25) AS q25, quantile_cont("Min Gap", 0.5) AS q50, '
    'quantile_cont("Min Gap", 0.75) AS q75 FROM uni) p')))
def q_robust(spark, sf):
    """(x - median) / IQR of Min Gap."""
    return S.robust_scale(events_unified(spark, sf).select("Min Gap"), "Min Gap")


@register("standard_scale", sql(["uni"], out(
    [("Vehicle", "i"), ("Vehicle_Scaled", "d",
                        '("Vehicle" - m) / CASE WHEN s = 0 OR s IS NULL THEN 1 ELSE s END')],
    'uni, (SELECT avg("Vehicle") AS m, stddev_pop("Vehicle") AS s FROM uni) p')))
def q_standard(spark, sf):
    """(x - mean) / population std of Vehicle."""
    return S.standard_scale(events_unified(spark, sf).select("Vehicle"), "Vehicle")
