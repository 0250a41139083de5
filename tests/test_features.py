"""Literal-row edge cases of cleaning, features and scaling (FIXTURES F4)."""
import datetime as dt
import math

from pyspark.sql import functions as F

from delayspark.functions import features as fx
from delayspark.functions import temporal as tx
from delayspark.operators import clean as C
from delayspark.operators import conform as B
from delayspark.operators import crosstab as X
from delayspark.operators import profile as P
from delayspark.operators import scaling as S
from delayspark.operators.features import add_features, category_codes
from delayspark.schema import INCIDENT_SCHEMA


def incidents(spark, rows):
    """rows: dicts with any of the standard columns; the rest NULL."""
    names = [f.name for f in INCIDENT_SCHEMA.fields]
    full = [tuple(r.get(n, "BUS" if n == "Vehicle_Type" else None) for n in names) for r in rows]
    return spark.createDataFrame(full, INCIDENT_SCHEMA)


def test_delay_category_edges(spark):
    vals = [0.0, -1.0, 5.0, 5.5, 15.0, 30.0, 31.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "`Min Delay` double")
    got = [r[0] for r in df.select(fx.delay_category()).collect()]
    assert got == [None, None, "Low (0-5min)", "Medium (5-15min)", "Medium (5-15min)",
                   "High (15-30min)", "Very High (30+min)", None]
    got0 = df.select(fx.delay_category(include_zero=True)).first()[0]
    assert got0 == "Low (0-5min)"


def test_time_shapes_and_flags(spark):
    times = ["07:05:09", "7:05:09", "07:05", "24:00:00", None]
    df = spark.createDataFrame([(t,) for t in times], "Time string")
    hours = [r[0] for r in df.select(tx.hour_of("Time")).collect()]
    assert hours == [7, 7, None, None, None]
    hrs = spark.createDataFrame([(h,) for h in [6, 7, 10, 15, 17, 20, 22, 0, 5, None]], "Hour int")
    out = hrs.select("Hour", fx.is_rush_hour("Hour").alias("r"), fx.is_peak_hour("Hour").alias("p"),
                     fx.is_night("Hour").alias("n")).collect()
    table = {r["Hour"]: (r["r"], r["p"], r["n"]) for r in out}
    assert table[6] == (0, 1, 1 - 1) and table[7] == (1, 1, 0) and table[10] == (0, 1, 0)
    assert table[15] == (0, 1, 0) and table[17] == (1, 1, 0) and table[20] == (0, 1, 0)
    assert table[22] == (0, 0, 1) and table[0] == (0, 0, 1) and table[5] == (0, 0, 1)
    assert table[None] == (0, 0, 0)


def test_year_end_calendar(spark):
    df = incidents(spark, [{"Date": dt.date(2024, 12, 30), "Time": "08:00:00"}])
    r = add_features(df).first()
    assert (r["Year"], r["WeekOfYear"], r["DayOfWeek"], r["DayName"]) == (2024, 1, 0, "Monday")
    assert r["Season"] == "Winter" and r["IsWeekend"] == 0 and r["IsRushHour"] == 1


def test_cyclical_unit_circle(spark):
    df = spark.range(0, 24).select(F.col("id").cast("int").alias("Hour"))
    s, c = fx.cyclical("Hour", 24)
    for row in df.select((s * s + c * c).alias("one")).collect():
        assert math.isclose(row[0], 1.0, rel_tol=1e-12)


def test_ratio_gap_minus_one(spark):
    df = spark.createDataFrame([(10.0, -1.0), (10.0, 4.0)], "`Min Delay` double, `Min Gap` double")
    assert [r[0] for r in df.select(fx.delay_ratio()).collect()] == [None, 2.0]


def test_mode_tie_and_all_null_median(spark):
    rows = [{"Vehicle": v, "Min Gap": None} for v in (3, 1, 1, 3, None)]
    rows += [{"Vehicle_Type": "SUBWAY", "Vehicle": None, "Min Gap": 2.0}]
    df = incidents(spark, rows)
    filled = C.fill_vehicle_mode(df)
    bus = sorted(r["Vehicle"] for r in filled.where("Vehicle_Type = 'BUS'").collect())
    assert bus == [1, 1, 1, 3, 3]
    sub = filled.where("Vehicle_Type = 'SUBWAY'").first()["Vehicle"]
    assert sub == 0  # a type without any vehicle gets 0
    med = C.fill_median(df, ["Min Gap"])
    assert all(r["Min Gap"] is None for r in med.where("Vehicle_Type = 'BUS'").collect())


def test_median_interpolates(spark):
    df = incidents(spark, [{"Min Delay": v} for v in (1.0, 2.0, 3.0, 10.0)])
    from delayspark.operators.stats import median_by_type
    assert median_by_type(df, "Min Delay").first()["median"] == 2.5


def test_year_filter_and_bad_dates(spark):
    raw = spark.createDataFrame([("2016-12-31",), ("2017-01-01",), ("2025-12-31",), ("2026-01-01",), ("abc",)],
                                "Date string")
    df = B.cast_standard(raw)
    kept = [r[0] for r in B.filter_year_range(df).collect()]
    assert kept == [dt.date(2017, 1, 1), dt.date(2025, 12, 31)]


def test_constant_column_scales_to_zero_and_corr_null(spark):
    df = spark.createDataFrame([(5.0, float(i)) for i in range(6)], "`Min Gap` double, x double")
    scaled = S.robust_scale(df, "Min Gap")
    assert {r["Min_Gap_Scaled"] for r in scaled.collect()} == {0.0}
    corr = P.correlation_matrix(df, ["Min Gap", "x"]).collect()
    vals = {(r["feature_a"], r["feature_b"]): r["corr"] for r in corr}
    assert vals[("Min Gap", "x")] is None and vals[("Min Gap", "Min Gap")] is None
    assert math.isclose(vals[("x", "x")], 1.0)


def test_scaled_median_zero_and_standard(spark):
    df = spark.createDataFrame([(float(v), v) for v in (1, 2, 3, 4, 100)], "`Min Gap` double, Vehicle long")
    r = S.robust_scale(df, "Min Gap")
    assert sorted(x["Min_Gap_Scaled"] for x in r.collect())[2] == 0.0
    st = S.standard_scale(df, "Vehicle").agg(F.avg("Vehicle_Scaled"), F.stddev_pop("Vehicle_Scaled")).first()
    assert abs(st[0]) < 1e-12 and math.isclose(st[1], 1.0)


def test_crosstab_invariants(spark):
    rows = [(2017, "BUS")] * 3 + [(2017, "SUBWAY")] + [(2018, "BUS")]
    df = spark.createDataFrame(rows, "Year int, Vehicle_Type string")
    pct = X.crosstab_row_pct(df, values=["BUS", "SUBWAY"]).collect()
    for r in pct:
        assert math.isclose(r["BUS"] + r["SUBWAY"], 100.0)
    cv = {r["Year"]: r["cv"] for r in X.cv_by_year(df).collect()}
    assert cv[2018] is None and cv[2017] is not None
    m = {r["Year"]: r for r in X.crosstab_margins(df, values=["BUS", "SUBWAY"]).collect()}
    assert m["All"]["All"] == 5 and m["2017"]["All"] == 4 and m["2018"]["SUBWAY"] == 0


def test_growth_and_extremes(spark):
    sizes = spark.createDataFrame([(2017, 10), (2018, 20), (2019, 10)], "Year int, count long")
    g = [r["growth_pct"] for r in P.yoy_growth(sizes).orderBy("Year").collect()]
    assert g == [None, 100.0, -50.0]
    e = P.extremes_of_counts(sizes).first()
    assert (e["key_of_max"], e["key_of_min"], e["max_min_ratio"]) == (2018, 2017, 2.0)


def test_histogram_constant_and_last_bin(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    h = P.histogram(df, "x", bins=4).collect()
    assert sum(r["count"] for r in h) == 2 and h[0]["bin_lo"] == 0.5
    df2 = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    h2 = P.histogram(df2, "x", bins=5).collect()
    assert h2[-1]["count"] == 1 and h2[0]["count"] == 1


def test_category_codes_null(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "Vehicle_Type string")
    got = {r[0]: r[1] for r in category_codes(df).collect()}
    assert got == {"a": 0, "b": 1, None: -1}


def test_missing_profile(spark):
    df = incidents(spark, [{"Bound": None, "Line": "1"}, {"Bound": "N", "Line": None}])
    prof = {r["Column"]: r for r in C.missing_profile(df).collect()}
    assert prof["Bound"]["Missing_Count"] == 1 and prof["Bound"]["Missing_Percentage"] == 50.0
    assert "Vehicle_Type" not in prof
    filled = C.fill_unknown(df)
    assert filled.where("Bound IS NULL OR Line IS NULL OR Station IS NULL").count() == 0


def test_schema_profile_and_feature_groups(spark):
    from delayspark.operators.conform import schema_profile
    bus = spark.createDataFrame([("2019-01-01", "36", 1)], "`Report Date` string, Route string, `_id` int")
    sub = spark.createDataFrame([("2019-01-01", "YU")], "Date string, Line string")
    prof = {(r["source"], r["column"]): r["standard"] for r in schema_profile(spark, {"bus": bus, "subway": sub}).collect()}
    assert prof == {("bus", "Report Date"): "Date", ("bus", "Route"): "Line", ("bus", "_id"): None,
                    ("subway", "Date"): "Date", ("subway", "Line"): "Line"}
    g = P.feature_groups(["Hour_sin", "IsNight", "Min_Gap_Scaled", "Min_Delay_Log", "Year"])
    assert g == {"cyclical": ["Hour_sin"], "flags": ["IsNight"], "transformed": ["Min_Gap_Scaled", "Min_Delay_Log"]}


def test_typed_conform_of_text_columns(spark):
    raw = spark.createDataFrame([("2019-01-01", "8001.0", "12", "x"), ("2019-01-02", "77", "abc", None)],
                                "`Report Date` string, Vehicle string, `Min Delay` string, Direction string")
    rows = B.conform(raw, "bus", typed=True).orderBy("Date").collect()
    assert [r["Vehicle"] for r in rows] == [8001, 77]
    assert [r["Min Delay"] for r in rows] == [12.0, None]
    assert rows[0]["Bound"] == "x" and rows[0]["Vehicle_Type"] == "BUS"


def test_histogram_matches_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.exponential(7.0, 2000).round(1), [0.0, 100.0, 20.0, 40.0]])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = [r["count"] for r in P.histogram(df, "x", bins=50).collect()]
    want, edges = np.histogram(vals, bins=50)
    assert got == list(want)
    lo = [r["bin_lo"] for r in P.histogram(df, "x", bins=50).collect()]
    assert np.allclose(lo, edges[:-1])


def test_texts_for_no_value_and_infinities_are_null(spark):
    raw = spark.createDataFrame([("2019-01-01", "NaN", "N/A", "inf", " "), ("2019-01-02", "4", "7", "-Infinity", "YU")],
                                "Date string, `Min Delay` string, Vehicle string, `Min Gap` string, Line string")
    rows = B.conform(raw, "subway", typed=True).orderBy("Date").collect()
    assert [(r["Min Delay"], r["Vehicle"], r["Min Gap"], r["Line"]) for r in rows] == [(None, None, None, None), (4.0, 7, None, "YU")]


def test_correlation_of_small_scales_and_constants(spark):
    df = spark.createDataFrame([(i * 1e-7, float(i), 0.1) for i in range(50)], "a double, b double, c double")
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in P.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert abs(got["a", "b"] - 1.0) < 1e-9 and got["a", "c"] is None and got["c", "c"] is None
