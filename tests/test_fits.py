"""Fits inside the plan: ordered bits, exact quantiles, no job at build, pruning, the fit store."""
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from delayspark import registry
from delayspark.operators import clean as C
from delayspark.operators import features as FE
from delayspark.operators import fits
from delayspark.operators import profile as P
from delayspark.operators import scaling as S
from delayspark.operators.stats import exact_quantiles, fill_with_group_stats
from delayspark.plans import incident_queries as IQ
from delayspark.plans import pipelines as PL

SF = "/root/testdata/sf0.001"


def bits(x):
    (b,) = struct.unpack("<q", struct.pack("<d", abs(x)))
    return -b if x < 0 else b


def test_ordered_bits_are_those_of_the_double(spark):
    rnd = random.Random(3)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.0 ** -1022, 2.0 ** -1022 - 5e-324, 1.7976931348623157e308, math.inf, -math.inf]
    values += [s * 2.0 ** e for e in range(-1074, 1024) for s in (1, -1)]
    values += [math.nextafter(2.0 ** e, d) for e in range(-1073, 1023) for d in (0, math.inf)]
    values += [struct.unpack("<d", struct.pack("<Q", rnd.getrandbits(64)))[0] for _ in range(4000)]
    values = [v for v in values if not math.isnan(v)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = fits.ordered_bits(df, "v", "b").select("v", "b", fits.double_of(F.col("b")).alias("back")).collect()
    assert all(r["b"] == bits(r["v"]) and r["back"] == r["v"] for r in got if r["v"] is not None)
    assert [r["b"] for r in got if r["v"] is None] == [None]
    nan = fits.ordered_bits(spark.createDataFrame([(math.nan,)], "v double"), "v", "b").select("b", fits.double_of(F.col("b"))).first()
    assert nan[0] > bits(math.inf) and math.isnan(nan[1])


@pytest.mark.parametrize("probs", [[0.5], [0.0, 0.25, 0.5, 0.75, 1.0], [0.123, 0.999]])
def test_quantiles_equal_numpy(spark, probs):
    rng = np.random.default_rng(5)
    groups = {"hot": np.concatenate([rng.normal(0, 1e9, 4000), np.full(900, -2.5)]), "tiny": rng.exponential(1e-300, 50),
              "one": np.array([7.25]), "few": rng.integers(-3, 4, 40).astype(float)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("few", None), ("none", None), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: [r[f"q{i}"] for i in range(len(probs))] for r in exact_quantiles(df, "v", probs, ["g"]).collect()}
    for g, vs in groups.items():
        assert np.allclose(got[g], np.quantile(vs, probs), rtol=1e-15, atol=0), g
    assert np.allclose(got[None], np.quantile([3.0, 5.0], probs)) and "none" not in got
    every = np.concatenate([*groups.values(), [3.0, 5.0]])
    one = spark.range(1).select(fits.quantiles(df, "v", probs).alias("q")).first()["q"]
    assert np.allclose(one, np.quantile(every, probs), rtol=1e-15, atol=0)
    assert spark.range(1).select(fits.quantiles(df.where("g = 'none'"), "v", probs)).first()[0] is None


def test_no_exchange_carries_a_value(spark):
    df = spark.range(1000).select((F.col("id") * 1.5).alias("v"), (F.col("id") % 3).alias("g"))
    plan = exact_quantiles(df, "v", [0.5], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "NestedLoop" not in plan and "rangepartitioning" not in plan
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanged and all(" v#" not in line and " b#" not in line and "x#" not in line for line in exchanged if "Broadcast" not in line)


def test_a_map_has_a_bound_and_the_join_has_none(spark):
    df = spark.range(60).select((F.col("id") % 30).cast("string").alias("k"), F.when(F.col("id") < 30, F.col("id") * 1.0).alias("x"))
    joined = fill_with_group_stats(df, medians=["x"], key="k", lookup="join").collect()
    mapped = fill_with_group_stats(df, medians=["x"], key="k").collect()
    assert sorted(map(tuple, joined)) == sorted(map(tuple, mapped)) and all(r["x"] == float(r["k"]) for r in mapped)
    with pytest.raises(Exception, match="lookup='join'"):
        spark.range(1).select(fits.group_map(df.groupBy("k").agg(F.max("x").alias("m")), "k", F.col("m"), limit=29)).collect()
    assert [r["c"] for r in FE.category_codes(df, "k", "c", lookup="join").sort("k").collect()] == [
        r["c"] for r in FE.category_codes(df, "k", "c").sort("k").collect()]



@pytest.mark.parametrize("name", ["mean_delay_by_type", "mean_delay_by_hour", "describe_target", "histogram", "processed_table", "correlation_matrix",
                                  "fill_median", "fill_vehicle_mode", "fill_from_group_stat", "median_by_type", "robust_scale", "standard_scale",
                                  "category_codes", "select_available", "value_pct_rows", "clean"])
def test_building_a_query_runs_no_job(spark, name):
    registry.load_all()
    sc = spark.sparkContext
    registry.QUERIES[name](spark, SF)  # the reader looks at the files' schema once
    sc.setJobGroup(f"build-{name}", name)
    try:
        registry.QUERIES[name](spark, SF)
        jobs = sc.statusTracker().getJobIdsForGroup(f"build-{name}")
        read = [sc.statusTracker().getJobInfo(j) for j in jobs]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    # reading a Parquet schema is a job of one task per table
    assert all(len(j.stageIds) == 1 for j in read) and len(read) <= 1


def test_unused_fits_are_pruned(spark):
    plan = registry.QUERIES["mean_delay_by_type"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "min_by" not in plan and "array_sort" not in plan and "stddev" not in plan
    assert registry.QUERIES["mean_delay_by_month"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("min_by") == 0
    counted = registry.QUERIES["value_counts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" not in counted


def test_reports_share_the_fits_of_a_store(spark, tmpdir_shared):
    unified = IQ.events_unified(spark, SF)
    store = PL.fit_incidents(unified, tmpdir_shared)
    own = sorted(map(str, PL.processed_table(unified).collect()))
    kept = PL.processed_table(unified, store=store)
    assert sorted(map(str, kept.collect())) == own
    plan = P.mean_by_key(kept, "Hour")._jdf.queryExecution().executedPlan().toString()
    assert "delay_medians" in plan and "Window" not in plan  # read, not fitted


def test_scalers_fitted_on_one_slice_apply_to_another(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(1, 12)] + [(None, None)], "`Min Gap` double, Vehicle long")
    late = spark.createDataFrame([(100.0, 7)], "`Min Gap` double, Vehicle long")
    row = late.select(S.apply_robust("Min Gap", S.robust_params(df, "Min Gap")), S.apply_standard("Vehicle", S.standard_params(df, "Vehicle"))).first()
    assert row[0] == (100.0 - 6.0) / 5.0 and abs(row[1] - (7 - 6) / np.std(np.arange(1, 12))) < 1e-12
    empty = C.clean(spark.createDataFrame([], IQ.events_unified(spark, SF).schema))
    assert S.scale(FE.add_features(empty)).collect() == []


def test_correlation_of_constant_and_missing_columns(spark):
    rows = [(float(i), float(i * i), 2.0, None if i % 2 else float(-i), None) for i in range(10)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = {(r[0], r[1]): r[2] for r in P.correlation_matrix(df, ["a", "b", "c", "d", "e"]).collect()}
    assert len(got) == 25 and abs(got["a", "b"] - np.corrcoef(np.arange(10), np.arange(10) ** 2)[0, 1]) < 1e-12
    assert abs(got["a", "d"] + 1.0) < 1e-12 and got["b", "a"] == got["a", "b"] and got["a", "a"] == 1.0
    assert all(got[x, y] is None for x, y in got if {"c", "e"} & {x, y})
    target = {r["feature"]: r["corr"] for r in P.correlation_target(df, ["a", "b", "c", "d", "e"], "a").collect()}
    assert target == {y: v for (x, y), v in got.items() if x == "a"}


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=500), np.array([3.0]), np.array([1.0, 1.0]), np.linspace(0, 1, 101), np.array([-1e300, 1e300])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        want, edges = np.histogram(values, bins=10)
        got = P.histogram(df, "v", 10).collect()
        assert [r["count"] for r in got] == list(want) and np.allclose([r["bin_lo"] for r in got], edges[:-1])
    assert P.histogram(df.where("v is null"), "v", 10).collect() == []


def nodes(plan):
    children = plan.children()
    return [plan, *(n for i in range(children.size()) for n in nodes(children.apply(i)))]


def test_correlations_fan_a_row_out_to_fewer_rows_than_pairs(spark):
    rng = np.random.default_rng(11)
    table = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6))
    table[rng.random(table.shape) < 0.2] = np.nan
    names = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame([[None if math.isnan(v) else float(v) for v in row] for row in table], ", ".join(f"{n} double" for n in names))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        matrix = P.correlation_pairs(df, [(a, b) for i, a in enumerate(names) for b in names[i:]])
        got = {(r[0], r[1]): r[2] for r in matrix.collect()}
        made = [n.metrics().apply("numOutputRows").value() for n in nodes(matrix._jdf.queryExecution().executedPlan()) if n.nodeName() == "Generate"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(got) == 21 and max(made) <= 200 * 5  # 21 pairs: five rows, the last one with a single pair
    for (a, b), corr in got.items():
        x, y = table[:, int(a[1])], table[:, int(b[1])]
        both = ~np.isnan(x) & ~np.isnan(y)
        assert abs(corr - np.corrcoef(x[both], y[both])[0, 1]) < 1e-12
