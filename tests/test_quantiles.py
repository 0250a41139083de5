"""Exact quantiles: distributed rank selection against the in-task map and a brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from delayspark.operators.stats import exact_quantiles, group_mode, select_quantiles, weighted_values


@pytest.mark.parametrize("probs", [[0.25, 0.5, 0.75], [0.0, 1.0, 0.1, 0.99]])
def test_selection_equals_numpy(spark, probs):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=3000), np.full(700, 2.5), rng.integers(0, 5, 300)])
    groups = ["hot"] * 3000 + ["hot"] * 700 + ["cold"] * 300
    pdf = [(g, float(v)) for g, v in zip(groups, vals)] + [("cold", None)]
    df = spark.createDataFrame(pdf, "g string, v double")
    a = {r["g"]: [r[f"q{i}"] for i in range(len(probs))]
         for r in exact_quantiles(df, "v", probs, ["g"]).collect()}
    for g in ("hot", "cold"):
        want = np.quantile(np.array([v for gg, v in pdf if gg == g and v is not None]), probs)
        assert np.allclose(a[g], want)


def test_global_select_quantiles(spark):
    df = spark.range(0, 10001).select((F.col("id") * 0.5).alias("v"))
    wv = weighted_values(df, "v")
    r = select_quantiles(wv, "v", [0.25, 0.5, 0.75], partitions=7).first()
    assert (r["q0"], r["q1"], r["q2"]) == (1250.0, 2500.0, 3750.0)


def test_mode_of_large_integers_and_approximate_medians(spark):
    from delayspark.operators import clean as C
    big = 1 << 53
    df = spark.createDataFrame([("A", big, 1.0, None), ("A", big + 1, 2.0, 3.0), ("A", big + 1, 9.0, 3.0), ("A", None, None, 5.0)],
                               "Vehicle_Type string, Vehicle long, `Min Delay` double, `Min Gap` double")
    assert group_mode(df, "Vehicle", ["Vehicle_Type"]).first()["mode"] == big + 1
    assert sorted(r["Vehicle"] for r in C.fill_vehicle_mode(df).collect()) == [big, big + 1, big + 1, big + 1]
    for approx in (False, True):
        rows = C.fill_median(df, approx=approx).collect()
        assert sorted(r["Min Delay"] for r in rows) == [1.0, 2.0, 2.0, 9.0] and {r["Min Gap"] for r in rows} == {3.0, 5.0}


def test_approx_quantiles_close(spark):
    df = spark.range(0, 100001).select(F.col("id").cast("double").alias("v"))
    exact = exact_quantiles(df, "v", [0.5]).first()["q0"]
    approx = exact_quantiles(df, "v", [0.5], approx=True).first()["q0"]
    assert exact == 50000.0 and abs(approx - exact) <= 100001 / 10_000


def test_fit_scalers_one_scan_equals_separate_fits(spark):
    from delayspark.operators import scaling as S
    rng = np.random.default_rng(11)
    rows = [(float(a) if i % 7 else None, float(b), int(c)) for i, (a, b, c) in
            enumerate(zip(rng.integers(0, 30, 500), rng.exponential(2.0, 500), rng.integers(1000, 9000, 500)))]
    df = spark.createDataFrame(rows, "g double, r double, v long")
    robust, std = S.fit_scalers(df, ["g", "r"], ["v"])
    for c in ("g", "r"):
        one = S.fit_robust(df, c)
        assert np.isclose(robust[c].center, one.center) and np.isclose(robust[c].scale, one.scale)
    sep = S.fit_standard(df, "v")
    assert np.isclose(std["v"].mean, sep.mean) and np.isclose(std["v"].scale, sep.scale)
