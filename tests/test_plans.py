"""Physical-plan properties the scale design relies on."""
from delayspark import registry
from delayspark.operators import profile as P
from delayspark.operators import web as W
from delayspark.plans import incident_queries as IQ
from delayspark.session import read_table

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_year_filter_and_pruning_reach_the_scan(spark):
    df = IQ.events_unified(spark, SF).select("Vehicle_Type", "Min Delay")
    p = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts,2017-01-01T00:00)" in p and "LessThan(ts,2026-01-01T00:00)" in p
    read = [line for line in p.splitlines() if "ReadSchema" in line or "FileScan parquet" in line]
    assert read and all("props" not in line and "user_id" not in line for line in read)


def test_group_reports_combine_map_side(spark):
    df = P.mean_by_key(IQ.events_unified(spark, SF), "Vehicle_Type")
    assert "partial_avg" in plan(df)


def test_link_dedupe_is_an_aggregation_not_a_window(spark):
    p = plan(W.dedupe_keep_first(W.extract_links(read_table(spark, SF, "pages"))))
    assert "Window" not in p and "partial_min_by" in p


def test_no_cartesian_or_nested_loop_join_in_any_query(spark):
    bad = {}
    registry.load_all()
    for name, fn in registry.QUERIES.items():
        p = plan(fn(spark, SF))
        hits = [k for k in ("CartesianProduct", "BroadcastNestedLoopJoin") if k in p]
        if hits:
            bad[name] = hits
    assert bad == {}
