"""Row order, which a comparison of row sets cannot see."""
from delayspark import registry
from delayspark.operators import conform as B
from delayspark.operators import profile as P
from delayspark.plans import incident_queries as IQ
from delayspark.sources import files as FS
from delayspark.sources import sinks as SK

SF = "/root/testdata/sf0.001"


def test_unified_table_is_date_ordered(spark):
    dates = [r["Date"] for r in B.sort_by_date(IQ.orders_union(spark, SF)).collect()]
    assert dates == sorted(dates) and len(dates) > 1000


def test_written_csv_is_date_ordered_across_files(spark):
    path = SK.scratch_path(spark, "order")
    SK.sink_unified(IQ.orders_unified(spark, SF), path)
    rows = FS.scan_csv(spark, path, with_file=True).select("_file", "Date").collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r["_file"], []).append(r["Date"])
    dates = [d for f in sorted(by_file) for d in by_file[f]]
    assert dates == sorted(dates)


def test_counts_are_ordered_by_count_then_value(spark):
    rows = [(r["count"], r["Station"]) for r in P.value_counts(IQ.orders_unified(spark, SF), "Station").collect()]
    assert rows == sorted(rows, key=lambda r: (-r[0], r[1]))


def test_reports_by_hour_and_head_are_ordered(spark):
    registry.load_all()
    hours = [r["Hour"] for r in registry.QUERIES["mean_delay_by_hour"](spark, SF).collect()]
    assert hours == sorted(hours)
    head = [r["Date"] for r in registry.QUERIES["head"](spark, SF).collect()]
    assert head == sorted(head) and len(head) == 5
