"""Composed jobs M1-M9 end to end on the sf0.001 tables."""
from pyspark.sql import functions as F

from delayspark.plans import pipelines as PL
from delayspark.schema import PROCESSED_COLUMNS
from delayspark.session import read_table
from delayspark.sources import capture as CP
from delayspark.sources.adapters import raw_delay_frames

SF = "/root/testdata/sf0.001"


def test_unify_process_profile(spark):
    frames = raw_delay_frames(read_table(spark, SF, "orders"))
    unified = PL.unify(frames, split_period={"subway": 2019})
    years = {r[0] for r in unified.select(F.year("Date")).distinct().collect()}
    assert years and min(years) >= 2017 and max(years) <= 2025
    sub_years = {r[0] for r in unified.where("Vehicle_Type = 'SUBWAY'").select(F.year("Date")).distinct().collect()}
    assert sub_years == {2019}
    processed = PL.processed_table(unified, materialize=True)  # reliable checkpoint in spark.checkpoint.dir
    assert processed.columns == [c for c in PROCESSED_COLUMNS if c in processed.columns]
    assert len(processed.columns) == 37
    assert processed.where("Bound IS NULL OR Line IS NULL OR Station IS NULL OR Vehicle IS NULL").count() == 0
    assert PL.profile(processed)["crosstab"].columns == ["Year", "Vehicle_Type", "count", "row_pct"]
    reports = PL.profile(processed, types=["BUS", "STREETCAR", "SUBWAY"])
    assert len(reports) == 22
    for name, df in reports.items():
        assert df.count() >= 0, name
    assert reports["crosstab"].where("Year = 'All'").count() == 1


def test_catalogue_jobs(spark):
    pages = read_table(spark, SF, "pages")
    s = CP.search_results(pages)
    cat = PL.catalogue(s)
    assert cat.count() > 0 and set(cat.columns) >= {"title", "url", "formats", "license", "name"}
    done = s.select("name").limit(3)
    e = PL.enrich_catalogue(s.select("page_id", "name"), CP.packages(s), CP.datastore_fields(s),
                            CP.resource_records(s), done=done)
    assert e.count() == s.count() - 3
    m = PL.link_manifest(pages, lenient=True)
    assert set(m.columns) >= {"dataset", "filename", "path", "status", "collision"}


def test_supplement_fills_from_first_yielding_page(spark):
    enriched = spark.createDataFrame(
        [("a", 0, False), ("b", 2, False), ("c", 1, True)],
        "name string, n_dictionary long, has_quality boolean")
    table = "<table><tr><th>c</th><th>t</th></tr><tr><td>id</td><td>int</td></tr><tr><td>x</td><td>text</td></tr></table>"
    pages = spark.createDataFrame([
        ("a", 0, "README notes", table + "<div>Overall score: 10%</div>"),  # skipped: readme heading
        ("a", 1, "Data 2024", "<p>no table</p>"),
        ("a", 2, "Data 2025", table + "<div>Overall score: 87%</div><div>Grade Gold</div>"),
        ("b", 0, "Data", "<div>Freshness: 50%</div>"),
        ("c", 0, "Data", table),
    ], "name string, rpos int, title string, html string")
    out = {r["name"]: r for r in PL.supplement(enriched, pages).collect()}
    assert set(out) == {"a", "b"}  # c has a dictionary and quality already
    a = out["a"]
    assert (a["dictionary_columns"], a["dictionary_rpos"], a["quality_rpos"]) == (2, 2, 2)
    assert (a["overall_score"], a["grade"]) == ("87%", "Gold")
    assert [(d["row"], d["column_name"], d["type"], d["description"]) for d in a["dictionary"]] == [(1, "id", "int", ""), (2, "x", "text", "")]
    assert out["b"]["dictionary"] is None and out["b"]["freshness"] == "50%"
    b = out["b"]
    assert (b["dictionary_columns"], b["dictionary_rpos"]) == (0, None)  # b already has a dictionary
    assert (b["quality_rpos"], b["freshness"]) == (0, "50%")


def test_supplement_shuffles_no_markup(spark):
    pages = read_table(spark, SF, "pages").selectExpr("concat('ds-', page_id) as name", "0 as rpos", "'t' as title", "html")
    enriched = spark.createDataFrame([("ds-1", 0, False)], "name string, n_dictionary long, has_quality boolean")
    plan = PL.supplement(enriched, pages)._jdf.queryExecution().executedPlan().toString()
    assert not any("html" in line for line in plan.splitlines() if "Exchange" in line)
