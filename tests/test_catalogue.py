"""Catalogue records (FIXTURES F8, F9): flattening, enrichment and quality policies."""
from pyspark.sql import functions as F

from delayspark.functions import catalogue as K
from delayspark.operators import catalogue as CAT
from delayspark.schema import CKAN_DATASET, FIELD_STRUCT
from pyspark.sql import types as T


def res(i, fmt, rid=None):
    return {"id": rid or f"r{i}", "name": f"res {i}", "format": fmt, "url": f"https://x/{i}", "size": 1024 * i,
            "last_modified": "2026-01-0%dT00:00:00" % (i + 1), "created": "2025-01-01", }


def records(spark):
    d1 = {"title": "Bus delays", "name": "bus-delays", "notes": "  Delays of buses.\n ",
          "metadata_modified": "2026-01-26T10:00:00.123456", "license_title": None, "license_id": "ogl",
          "organization": {"title": "Transit"}, "groups": [{"title": "Transport"}, {"title": ""}],
          "tags": [{"name": "bus"}, {"name": "delay"}],
          "extras": [{"key": "refresh_rate", "value": "Daily"}, {"key": "refresh_rate", "value": "Monthly"}],
          "resources": [res(0, "csv"), res(1, "XLSX"), res(2, "CSV ")]}
    d2 = {"title": "Maps", "name": "maps", "notes": None, "metadata_modified": "not a date", "license_title": "",
          "license_id": "", "organization": None, "groups": [], "tags": None,
          "extras": [{"key": "frequency", "value": "Weekly"}, {"key": "dataset_category", "value": "Map"}],
          "resources": [res(0, "geojson")]}
    d3 = {"title": "Polls", "name": "polls", "notes": "", "metadata_modified": "", "license_title": "Open",
          "license_id": None, "organization": {"title": "Clerk"}, "groups": None, "tags": [],
          "extras": [{"key": "date_modified", "value": ""}, {"key": "update_frequency", "value": "As needed"}],
          "resources": [res(0, "CSV", "p0"), res(1, "XLSX", "p1")]}
    return spark.createDataFrame([d1, d2, d3], CKAN_DATASET)


def test_dataset_info_fields(spark):
    info = {r["name"]: r for r in CAT.dataset_info(records(spark), keep_all=True).collect()}
    b = info["bus-delays"]
    assert b["url"] == "https://open.toronto.ca/dataset/bus-delays/"
    assert b["description"] == "Delays of buses."
    assert b["refresh_rate"] == "Monthly"  # the later duplicate wins
    assert b["last_refreshed"] == "Jan 26, 2026"
    assert b["formats"] == "CSV | CSV  | XLSX" and b["topics"] == "Transport" and b["tags"] == "bus | delay"
    assert b["license"] == "ogl" and b["type"] == "Table" and b["publisher"] == "Transit"
    m = info["maps"]
    assert (m["description"], m["publisher"], m["refresh_rate"], m["type"]) == ("", "", "Weekly", "Map")
    assert m["last_refreshed"] == "not a date" and m["license"] is None and m["tags"] == ""
    p = info["polls"]
    assert p["last_refreshed"] == "" and p["refresh_rate"] == "As needed"
    kept = {r["name"] for r in CAT.dataset_info(records(spark)).collect()}
    assert kept == {"bus-delays", "polls"}  # C4: datasets without CSV are dropped


def test_extras_map_last_wins(spark):
    m = records(spark).where("name = 'bus-delays'").select(K.extras_to_map("extras")).first()[0]
    assert m == {"refresh_rate": "Monthly"}


def lookups(spark):
    recs = records(spark)
    packages = recs.select("name", "resources")
    field = lambda i, t, n: {"id": i, "type": t, "info": None if n is None else {"notes": n}}
    fields = spark.createDataFrame([
        ("r0", [field("_id", "int", None), field("Date", "date", "Day")]),
        ("r2", [field("Route", "text", "Line")]),
        ("p0", [field("Poll", "text", "")]),
    ], T.StructType([T.StructField("resource_id", T.StringType()), T.StructField("fields", T.ArrayType(FIELD_STRUCT))]))
    recs_tbl = spark.createDataFrame([
        ("r1", "2026-01-02", "2025", "XLSX", 2048, [("quality_score", "80")]),
        ("r2", "2026-01-03", "2025", "CSV", 3072, [("Score_Grade", "A"), ("other", "x")]),
        ("p0", "2026-02-01", "2025", "CSV", 10, []),
        ("p1", "2026-02-02", "2025", "XLSX", 20, []),
    ], "resource_id string, last_modified string, created string, format string, size long, "
       "extras array<struct<key:string,value:string>>")
    return recs, packages, fields, recs_tbl


def test_dictionary_in_resource_order(spark):
    recs, pk, fl, _ = lookups(spark)
    rows = CAT.dictionary_rows(pk, fl).where("name = 'bus-delays'").orderBy("rpos", "fpos").collect()
    assert [(r["column_name"], r["description"]) for r in rows] == [("_id", ""), ("Date", "Day"), ("Route", "Line")]


def test_quality_policies(spark):
    recs, pk, fl, rc = lookups(spark)
    first = {r["name"]: r["format"] for r in CAT.quality_first(pk, rc).collect()}
    assert first == {"bus-delays": "CSV", "polls": "CSV"}  # r0 has no record; r2 is the first CSV with one
    last = {r["name"]: r["format"] for r in CAT.quality_last(pk, rc).collect()}
    assert last == {"bus-delays": "CSV", "polls": "XLSX"}
    upd = {(r["name"], r["key"]): r["value"] for r in CAT.quality_update(pk, rc).collect()}
    assert upd[("bus-delays", "Score_Grade")] == "A" and ("bus-delays", "other") not in upd
    assert upd[("bus-delays", "size")] == "3072"


def test_enrich_keeps_failed_lookups_and_coverage(spark):
    recs, pk, fl, rc = lookups(spark)
    e = CAT.enrich(recs.select("name"), pk, fl, rc)
    got = {r["name"]: (r["n_resources"], r["n_dictionary"], r["has_quality"]) for r in e.collect()}
    assert got == {"bus-delays": (2, 3, True), "maps": (0, 0, False), "polls": (1, 1, True)}
    cov = CAT.enrichment_coverage(e).first()
    assert (cov["datasets"], cov["with_dictionary"], cov["with_quality"], cov["dictionary_columns"]) == (3, 2, 2, 4)
    assert {r["name"] for r in CAT.needs_enrichment(e).collect()} == {"maps"}
    assert {r["name"] for r in CAT.union_distinct(e).collect()} == {"maps"}
    done = e.where(F.col("n_dictionary") > 0)
    assert {r["name"] for r in CAT.resume_remaining(recs.select("name"), done).collect()} == {"maps"}
    assert CAT.first_with(e, order="name").first()["name"] == "bus-delays"


def test_golden_sample_shape(spark):
    """Shape of an enriched document (a hand-made literal mirroring F8)."""
    from delayspark.sources.files import CATALOGUE_DATASET
    row = {"title": "Polls", "name": "polls", "dictionary": [{"column_name": f"c{i}", "type": "text",
                                                             "description": ""} for i in range(25)],
           "quality": {"format": "XLSX", "size": "10"}}
    df = spark.createDataFrame([row], CATALOGUE_DATASET)
    r = df.select(F.size("dictionary").alias("n"), F.col("quality")["format"].alias("f"),
                  F.slice("dictionary", 1, 3).alias("head")).first()
    assert r["n"] == 25 and r["f"] == "XLSX" and [d["column_name"] for d in r["head"]] == ["c0", "c1", "c2"]


def test_size_label_and_mojibake(spark):
    df = spark.createDataFrame([(512,), (2 * 1024 * 1024 + 5000,), (None,)], "s long")
    assert [r[0] for r in df.select(K.file_size_label("s")).collect()] == ["0.50 KB", "2.00 MB", None]
    broken = "Delay â\u0080\u0093 mechanical".encode("utf-8").decode("utf-8")
    d = spark.createDataFrame([(broken,), ("clean – text",)], "t string")
    assert [r[0] for r in d.select(K.repair_mojibake("t")).collect()] == ["Delay – mechanical",
                                                                         "clean – text"]


def test_dictionary_lists_keep_order(spark):
    rows = spark.createDataFrame([("d", 2, 0, "c", "int", ""), ("d", 0, 1, "b", "text", ""), ("d", 0, 0, "a", "date", "x")],
                                 "name string, rpos int, fpos int, column_name string, type string, description string")
    got = CAT.dictionary_lists(rows).first()
    assert [e["column_name"] for e in got["dictionary"]] == ["a", "b", "c"]


def test_crosstab_long(spark):
    from delayspark.operators import crosstab as X
    df = spark.createDataFrame([(2017, "BUS")] * 3 + [(2017, "SUBWAY")], "Year int, Vehicle_Type string")
    got = {(r["Year"], r["Vehicle_Type"]): (r["count"], r["row_pct"]) for r in X.crosstab_long(df).collect()}
    assert got == {(2017, "BUS"): (3, 75.0), (2017, "SUBWAY"): (1, 25.0)}
