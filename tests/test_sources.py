from pyspark.sql import functions as F
"""Sources: workbooks, code lists, permissive CSV, file selection, catalogue documents."""
import io
import json
import os
import zipfile


from delayspark.operators import conform as B
from delayspark.operators.codes import code_dimension, describe_code
from delayspark.sources import files as FS
from delayspark.sources import sinks as SK

M = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def xlsx_bytes(rows):
    """A minimal workbook: first row shared strings, numbers as numbers, other text inline."""
    shared = []
    cells_xml = []
    for ri, row in enumerate(rows, start=1):
        cs = []
        for ci, v in enumerate(row):
            ref = f"{chr(65 + ci)}{ri}"
            if v is None:
                continue
            if ri == 1:
                shared.append(v)
                cs.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
            elif isinstance(v, (int, float)):
                cs.append(f'<c r="{ref}"><v>{v}</v></c>')
            else:
                cs.append(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>')
        cells_xml.append(f'<row r="{ri}">{"".join(cs)}</row>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{M}" xmlns:r="{R}"><sheets>'
                   f'<sheet name="2019" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/data.xml" Type="x"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{M}">' + "".join(f"<si><t>{s}</t></si>" for s in shared)
                   + "</sst>")
        z.writestr("xl/worksheets/data.xml", f'<worksheet xmlns="{M}"><sheetData>{"".join(cells_xml)}'
                   "</sheetData></worksheet>")
    return buf.getvalue()


def test_workbook_reader_isolates_bad_files(spark, tmpdir_shared):
    os.makedirs(tmpdir_shared, exist_ok=True)
    rows = [["Report Date", "Route", "Time", "Location", "Incident", "Min Delay", "Min Gap", "Direction", "Vehicle"],
            ["2019-01-01", 36, "7:05:09", "Finch", "Mechanical", 10, 20, "N", 8001],
            ["2019-01-02", 501, "23:10:00", "Queen", "Diversion", 5, None, None, None]]
    with open(os.path.join(tmpdir_shared, "ttc-bus-delay-data-2019.xlsx"), "wb") as f:
        f.write(xlsx_bytes(rows))
    with open(os.path.join(tmpdir_shared, "broken-2018.xlsx"), "wb") as f:
        f.write(b"not a zip file")
    cells = FS.scan_workbook_cells(spark, tmpdir_shared)
    errors = cells.where("error IS NOT NULL").collect()
    assert len(errors) == 1 and errors[0]["path"].endswith("broken-2018.xlsx")
    raw = FS.workbook_frame(cells, rows[0])
    bus = B.conform(raw, "bus", typed=True).orderBy("Date").collect()
    assert len(bus) == 2
    assert bus[0]["Line"] == "36" and bus[0]["Station"] == "Finch" and bus[0]["Min Delay"] == 10.0
    assert bus[0]["Vehicle"] == 8001 and bus[1]["Min Gap"] is None and bus[0]["Vehicle_Type"] == "BUS"
    assert str(bus[0]["Date"]) == "2019-01-01"


def test_code_lists(spark, tmpdir_shared):
    os.makedirs(tmpdir_shared, exist_ok=True)
    body = ('_id,CODE,DESCRIPTION\r\n1,EUME,Mechanical\r\n2,EXVE,"Vehicle, exterior"\r\n'
            '3,EXVE,Vehicle duplicate\r\n4,MUIS,Injury â\u0080\u0093 minor\r\n')
    p = os.path.join(tmpdir_shared, "codes.csv")
    with open(p, "w", encoding="utf-8", newline="") as f:
        f.write(body)
    codes = FS.scan_codes(spark, p)
    assert codes.count() == 4
    dim = code_dimension({"bus": codes})
    got = {r["Code"]: r["Description"] for r in dim.collect()}
    assert got == {"EUME": "Mechanical", "EXVE": "Vehicle, exterior", "MUIS": "Injury – minor"}
    inc = spark.createDataFrame([("BUS", "EXVE"), ("BUS", "ZZZ"), ("SUBWAY", "EXVE")], "Vehicle_Type string, Code string")
    d = {(r["Vehicle_Type"], r["Code"]): r["Description"] for r in describe_code(inc, dim).collect()}
    assert d == {("BUS", "EXVE"): "Vehicle, exterior", ("BUS", "ZZZ"): None, ("SUBWAY", "EXVE"): None}


def test_permissive_csv_and_ingest_log(spark, tmpdir_shared):
    os.makedirs(tmpdir_shared, exist_ok=True)
    with open(os.path.join(tmpdir_shared, "a.csv"), "w") as f:
        f.write("Date,Min Delay\n2025-01-01,5\n2025-01-02,x,extra\n")
    schema = B.INCIDENT_SCHEMA.__class__([f for f in B.INCIDENT_SCHEMA.fields if f.name in ("Date", "Min Delay")])
    log = FS.ingest_csv(spark, tmpdir_shared + "/a.csv", schema, tmpdir_shared + "/landed").first()
    assert (log["rows"], log["corrupt_rows"]) == (2, 1)


def test_select_files_by_year_and_name(spark, tmpdir_shared):
    for name in ("ttc-subway-delay-data-2019.csv", "ttc-subway-delay-data-2020.csv", "unified-2020.csv"):
        d = os.path.join(tmpdir_shared, name.replace(".csv", ""))
        os.makedirs(d, exist_ok=True)
        with open(os.path.join(d, name), "w") as f:
            f.write("Date,Line\n2020-01-01,YU\n")
    df = FS.scan_csv(spark, tmpdir_shared + "/*", with_file=True)
    picked = sorted(r["_file"] for r in FS.select_files(df, years=[2020]).collect())
    assert picked == ["ttc-subway-delay-data-2020.csv"]
    first = FS.select_files(df, years=[2019, 2020], first_only=True).select("_file").distinct().collect()
    assert [r[0] for r in first] == ["ttc-subway-delay-data-2019.csv"]


def test_folders_do_not_choose_files(spark, tmpdir_shared):
    root = os.path.join(tmpdir_shared, "a2020f", "land", "2024", "delay-2018")
    os.makedirs(root)
    with open(os.path.join(root, "delay-2019.csv"), "w") as f:
        f.write("Date,Line\n2019-01-01,YU\n")
    df = FS.scan_csv(spark, root)
    assert FS.select_files(df, years=[2019]).count() == 1 and FS.select_files(df, years=[2019], first_only=True).count() == 1
    assert FS.select_files(df, years=[2018, 2020, 2024]).count() == 0
    names = spark.createDataFrame([("x-2019.xlsx",), ("x-2019-v2.xlsx",), ("x 2019 b.csv",), ("x12019.csv",)], "n string")
    assert [r[0] for r in names.select(FS.year_of_file(F.col("n"))).collect()] == [2019, None, 2019, None]


def test_catalogue_document_and_lines(spark, tmpdir_shared):
    os.makedirs(tmpdir_shared, exist_ok=True)
    doc = {"total_datasets": 2, "scraped_at": "2026-01-26", "source_url": "x", "api_endpoint": "y",
           "datasets": [{"title": "A", "name": "a", "license": None, "dictionary": [], "quality": {}},
                        {"title": "B", "name": "b", "license": "ogl",
                         "dictionary": [{"column_name": "c", "type": "int", "description": ""}],
                         "quality": {"format": "CSV", "size": 5}}]}
    p = os.path.join(tmpdir_shared, "catalogue.json")
    with open(p, "w") as f:
        json.dump(doc, f, indent=2)
    ds = FS.scan_catalogue(spark, p).orderBy("pos").collect()
    assert [r["name"] for r in ds] == ["a", "b"] and ds[0]["license"] is None
    assert ds[1]["quality"]["size"] == "5" and len(ds[1]["dictionary"]) == 1
    out = os.path.join(tmpdir_shared, "sink")
    SK.sink_catalogue(FS.scan_catalogue(spark, p).drop("pos"), out)
    back = FS.scan_catalogue(spark, out + "/datasets", document=False)
    assert back.count() == 2
    header = spark.read.json(out + "/header").first()
    assert header["total_datasets"] == 2


def test_sink_manifest_counts_distinct(spark, tmpdir_shared):
    files = spark.createDataFrame([("a/x.csv", "download"), ("a/x.csv", "skipped"), ("a/y.csv", "download")],
                                  "path string, status string")
    SK.sink_manifest(files, tmpdir_shared)
    h = spark.read.json(tmpdir_shared + "/header").first()
    assert (h["total_files"], h["distinct_files"]) == (3, 2)
    assert spark.read.json(tmpdir_shared + "/files").count() == 3


def test_processed_sink_partitions_by_year(spark, tmpdir_shared):
    from delayspark.plans.incident_queries import events_processed
    df = events_processed(spark, "/root/testdata/sf0.001")
    SK.sink_processed(df, tmpdir_shared)
    back = spark.read.parquet(tmpdir_shared)
    assert back.count() == df.count() and "Year" in back.columns
    assert any(name.startswith("Year=") for name in os.listdir(tmpdir_shared))


def test_workbook_serial_dates_and_times(spark, tmpdir_shared):
    os.makedirs(tmpdir_shared, exist_ok=True)
    rows = [["Date", "Time", "Line", "Min Delay"], [43466, 0.2951041667, "YU", 4], ["2019-01-02", "7:05:09", "BD", 3]]
    with open(os.path.join(tmpdir_shared, "ttc-subway-delay-data-2019.xlsx"), "wb") as f:
        f.write(xlsx_bytes(rows))
    raw = FS.scan_workbook(spark, tmpdir_shared, rows[0])
    got = sorted((r["Date"], r["Time"]) for r in raw.collect())
    assert got == [("2019-01-01", "07:04:57"), ("2019-01-02", "7:05:09")]


def test_visible_text_lines(spark):
    from delayspark.operators import web as W
    html = "<div>Last refreshed</div><div>Jan 26, 2026</div><p>Freshness: 80%</p><script>x='Grade A'</script>"
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    q = W.quality_metrics(df).first()
    assert q["last_refreshed"] == "Jan 26, 2026" and q["freshness"] == "80%" and q["grade"] is None
