"""Literal pages for the link, table, quality and card jobs (FIXTURES F11, F12)."""
from pyspark.sql import functions as F

from delayspark.functions import html as H
from delayspark.operators import web as W

PAGE = """<html><body>
<a href="/datastore/dump/x.xlsx">Download ttc-x-2014 dataset in XLSX format</a>
<a class="b" href="https://ckan.example.org/dataset/a/resource/abc-123/download/">Download A_b dataset in CSV</a>
<a href="/resource/r-9/">Download this file</a>
<a href="files/data.csv">Download 2019 data</a>
<a href="/datastore/dump/x.xlsx">Download ttc-x-2014 dataset in XLSX format</a>
<a href="/about">About us</a>
<a href="https://open.example.com/dataset/streetcar/">Streetcar &amp; <b>bus</b></a>
</body></html>"""


def pages(spark, html=PAGE, url="https://open.example.com/dataset/ttc-delay/"):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def test_extract_links(spark):
    links = W.extract_links(pages(spark)).orderBy("pos").collect()
    assert len(links) == 7
    assert links[0]["url"] == "https://open.example.com/datastore/dump/x.xlsx"
    assert links[3]["url"] == "https://open.example.com/files/data.csv"
    assert links[6]["text"] == "Streetcar &bus"  # entities decoded, pieces stripped and joined
    assert links[1]["url"].startswith("https://ckan.example.org/")


def test_download_links_and_filenames(spark):
    strict = {r["pos"]: r for r in W.download_links(pages(spark)).collect()}
    assert set(strict) == {0, 1}  # same URL twice keeps the first; "Download this file" is not strict
    assert strict[0]["filename"] == "ttc-x-2014.xlsx"
    assert strict[1]["filename"] == "a-b.csv"
    lenient = {r["pos"]: r["filename"] for r in W.download_links(pages(spark), lenient=True).collect()}
    assert set(lenient) == {0, 1, 2, 3}
    assert lenient[2] == "r-9.xlsx"  # resource id fallback
    assert lenient[3] == "data.csv"  # URL basename with a dot


def test_filename_terminator_without_word_boundary(spark):
    df = spark.createDataFrame([("Download ttc bus index file dataset in CSV", "/x")], "t string, h string")
    assert df.select(H.derive_filename(F.col("t"), F.col("h"))).first()[0] == "ttc-bus.csv"


def test_table_rows(spark):
    html = """<table><tr><th>Column</th><th>Type</th></tr>
    <tr><td>_id</td><td>int</td><td>Row id</td></tr>
    <tr><td> Date </td><td>date</td></tr><tr><td>solo</td></tr><tr><td></td><td>text</td></tr></table>"""
    rows = W.table_rows(pages(spark, html)).orderBy("row").collect()
    assert [(r["column_name"], r["type"], r["description"]) for r in rows] == [
        ("_id", "int", "Row id"), ("Date", "date", ""), ("", "text", "")]
    assert W.table_rows(pages(spark, html), drop_empty_names=True).count() == 2


def test_quality_variants(spark):
    text = "Overall score: 87%\nGrade Gold\nFreshness: 100%\ncompleteness 90%\nLast refreshed: Jan 26, 2026"
    df = pages(spark, f"<div>{text}</div>")
    q = W.quality_metrics(df).first()
    assert (q["overall_score"], q["grade"], q["freshness"], q["completeness"]) == ("87%", "Gold", "100%", "90%")
    assert q["last_refreshed"] == "Jan 26, 2026"
    s = W.quality_metrics_strict(df).first()
    assert s["overall_score"] == "87%" and s["completeness"] is None  # case-sensitive labels
    no_score = pages(spark, "<div>Freshness: 50%</div>")
    assert W.quality_metrics_strict(no_score).first()["freshness"] is None
    assert W.quality_metrics_strict(no_score, parity=False).first()["freshness"] == "50%"


def test_catalogue_cards(spark):
    html = """<ul><li><h3><a href="/dataset/bus-delays/">Bus Delays</a></h3><p>All bus delays.</p>
    <div>Refresh Rate Monthly
    Publisher Transit</div></li>
    <li><h3>Not a dataset</h3><p>x</p></li></ul>"""
    cards = W.catalogue_cards(pages(spark, html, "https://open.example.com/catalogue")).collect()
    assert len(cards) == 1
    c = cards[0]
    assert (c["title"], c["url"], c["description"]) == ("Bus Delays", "https://open.example.com/dataset/bus-delays/",
                                                         "All bus delays.")
    assert c["refresh_rate"] == "Monthly" and c["publisher"] == "Transit" and c["formats"] == ""


def test_link_manifest_skip_and_collision(spark):
    html = """<a href="/a/one.csv">Download one.csv</a><a href="/b/one.csv">Download one.csv</a>"""
    existing = spark.createDataFrame([("ttc", "one.csv", 10)], "dataset string, filename string, size long")
    m = W.link_manifest(pages(spark, html, "https://x.org/dataset/ttc/"), existing).orderBy("pos").collect()
    assert [r["status"] for r in m] == ["skipped", "skipped"]
    assert [r["collision"] for r in m] == [False, True]
    assert m[0]["path"] == "dataset/ttc/one.csv"


def test_dataset_slug(spark):
    df = spark.createDataFrame([("https://x.org/dataset/ttc-bus-delay-data/",), ("https://x.org/a",)], "u string")
    assert [r[0] for r in df.select(H.dataset_slug(F.col("u"))).collect()] == ["ttc-bus-delay-data", "https://x.org/a"]


def test_escaped_markup_stays_text_and_entities(spark):
    df = spark.createDataFrame([("Download &lt;csv&gt; set",), ("a&#233;b &#x20AC; &middot; &amp;lt; &copy;",), ("x <b> y </b>",)], "h string")
    assert [r[0] for r in df.select(H.text_of("h")).collect()] == ["Download <csv> set", "aéb € · &lt; ©", "xy"]


def test_anchor_attributes(spark):
    html = ("<a data-href=\"x.json\" href=\"y.csv\">1</a><a href=\"it's.csv\">2</a><a href=z.csv>3</a><!-- <a href='no'>4</a> -->"
            "<a name=top>5</a><A HREF='q?a=1&amp;b=2' title=\"a > b\">6</A><abbr href=no>7</abbr><a href=\"\">8</a>")
    got = [(r["href"], r["text"]) for r in W.extract_links(pages(spark, html)).orderBy("pos").collect()]
    assert got == [("y.csv", "1"), ("it's.csv", "2"), ("z.csv", "3"), ("q?a=1&b=2", "6"), ("", "8")]


def test_links_resolve_against_the_root_and_fold_dots(spark):
    html = "".join(f'<a href="{h}">t</a>' for h in ("b.csv", "../c.csv", "/x/../y/./z", "#f", "?q=1", "//o.org/a", "http://p.org/../k", "", "d/.."))
    url = "https://open.example.com/dataset/foo/"
    root = [r["url"] for r in W.extract_links(pages(spark, html, url)).orderBy("pos").collect()]
    assert root == [f"https://open.example.com{x}" for x in ("/b.csv", "/c.csv", "/y/z", "#f", "?q=1")] + [
        "https://o.org/a", "http://p.org/../k", "https://open.example.com", "https://open.example.com/"]
    page = [r["url"] for r in W.extract_links(pages(spark, html, url), from_root=False).orderBy("pos").collect()]
    assert page[:3] == [url + "b.csv", "https://open.example.com/dataset/c.csv", "https://open.example.com/y/z"]


def test_cards_on_one_line(spark):
    html = ('<h3><a href="/dataset/a/">A</a></h3><p>About a</p><div>Refresh Rate</div><div>Daily</div><div>Publisher</div><div>City</div>'
            '<h3><a href="/other/">No</a></h3>')
    rows = W.catalogue_cards(pages(spark, html)).collect()
    assert len(rows) == 1 and (rows[0]["title"], rows[0]["url"], rows[0]["description"]) == ("A", "https://open.example.com/dataset/a/", "About a")
    assert (rows[0]["refresh_rate"], rows[0]["publisher"]) == ("Daily", "City")


def test_second_filename_form(spark):
    df = spark.createDataFrame([("Download a b in CSV", "/p/x~1.csv"), ("Download A b dataset in CSV", "/x")], "t string, h string")
    from delayspark.schema import FILENAME_PATTERN_DATASET as pattern
    assert [r[0] for r in df.select(H.derive_filename("t", "h", pattern=pattern, clean_url=False)).collect()] == ["x~1.csv", "a-b.csv"]


def rows_of(spark, html):
    return [(r["column_name"], r["type"], r["description"]) for r in W.table_rows(pages(spark, html)).orderBy("row").collect()]


def test_nested_table_keeps_the_rows_after_it(spark):
    html = ("<table><tr><th>c</th></tr><tr><td>a</td><td>int<table><tr><td>x</td></tr></table></td></tr>"
            "<tr><td>b</td><td>text</td></tr></table><table><tr><td>z</td><td>z</td></tr><tr><td>y</td><td>y</td></tr></table>")
    assert rows_of(spark, html) == [("a", "intx", "x"), ("b", "text", "")]
    both = "<table><tr><td>h<tr><td>a<td><table><tr><td>k<td>v<tr><td>l<td>w</table><td>last<tr><td>b<td>c</table>"
    assert rows_of(spark, both) == [("a", "kvlw", "k"), ("k", "v", ""), ("l", "w", ""), ("b", "c", "")]


def test_table_without_end_tags(spark):
    assert rows_of(spark, "<p>x<table><tr><th>Name<th>Type<tr><td>a<td>int<tr><td> b &amp; c <td>text<td>d</table><td>out<td>out") == [
        ("a", "int", ""), ("b & c", "text", "d")]
    assert rows_of(spark, "<TABLE><thead><tr><th>h<tbody><tr><td>a</td><td>b<tfoot><tr><td>f<td>g") == [("a", "b", ""), ("f", "g", "")]
    assert rows_of(spark, "<table><td>h<td>h</tr><td>a<td>b</table>") == [("a", "b", "")]  # rows implied by their cells


def test_table_in_a_comment_or_script_is_none(spark):
    old = "<table><tr><th>o</th></tr><tr><td>old</td><td>old</td></tr></table>"
    new = "<table><tr><th>n</th></tr><tr><td>new<!-- <td>no --></td><td title='a > b'>text</td></tr></table>"
    assert rows_of(spark, f"<!-- {old} --><script>var t = '{old}';</script><track src=x>{new}") == [("new", "text", "")]
    assert rows_of(spark, f"<!-- {old}") == [] and rows_of(spark, None) == [] and rows_of(spark, "") == []
    array = pages(spark, f"<!-- {old} -->{new}").select(W.table_row_array(F.col("html")).alias("r")).first()["r"]
    assert [tuple(r) for r in array] == [(1, "new", "text", "")]


def test_cards_and_text_skip_comments(spark):
    html = '<!-- <h3><a href="/dataset/no/">No</a></h3> --><h3><a href="/dataset/a/">A</a></h3><!-- <p>no</p> --><p>yes</p><h3>plain</h3>'
    rows = W.catalogue_cards(pages(spark, html)).collect()
    assert [(r["title"], r["description"]) for r in rows] == [("A", "yes")]
    df = pages(spark, "<div>Overall score: 10%</div><!-- a > b Grade: Gold -->")
    assert W.quality_metrics(df).first()["grade"] is None


def test_long_tables_stay_in_order(spark):
    html = "<table><tr><th>c<th>t" + "".join(f"<tr><td>n{i}<td>t{i}<td>d{i}" for i in range(400)) + "</table>"
    assert rows_of(spark, html) == [(f"n{i}", f"t{i}", f"d{i}") for i in range(400)]
