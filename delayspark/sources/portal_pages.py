"""Captured portal pages derived from the driver's ``part`` and ``supplier`` tables.

The driver's ``pages`` hold no table, no ``h3`` card and no data link, so the pages that those jobs read are rendered
here from rows of other tables, in the forms real portals write: omitted end tags, nested tables, markup in
comments and scripts, headings without a link.  Every row gives one page (a catalogue page holds the cards of ten
suppliers); values and texts come from the rows alone.  ``delayspark.plans.portal_queries`` states in SQL,
from the same rows, what a reader of the pages must find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOST = "https://open.example.org"
CARDS_PER_PAGE = 10
REFRESH = ["Daily", "Weekly", "Monthly"]


def _html(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def dictionary_pages(part: DataFrame) -> DataFrame:
    """(page_id, url, html): a resource page per part with a data dictionary, in four forms of markup."""
    name, kind, brand, size = F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.col("p_size").cast("string")
    plain = _html("<table><tr><th>Column</th><th>Type</th><th>Description</th></tr><tr><td> <b>", name, "</b> </td><td>text</td><td>", brand,
                  " &amp; more</td></tr><tr><td>size</td><td>int</td></tr><tr><td>only</td></tr></table>")
    omitted = _html("<table class=d><tr><th>Column<th>Type<tbody><tr><td>", name, "<td>", kind, "<td>", brand,
                    "<tr><td>price<td>numeric</table><table><tr><td>x<td>y<tr><td>p<td>q</table>")
    nested = _html("<TABLE title='a > b'><TR><TH>Column</TH><TH>Type</TH></TR><TR><TD>", name, "</TD><TD>", kind, "<table><tr><td>k</td><td>", size,
                   "</td></tr></table></TD></TR><TR><TD>price</TD><TD>numeric</TD><TD>", brand, "</TD></TR></TABLE>")
    hidden = _html("<!-- <table><tr><th>Old</th></tr><tr><td>gone</td><td>text</td></tr></table> --><track src=x>",
                   "<table><caption>Fields</caption><thead><tr><th>Column</th><th>Type</th></tr></thead><tr><td>", name,
                   "</td><td>", kind, "<!-- <td>no</td> --></td><td>", brand, "</table>")
    body = F.when(F.col("p_partkey") % 4 == 0, plain).when(F.col("p_partkey") % 4 == 1, omitted).when(F.col("p_partkey") % 4 == 2, nested).otherwise(hidden)
    return part.select(F.col("p_partkey").alias("page_id"), _html(HOST, "/dataset/parts/resource/", F.col("p_partkey").cast("string")).alias("url"),
                       _html("<html><head><script>var t='<table><tr><td>no</td><td>no</td></tr>';</script></head><body>", body, "</body></html>").alias("html"))


def catalogue_pages(supplier: DataFrame) -> DataFrame:
    """(page_id, url, html): catalogue pages of ten suppliers' cards each; suppliers of every fifth nation have a heading without a link."""
    name, key = F.col("s_name"), F.col("s_suppkey").cast("string")
    rate = F.element_at(F.array(*[F.lit(r) for r in REFRESH]), (F.col("s_nationkey") % 3 + 1).cast("int"))
    linked = _html("<li><h3 class=title><a class=\"t\" href=\"/dataset/s-", key, "/\">", name, "</a></h3><p>All about <i>", name,
                   "</i></p><div>Refresh Rate</div><div>", rate, "</div><!-- Publisher none --><div>Publisher</div><div>Nation ", F.col("s_nationkey").cast("string"),
                   "</div></li>")
    bare = _html("<li><h3>", name, "</h3><p>No dataset</p></li><!-- <li><h3><a href=\"/dataset/hidden/\">Hidden</a></h3></li> -->")
    cards = supplier.select(F.floor(F.col("s_suppkey") / CARDS_PER_PAGE).cast("long").alias("page_id"),
                            F.struct("s_suppkey", F.when(F.col("s_nationkey") % 5 == 0, bare).otherwise(linked).alias("card")).alias("c"))
    pages = cards.groupBy("page_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    return pages.select("page_id", _html(HOST, "/catalogue?page=", F.col("page_id").cast("string")).alias("url"),
                        _html("<html><body><h1>Catalogue</h1><ul>", F.array_join(F.transform("cs", lambda c: c["card"]), "\n"), "</ul></body></html>").alias("html"))


def download_pages(supplier: DataFrame) -> DataFrame:
    """(page_id, url, html): a dataset page per supplier with links to a workbook, twice to one table file, and to other pages."""
    name, key = F.col("s_name"), F.col("s_suppkey").cast("string")
    links = _html("<a href='/datastore/dump/", key, ".xlsx'>Download ", name, " dataset in XLSX format</a> <a href='/about'>About</a>",
                  "<a href=\"/files/", key, "/data.csv\">Download data in CSV</a><a href=\"/files/", key, "/data.csv?v=2\">Download data dataset in CSV</a>",
                  "<!-- <a href='/old.csv'>Download old dataset in CSV</a> -->")
    return supplier.select(F.col("s_suppkey").alias("page_id"), _html(HOST, "/dataset/s-", key, "/").alias("url"),
                           _html("<html><body>", links, "</body></html>").alias("html"))
