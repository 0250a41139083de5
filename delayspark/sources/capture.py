"""A landed catalogue capture derived from the driver's ``pages`` table.

The catalogue jobs consume what a portal's API returned (search results,
package, datastore fields and resource records).  The driver ships no such
capture, so one is derived from ``pages`` with Spark: every page becomes a
dataset whose resources are the page's links, all of them.  Every value is
read from the page: dates from the number in its path, update rates from its
language, organisation from its host, formats and sizes from the link.
Lookups miss where the data does not have what they need: a page without a
number has an unknown date, a link whose text is more than one word has no
datastore fields, a link with a non-ASCII address has no record.
``delayspark.plans.catalogue_queries`` builds the same capture in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H

# --- fixed values: capture rules ------------------------------------------------
FORMATS = ["CSV", "XLSX", "JSON", "csv", "GeoJSON", "XML", ""]
REFRESH = {"en": "Daily", "fr": "Weekly", "de": "Monthly", "es": "Annually"}
FIELD_TYPES = ["text", "int", "numeric", "date"]
LICENSE = "Open Government Licence"
CAPTURE_EPOCH = "2025-01-01"
ONE_WORD = r"^\pL+$"
ASCII_ONLY = r"^[ -~]*$"


def _iso(offset: Column, hhmmss: str) -> Column:
    day = F.date_add(F.lit(CAPTURE_EPOCH).cast("date"), offset.cast("int"))
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(f"T{hhmmss}"))


def path_number(url: Column) -> Column:
    """The number in a page's path, NULL without one."""
    return F.regexp_extract(url, r"://[^/]+/[a-z]+/(\d+)", 1).try_cast("int")


def _resources(name: Column, number: Column, url: Column, html: Column) -> Column:
    root = H.origin_of(url)

    def one(x, i):
        href = H.decode_entities(x["href"])
        text = H.text_of(x["inner"])
        off = F.coalesce(number, F.lit(0)) + i
        return F.struct(
            F.concat(name, F.lit("-r"), i.cast("string")).alias("id"),
            text.alias("name"),
            F.element_at(F.array(*[F.lit(f) for f in FORMATS]), F.length(text) % len(FORMATS) + 1).alias("format"),
            H.resolve_url(root, href).alias("url"),
            F.when(F.regexp_like(href, F.lit(ASCII_ONLY)), (F.length(href) * 100_000).cast("bigint")).alias("size"),
            _iso(off, "08:00:00").alias("last_modified"),
            _iso(F.coalesce(number, F.lit(0)), "07:00:00").alias("created"),
        )
    return F.transform(H.anchors(html), one)


def search_results(pages: DataFrame) -> DataFrame:
    """One CKAN dataset record per page (the ``package_search`` results)."""
    k, url, html = F.col("page_id"), F.col("url"), F.col("html")
    name = F.concat(F.lit("ds-"), k.cast("string"))
    title = F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)
    number = path_number(url)
    https, query = F.startswith(url, F.lit("https:")), F.contains(url, F.lit("?"))
    rates = F.create_map(*[F.lit(x) for kv in REFRESH.items() for x in kv])
    rate = F.try_element_at(rates, F.regexp_extract(url, r"://[^/]+/([a-z]+)", 1))
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    extras = F.filter(F.array(
        F.when(~https, entry("refresh_rate", rate)),
        F.when(https, entry("update_frequency", rate)),
        F.when(query & number.isNotNull(), entry("date_modified", _iso(number, "09:15:00"))),
        F.when(F.contains(url, F.lit("#")), entry("refresh_rate", F.lit("As available"))),
        F.when(F.contains(url, F.lit(".html")), entry("dataset_category", F.lit("Map"))),
    ), lambda e: e.isNotNull())
    host = F.regexp_extract(url, r"://([^/]+)", 1)
    base = pages.select(
        k.alias("page_id"), title.alias("title"), name.alias("name"),
        F.when(title != "", F.concat(F.lit("  "), title, F.lit(" \n"))).alias("notes"),
        F.coalesce(_iso(number, "10:30:00"), F.lit("unknown")).alias("metadata_modified"),
        F.when(~https, F.lit(LICENSE)).when(query, F.lit("")).alias("license_title"),
        F.when(https, F.lit("ogl")).otherwise(F.lit("")).alias("license_id"),
        F.when(~F.startswith(host, F.lit("m.")), F.struct(host.alias("title"))).alias("organization"),
        extras.alias("extras"), _resources(name, number, url, html).alias("resources"))
    texts = F.transform("resources", lambda r: r["name"])
    return base.withColumns({
        "groups": F.transform(F.filter(texts, lambda t: F.regexp_like(t, F.lit(r"^\p{Lu}"))), lambda t: F.struct(t.alias("title"))),
        "tags": F.transform(texts, lambda t: F.struct(t.alias("name")))}).select(
        "page_id", "title", "name", "notes", "metadata_modified", "license_title", "license_id", "organization",
        "groups", "tags", "extras", "resources")


def _results(df: DataFrame) -> DataFrame:
    """Accept either the pages table or already derived search results."""
    return df if "resources" in df.columns else search_results(df)


def packages(pages: DataFrame) -> DataFrame:
    """``package_show`` per dataset name: (name, resources)."""
    return _results(pages).select("name", "resources")


def datastore_fields(pages: DataFrame) -> DataFrame:
    """``datastore_search`` schema per resource: (resource_id, fields).

    A resource whose link text is one word is in the datastore; its fields
    are the parts of its address, each with a type by its length and notes when it has
    more than three characters."""
    res = _results(pages).select(F.explode("resources").alias("r")).where(F.regexp_like("r.name", F.lit(ONE_WORD)))
    parts = F.filter(F.split(F.regexp_replace("r.url", "^[a-z]+://", ""), "[/.]"), lambda x: x != F.lit(""))
    fields = F.transform(parts, lambda t: F.named_struct(
        F.lit("id"), t,
        F.lit("type"), F.element_at(F.array(*[F.lit(x) for x in FIELD_TYPES]), F.length(t) % 4 + 1),
        F.lit("info"), F.when(F.length(t) > 3, F.named_struct(F.lit("notes"), F.concat(F.lit("About "), t)))))
    return res.select(F.col("r.id").alias("resource_id"), fields.alias("fields"))


def resource_records(pages: DataFrame) -> DataFrame:
    """``resource_show`` per resource id; only addresses in ASCII have a record."""
    res = _results(pages).select(F.explode("resources").alias("r")).where(F.regexp_like("r.url", F.lit(ASCII_ONLY)))
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    return res.select(
        F.col("r.id").alias("resource_id"), F.col("r.last_modified").alias("last_modified"),
        F.col("r.created").alias("created"), F.col("r.format").alias("format"), F.col("r.size").alias("size"),
        F.array(entry("quality_score", F.length("r.url").cast("string")),
                entry("openness", F.length("r.format").cast("string")),
                entry("Score_Grade", F.upper(F.substring("r.name", 1, 1)))).alias("extras"))
