"""Registered queries over portal pages rendered from ``part`` and ``supplier`` rows.

The SQL never parses markup: it states, from the same rows, what a reader of each form of page finds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import web as W
from ..registry import register
from ..session import read_table
from ..sources import portal_pages as PP
from ..sources import sinks as SK


@register("table_rows_portal", """
SELECT p_partkey AS page_id, CAST(row AS BIGINT) AS row, column_name, type, description FROM (
  SELECT p_partkey, 1 AS row, p_name AS column_name, 'text' AS type, p_brand || ' & more' AS description FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT p_partkey, 2, 'size', 'int', '' FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT p_partkey, 1, p_name, p_type, p_brand FROM part WHERE p_partkey % 4 IN (1, 3)
  UNION ALL SELECT p_partkey, 2, 'price', 'numeric', '' FROM part WHERE p_partkey % 4 = 1
  UNION ALL SELECT p_partkey, 1, p_name, p_type || 'k' || p_size, 'k' FROM part WHERE p_partkey % 4 = 2
  UNION ALL SELECT p_partkey, 2, 'k', CAST(p_size AS VARCHAR), '' FROM part WHERE p_partkey % 4 = 2
  UNION ALL SELECT p_partkey, 3, 'price', 'numeric', p_brand FROM part WHERE p_partkey % 4 = 2)""")
def q_table_rows_portal(spark, sf):
    """Dictionary rows of pages with omitted end tags, nested tables, and markup in comments and scripts."""
    return W.table_rows(PP.dictionary_pages(read_table(spark, sf, "part")))


@register("catalogue_cards_portal", """
SELECT s_suppkey // 10 AS page_id, row_number() OVER (PARTITION BY s_suppkey // 10 ORDER BY s_suppkey) AS card, s_name AS title,
  'https://open.example.org/dataset/s-' || s_suppkey || '/' AS url, 'All about' || s_name AS description,
  CASE s_nationkey % 3 WHEN 0 THEN 'Daily' WHEN 1 THEN 'Weekly' ELSE 'Monthly' END AS refresh_rate,
  '' AS last_refreshed, 'Nation ' || s_nationkey AS publisher, '' AS type, '' AS formats, '' AS topics
FROM supplier QUALIFY s_nationkey % 5 <> 0""")
def q_catalogue_cards_portal(spark, sf):
    """Cards of h3 headings that link to a dataset; other headings and cards in comments are none."""
    return W.catalogue_cards(PP.catalogue_pages(read_table(spark, sf, "supplier")))


@register("download_manifest", """
SELECT s_suppkey AS page_id, 's-' || s_suppkey AS dataset, filename, url, 'dataset/s-' || s_suppkey || '/' || filename AS path,
  CASE WHEN s_suppkey % 2 = 0 AND s_acctbal >= 1 THEN 'skipped' ELSE 'download' END AS status, pos = 3 AS collision
FROM supplier, (VALUES (0, '/datastore/dump/', '.xlsx'), (2, '/files/', '/data.csv'), (3, '/files/', '/data.csv?v=2')) l(pos, a, b),
LATERAL (SELECT CASE WHEN pos = 0 THEN lower(replace(s_name, '#', '')) || '.xlsx' ELSE 'data.csv' END AS filename,
                'https://open.example.org' || a || s_suppkey || b AS url)""")
def q_download_manifest(spark, sf):
    """M8 + D4 + A13: the manifest of a second crawl; what the first crawl (every other supplier) has
    landed with a size is skipped.  Both manifests are written and read back."""
    supplier = read_table(spark, sf, "supplier")
    root = SK.scratch_path(spark, "manifests")
    first = W.link_manifest(PP.download_pages(supplier.where("s_suppkey % 2 = 0")))
    SK.sink_manifest(first, f"{root}/first")
    landed = spark.read.schema(first.schema).json(f"{root}/first/files")
    sizes = supplier.select(F.col("s_suppkey").alias("page_id"), F.col("s_acctbal").cast("long").alias("size"))
    existing = landed.join(sizes, "page_id").select("dataset", "filename", "size")
    second = W.link_manifest(PP.download_pages(supplier), existing)
    SK.sink_manifest(second, f"{root}/second")
    return spark.read.schema(second.schema).json(f"{root}/second/files").select("page_id", "dataset", "filename", "url", "path", "status", "collision")
