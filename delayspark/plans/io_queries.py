"""Registered queries of sources, sinks and the incremental job.

Each writes data derived from the driver tables to a fresh folder under the
shared checkpoint directory and reads it back through the source operator,
so the result must equal the SQL of the table that was written.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as CAT
from ..operators import conform as B
from ..registry import register
from ..schema import PROCESSED_COLUMNS
from ..session import read_table
from ..sources import capture as CP
from ..sources import files as FS
from ..sources import sinks as SK
from ..streaming import incremental as INC
from . import catalogue_queries as CQ
from . import incident_queries as IQ
from . import pipelines as PL


@register("scan_csv", IQ.sql(["ouni"], IQ.out(IQ.STD_COLS, "ouni")))
def q_scan_csv(spark, sf):
    """A11 then A1: the unified table written as date-sorted CSV and read
    back as text, then typed with try_cast."""
    path = SK.scratch_path(spark, "unified_csv")
    SK.sink_unified(IQ.orders_unified(spark, sf), path)
    return B.cast_standard(B.select_available(FS.scan_csv(spark, path)))


@register("select_files", IQ.sql(["ouni"], IQ.out(IQ.STD_COLS, "ouni",
          'WHERE year("Date") BETWEEN 2018 AND 2020')))
def q_select_files(spark, sf):
    """A3: files named after their year; only those of 2018-2020 are read."""
    path = SK.scratch_path(spark, "yearly_csv")
    SK.land_yearly_csv(IQ.orders_unified(spark, sf), path, "delay-data")
    picked = FS.select_files(FS.scan_csv(spark, path), years=[2018, 2019, 2020])
    return B.cast_standard(B.select_available(picked))


@register("sink_processed", IQ.sql(["proc"], IQ.out(IQ.O.cols_of(PROCESSED_COLUMNS, IQ.O.PROC_KINDS), "proc")))
def q_sink_processed(spark, sf):
    """A10: the processed table, its fits kept in a store, written as Parquet partitioned by Year and read back."""
    path = SK.scratch_path(spark, "processed")
    unified = IQ.events_unified(spark, sf)
    SK.sink_processed(PL.processed_table(unified, store=PL.fit_incidents(unified, SK.scratch_path(spark, "fits"))), path)
    back = spark.read.parquet(path)
    return back.select(*[F.col(f"`{c}`") for c in PROCESSED_COLUMNS])


_INFO_NO_KEY = CQ.cat_sql(f"SELECT * EXCLUDE (page_id) FROM ({CQ.INFO_SELECT})")


@register("catalogue_roundtrip", _INFO_NO_KEY)
def q_catalogue_roundtrip(spark, sf):
    """A12 then A6: catalogue datasets written as JSON (+ header) and scanned back."""
    path = SK.scratch_path(spark, "catalogue")
    info = CAT.dataset_info(CP.search_results(read_table(spark, sf, "pages"))).drop("page_id")
    SK.sink_catalogue(info, path)
    back = FS.scan_catalogue(spark, f"{path}/datasets", document=False)
    return back.select(*CAT.DATASET_FIELDS)


@register("enriched_catalogue", CQ.cat_sql(f"""SELECT d.name, 'dictionary' AS part, t.k AS pos, t.column_name AS a, t.type AS b, t.description AS c
FROM ds d JOIN (SELECT f.name, row_number() OVER (PARTITION BY f.name ORDER BY f.rpos, f.fpos) - 1 AS k, {CQ._FIELD_COLS}
                FROM {CQ._FIELDS} f WHERE {CQ._CSV_FIELD}) t ON d.name = t.name
UNION ALL SELECT name, 'resource', row_number() OVER (PARTITION BY name ORDER BY rpos) - 1, rname, format, id FROM res WHERE {CQ._CSV_RES}
UNION ALL SELECT name, 'quality', 0, last_modified, format, CAST(size AS VARCHAR) FROM enriched WHERE has_quality""", CQ._ENRICHED))
def q_enriched_catalogue(spark, sf):
    """D2 + A12: enriched datasets written as JSON documents with their dictionary, resource and
    quality parts, and read back as rows."""
    path = SK.scratch_path(spark, "enriched")
    s, pk, fl, rc = CQ._capture(spark, sf)
    SK.sink_catalogue(CAT.catalogue_documents(s.select("name", "title"), pk, fl, rc), path)
    docs = spark.read.schema(FS.DOCUMENT_SCHEMA).json(f"{path}/datasets")
    part = lambda kind, pos, *v: docs.select("name", F.lit(kind).alias("part"), pos, *[x.alias(n) for x, n in zip(v, "abc", strict=True)])
    row = lambda kind, col, *names: docs.select("name", F.lit(kind).alias("part"), F.posexplode(col).alias("pos", "x")).select(
        "name", "part", "pos", *[F.col(f"x.{n}").alias(a) for n, a in zip(names, "abc", strict=True)])
    quality = part("quality", F.lit(0).alias("pos"), F.col("quality.last_modified"), F.col("quality.format"), F.col("quality.size"))
    return (row("dictionary", "dictionary", "column_name", "type", "description")
            .unionByName(row("resource", "resources_detail", "name", "format", "id"))
            .unionByName(quality.where("c is not null or a is not null or b is not null")))


@register("scan_ckan_search", _INFO_NO_KEY)
def q_scan_ckan_search(spark, sf):
    """Search results landed as API pages of at most 100 records, read
    back (success check, explode) and flattened with J8."""
    path = SK.scratch_path(spark, "ckan_pages")
    s = CP.search_results(read_table(spark, sf, "pages"))
    grouped = (s.withColumn("__page", F.floor(F.col("page_id") / 100))
                .groupBy("__page").agg(F.collect_list(F.struct(*[c for c in s.columns if c != "page_id"])).alias("results")))
    grouped.select(F.lit(True).alias("success"),
                   F.struct(F.size("results").cast("long").alias("count"), "results").alias("result")) \
           .write.mode("overwrite").json(path)
    return CAT.dataset_info(FS.scan_ckan_search(spark, path, multi_line=False)).drop("pos")


@register("incremental_enrich", CQ.cat_sql("SELECT * EXCLUDE (page_id) FROM enriched", CQ._ENRICHED))
def q_incremental(spark, sf):
    """K1: datasets landed in two waves and enriched by a resumable
    availableNow stream (second run picks up only the new files)."""
    pages = read_table(spark, sf, "pages")
    s = CP.search_results(pages).drop("page_id")
    root = SK.scratch_path(spark, "incremental")
    landing, output, ckpt = f"{root}/landing", f"{root}/output", f"{root}/checkpoint"
    # the API lookups are landed tables, as captures would be
    lookups = {"packages": CP.packages(pages), "fields": CP.datastore_fields(pages),
               "records": CP.resource_records(pages)}
    for name, df in lookups.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    pk, fl, rc = (spark.read.parquet(f"{root}/{n}") for n in ("packages", "fields", "records"))
    # two landing waves; every record lands in exactly one of them
    half = F.abs(F.hash("name")) % 2 == 0
    INC.land(s.where(half), landing)
    INC.run_incremental_enrich(spark, landing, output, ckpt, s.schema, pk, fl, rc, files_per_batch=2)
    INC.land(s.where(~half), landing)
    INC.run_incremental_enrich(spark, landing, output, ckpt, s.schema, pk, fl, rc, files_per_batch=2)
    return INC.final_table(spark, output)

