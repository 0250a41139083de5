"""Catalogue jobs: flatten search results, enrich datasets with resources,
column dictionaries and quality facts, report coverage, resume (M6, M7, M9).

Enrichment is a set of left equi-joins between landed API tables keyed by
dataset name and resource id (the reference calls an API per dataset in a
loop).  Per-dataset lists are produced in *long* form - one row per
(dataset, resource) or (dataset, resource, field) - and only the optional
nested sink regroups them, so a dataset with a huge resource list never has
to sit in one task.  Quality policies are aggregations (``min_by`` /
``max_by`` over the resource position), which combine map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalogue as K

DATASET_FIELDS = ["title", "url", "description", "refresh_rate", "last_refreshed", "publisher", "type",
                  "formats", "topics", "tags", "license", "name"]


def scan_ckan_pages(pages: DataFrame) -> DataFrame:
    """Landed search pages (success, result.count, result.results[]) ->
    one row per dataset record (unsuccessful pages skipped)."""
    return (pages.where(F.col("success"))
                 .select(F.posexplode("result.results").alias("pos", "d"))
                 .select("pos", "d.*"))


def dataset_info(datasets: DataFrame, keep_all: bool = False, base: str | None = None) -> DataFrame:
    """J8 (I21-I27, C4, H3): the 12 catalogue fields per dataset; datasets
    without a CSV resource are dropped unless ``keep_all``."""
    url = K.dataset_url("name") if base is None else K.dataset_url("name", base)
    out = datasets.select(
        *[c for c in ("page_id", "pos") if c in datasets.columns],
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        url.alias("url"),
        K.trim_description("notes").alias("description"),
        K.refresh_rate("extras").alias("refresh_rate"),
        K.last_refreshed("extras", "metadata_modified").alias("last_refreshed"),
        K.publisher("organization").alias("publisher"),
        K.dataset_type("extras").alias("type"),
        K.formats("resources").alias("formats"),
        K.join_names("groups", "title").alias("topics"),
        K.join_names("tags", "name").alias("tags"),
        K.license_name().alias("license"),
        F.coalesce(F.col("name"), F.lit("")).alias("name"),
        K.has_format("resources", "CSV").alias("__csv"),
    )
    if not keep_all:
        out = out.where(F.col("__csv"))
    return out.drop("__csv")


def resource_rows(packages: DataFrame, csv_only: bool = True, full: bool = True) -> DataFrame:
    """One row per (dataset, resource) with its position; the batch
    variant keeps CSV resources only."""
    r = packages.select("name", F.posexplode("resources").alias("rpos", "r"))
    if csv_only:
        r = r.where(F.upper(F.coalesce(F.col("r.format"), F.lit(""))).contains("CSV"))
    return r.select("name", F.col("rpos").cast("int").alias("rpos"), K.resource_detail(F.col("r"), full).alias("detail"))


def dictionary_rows(packages: DataFrame, fields: DataFrame) -> DataFrame:
    """E25 + I28: the column dictionary of every dataset in long form
    (name, rpos, fpos, column_name, type, description): the fields of all its
    CSV resources concatenated in resource order, duplicates kept."""
    res = resource_rows(packages, csv_only=True).select("name", "rpos", F.col("detail.id").alias("resource_id"))
    res = res.where(F.coalesce(F.col("resource_id"), F.lit("")) != "")
    f = fields.select("resource_id", F.posexplode(K.field_dictionary("fields")).alias("fpos", "f"))
    return res.join(f, "resource_id").select(
        "name", "rpos", F.col("fpos").cast("int").alias("fpos"), "f.column_name", "f.type", "f.description")


def quality_first(packages: DataFrame, records: DataFrame) -> DataFrame:
    """E26 "first": the record of the first CSV resource that has one
    (name, last_modified, created, format, size)."""
    res = resource_rows(packages, csv_only=True).select("name", "rpos", F.col("detail.id").alias("resource_id"))
    rec = records.select("resource_id", F.struct("last_modified", "created", "format", "size").alias("q"))
    j = res.join(rec, "resource_id")
    return j.groupBy("name").agg(F.min_by("q", "rpos").alias("q")).select("name", "q.*")


def quality_last(packages: DataFrame, records: DataFrame) -> DataFrame:
    """E26 "last": the record of the last resource (any format) that has one."""
    res = resource_rows(packages, csv_only=False).select("name", "rpos", F.col("detail.id").alias("resource_id"))
    rec = records.select("resource_id", F.struct("last_modified", "created", "format", "size").alias("q"))
    j = res.join(rec, "resource_id")
    return j.groupBy("name").agg(F.max_by("q", "rpos").alias("q")).select("name", "q.*")


def quality_update(packages: DataFrame, records: DataFrame) -> DataFrame:
    """E26 "update" (+I31): every CSV resource's facts (last_refreshed,
    format, size and quality/score extras) merged key by key in resource
    order, later resources overwriting earlier ones.  Long form
    (name, key, value)."""
    res = resource_rows(packages, csv_only=True).select("name", "rpos", F.col("detail.id").alias("resource_id"))
    kv = records.select("resource_id", F.posexplode(F.concat(
        F.array(F.struct(F.lit("last_refreshed").alias("key"), F.col("last_modified").alias("value")),
                F.struct(F.lit("format").alias("key"), F.col("format").alias("value")),
                F.struct(F.lit("size").alias("key"), F.col("size").cast("string").alias("value"))),
        K.quality_extras(F.col("extras")))).alias("kpos", "kv"))
    j = res.join(kv, "resource_id")
    # within one resource a repeated key keeps its last entry; across resources the later one wins
    return (j.groupBy("name", F.col("kv.key").alias("key"))
             .agg(F.max_by(F.col("kv.value"), F.struct("rpos", "kpos")).alias("value")))


def enrich(datasets: DataFrame, packages: DataFrame, fields: DataFrame, records: DataFrame,
           policy: str = "first") -> DataFrame:
    """Per dataset the number of detailed resources, dictionary
    columns and the quality facts (first/last policy), left-joined so a
    dataset whose lookups fail is kept with empty values.

    Resources are exploded once; fields are counted by the size of their
    arrays; both lookups join on the resource id and one aggregation per
    dataset gives every figure."""
    first = policy == "first"
    res = packages.select("name", F.posexplode("resources").alias("rpos", "r")).select(
        "name", "rpos", F.col("r.id").alias("rid"),
        F.upper(F.coalesce(F.col("r.format"), F.lit(""))).contains("CSV").alias("csv"))
    if first:
        res = res.where("csv")
    sizes = (fields.where(F.coalesce("resource_id", F.lit("")) != "").groupBy(F.col("resource_id").alias("rid"))
             .agg(F.sum(F.greatest(F.size("fields"), F.lit(0))).alias("__n")))
    facts = records.groupBy(F.col("resource_id").alias("rid")).agg(
        F.min(F.struct("last_modified", "created", "format", "size")).alias("__q"))
    pick = F.min_by if first else F.max_by
    rpos = F.when(F.col("__q").isNotNull(), F.col("rpos"))
    per = res.join(sizes, "rid", "left").join(facts, "rid", "left").groupBy("name").agg(
        F.count(F.lit(1)).alias("n_resources"), F.sum(F.when(F.col("csv"), F.col("__n"))).alias("n_dictionary"),
        pick(F.col("__q"), rpos).alias("__q"))
    base = datasets.select(*[c for c in ("page_id",) if c in datasets.columns], "name")
    return base.join(per, "name", "left").select(
        *base.columns, F.coalesce("n_resources", F.lit(0)).alias("n_resources"),
        F.coalesce("n_dictionary", F.lit(0)).alias("n_dictionary"), F.col("__q").isNotNull().alias("has_quality"), "__q.*")


def catalogue_documents(datasets: DataFrame, packages: DataFrame, fields: DataFrame, records: DataFrame) -> DataFrame:
    """The nested form of D2 for the JSON sink (A12): per dataset its columns, the ``dictionary`` and
    ``resources_detail`` lists and the ``quality`` facts of the first CSV resource with a record.

    Lists are as long as one dataset's own resources; jobs work on the long tables
    (:func:`resource_rows`, :func:`dictionary_rows`, :func:`quality_first`)."""
    details = resource_rows(packages, csv_only=True).groupBy("name").agg(
        F.array_sort(F.collect_list(F.struct("rpos", "detail"))).alias("d")).select(
        "name", F.transform("d", lambda x: x["detail"]).alias("resources_detail"))
    quality = quality_first(packages, records).select("name", F.struct(
        "last_modified", "created", "format", F.col("size").cast("string").alias("size")).alias("quality"))
    none = F.array().cast("array<struct<column_name:string,type:string,description:string>>")
    out = (datasets.join(dictionary_lists(dictionary_rows(packages, fields)), "name", "left")
           .join(details, "name", "left").join(quality, "name", "left"))
    return out.select(*datasets.columns, F.coalesce("dictionary", none).alias("dictionary"), "quality",
                      F.coalesce("resources_detail", F.array().cast(details.schema["resources_detail"].dataType)).alias("resources_detail"))


def enrichment_coverage(enriched: DataFrame) -> DataFrame:
    """Datasets with a dictionary / with quality, their percentages and
    the total number of dictionary columns."""
    return enriched.agg(
        F.count(F.lit(1)).alias("datasets"),
        F.count_if(F.col("n_dictionary") > 0).alias("with_dictionary"),
        F.count_if(F.col("has_quality")).alias("with_quality"),
        F.sum("n_dictionary").alias("dictionary_columns"),
    ).select("*", (F.col("with_dictionary") * 100.0 / F.col("datasets")).alias("pct_dictionary"),
             (F.col("with_quality") * 100.0 / F.col("datasets")).alias("pct_quality"))


def needs_enrichment(enriched: DataFrame) -> DataFrame:
    """C5 (= H2, the union of the two lists by name): datasets still missing
    a dictionary or quality facts."""
    return enriched.where((F.col("n_dictionary") == 0) | ~F.col("has_quality"))


def union_distinct(enriched: DataFrame) -> DataFrame:
    """H2: datasets needing a dictionary united with those needing quality,
    one row per name.  Both lists are filters of one table, so their union is
    one filter over one plan."""
    return needs_enrichment(enriched).dropDuplicates(["name"])


def resume_remaining(datasets: DataFrame, done: DataFrame, key: str = "name") -> DataFrame:
    """D3: datasets not yet processed (anti join on the key)."""
    return datasets.join(done.select(key).distinct(), key, "left_anti")


def first_with(enriched: DataFrame, order: str = "page_id") -> DataFrame:
    """The first dataset having a dictionary, else the first dataset."""
    return enriched.orderBy((F.col("n_dictionary") > 0).desc(), F.col(order)).limit(1)


def not_readme(headings: DataFrame, col: str = "title") -> DataFrame:
    """Skip blank headings and those mentioning readme."""
    h = F.col(col)
    return headings.where((F.trim(F.coalesce(h, F.lit(""))) != "") & ~F.lower(h).contains("readme"))


def dictionary_lists(dict_rows: DataFrame) -> DataFrame:
    """Nested sink form of E25: (name, dictionary array) in order.  Only for
    writing the JSON document; jobs use the long form."""
    return dict_rows.groupBy("name").agg(F.array_sort(F.collect_list(
        F.struct("rpos", "fpos", "column_name", "type", "description"))).alias("d")).select(
        "name", F.transform("d", lambda x: F.struct(x["column_name"].alias("column_name"), x["type"].alias("type"),
                                                   x["description"].alias("description"))).alias("dictionary"))


def head_dictionary(datasets: DataFrame, dict_rows: DataFrame, n_datasets: int = 3, n_columns: int = 3,
                    order: str = "page_id") -> DataFrame:
    """G4 (catalogue form): the first ``n_datasets`` datasets and the first
    ``n_columns`` entries of each one's dictionary (a top-k report; the
    ``row_number() <= k`` filter is applied per partition before the shuffle)."""
    from pyspark.sql import Window
    first = datasets.orderBy(order).limit(n_datasets).select(order, "name")
    picked = dict_rows.join(first.select("name"), "name", "left_semi")
    rn = F.row_number().over(Window.partitionBy("name").orderBy("rpos", "fpos"))
    top = picked.withColumn("__rn", rn).where(F.col("__rn") <= n_columns)
    return first.join(top, "name", "left").select(order, "name", F.col("__rn").alias("column_no"),
                                                  "column_name", "type", "description")
