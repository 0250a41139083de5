"""Registered queries of the catalogue jobs over the capture derived from
``pages`` (C4-C6, D2, D3, E24-E26, G5, H2, H3, I21-I31, J8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalogue as K
from ..operators import catalogue as CAT
from ..registry import register
from ..session import read_table
from ..sources import capture as CP
from .web_queries import _HREF, _INNER, _PAGE_TEXT, _QUALITY_COLS, ANCHORS, _decode, _resolve, _root, _strip, _text_of, q


def _pages(spark, sf):
    return read_table(spark, sf, "pages")


def _arr(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def _day(expr: str, hhmmss: str) -> str:
    return f"strftime(DATE '2025-01-01' + CAST({expr} AS INTEGER), '%Y-%m-%d') || 'T{hhmmss}'"


_RATE = """CASE regexp_extract(url, '://[^/]+/([a-z]+)', 1)
  WHEN 'en' THEN 'Daily' WHEN 'fr' THEN 'Weekly' WHEN 'de' THEN 'Monthly' WHEN 'es' THEN 'Annually' END"""

PG = f"""pg AS (
  SELECT page_id, url, 'ds-' || CAST(page_id AS VARCHAR) AS name,
         regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
         TRY_CAST(regexp_extract(url, '://[^/]+/[a-z]+/([0-9]+)', 1) AS INTEGER) AS num,
         starts_with(url, 'https:') AS https, {ANCHORS} AS links
  FROM pages)"""

RES = f"""res0 AS (
  SELECT page_id, name, num, url, rpos, {_text_of(_INNER.format('m'))} AS rname, {_decode(_HREF.format('m'))} AS href
  FROM (SELECT page_id, url, name, num, unnest(links) AS m, CAST(generate_subscripts(links, 1) - 1 AS BIGINT) AS rpos FROM pg)),
res AS (
  SELECT page_id, name, rpos, name || '-r' || CAST(rpos AS VARCHAR) AS id, rname,
         ['CSV', 'XLSX', 'JSON', 'csv', 'GeoJSON', 'XML', ''][length(rname) % 7 + 1] AS format,
         {_resolve(_root('url'), 'href')} AS rurl,
         CASE WHEN regexp_full_match(href, '[ -~]*') THEN CAST(length(href) * 100000 AS BIGINT) END AS size,
         {_day('coalesce(num, 0) + rpos', '08:00:00')} AS last_modified,
         {_day('coalesce(num, 0)', '07:00:00')} AS created FROM res0)"""

_EXTRAS = (f"list_filter(["
           f"CASE WHEN NOT https THEN {{'key': 'refresh_rate', 'value': {_RATE}}} END, "
           f"CASE WHEN https THEN {{'key': 'update_frequency', 'value': {_RATE}}} END, "
           f"CASE WHEN contains(url, '?') AND num IS NOT NULL THEN {{'key': 'date_modified', 'value': {_day('num', '09:15:00')}}} END, "
           f"CASE WHEN contains(url, '#') THEN {{'key': 'refresh_rate', 'value': 'As available'}} END, "
           f"CASE WHEN contains(url, '.html') THEN {{'key': 'dataset_category', 'value': 'Map'}} END"
           f"], lambda e: e IS NOT NULL)")

DS = f"""ds AS (
  SELECT page_id, pg.name, title,
         CASE WHEN title <> '' THEN '  ' || title || ' ' || chr(10) END AS notes,
         coalesce({_day('num', '10:30:00')}, 'unknown') AS metadata_modified,
         CASE WHEN NOT https THEN 'Open Government Licence' WHEN contains(url, '?') THEN '' END AS license_title,
         CASE WHEN https THEN 'ogl' ELSE '' END AS license_id,
         CASE WHEN NOT starts_with(regexp_extract(url, '://([^/]+)', 1), 'm.') THEN regexp_extract(url, '://([^/]+)', 1) END AS org_title,
         coalesce(rl.texts, []) AS texts, coalesce(rl.fmts, []) AS fmts, {_EXTRAS} AS extras
  FROM pg LEFT JOIN (SELECT name, list(rname ORDER BY rpos) AS texts, list(format ORDER BY rpos) AS fmts FROM res GROUP BY name) rl
    ON pg.name = rl.name)"""


def _last(key_pred: str) -> str:
    return f"list_filter(extras, lambda e: {key_pred})[-1].value"


def _has(key: str) -> str:
    return f"len(list_filter(extras, lambda e: e.key = '{key}')) > 0"


_REFRESH = "CASE " + " ".join(f"WHEN {_has(k)} THEN coalesce({_last(f'e.key = {q(k)}')}, '')"
                              for k in K.REFRESH_KEYS) + " ELSE '' END"
_MOD = _last("e.key IN ('date_modified', 'metadata_modified')")
_LAST_REFRESHED = (f"CASE WHEN coalesce({_MOD}, '') <> '' THEN {_MOD} "
                   f"WHEN coalesce(metadata_modified, '') <> '' THEN coalesce(strftime(TRY_CAST("
                   f"regexp_replace(metadata_modified, 'Z$', '+00:00') AS TIMESTAMP), '%b %d, %Y'), metadata_modified) "
                   f"ELSE '' END")
_CAT = _last("e.key = 'dataset_category'")
_UPPER_FMTS = "list_transform(fmts, lambda f: upper(coalesce(f, '')))"
_HAS_CSV = f"len(list_filter({_UPPER_FMTS}, lambda f: contains(f, 'CSV'))) > 0"


def _join_nonempty(lst: str) -> str:
    return f"array_to_string(list_filter({lst}, lambda t: coalesce(t, '') <> ''), ' | ')"


_TOPICS = r"list_filter(texts, lambda t: regexp_matches(t, '^\p{Lu}'))"

INFO_SELECT = f"""SELECT page_id, coalesce(title, '') AS title,
  CASE WHEN coalesce(name, '') <> '' THEN '{K.PORTAL_BASE}/dataset/' || name || '/' ELSE '' END AS url,
  coalesce({_strip('notes')}, '') AS description,
  {_REFRESH} AS refresh_rate,
  {_LAST_REFRESHED} AS last_refreshed,
  coalesce(org_title, '') AS publisher,
  CASE WHEN coalesce({_CAT}, '') <> '' THEN {_CAT} ELSE 'Table' END AS type,
  array_to_string(list_sort(list_distinct(list_filter({_UPPER_FMTS}, lambda f: f <> ''))), ' | ') AS formats,
  {_join_nonempty(_TOPICS)} AS topics,
  {_join_nonempty('texts')} AS tags,
  coalesce(NULLIF(license_title, ''), NULLIF(license_id, '')) AS license,
  coalesce(name, '') AS name
FROM ds WHERE {_HAS_CSV}"""


def cat_sql(final: str, extra: str = "") -> str:
    ctes = [PG, RES, DS] + ([extra] if extra else [])
    return "WITH " + ",\n".join(ctes) + "\n" + final


def _capture(spark, sf):
    """The derived capture: the four API tables all read the search results."""
    s = CP.search_results(_pages(spark, sf))
    return s, CP.packages(s), CP.datastore_fields(s), CP.resource_records(s)


@register("dataset_info", cat_sql(INFO_SELECT))
def q_dataset_info(spark, sf):
    """J8 (I21-I27, C4, H3): the 12 catalogue fields of every dataset with a CSV resource."""
    return CAT.dataset_info(CP.search_results(_pages(spark, sf)))


@register("has_format", cat_sql(f"SELECT page_id, name, {_HAS_CSV} AS has_csv FROM ds"))
def q_has_format(spark, sf):
    """C4: does a dataset have a CSV resource."""
    s = CP.search_results(_pages(spark, sf))
    return s.select("page_id", "name", K.has_format("resources", "CSV").alias("has_csv"))


@register("extras_to_map", cat_sql("""SELECT page_id, e.key AS key, arg_max_null(e.value, p) AS value FROM (
  SELECT page_id, unnest(extras) AS e, generate_subscripts(extras, 1) AS p FROM ds) GROUP BY page_id, e.key"""))
def q_extras_map(spark, sf):
    """Extras list -> map (last duplicate wins), shown as (key, value) rows."""
    s = CP.search_results(_pages(spark, sf))
    return s.select("page_id", F.explode(K.extras_to_map("extras")).alias("key", "value"))


_CSV_RES = "contains(upper(coalesce(format, '')), 'CSV')"


@register("resource_detail", cat_sql(f"""SELECT name, rpos, rname AS resource_name, format, rurl AS url, size,
  last_modified, created, id FROM res WHERE {_CSV_RES}"""))
def q_resource_detail(spark, sf):
    """CSV resources of every package with the 7 detail fields."""
    r = CAT.resource_rows(CP.packages(_pages(spark, sf)), csv_only=True)
    return r.select("name", "rpos", F.col("detail.name").alias("resource_name"), "detail.format", "detail.url",
                    "detail.size", "detail.last_modified", "detail.created", "detail.id")


# fields of the resources whose link text is one word: the parts of the address
_FIELDS = r"""(SELECT id, name, rpos, format, unnest(parts) AS t, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS fpos FROM (
  SELECT *, list_filter(regexp_split_to_array(regexp_replace(rurl, '^[a-z]+://', ''), '[/.]'), lambda x: x <> '') AS parts
  FROM res WHERE regexp_full_match(rname, '\pL+')))"""
_FIELD_COLS = ("f.t AS column_name, ['text', 'int', 'numeric', 'date'][length(f.t) % 4 + 1] AS type, "
               "CASE WHEN length(f.t) > 3 THEN 'About ' || f.t ELSE '' END AS description")
_CSV_FIELD = _CSV_RES.replace("format", "f.format")


@register("field_dictionary", cat_sql(f"""SELECT f.id AS resource_id, f.fpos, {_FIELD_COLS} FROM {_FIELDS} f"""))
def q_field_dictionary(spark, sf):
    """(column_name, type, description) per datastore field."""
    fields = CP.datastore_fields(_pages(spark, sf))
    return fields.select("resource_id", F.posexplode(K.field_dictionary("fields")).alias("fpos", "f")).select(
        "resource_id", "fpos", "f.column_name", "f.type", "f.description")


@register("collect_dictionary", cat_sql(f"""SELECT f.name, f.rpos, f.fpos, {_FIELD_COLS} FROM {_FIELDS} f WHERE {_CSV_FIELD}"""))
def q_collect_dictionary(spark, sf):
    """Each dataset's dictionary = fields of its CSV resources in order (long form)."""
    _, pk, fl, _ = _capture(spark, sf)
    return CAT.dictionary_rows(pk, fl)


_REC = "(SELECT * FROM res WHERE regexp_full_match(rurl, '[ -~]*'))"


@register("quality_first", cat_sql(f"""SELECT name, last_modified, created, format, size FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY rpos) AS rn FROM {_REC} WHERE {_CSV_RES}) WHERE rn = 1"""))
def q_quality_first(spark, sf):
    """E26 first: facts of the first CSV resource with a record."""
    _, pk, _, rc = _capture(spark, sf)
    return CAT.quality_first(pk, rc)


@register("quality_last", cat_sql(f"""SELECT name, last_modified, created, format, size FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY rpos DESC) AS rn FROM {_REC}) WHERE rn = 1"""))
def q_quality_last(spark, sf):
    """E26 last: facts of the last resource with a record."""
    _, pk, _, rc = _capture(spark, sf)
    return CAT.quality_last(pk, rc)


@register("quality_update", cat_sql(f"""SELECT name, key, arg_max_null(value, rpos * 10 + kpos) AS value FROM (
  SELECT name, rpos, 0 AS kpos, 'last_refreshed' AS key, last_modified AS value FROM {_REC} WHERE {_CSV_RES}
  UNION ALL SELECT name, rpos, 1, 'format', format FROM {_REC} WHERE {_CSV_RES}
  UNION ALL SELECT name, rpos, 2, 'size', CAST(size AS VARCHAR) FROM {_REC} WHERE {_CSV_RES}
  UNION ALL SELECT name, rpos, 3, 'quality_score', CAST(length(rurl) AS VARCHAR) FROM {_REC} WHERE {_CSV_RES}
  UNION ALL SELECT name, rpos, 4, 'Score_Grade', upper(rname[1]) FROM {_REC} WHERE {_CSV_RES}) GROUP BY name, key"""))
def q_quality_update(spark, sf):
    """E26 update + I31: key-wise merge of CSV resource facts, later wins."""
    _, pk, _, rc = _capture(spark, sf)
    return CAT.quality_update(pk, rc)


@register("quality_extras", cat_sql(f"""SELECT id AS resource_id, key, value FROM (
  SELECT id, 'quality_score' AS key, CAST(length(rurl) AS VARCHAR) AS value FROM {_REC}
  UNION ALL SELECT id, 'Score_Grade', upper(rname[1]) FROM {_REC})"""))
def q_quality_extras(spark, sf):
    """Resource extras whose key mentions quality or score."""
    rc = CP.resource_records(_pages(spark, sf))
    return rc.select("resource_id", F.explode(K.quality_extras("extras")).alias("e")).select(
        "resource_id", "e.key", "e.value")


_ENRICHED = f"""enriched AS (
  SELECT d.page_id, d.name, coalesce(nr.n, 0) AS n_resources, coalesce(nd.n, 0) AS n_dictionary,
         qf.name IS NOT NULL AS has_quality, qf.last_modified, qf.created, qf.format, qf.size
  FROM ds d
  LEFT JOIN (SELECT name, count(*) AS n FROM res WHERE {_CSV_RES} GROUP BY 1) nr ON d.name = nr.name
  LEFT JOIN (SELECT f.name, count(*) AS n FROM {_FIELDS} f WHERE {_CSV_FIELD} GROUP BY 1) nd ON d.name = nd.name
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rpos) AS rn
             FROM {_REC} WHERE {_CSV_RES}) WHERE rn = 1) qf ON d.name = qf.name)"""


def _enriched(spark, sf):
    s, pk, fl, rc = _capture(spark, sf)
    return CAT.enrich(s, pk, fl, rc, policy="first")


@register("enrich", cat_sql("SELECT * FROM enriched", _ENRICHED))
def q_enrich(spark, sf):
    """Datasets enriched by left joins with packages, fields and records."""
    return _enriched(spark, sf)


@register("enrichment_coverage", cat_sql("""SELECT count(*) AS datasets, count(*) FILTER (WHERE n_dictionary > 0) AS with_dictionary,
  count(*) FILTER (WHERE has_quality) AS with_quality, CAST(sum(n_dictionary) AS BIGINT) AS dictionary_columns,
  round(count(*) FILTER (WHERE n_dictionary > 0) * 100.0 / count(*) * 1000000.0) / 1000000.0 + 0.0 AS pct_dictionary,
  round(count(*) FILTER (WHERE has_quality) * 100.0 / count(*) * 1000000.0) / 1000000.0 + 0.0 AS pct_quality
FROM enriched""", _ENRICHED))
def q_coverage(spark, sf):
    """Enrichment coverage counts and percentages."""
    return CAT.enrichment_coverage(_enriched(spark, sf))


@register("needs_enrichment", cat_sql("SELECT * FROM enriched WHERE n_dictionary = 0 OR NOT has_quality", _ENRICHED))
def q_needs(spark, sf):
    """Datasets still missing a dictionary or quality."""
    return CAT.needs_enrichment(_enriched(spark, sf))


@register("union_distinct", cat_sql("SELECT * FROM enriched WHERE n_dictionary = 0 OR NOT has_quality", _ENRICHED))
def q_union_distinct(spark, sf):
    """H2: needing-dictionary united with needing-quality, one row per dataset."""
    return CAT.union_distinct(_enriched(spark, sf))


@register("resume_remaining", cat_sql("""SELECT page_id, name FROM ds
WHERE name NOT IN (SELECT name FROM enriched WHERE n_dictionary > 0)""", _ENRICHED))
def q_resume(spark, sf):
    """D3: datasets not processed yet (those without a dictionary count as not done)."""
    done = _enriched(spark, sf).where(F.col("n_dictionary") > 0)
    return CAT.resume_remaining(CP.search_results(_pages(spark, sf)).select("page_id", "name"), done)


@register("first_with", cat_sql("SELECT * FROM enriched ORDER BY n_dictionary > 0 DESC, page_id LIMIT 1", _ENRICHED))
def q_first_with(spark, sf):
    """First dataset having a dictionary (else the first)."""
    return CAT.first_with(_enriched(spark, sf))


@register("not_readme", cat_sql("""SELECT name, rpos, rname AS title FROM res
WHERE trim(coalesce(rname, '')) <> '' AND NOT contains(lower(rname), 'readme')"""))
def q_not_readme(spark, sf):
    """Resource headings that are not blank and not a readme."""
    r = CAT.resource_rows(CP.packages(_pages(spark, sf)), csv_only=False)
    return CAT.not_readme(r.select("name", "rpos", F.col("detail.name").alias("title")))


@register("file_size_label", cat_sql("""SELECT name, rpos, size, CASE WHEN size IS NULL THEN NULL
  WHEN size / 1048576.0 < 1 THEN printf('%.2f', size / 1024.0) || ' KB' ELSE printf('%.2f', size / 1048576.0) || ' MB' END AS label
FROM res"""))
def q_size_label(spark, sf):
    """Human-readable resource sizes."""
    r = CAT.resource_rows(CP.packages(_pages(spark, sf)), csv_only=False)
    return r.select("name", "rpos", F.col("detail.size").alias("size"),
                    K.file_size_label(F.col("detail.size")).alias("label"))


# --- M9: supplement from captured pages ---------------------------------------------------
_PAGE_ROWS = f"""page_rows AS (
  SELECT * FROM (SELECT page_id, row, {_text_of('tds[1]')} AS column_name, {_text_of('tds[2]')} AS type,
                        CASE WHEN len(tds) > 2 THEN {_text_of('tds[3]')} ELSE '' END AS description FROM (
    SELECT page_id, row, regexp_extract_all(tr, '(?is)<td[^>]*>(.*?)</td>', 1) AS tds FROM (
      SELECT page_id, unnest(trs) AS tr, CAST(generate_subscripts(trs, 1) - 1 AS BIGINT) AS row FROM (
        SELECT page_id, regexp_extract_all(regexp_extract(html, '(?is)<table[^>]*>(.*?)</table>', 1),
                                           '(?is)<tr[^>]*>(.*?)</tr>', 1) AS trs FROM pages)))
    WHERE row > 0 AND len(tds) >= 2) WHERE column_name <> '')"""

_PAGE_Q = f"""page_q AS (
  SELECT * FROM (SELECT page_id, {_QUALITY_COLS} FROM (SELECT page_id, {_PAGE_TEXT} AS t FROM pages))
  WHERE coalesce(overall_score, grade, freshness, metadata, accessibility, completeness, usability,
                 last_refreshed) IS NOT NULL)"""

# a dataset's resource pages: its own page and the next one
_RES_PAGES = """res_pages AS (
  SELECT name, rpos, page_id FROM (
    SELECT 'ds-' || CAST(page_id AS VARCHAR) AS name, 0 AS rpos, page_id, title FROM ds
    UNION ALL SELECT 'ds-' || CAST(page_id - 1 AS VARCHAR), 1, page_id, title FROM ds)
  WHERE trim(coalesce(title, '')) <> '' AND NOT contains(lower(title), 'readme'))"""

_FIRST = """first_rows AS (SELECT name, rpos, page_id FROM (
  SELECT p.*, row_number() OVER (PARTITION BY name ORDER BY rpos) AS k FROM res_pages p
  WHERE page_id IN (SELECT page_id FROM page_rows)) WHERE k = 1),
first_q AS (SELECT name, rpos, page_id FROM (
  SELECT p.*, row_number() OVER (PARTITION BY name ORDER BY rpos) AS k FROM res_pages p
  WHERE page_id IN (SELECT page_id FROM page_q)) WHERE k = 1)"""

_FIGS = ["overall_score", "grade", "freshness", "metadata", "accessibility", "completeness", "usability", "last_refreshed"]
_FIG_COLS = ", ".join(f"CASE WHEN NOT e.has_quality THEN q.{c} END AS {c}" for c in _FIGS)

_SUPPLEMENT = f"""SELECT e.name,
  CASE WHEN e.n_dictionary = 0 THEN (SELECT count(*) FROM page_rows r WHERE r.page_id = fr.page_id) ELSE 0 END AS dictionary_columns,
  CAST(CASE WHEN e.n_dictionary = 0 THEN fr.rpos END AS BIGINT) AS dictionary_rpos,
  CAST(CASE WHEN NOT e.has_quality THEN fq.rpos END AS BIGINT) AS quality_rpos, {_FIG_COLS}
FROM enriched e LEFT JOIN first_rows fr ON e.name = fr.name
LEFT JOIN first_q fq ON e.name = fq.name LEFT JOIN page_q q ON q.page_id = fq.page_id
WHERE e.n_dictionary = 0 OR NOT e.has_quality"""
_SUPP_CTES = ",\n".join([_ENRICHED, _PAGE_ROWS, _PAGE_Q, _RES_PAGES, _FIRST])


def _supplemented(spark, sf):
    from ..operators import web as W
    from .pipelines import supplement
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    facts = W.page_facts(_pages(spark, sf).select("page_id", title.alias("title"), "html"))
    name = lambda back: F.concat(F.lit("ds-"), (F.col("page_id") - back).cast("string"))
    pages = facts.withColumn("at", F.explode(F.array(
        F.struct(name(0).alias("name"), F.lit(0).alias("rpos")), F.struct(name(1).alias("name"), F.lit(1).alias("rpos"))))).select(
        "at.*", "title", "rows", "figures")
    return supplement(_enriched(spark, sf), pages)


@register("supplement", cat_sql(_SUPPLEMENT, _SUPP_CTES))
def q_supplement(spark, sf):
    """M9 (C5, C6, J4, J5): datasets still missing a dictionary or quality, filled from the first of
    their captured pages (their own, then the next) that yields one."""
    return _supplemented(spark, sf).drop("dictionary")


@register("supplement_dictionary", cat_sql("""SELECT e.name, r.row, r.column_name, r.type, r.description
FROM enriched e JOIN first_rows fr ON e.name = fr.name JOIN page_rows r ON r.page_id = fr.page_id WHERE e.n_dictionary = 0""", _SUPP_CTES))
def q_supplement_dictionary(spark, sf):
    """M9: the dictionary rows that supplement the datasets without one."""
    return _supplemented(spark, sf).select("name", F.explode("dictionary").alias("d")).select("name", "d.*")


@register("head_dictionary", cat_sql(f"""SELECT d.page_id, d.name, t.column_no, t.column_name, t.type, t.description
FROM (SELECT page_id, name FROM ds ORDER BY page_id LIMIT 3) d LEFT JOIN (
  SELECT * FROM (SELECT f.name, row_number() OVER (PARTITION BY f.name ORDER BY f.rpos, f.fpos) AS column_no, {_FIELD_COLS}
                 FROM {_FIELDS} f WHERE {_CSV_FIELD})
  WHERE column_no <= 3) t ON d.name = t.name"""))
def q_head_dictionary(spark, sf):
    """First three datasets with the first three columns of their dictionaries."""
    s, pk, fl, _ = _capture(spark, sf)
    return CAT.head_dictionary(s, CAT.dictionary_rows(pk, fl))
