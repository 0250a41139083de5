"""File sources of the delay and catalogue data.

* CSV is read with every column as text (no schema inference) and cast by
  ``conform(typed=True)`` with ``try_cast``, so a bad value becomes NULL
  instead of failing the job under ANSI mode.
* Yearly workbooks (XLSX) have no built-in Spark source: they are read as
  ``binaryFile`` rows (one task per file) and parsed with the standard
  library inside ``mapInPandas``; each data row comes out as a
  ``map<header, text>`` so files with different column sets share a schema.
* File selection works on ``_metadata.file_path``; Spark prunes files on
  metadata-column filters before reading them.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CKAN_PAGE

# --- fixed values: years in file names
NAME_YEAR = r"(?<!\d)((?:19|20)\d{2})(?!\d)"
WORKBOOK_YEAR = r"(?i)-((?:19|20)\d{2})\.xlsx$"


def file_name():
    return F.col("_metadata.file_name")


def file_path():
    return F.col("_metadata.file_path")


def scan_csv(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None,
             with_file: bool = False) -> DataFrame:
    """A1: CSV with a header, all columns as STRING (quoted commas and CRLF
    handled by the reader); ``with_file`` adds the source file name."""
    r = spark.read.option("header", True).option("inferSchema", False).option("multiLine", False)
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.csv(paths if isinstance(paths, str) else list(paths))
    return df.withColumn("_file", file_name()) if with_file else df


def year_of_file(name_col=None):
    """The 4-digit year in a file's name (NULL when there is none); a workbook's name ends in
    ``-<year>.xlsx``.  Folders are not looked at."""
    name = file_name() if name_col is None else name_col
    found = F.when(F.endswith(F.lower(name), F.lit(".xlsx")), F.regexp_extract(name, WORKBOOK_YEAR, 1)) \
        .otherwise(F.regexp_extract(name, NAME_YEAR, 1))
    return F.nullif(found, F.lit("")).cast("int")


def select_files(df: DataFrame, years: Sequence[int] | None = None, exclude: str | None = "unified",
                 first_only: bool = False) -> DataFrame:
    """A3: keep rows of files whose name carries one of ``years`` and does
    not contain ``exclude``; with ``first_only`` only the
    alphabetically first matching file is kept (the "first glob match" rule).
    The conditions only touch file metadata; the first match is chosen from
    the file listing (``inputFiles``), without reading any rows."""
    cond = F.lit(True)
    if years is not None:
        cond = cond & year_of_file().isin(list(years))
    if exclude:
        cond = cond & ~F.lower(file_name()).contains(exclude.lower())
    out = df.where(cond)
    if first_only:
        listed = []
        for f in df.inputFiles():
            name = f.rsplit("/", 1)[-1]
            m = re.search(WORKBOOK_YEAR if name.lower().endswith(".xlsx") else NAME_YEAR, name)
            if exclude and exclude.lower() in name.lower():
                continue
            if years is not None and not (m and int(m[1]) in set(years)):
                continue
            listed.append(f)
        first = min(listed) if listed else None
        if first is None:
            return out.limit(0)
        # the listing writes scheme:///path, the metadata column scheme:/path
        norm = re.sub(r"^([A-Za-z][\w+.-]*):/+", r"\1:/", first)
        out = out.where(F.regexp_replace(file_path(), r"^([A-Za-z][\w+.-]*):/+", "$1:/") == F.lit(norm))
    return out


def scan_sample(df: DataFrame, n: int = 10) -> DataFrame:
    """A5: the first ``n`` rows (schema preview; the limit is the feature)."""
    return df.limit(n)


def scan_codes(spark: SparkSession, path: str) -> DataFrame:
    """Code list (_id, CODE, DESCRIPTION); CRLF line ends and quoted
    commas are handled by the CSV reader."""
    schema = "_id int, CODE string, DESCRIPTION string"
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
                 .option("encoding", "UTF-8").schema(schema).csv(path))


def ingest_log(df: DataFrame, corrupt_col: str | None = None) -> DataFrame:
    """Rows (and corrupt rows) per source file."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    if corrupt_col and corrupt_col in df.columns:
        aggs.append(F.count_if(F.col(corrupt_col).isNotNull()).alias("corrupt_rows"))
    key = F.col("_file") if "_file" in df.columns else file_name()
    return df.groupBy(key.alias("file")).agg(*aggs)


def ingest_csv(spark: SparkSession, path: str, schema: T.StructType, out: str,
               corrupt_col: str = "_corrupt_record") -> DataFrame:
    """Parse raw CSV files permissively, land the rows (with their file
    name and any corrupt record) as Parquet, and return the per-file log.

    The log is computed from the landed table: whether a row is corrupt
    depends on parsing all of its columns, which the landing does once."""
    raw = scan_csv_permissive(spark, path, schema, corrupt_col).withColumn("_file", file_name())
    raw.write.mode("overwrite").parquet(out)
    return ingest_log(spark.read.parquet(out), corrupt_col)


def scan_csv_permissive(spark: SparkSession, path: str, schema: T.StructType,
                        corrupt_col: str = "_corrupt_record") -> DataFrame:
    """A malformed row is kept aside in ``corrupt_col``; unreadable files
    are skipped (``ignoreCorruptFiles``) and the other files continue."""
    full = T.StructType(schema.fields + [T.StructField(corrupt_col, T.StringType())])
    return (spark.read.option("header", True).option("mode", "PERMISSIVE")
                 .option("columnNameOfCorruptRecord", corrupt_col).option("ignoreCorruptFiles", True)
                 .schema(full).csv(path))


# --- A2: workbooks ---------------------------------------------------------------
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
WORKBOOK_SCHEMA = "path string, row long, cells map<string,string>, error string"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _first_sheet_rows(data: bytes) -> list[list[str | None]]:
    """Rows of the first worksheet of an XLSX file as text (stdlib only)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            root = ET.fromstring(z.read("xl/sharedStrings.xml"))
            for si in root.findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        first = wb.find("m:sheets/m:sheet", _NS)
        rid = first.get(f"{{{_NS['r']}}}id")
        target = "worksheets/sheet1.xml"
        if "xl/_rels/workbook.xml.rels" in names:
            rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
            for rel in rels.findall("pr:Relationship", _NS):
                if rel.get("Id") == rid:
                    target = rel.get("Target").lstrip("/").removeprefix("xl/")
        sheet = ET.fromstring(z.read(f"xl/{target}"))
        rows = []
        for r in sheet.iter(f"{{{_NS['m']}}}row"):
            vals: dict[int, str | None] = {}
            for c in r.findall("m:c", _NS):
                t = c.get("t")
                v = c.find("m:v", _NS)
                if t == "s" and v is not None:
                    val = shared[int(v.text)]
                elif t == "inlineStr":
                    val = "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
                else:
                    val = v.text if v is not None else None
                vals[_col_index(c.get("r"))] = val
            width = max(vals) + 1 if vals else 0
            rows.append([vals.get(i) for i in range(width)])
        return rows


def _parse_workbooks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                rows = _first_sheet_rows(bytes(content))
            except Exception as e:  # noqa: BLE001 - a bad file is reported, others continue (A9)
                out.append({"path": path, "row": None, "cells": None, "error": f"{type(e).__name__}: {e}"})
                continue
            if not rows:
                continue
            header = [("" if h is None else str(h)) for h in rows[0]]
            for i, r in enumerate(rows[1:], start=1):
                cells = {h: r[j] if j < len(r) else None for j, h in enumerate(header) if h}
                out.append({"path": path, "row": i, "cells": cells, "error": None})
        yield pd.DataFrame(out, columns=["path", "row", "cells", "error"])


def scan_workbook_cells(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """A2 (+A9): every data row of the first sheet of each workbook as
    (path, row, cells map, error).  A file that cannot be parsed yields one
    row with ``error`` set and no cells; the other files are unaffected."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(_parse_workbooks, WORKBOOK_SCHEMA)


# --- fixed values: spreadsheet serial day 0 ---------------------------------------
EXCEL_EPOCH = "1899-12-30"
_NUMBER = r"^\d+(\.\d+)?$"


def excel_date(col):
    """A serial day number (date cells are stored as numbers) -> 'yyyy-MM-dd';
    text values pass through for the date parser."""
    serial = F.floor(col.cast("double"))
    as_date = F.date_format(F.date_add(F.lit(EXCEL_EPOCH).cast("date"), serial.cast("int")), "yyyy-MM-dd")
    return F.when(col.rlike(_NUMBER), as_date).otherwise(col)


def excel_time(col):
    """A day fraction (time cells) -> 'HH:mm:ss'; text passes through."""
    secs = F.round((col.cast("double") - F.floor(col.cast("double"))) * 86400).cast("long")
    hms = F.format_string("%02d:%02d:%02d", (secs / 3600).cast("int") % 24, ((secs % 3600) / 60).cast("int"), secs % 60)
    return F.when(col.rlike(_NUMBER), hms).otherwise(col)


def workbook_frame(cells: DataFrame, columns: Sequence[str], date_columns: Sequence[str] = (),
                   time_columns: Sequence[str] = ()) -> DataFrame:
    """Project parsed workbook rows onto named columns (absent ones NULL);
    serial dates / day-fraction times are turned into text in the listed
    columns."""
    ok = cells.where(F.col("error").isNull())
    out = []
    for c in columns:
        v = F.col("cells")[c]
        if c in date_columns:
            v = excel_date(v)
        elif c in time_columns:
            v = excel_time(v)
        out.append(v.alias(c))
    return ok.select("path", "row", *out)


def scan_workbook(spark: SparkSession, path: str, columns: Sequence[str], glob: str = "*.xlsx",
                  date_columns: Sequence[str] = ("Report Date", "Date"),
                  time_columns: Sequence[str] = ("Time",)) -> DataFrame:
    """A2: yearly workbooks as a text frame with the requested raw columns."""
    return workbook_frame(scan_workbook_cells(spark, path, glob), columns, date_columns, time_columns)


# --- A6 / A7: catalogue documents --------------------------------------------------
CATALOGUE_DATASET = T.StructType([T.StructField(n, T.StringType()) for n in (
    "title", "url", "description", "refresh_rate", "last_refreshed", "publisher", "type", "formats",
    "topics", "tags", "license", "name")] + [
    T.StructField("dictionary", T.ArrayType(T.StructType([
        T.StructField("column_name", T.StringType()), T.StructField("type", T.StringType()),
        T.StructField("description", T.StringType())]))),
    T.StructField("quality", T.MapType(T.StringType(), T.StringType())),
])
CATALOGUE_DOC = T.StructType([
    T.StructField("total_datasets", T.LongType()),
    T.StructField("scraped_at", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("api_endpoint", T.StringType()),
    T.StructField("datasets", T.ArrayType(CATALOGUE_DATASET)),
])


def scan_catalogue(spark: SparkSession, path: str, document: bool = True,
                   schema: T.StructType = CATALOGUE_DATASET) -> DataFrame:
    """Catalogue datasets.  ``document``: one JSON document per file with
    a ``datasets`` array (the portal scraper's shape); otherwise JSON lines,
    one dataset per line (what :func:`sinks.sink_catalogue` writes)."""
    if document:
        doc = T.StructType([f if f.name != "datasets" else T.StructField("datasets", T.ArrayType(schema))
                            for f in CATALOGUE_DOC.fields])
        raw = spark.read.option("multiLine", True).schema(doc).json(path)
        return raw.select(F.posexplode("datasets").alias("pos", "d")).select("pos", "d.*")
    return spark.read.schema(schema).json(path)


def scan_ckan_search(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Landed ``package_search`` pages -> one row per dataset record.
    ``multi_line``: one API response per file (as captured); otherwise one
    response per line."""
    from ..operators.catalogue import scan_ckan_pages
    return scan_ckan_pages(spark.read.option("multiLine", multi_line).schema(CKAN_PAGE).json(path))


__all__ = ["scan_csv", "select_files", "scan_sample", "scan_codes", "dedupe_codes", "ingest_log",
           "scan_csv_permissive", "scan_workbook", "scan_workbook_cells", "workbook_frame",
           "scan_catalogue", "scan_ckan_search", "CKAN_DATASET"]


# One enriched dataset as the JSON sink writes it.
DOCUMENT_SCHEMA = ("name string, title string, dictionary array<struct<column_name:string,type:string,description:string>>, "
                   "quality struct<last_modified:string,created:string,format:string,size:string>, "
                   "resources_detail array<struct<name:string,format:string,url:string,size:bigint,last_modified:string,created:string,id:string>>")
