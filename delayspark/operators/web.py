"""Jobs over captured pages: links, download links, dictionary tables,
quality panels and catalogue cards (section J, F2, C7/C8, D4, M8).

Input is a table of pages ``(page_id, url, html)``.  Each page is parsed
inside its own row with JVM regular expressions; links are exploded with
their position, so no page is ever gathered into one task with others and
no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import markup as M
from ..session import cut_lineage
from ..schema import (CARD_LABELS, FIRST_PERCENT, GRADE, LAST_REFRESHED, OVERALL_LABEL, PERCENT_AFTER,
                      QUALITY_LABELS)


def extract_links(pages: DataFrame, key: str = "page_id", base: str = "url",
                  html: str = "html", keep: Sequence[str] = (), from_root: bool = True) -> DataFrame:
    """One row per ``<a href>``: (key, pos, href, url, text, keep...).

    ``pos`` is the 0-based order on the page, ``url`` the href resolved
    against the site root (``from_root=False``: against the page URL) and
    ``text`` the anchor's stripped text; ``keep`` page columns are carried
    along (no join back to the pages)."""
    root = H.origin_of(base) if from_root else F.col(base)
    exploded = pages.select(F.col(key), root.alias("__base"), *keep,
                            F.posexplode(H.anchors(F.col(html))).alias("pos", "__a"))
    href = H.decode_entities(F.col("__a.href"))
    return exploded.select(key, F.col("pos").cast("int").alias("pos"), href.alias("href"),
                           H.resolve_url(F.col("__base"), href).alias("url"),
                           H.text_of(F.col("__a.inner")).alias("text"), *keep)


def dedupe_keep_first(links: DataFrame, keys: Sequence[str] = ("page_id", "url"),
                      order: str = "pos") -> DataFrame:
    """first row per key in page order.

    An aggregation (``min_by`` over the position) rather than a window: the
    map side keeps one candidate per key, so a page or URL holding a large
    share of all links is reduced before the shuffle."""
    keys = list(keys)
    rest = [c for c in links.columns if c not in keys]
    best = links.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), F.col(order)).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def with_filenames(links: DataFrame, text: str = "text", href: str = "href",
                   extensions=("xlsx", "csv", "json"), **rule) -> DataFrame:
    """J2 applied to a link table (``rule``: pattern, clean_url)."""
    return links.withColumn("filename", H.derive_filename(F.col(text), F.col(href), extensions, **rule))


def download_links(pages: DataFrame, lenient: bool = False, key: str = "page_id",
                   keep: Sequence[str] = ()) -> DataFrame:
    """Links that look like data downloads, with a file name, first per
    (page, URL).  ``lenient`` uses C8 instead of C7."""
    links = extract_links(pages, key, keep=keep)
    cond = (H.is_download_link_lenient(F.col("text"), F.col("href")) if lenient
            else H.is_download_link(F.col("text")))
    picked = with_filenames(links.where(cond))
    return dedupe_keep_first(picked, (key, "url"))


def table_rows(pages: DataFrame, key: str = "page_id", html: str = "html",
               drop_empty_names: bool = False) -> DataFrame:
    """(key, row, column_name, type, description) from the first table of each page, as a parser sees it: rows after
    the header with at least two cells (:func:`..functions.markup.table_rows`)."""
    rows = pages.select(F.col(key), F.explode(M.table_rows(F.col(html))).alias("__r"))
    cell = lambda i: F.coalesce(F.get("__r.c", F.lit(i)), F.lit(""))
    out = rows.select(key, "__r.row", cell(0).alias("column_name"), cell(1).alias("type"), cell(2).alias("description"))
    if drop_empty_names:
        out = out.where(F.col("column_name") != "")
    return out


def table_row_array(html):
    """J4 inside a row: array<struct<row, column_name, type, description>> of the first table's rows
    after the header with at least two cells and a name."""
    cell = lambda r, i: F.coalesce(F.get(r["c"], F.lit(i)), F.lit(""))
    rows = F.transform(M.table_rows(html), lambda r: F.struct(
        r["row"].alias("row"), cell(r, 0).alias("column_name"), cell(r, 1).alias("type"), cell(r, 2).alias("description")))
    return F.filter(rows, lambda x: x["column_name"] != "")


def page_facts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every other column of ``pages`` with ``rows`` (J4) and ``figures`` (J5, a struct of the eight
    quality figures): all that later steps need of a page, so its markup is never shuffled."""
    rest = [c for c in pages.columns if c != html]
    narrow = pages.select(*rest, table_row_array(F.col(html)).alias("rows"), H.visible_text(F.col(html)).alias("__text"))
    figures = quality_columns(F.col("__text"))
    return narrow.select(*rest, "rows", F.struct(*figures).alias("figures"))


def page_text(html: str = "html"):
    """Visible text of a page (scripts and styles dropped, block elements on
    their own lines)."""
    return H.visible_text(F.col(html))


def quality_columns(t) -> list:
    """J5 over a text: overall_score, grade, freshness, metadata, accessibility,
    completeness, usability (``N%`` strings) and last_refreshed; absent ones
    are NULL."""
    pct = lambda label: F.nullif(F.regexp_extract(t, rf"(?i){label}{PERCENT_AFTER}", 1), F.lit(""))
    with_pct = lambda c: F.when(c.isNotNull(), F.concat(c, F.lit("%")))
    cols = [with_pct(pct(OVERALL_LABEL)).alias("overall_score"),
            F.nullif(F.regexp_extract(t, f"(?i){GRADE}", 1), F.lit("")).alias("grade")]
    cols += [with_pct(pct(m)).alias(m.lower()) for m in QUALITY_LABELS]
    cols.append(F.nullif(H.strip_ws(F.regexp_extract(t, f"(?i){LAST_REFRESHED}", 1)),
                         F.lit("")).alias("last_refreshed"))
    return cols


def quality_metrics(pages: DataFrame, key: str = "page_id", text=None) -> DataFrame:
    """Quality panel figures found anywhere in the text, any case
    (:func:`quality_columns`)."""
    return pages.select(F.col(key), *quality_columns(text if text is not None else page_text()))


def quality_metrics_strict(pages: DataFrame, key: str = "page_id", text=None,
                           parity: bool = True) -> DataFrame:
    """The "details" variant.  If the text mentions a score, the first
    ``N%`` anywhere is the overall score; the other labels are case-sensitive;
    there is no last_refreshed.  With ``parity`` a text without "score" yields
    nothing at all (the reference fails there); without it the labels are
    still read."""
    t = text if text is not None else page_text()
    has_score = t.contains(OVERALL_LABEL) | F.lower(t).contains("score")
    first_pct = F.nullif(F.regexp_extract(t, FIRST_PERCENT, 1), F.lit(""))
    pct = lambda label: F.nullif(F.regexp_extract(t, rf"{label}{PERCENT_AFTER}", 1), F.lit(""))
    with_pct = lambda c: F.when(c.isNotNull(), F.concat(c, F.lit("%")))
    gate = (lambda c: F.when(has_score, c)) if parity else (lambda c: c)
    cols = [F.when(has_score, with_pct(first_pct)).alias("overall_score"),
            gate(F.nullif(F.regexp_extract(t, GRADE, 1), F.lit(""))).alias("grade")]
    cols += [gate(with_pct(pct(m))).alias(m.lower()) for m in QUALITY_LABELS]
    return pages.select(F.col(key), *cols)


def catalogue_cards(pages: DataFrame, heading: str = "h3", key: str = "page_id", base: str = "url",
                    html: str = "html", require_dataset_link: bool = True) -> DataFrame:
    """One row per catalogue card.

    A card runs from a ``<heading>`` to the next one.  Title and URL come
    from the heading's link (or its text, URL ''), description from the first
    paragraph of the card, and the labelled fields (Refresh Rate, Last
    Refreshed, Publisher, Type, Formats, Topics) from the text after each
    label up to the line end; missing values are ''.  With
    ``require_dataset_link`` only headings linking to ``/dataset/`` count."""
    h = heading
    # split the page, without comments, at every heading start; each piece after the first is a card
    shown = F.regexp_replace(F.col(html), H.COMMENT, "")
    pieces = pages.select(F.col(key), F.col(base).alias("__base"),
                          F.posexplode(F.split(shown, rf"(?i)<{h}\b")).alias("card", "__piece"))
    pieces = pieces.where(F.col("card") > 0).withColumn("__card", F.concat(F.lit(f"<{h}"), F.col("__piece")))
    head = F.regexp_extract(F.col("__card"), rf"(?is)<{h}[^>]*>(.*?)</{h}>", 1)
    attributes = F.regexp_extract(head, H.ANCHOR, 1)
    link_href = H.decode_entities(H.href_of(attributes))
    link_text = F.regexp_extract(head, H.ANCHOR, 2)
    has_link = F.regexp_like(attributes, F.lit(H.HREF))
    para = F.regexp_extract(F.col("__card"), r"(?is)<p(?:\s[^>]*)?>(.*?)</p>", 1)
    text = H.visible_text(F.col("__card"))
    cols = [F.col(key), F.col("card").cast("int").alias("card"),
            F.when(has_link, H.text_of(link_text)).otherwise(H.text_of(head)).alias("title"),
            F.when(has_link & (link_href != ""), H.resolve_url(H.origin_of("__base"), link_href))
             .otherwise(F.lit("")).alias("url"),
            H.text_of(para).alias("description")]
    for name, label in CARD_LABELS.items():
        cols.append(H.strip_ws(F.regexp_extract(text, rf"{label}\s*([^\n]*)", 1)).alias(name))
    out = pieces.select(*cols)
    if require_dataset_link:
        out = out.where(F.col("url").contains("/dataset/"))
    return out


def skip_existing(links: DataFrame, existing: DataFrame, dataset_col: str = "dataset",
                  filename: str = "filename") -> DataFrame:
    """Mark links whose target file already exists with a non-empty size
    (``existing``: dataset, filename, size) as ``skipped``; all links stay in
    the result.  A second link deriving the same file name within a dataset is
    flagged as a collision (it would overwrite or be skipped)."""
    done = existing.where(F.col("size") > 0).select(dataset_col, filename).distinct().withColumn("__done", F.lit(True))
    first = links.groupBy(dataset_col, filename).agg(F.min(F.struct("page_id", "pos")).alias("__first"))
    return (links.join(done, [dataset_col, filename], "left")
                 .join(first, [dataset_col, filename], "left")
                 .select(*links.columns,
                         F.when(F.col("__done"), F.lit("skipped")).otherwise(F.lit("download")).alias("status"),
                         (F.struct("page_id", "pos") != F.col("__first")).alias("collision")))


def link_manifest(pages: DataFrame, existing: DataFrame | None = None, base_dir: str = "dataset",
                  lenient: bool = False) -> DataFrame:
    """M8: download links per dataset page with their target path and status
    (A13 rows).  ``existing`` lists files already present."""
    with_slug = pages.withColumn("dataset", H.dataset_slug(F.col("url")))
    dl = download_links(with_slug, lenient, keep=["dataset"])
    # the narrow link rows are written once: the collision aggregate never parses pages again
    dl = cut_lineage(dl.withColumn("path", F.concat_ws("/", F.lit(base_dir), F.col("dataset"), F.col("filename"))))
    if existing is None:
        existing = dl.sparkSession.createDataFrame([], "dataset string, filename string, size bigint")
    return skip_existing(dl, existing)
