"""Column functions over catalogue records.

Arrays of structs are handled with higher-order functions (``filter``,
``transform``, ``exists``) inside each row; no row is exploded or regrouped
for these per-dataset derivations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import (DEFAULT_DATASET_TYPE, LAST_REFRESHED_FORMAT, LIST_SEPARATOR, MODIFIED_KEYS,
                      PORTAL_BASE, REFRESH_KEYS)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def blank_to_null(col) -> Column:
    """'' -> NULL (Python's "falsy string")."""
    c = _c(col)
    return F.when(c != "", c)


def dataset_url(name="name", base: str = PORTAL_BASE) -> Column:
    """``{base}/dataset/{name}/``, '' when there is no name."""
    n = _c(name)
    return F.when(F.coalesce(n, F.lit("")) != "", F.concat(F.lit(f"{base}/dataset/"), n, F.lit("/"))).otherwise(F.lit(""))


def extras_get(extras, key: str) -> Column:
    """Value of the *last* ``key`` entry of a key/value list (NULL if absent)."""
    hits = F.filter(_c(extras), lambda e: e["key"] == F.lit(key))
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)["value"])


def extras_has(extras, key: str) -> Column:
    return F.exists(_c(extras), lambda e: e["key"] == F.lit(key))


def extras_to_map(extras) -> Column:
    """key/value list -> map; a repeated key keeps its last value.

    Built from the distinct keys so it does not depend on the session's
    map-key dedup policy."""
    e = _c(extras)
    keys = F.array_distinct(F.transform(e, lambda x: x["key"]))
    vals = F.transform(keys, lambda k: F.element_at(F.filter(e, lambda x: x["key"] == k), -1)["value"])
    return F.map_from_arrays(keys, vals)


def refresh_rate(extras="extras", keys: Sequence[str] = REFRESH_KEYS) -> Column:
    """The first *present* key of refresh_rate, update_frequency,
    frequency (its last value), else ''."""
    out = F.lit("")
    for k in reversed(list(keys)):
        out = F.when(extras_has(extras, k), F.coalesce(extras_get(extras, k), F.lit(""))).otherwise(out)
    return out


def last_refreshed(extras="extras", metadata_modified="metadata_modified",
                   keys: Sequence[str] = MODIFIED_KEYS, fmt: str = LAST_REFRESHED_FORMAT) -> Column:
    """The last date_modified / metadata_modified extra; if that is
    absent or empty, the dataset's ``metadata_modified`` formatted as
    ``Mon dd, YYYY`` (kept raw when it does not parse); else ''."""
    e = _c(extras)
    hits = F.filter(e, lambda x: x["key"].isin(*keys))
    from_extras = F.when(F.size(hits) > 0, F.element_at(hits, -1)["value"])
    mm = _c(metadata_modified)
    ts = F.try_to_timestamp(F.regexp_replace(mm, "Z$", "+00:00"))
    from_field = F.when(F.coalesce(mm, F.lit("")) != "",
                        F.coalesce(F.date_format(ts, fmt), mm)).otherwise(F.lit(""))
    return F.when(F.coalesce(from_extras, F.lit("")) != "", from_extras).otherwise(from_field)


def dataset_type(extras="extras", default: str = DEFAULT_DATASET_TYPE) -> Column:
    """The last ``dataset_category`` extra, else 'Table'."""
    v = extras_get(extras, "dataset_category")
    return F.when(F.coalesce(v, F.lit("")) != "", v).otherwise(F.lit(default))


def publisher(organization="organization") -> Column:
    """Organisation title, '' without organisation."""
    return F.coalesce(_c(organization)["title"], F.lit(""))


def license_name(title="license_title", lid="license_id") -> Column:
    """Licence title, else licence id, else NULL."""
    return F.coalesce(blank_to_null(title), blank_to_null(lid))


def join_names(items, field: str, sep: str = LIST_SEPARATOR) -> Column:
    """Non-empty ``field`` values in source order joined by ' | '."""
    vals = F.transform(F.coalesce(_c(items), F.array()), lambda x: x[field])
    return F.array_join(F.filter(vals, lambda v: F.coalesce(v, F.lit("")) != ""), sep)


def trim_description(notes="notes") -> Column:
    """Notes stripped of surrounding whitespace, '' when missing."""
    return F.coalesce(F.regexp_replace(_c(notes), r"^\s+|\s+$", ""), F.lit(""))


def upper_formats(resources="resources") -> Column:
    return F.transform(F.coalesce(_c(resources), F.array()), lambda r: F.upper(F.coalesce(r["format"], F.lit(""))))


def has_format(resources="resources", fmt: str = "CSV") -> Column:
    """C4: some resource's upper-cased format contains ``fmt``."""
    return F.exists(upper_formats(resources), lambda f: f.contains(fmt))


def distinct_sorted_join(values: Column, sep: str = LIST_SEPARATOR) -> Column:
    """H3: sorted distinct non-empty values joined by ' | '."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(values, lambda v: v != ""))), sep)


def formats(resources="resources") -> Column:
    return distinct_sorted_join(upper_formats(resources))


def field_dictionary(fields="fields") -> Column:
    """(column_name, type, description) per datastore field, '' defaults."""
    return F.transform(F.coalesce(_c(fields), F.array()), lambda f: F.struct(
        F.coalesce(f["id"], F.lit("")).alias("column_name"),
        F.coalesce(f["type"], F.lit("")).alias("type"),
        F.coalesce(f["info"]["notes"], F.lit("")).alias("description")))


def resource_detail(r: Column, full: bool = True) -> Column:
    """The 7 resource fields (5 in the short variant)."""
    cols = [r["name"].alias("name"), r["format"].alias("format"), r["url"].alias("url"),
            r["size"].alias("size"), r["last_modified"].alias("last_modified")]
    if full:
        cols += [r["created"].alias("created"), r["id"].alias("id")]
    return F.struct(*cols)


def file_size_label(size) -> Column:
    """I30: '<n> KB' under 1 MB, else '<n> MB', two decimals (ties to even, like Python)."""
    s = _c(size).cast("double")
    mb = s / (1024 * 1024)
    return (F.when(s.isNull(), F.lit(None).cast("string"))
             .when(mb < 1, F.format_string("%.2f KB", F.bround(s / 1024, 2)))
             .otherwise(F.format_string("%.2f MB", F.bround(mb, 2))))


def quality_extras(extras) -> Column:
    """Resource extras whose key mentions quality or score (any case)."""
    return F.filter(_c(extras), lambda e: F.lower(e["key"]).contains("quality") | F.lower(e["key"]).contains("score"))


def repair_mojibake(col) -> Column:
    """Undo UTF-8 text decoded as Latin-1 (``â\\x80\\x93`` -> en dash), only
    on values that show the pattern."""
    c = _c(col)
    return F.when(c.contains("â\u0080"), F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")).otherwise(c)
