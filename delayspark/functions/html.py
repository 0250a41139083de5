"""Column expressions over captured HTML and link text.

Everything is a regular expression or string function evaluated inside the
JVM; patterns avoid look-arounds so the same text also runs in RE2 (DuckDB),
which the correctness check uses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DATA_EXTENSIONS, DEFAULT_EXTENSION, FILENAME_PATTERN, LENIENT_LINK_WORDS, STRICT_LINK_WORDS

# --- fixed values: markup patterns -------------------------------------------
COMMENT = r"(?s)<!--.*?-->"
# an opening <a> whose attributes may hold ">" in quotes, and all up to its end
ANCHOR = r"""(?is)<a((?:\s(?:[^>"']|"[^"]*"|'[^']*')*)?)>(.*?)</a\s*>"""
# href among the attributes of an opening tag: double, single or no quotes
HREF = (r"""(?is)^(?:\s+[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?)*?"""
        r"""\s+href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
TAG = r"<[^>]*>"
ORIGIN = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*:)"
# Python's Unicode \w (letters, numbers, underscore) plus dash and dot are kept.
FILENAME_JUNK = r"[^\pL\pN_\-.]"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
            ("&reg;", "®"), ("&trade;", "™"), ("&middot;", "·"), ("&bull;", "•"), ("&ndash;", "–"), ("&mdash;", "—"),
            ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"),
            ("&raquo;", "»"), ("&deg;", "°"), ("&eacute;", "é"), ("&egrave;", "è"), ("&agrave;", "à"), ("&ccedil;", "ç"),
            ("&ouml;", "ö"), ("&uuml;", "ü"), ("&auml;", "ä"), ("&szlig;", "ß"), ("&ntilde;", "ñ"), ("&amp;", "&")]
NUMERIC_ENTITY = r"&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _numeric(entity: Column) -> Column:
    """The character of ``&#...;`` (decimal or hexadecimal)."""
    hexed = F.regexp_extract(entity, r"(?i)x([0-9a-f]+)", 1)
    code = F.when(hexed != "", F.conv(hexed, 16, 16)).otherwise(F.conv(F.regexp_extract(entity, r"([0-9]+)", 1), 10, 16))
    return F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")


def decode_entities(col) -> Column:
    """Named entities of ``ENTITIES`` and all numeric ones; a text without ``&`` is passed on."""
    raw = _c(col)
    found = F.array_distinct(F.regexp_extract_all(raw, F.lit(NUMERIC_ENTITY), F.lit(0)))
    out = F.aggregate(found, raw, lambda t, e: F.replace(t, e, _numeric(e)))
    for ent, ch in ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return F.when(F.contains(raw, F.lit("&")), out).otherwise(raw)


def strip_ws(col) -> Column:
    """Python ``str.strip()``: leading/trailing whitespace of any kind."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def text_of(col) -> Column:
    """Text of an HTML fragment like ``get_text(strip=True)``: the pieces between tags are decoded
    and stripped (so escaped markup stays text), then put together."""
    return F.array_join(F.transform(F.split(_c(col), TAG), lambda p: strip_ws(decode_entities(p))), "")


# --- fixed values: tags that start a new line in rendered text ---------------
BLOCK_TAG = r"(?i)<(?:br|/?(?:p|div|li|tr|td|th|h[1-6]|section|article|ul|ol|table|header|footer|nav|dt|dd))(?:\s[^>]*)?/?>"
CODE_BLOCK = r"(?is)<(script|style)[^>]*>.*?</(script|style)>"


def visible_text(col) -> Column:
    """Rendered text of a page: comments, scripts and styles dropped, a line break at
    every block element, other tags removed, entities decoded."""
    no_code = F.regexp_replace(F.regexp_replace(_c(col), COMMENT, ""), CODE_BLOCK, "")
    lines = F.regexp_replace(no_code, BLOCK_TAG, "\n")
    return decode_entities(F.regexp_replace(lines, TAG, ""))


def anchors(html) -> Column:
    """array<struct<href, inner>> of every ``<a href=...>`` outside comments, in document order.

    The page is scanned once; href and inner markup are taken from each match."""
    found = F.regexp_extract_all(F.regexp_replace(_c(html), COMMENT, ""), F.lit(ANCHOR), F.lit(0))
    parts = F.transform(found, lambda m: F.struct(
        F.regexp_extract(m, ANCHOR, 1).alias("attributes"), F.regexp_extract(m, ANCHOR, 2).alias("inner")))
    linked = F.filter(parts, lambda p: F.regexp_like(p["attributes"], F.lit(HREF)))
    return F.transform(linked, lambda p: F.struct(href_of(p["attributes"]).alias("href"), p["inner"].alias("inner")))


def href_of(attributes) -> Column:
    """href among the attributes of an opening tag ('' when empty or absent)."""
    a = _c(attributes)
    return F.concat(*[F.regexp_extract(a, HREF, k) for k in (1, 2, 3)])


def origin_of(url) -> Column:
    return F.regexp_extract(_c(url), ORIGIN, 1)


def _fold(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments (``..`` at the root is dropped)."""
    def step(done, seg):
        return (F.when(seg == ".", done).when(seg == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
                .otherwise(F.concat(done, F.array(seg))))
    segs = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    folded = F.concat(F.lit("/"), F.array_join(F.aggregate(segs, F.array().cast("array<string>"), step), "/"),
                      F.when(F.element_at(segs, -1).isin(".", "..") & (F.size(segs) > 1), F.lit("/")).otherwise(F.lit("")))
    return F.when(F.regexp_like(path, F.lit(r"/\.\.?(/|$)")), F.regexp_replace(folded, "^//+", "/")).otherwise(path)


def resolve_url(base, href) -> Column:
    """``urljoin(base, href)`` for the common shapes: absolute, scheme-relative,
    root-relative, empty and path-relative; dot segments of joined paths are folded."""
    b, h = _c(base), _c(href)
    origin = origin_of(b)
    no_query = F.regexp_replace(b, r"[?#].*$", "")
    directory = F.regexp_extract(F.substring(no_query, F.length(origin) + 1, F.lit(1 << 30)), r"^(.*/)", 1)
    tail = F.regexp_extract(h, r"[?#].*$", 0)
    path = F.regexp_replace(h, r"[?#].*$", "")
    joined = (F.when(path.startswith("/"), path)
              .otherwise(F.concat(F.when(directory == "", F.lit("/")).otherwise(directory), path)))
    return (F.when(h.rlike(SCHEME), h)
             .when(h.startswith("//"), F.concat(F.regexp_extract(b, SCHEME, 1), h))
             .when(h == "", b)
             .when(h.startswith("#") | h.startswith("?"), F.concat(no_query, h))
             .otherwise(F.concat(origin, _fold(joined), tail)))


def _contains_any(lower_col: Column, words) -> Column:
    cond = None
    for w in words:
        part = lower_col.contains(w)
        cond = part if cond is None else (cond | part)
    return cond


def is_download_link(text) -> Column:
    """Text mentions "download" and one of xlsx/csv/json/xml/dataset."""
    t = F.lower(_c(text))
    return t.contains("download") & _contains_any(t, STRICT_LINK_WORDS)


def is_download_link_lenient(text, href) -> Column:
    """C7 widened to format/kb/mb words or a 20dd year in the text, or an
    href pointing at ``/resource/`` or a data-file extension."""
    t, h = F.lower(F.coalesce(_c(text), F.lit(""))), F.lower(F.coalesce(_c(href), F.lit("")))
    by_text = t.contains("download") & (_contains_any(t, LENIENT_LINK_WORDS) | _c(text).rlike(r"20\d{2}"))
    by_href = h.contains("/resource/") | _contains_any(h, [f".{e}" for e in DATA_EXTENSIONS])
    return F.coalesce(by_text, F.lit(False)) | by_href


def url_basename(href) -> Column:
    """Last path segment of a URL (query and fragment removed)."""
    path = F.regexp_replace(F.regexp_replace(_c(href), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", ""), r"[?#].*$", "")
    return F.regexp_extract(path, r"([^/]*)$", 1)


def derive_filename(text, href, extensions=("xlsx", "csv", "json"),
                    default_ext: str = DEFAULT_EXTENSION, default_name: str = "download",
                    pattern: str = FILENAME_PATTERN, clean_url: bool = True) -> Column:
    """File name for a download link.

    ``Download <name> dataset|in ...`` in the text gives ``<name>`` lower-cased
    with spaces and underscores as dashes, plus the first extension named in
    the text (else the default).  Otherwise the URL's last path segment if it
    has a dot; else the resource id after ``/resource/``; else a default name.
    Characters other than word characters, dash and dot are removed (with
    ``clean_url=False`` only from names taken from the text; ``pattern`` may
    name another text, e.g. ``FILENAME_PATTERN_DATASET``).
    """
    t, h = _c(text), _c(href)
    lt = F.lower(t)
    name = F.regexp_extract(t, pattern, 1)
    ext = F.lit(f".{default_ext}")
    for e in reversed(list(extensions)):
        ext = F.when(lt.contains(e), F.lit(f".{e}")).otherwise(ext)
    from_text = F.concat(F.translate(F.lower(strip_ws(name)), " _", "--"), ext)
    base = url_basename(h)
    rid = F.element_at(F.split(F.element_at(F.split(h, "/resource/"), -1), "/"), 1)
    from_url = (F.when((base != "") & base.contains("."), base)
                 .when(h.contains("/resource/"), F.concat(rid, F.lit(f".{default_ext}")))
                 .otherwise(F.lit(f"{default_name}.{default_ext}")))
    cleaned = lambda c: F.regexp_replace(c, FILENAME_JUNK, "")
    return F.when(name != "", cleaned(from_text)).otherwise(cleaned(from_url) if clean_url else from_url)


def dataset_slug(url) -> Column:
    """I32: what follows the last ``/dataset/`` (the whole URL if absent),
    trailing slashes removed."""
    return F.regexp_replace(F.element_at(F.split(_c(url), "/dataset/"), -1), "/+$", "")
