"""Registered queries of the captured-page jobs
over the driver's ``pages`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import web as W
from ..registry import register
from ..schema import CARD_LABELS, FILENAME_PATTERN_DATASET, QUALITY_LABELS
from ..session import read_table


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# The SQL states the page rules in its own terms: tags and comments as a parser sees them, hrefs
# against the site root, text between tags decoded after the tags are cut.
def _decode(e: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
                    ("&middot;", "·"), ("&amp;", "&")):
        e = f"replace({e}, {q(ent)}, {q(ch)})"
    return e


def _strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def _text_of(e: str) -> str:
    return f"array_to_string(list_transform(regexp_split_to_array({e}, '<[^>]*>'), lambda x: {_strip(_decode('x'))}), '')"


_SCHEME = "'^[A-Za-z][A-Za-z0-9+.-]*:'"


def _root(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')"


def _fold(path: str) -> str:
    """Dot segments folded: a stack of segments."""
    return (f"'/' || array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(({path})[2:], '/'), lambda s: [s])), "
            f"lambda a, s: CASE s[1] WHEN '.' THEN a WHEN '..' THEN a[1:len(a) - 1] ELSE list_concat(a, s) END), '/')")


def _resolve(b: str, h: str) -> str:
    """``b``: the page's root."""
    path = f"regexp_replace({h}, '[?#].*$', '')"
    rooted = f"CASE WHEN starts_with({path}, '/') THEN {path} ELSE '/' || {path} END"
    return (f"CASE WHEN regexp_matches({h}, {_SCHEME}) THEN {h} "
            f"WHEN starts_with({h}, '//') THEN regexp_extract({b}, {_SCHEME}) || {h} "
            f"WHEN {h} = '' THEN {b} WHEN left({h}, 1) IN ('#', '?') THEN {b} || {h} "
            f"ELSE {b} || CASE WHEN contains({path}, './') THEN {_fold(rooted)} ELSE {rooted} END || regexp_extract({h}, '[?#].*$') END")


ANCHORS = r"""regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<a\s[^>]*href\s*=.*?</a>')"""
_HREF = "trim(regexp_extract({0}, " + q(r"""(?is)^<a\s(?:[^>]*\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""") + ", 1), chr(34) || chr(39))"
_INNER = r"regexp_extract({0}, '(?is)^<a[^>]*>(.*)</a>$', 1)"

LINKS_SQL = f"""links AS (
  SELECT page_id, base, {_decode('href0')} AS href, {_resolve('base', _decode('href0'))} AS url, {_text_of("inner_html")} AS text, pos
  FROM (SELECT page_id, base, {_HREF.format('m')} AS href0, {_INNER.format('m')} AS inner_html, pos
        FROM (SELECT page_id, {_root('url')} AS base, unnest({ANCHORS}) AS m,
                     CAST(generate_subscripts({ANCHORS}, 1) - 1 AS BIGINT) AS pos FROM pages)))"""


def _contains_any(e: str, words) -> str:
    return "(" + " OR ".join(f"contains({e}, {q(w)})" for w in words) + ")"


STRICT = "(regexp_matches(text, '(?i)download') AND regexp_matches(text, '(?i)xlsx|csv|json|xml|dataset'))"
LENIENT = ("(coalesce(regexp_matches(text, '(?i)download') AND regexp_matches(text, '(?i)xlsx|csv|json|xml|dataset|format|kb|mb|20[0-9][0-9]'), false) "
           "OR regexp_matches(href, '(?i)/resource/|[.](xlsx|csv|json|xml)'))")


def _filename(t: str = "text", h: str = "href", exts=("xlsx", "csv", "json"), ends: str = "(?:dataset|in)",
              clean_url: bool = True) -> str:
    name = rf"regexp_extract({t}, '(?i)Download\s+(.+?)\s+{ends}', 1)"
    ext = "'.xlsx'"
    for e in reversed(list(exts)):
        ext = f"CASE WHEN contains(lower({t}), '{e}') THEN '.{e}' ELSE {ext} END"
    junk = lambda x: rf"regexp_replace({x}, '[^\pL\pN_\-.]', '', 'g')"
    from_text = junk(f"translate(lower({_strip(name)}), ' _', '--') || {ext}")
    path = rf"regexp_replace(regexp_replace({h}, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*', ''), '[?#].*$', '')"
    base = f"regexp_extract({path}, '([^/]*)$', 1)"
    rid = f"string_split(string_split({h}, '/resource/')[-1], '/')[1]"
    from_url = (f"CASE WHEN {base} <> '' AND contains({base}, '.') THEN {base} "
                f"WHEN contains({h}, '/resource/') THEN {rid} || '.xlsx' ELSE 'download.xlsx' END")
    return f"CASE WHEN {name} <> '' THEN {from_text} ELSE {junk(from_url) if clean_url else from_url} END"


def links(spark, sf):
    return W.extract_links(read_table(spark, sf, "pages"))


@register("extract_links", f"WITH {LINKS_SQL} SELECT page_id, pos, href, url, text FROM links")
def q_extract_links(spark, sf):
    """Every anchor of every page with resolved URL and text."""
    return links(spark, sf)


@register("dedupe_keep_first", f"""WITH {LINKS_SQL}
SELECT page_id, url, pos, href, text FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS rn FROM links) WHERE rn = 1""")
def q_dedupe(spark, sf):
    """first link per (page, URL)."""
    return W.dedupe_keep_first(links(spark, sf))


@register("derive_filename", f"WITH {LINKS_SQL} SELECT page_id, pos, text, href, {_filename()} AS filename FROM links")
def q_filename(spark, sf):
    """File name derived from link text / href for every link."""
    return W.with_filenames(links(spark, sf)).select("page_id", "pos", "text", "href", "filename")


@register("derive_filename_dataset", f"""WITH {LINKS_SQL}
SELECT page_id, pos, text, href, {_filename(ends='dataset', clean_url=False)} AS filename FROM links""")
def q_filename_dataset(spark, sf):
    """J2, second form: only "dataset" ends the name, names from the URL stay as they are."""
    named = W.with_filenames(links(spark, sf), pattern=FILENAME_PATTERN_DATASET, clean_url=False)
    return named.select("page_id", "pos", "text", "href", "filename")


@register("is_download_link", f"WITH {LINKS_SQL} SELECT page_id, pos, {STRICT} AS is_download FROM links")
def q_is_download(spark, sf):
    """Strict download-link test for every link."""
    return links(spark, sf).select("page_id", "pos", H.is_download_link(F.col("text")).alias("is_download"))


@register("is_download_link_lenient", f"WITH {LINKS_SQL} SELECT page_id, pos, {LENIENT} AS is_download FROM links")
def q_is_download_lenient(spark, sf):
    """Lenient download-link test for every link."""
    return links(spark, sf).select("page_id", "pos",
                                   H.is_download_link_lenient(F.col("text"), F.col("href")).alias("is_download"))


@register("download_links", f"""WITH {LINKS_SQL}
SELECT page_id, url, pos, href, text, filename FROM (
  SELECT *, {_filename()} AS filename, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS rn
  FROM links WHERE {STRICT}) WHERE rn = 1""")
def q_download_links(spark, sf):
    """Download links (C7) with file names, first per (page, URL)."""
    return W.download_links(read_table(spark, sf, "pages"))


@register("download_links_lenient", f"""WITH {LINKS_SQL}
SELECT page_id, url, pos, href, text, filename FROM (
  SELECT *, {_filename()} AS filename, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS rn
  FROM links WHERE {LENIENT}) WHERE rn = 1""")
def q_download_links_lenient(spark, sf):
    """J3 with C8: the lenient download-link variant."""
    return W.download_links(read_table(spark, sf, "pages"), lenient=True)


_SLUG = "regexp_replace(string_split(url, '/dataset/')[-1], '/+$', '', 'g')"


@register("dataset_slug", f"SELECT page_id, url, {_SLUG} AS dataset FROM pages")
def q_slug(spark, sf):
    """I32: dataset folder name from the page URL."""
    return read_table(spark, sf, "pages").select("page_id", "url", H.dataset_slug(F.col("url")).alias("dataset"))


def _page_text(html: str) -> str:
    """Comments, scripts and styles cut out, a line break for each tag of a block, other tags cut out."""
    blocks = "br|p|div|li|tr|td|th|h1|h2|h3|h4|h5|h6|section|article|ul|ol|table|header|footer|nav|dt|dd"
    no_code = f"regexp_replace({html}, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g')"
    lines = f"regexp_replace({no_code}, '(?i)</?({blocks})([ \\t\\r\\n][^>]*)?/?>', chr(10), 'g')"
    return _decode(f"regexp_replace({lines}, '<[^>]*>', '', 'g')")


_PAGE_TEXT = _page_text("html")


def _pct(label: str, ci: bool = True) -> str:
    flag = "(?i)" if ci else ""
    v = f"NULLIF(regexp_extract(t, {q(flag + label + r'[:\s]+(\d+)%')}, 1), '')"
    return f"CASE WHEN {v} IS NOT NULL THEN {v} || '%' END"


_LAST_REFRESHED = _strip(f"regexp_extract(t, {q(r'(?i)Last refreshed[:\s]+([^\n]+)')}, 1)")
_QUALITY_COLS = ", ".join(
    [f"{_pct('Overall score')} AS overall_score",
     f"NULLIF(regexp_extract(t, {q(r'(?i)Grade[:\s]+([A-Za-z]+)')}, 1), '') AS grade"]
    + [f"{_pct(m)} AS {m.lower()}" for m in QUALITY_LABELS]
    + [f"NULLIF({_LAST_REFRESHED}, '') AS last_refreshed"])


@register("quality_metrics", f"SELECT page_id, {_QUALITY_COLS} FROM (SELECT page_id, {_PAGE_TEXT} AS t FROM pages)")
def q_quality(spark, sf):
    """Quality panel figures (any case) read from each page's text."""
    return W.quality_metrics(read_table(spark, sf, "pages"))


_HAS_SCORE = "(contains(t, 'Overall score') OR contains(lower(t), 'score'))"
_FIRST_PCT = "NULLIF(regexp_extract(t, '(\\d+)%', 1), '')"
_STRICT_COLS = ", ".join(
    [f"CASE WHEN {_HAS_SCORE} AND {_FIRST_PCT} IS NOT NULL THEN {_FIRST_PCT} || '%' END AS overall_score",
     f"CASE WHEN {_HAS_SCORE} THEN NULLIF(regexp_extract(t, 'Grade[:\\s]+([A-Za-z]+)', 1), '') END AS grade"]
    + [f"CASE WHEN {_HAS_SCORE} THEN {_pct(m, False)} END AS {m.lower()}" for m in QUALITY_LABELS])


@register("quality_metrics_strict", f"SELECT page_id, {_STRICT_COLS} FROM (SELECT page_id, {_PAGE_TEXT} AS t FROM pages)")
def q_quality_strict(spark, sf):
    """The strict quality variant (nothing without a score mention)."""
    return W.quality_metrics_strict(read_table(spark, sf, "pages"))


# J4 relationally: tags and texts of a page as numbered rows, each table an instance, a row and a cell from
# its start to the next token of the instance that ends it.
_TOKENS = r"""regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?i)</?[a-z][^>]*>|[^<]+')"""
_ROW_END = "('tr', '/tr', 'tbody', '/tbody', 'thead', '/thead', 'tfoot', '/tfoot', 'caption', 'colgroup', '/table')"
_CELL_TEXT = "coalesce((SELECT string_agg({0}, '' ORDER BY x.pos) FROM tx x WHERE x.page_id = c.page_id AND x.pos > c.pos AND x.pos < c.ends AND x.kind = ''), '')"
TABLE_SQL = f"""
tk AS (SELECT page_id, unnest({_TOKENS}) AS tok, generate_subscripts({_TOKENS}, 1) AS pos FROM pages WHERE regexp_matches(html, '(?i)<table')),
tx AS (SELECT page_id, tok, pos, CASE WHEN starts_with(tok, '<') THEN lower(regexp_extract(tok, '^<(/?[A-Za-z0-9]+)', 1)) ELSE '' END AS kind FROM tk),
td AS (SELECT *, sum(CASE kind WHEN 'table' THEN 1 WHEN '/table' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos)
                 + CASE kind WHEN '/table' THEN 1 ELSE 0 END AS depth,
       sum(CASE WHEN kind = 'table' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS opened FROM tx),
tr AS (SELECT page_id, coalesce(min(pos) FILTER (kind = '/table' AND depth = 1 AND opened > 0), max(pos) + 1) AS root_end FROM td GROUP BY page_id),
ti AS (SELECT d.*, r.root_end, max(CASE WHEN kind = 'table' THEN opened END) OVER (PARTITION BY d.page_id, depth ORDER BY pos) AS inst
       FROM td d JOIN tr r ON r.page_id = d.page_id WHERE depth > 0 AND pos <= root_end),
tc AS (SELECT *, lag(kind IN ('tr', 'td', 'th', '/td', '/th')) OVER (PARTITION BY page_id, inst ORDER BY pos) AS in_row
       FROM ti WHERE kind IN ('table', 'td', 'th', '/td', '/th') OR kind IN {_ROW_END}),
te AS (SELECT *, kind = 'tr' OR (kind IN ('td', 'th') AND NOT coalesce(in_row, false)) AS starts,
       coalesce(min(CASE WHEN kind IN {_ROW_END} THEN pos END) OVER w, root_end) AS row_ends,
       coalesce(min(pos) OVER w, root_end) AS ends FROM tc
       WINDOW w AS (PARTITION BY page_id, inst ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
rw AS (SELECT page_id, pos, row_ends, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS row FROM te WHERE starts),
cl AS (SELECT c.page_id, {_CELL_TEXT.format(_strip(_decode('x.tok')))} AS text, c.pos FROM te c WHERE c.kind = 'td'),
rc AS (SELECT r.page_id, r.row, list(c.text ORDER BY c.pos) AS tds FROM rw r JOIN cl c ON c.page_id = r.page_id AND c.pos >= r.pos AND c.pos < r.row_ends
       GROUP BY r.page_id, r.row)"""


@register("table_rows", f"""WITH {TABLE_SQL}
SELECT page_id, row, tds[1] AS column_name, tds[2] AS type, coalesce(tds[3], '') AS description FROM rc WHERE row > 0 AND len(tds) >= 2""")
def q_table_rows(spark, sf):
    """Dictionary rows (name, type, description) from the first table of each page."""
    return W.table_rows(read_table(spark, sf, "pages"))


def _cards_sql(h: str) -> str:
    head = f"regexp_extract(ctext, {q(rf'(?is)<{h}[^>]*>(.*?)</{h}>')}, 1)"
    link = rf"regexp_extract({head}, '(?is)<a\s[^>]*href\s*=.*?</a>')"
    href = _HREF.format(link)
    para = f"regexp_extract(ctext, {q(r'(?is)<p(?:\s[^>]*)?>(.*?)</p>')}, 1)"
    text = _page_text("ctext")
    labels = []
    for name, label in CARD_LABELS.items():
        pattern = q(label + r"\s*([^\n]*)")
        labels.append(f"{_strip(f'regexp_extract({text}, {pattern}, 1)')} AS {name}")
    return f"""
SELECT page_id, card, CASE WHEN {link} <> '' THEN {_text_of(_INNER.format(link))} ELSE {_text_of(head)} END AS title,
       CASE WHEN {link} <> '' AND {href} <> '' THEN {_resolve('base', _decode(href))} ELSE '' END AS url,
       {_text_of(para)} AS description, {', '.join(labels)}
FROM (SELECT page_id, base, card, '<{h}' || piece AS ctext FROM (
  SELECT page_id, {_root('url')} AS base, unnest(pieces) AS piece, CAST(generate_subscripts(pieces, 1) - 1 AS BIGINT) AS card
  FROM (SELECT page_id, url, regexp_split_to_array(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?i)<{h}') AS pieces FROM pages)) WHERE card > 0)"""


@register("catalogue_cards", _cards_sql("h1"))
def q_cards(spark, sf):
    """Catalogue cards split at each <h1> (the heading the captured pages use)."""
    return W.catalogue_cards(read_table(spark, sf, "pages"), heading="h1", require_dataset_link=False)


@register("link_manifest", f"""WITH {LINKS_SQL}
SELECT page_id, url, pos, href, text, filename, dataset, 'dataset/' || dataset || '/' || filename AS path,
       'download' AS status, row_number() OVER (PARTITION BY dataset, filename ORDER BY page_id, pos) > 1 AS collision
FROM (SELECT l.*, {_filename('l.text', 'l.href')} AS filename, {_SLUG.replace('url', 'p.url')} AS dataset,
             row_number() OVER (PARTITION BY l.page_id, l.url ORDER BY l.pos) AS rn
      FROM links l JOIN pages p ON l.page_id = p.page_id WHERE {STRICT.replace('text', 'l.text')}) WHERE rn = 1""")
def q_link_manifest(spark, sf):
    """M8 + D4 + A13: download links per dataset page with target path, status and collision flag."""
    return W.link_manifest(read_table(spark, sf, "pages"))
