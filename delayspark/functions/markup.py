"""Tables of captured pages as a parser sees them, in native array expressions.

A page is cut once into tokens: comments, scripts and styles as wholes, tags (attribute values may hold ``>``), and the
text between them.  The tag and text tokens from the first table on pass through one fold with two small
stacks, of open rows and of open cells; end tags that HTML lets a page omit are implied, and a nested table's rows and
cells belong to the rows and cells around it as well, as a search for ``tr`` and ``td`` below an element
gives them.  Everything happens inside a page's own row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import decode_entities, strip_ws

# --- fixed values: tokens of a page -----------------------------------------------------------------
TOKEN = (r"(?is)<!--.*?(?:-->|\z)|<(?:script|style)\b.*?(?:</(?:script|style)\s*>|\z)|"
         r"""</?[a-z](?:[^>"']|"[^"]*"|'[^']*')*+>|<[!?][^>]*>|[^<]++|<""")
# tags that take part in the structure of a table
TABLE_TAG = r"(?is)^</?(?:table|tr|td|th|tbody|thead|tfoot|caption|colgroup)\b"
CELLS = 3  # cells of a row that are kept

_ROW = "struct<d:int,row:int,n:int,c:array<string>>"
_CELL = "struct<d:int,at:array<int>,text:string>"
_STATE = f"struct<depth:int,next:int,over:boolean,rows:array<{_ROW}>,cells:array<{_CELL}>,out:array<struct<row:int,n:int,c:array<string>>>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.transform(F.array(value), body)[0]


def tokens(html: Column) -> Column:
    """The tokens of a page in order: (kind, text) with kind ``table`` or ``/table`` and so on for tags of tables and
    '' for text; comments, scripts, styles, other tags and blank text are left out."""
    found = F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))
    is_text = lambda t: ~t.startswith("<") | (t == "<")
    kept = F.filter(found, lambda t: F.when(is_text(t), F.regexp_like(t, F.lit(r"\S"))).otherwise(F.regexp_like(t, F.lit(TABLE_TAG))))
    return F.transform(kept, lambda t: F.struct(
        F.when(is_text(t), F.lit("")).otherwise(F.lower(F.regexp_extract(t, r"(?i)^<(/?[a-z]+)", 1))).alias("kind"),
        F.when(is_text(t), t).alias("text")))


def _step(s: Column, t: Column) -> Column:
    """The fold's state after one token."""
    kind = t["kind"]
    opens_cell = kind.isin("td", "th")
    row_ends = kind.isin("tr", "/tr", "tbody", "/tbody", "thead", "/thead", "tfoot", "/tfoot", "caption", "colgroup", "/table", "/all")
    cell_ends = row_ends | opens_cell | kind.isin("/td", "/th")
    at = F.when(kind == "/all", F.lit(0)).otherwise(s["depth"])
    depth = s["depth"] + F.when(kind == "table", 1).when(kind == "/table", -1).otherwise(0)

    def cells_closed(closed: Column) -> Column:
        """Rows with the texts of cells that end here; a cell knows its number in each row around it."""
        return F.transform(s["rows"], lambda r, p: F.struct(r["d"].alias("d"), r["row"].alias("row"), r["n"].alias("n"), F.transform(
            r["c"], lambda had, k: F.coalesce(F.get(F.filter(closed, lambda c: F.get(c["at"], p) == k), F.lit(0))["text"], had)).alias("c")))

    def after(rows: Column) -> Column:
        """State once cells are closed in ``rows``."""
        done = F.filter(rows, lambda r: row_ends & (r["d"] >= at) & (r["row"] > 0) & (r["n"] >= 2))
        left = F.filter(rows, lambda r: ~(row_ends & (r["d"] >= at)))
        cells = F.filter(s["cells"], lambda c: ~(cell_ends & (c["d"] >= at)))
        return _let(F.struct(left.alias("rows"), cells.alias("cells"), F.concat(s["out"], F.transform(done, lambda r: F.struct(
            r["row"].alias("row"), r["n"].alias("n"), r["c"].alias("c")))).alias("out")), opened)

    def opened(x: Column) -> Column:
        """State once what this token starts is open: a row, implied by a cell without one, then the cell."""
        new_row = (kind == "tr") | (opens_cell & ~F.exists(x["rows"], lambda r: r["d"] == depth))
        fresh = F.struct(depth.alias("d"), s["next"].alias("row"), F.lit(0).alias("n"),
                         F.array_repeat(F.lit(None).cast("string"), CELLS).alias("c"))
        rows = F.when(new_row, F.concat(x["rows"], F.array(fresh))).otherwise(x["rows"])
        counted = lambda r: F.struct(r["d"].alias("d"), r["row"].alias("row"), (r["n"] + 1).alias("n"), r["c"].alias("c"))
        return _let(rows, lambda rows: F.struct(
            depth.alias("depth"), (s["next"] + new_row.cast("int")).alias("next"),
            (s["over"] | ((kind == "/table") & (depth == 0))).alias("over"),
            F.when(kind == "td", F.transform(rows, counted)).otherwise(rows).alias("rows"),
            F.when(kind == "td", F.concat(x["cells"], F.array(F.struct(
                depth.alias("d"), F.transform(rows, lambda r: r["n"]).alias("at"), F.lit("").alias("text"))))).otherwise(x["cells"]).alias("cells"),
            x["out"].alias("out")))

    closed = F.filter(s["cells"], lambda c: cell_ends & (c["d"] >= at))
    tag = _let(F.when(cell_ends, _let(closed, cells_closed)).otherwise(s["rows"]), after)
    # only text of an open cell is read
    text = F.when(F.size(s["cells"]) == 0, s).otherwise(_let(strip_ws(decode_entities(t["text"])), lambda piece: F.struct(
        s["depth"].alias("depth"), s["next"].alias("next"), s["over"].alias("over"), s["rows"].alias("rows"),
        F.transform(s["cells"], lambda c: F.struct(c["d"].alias("d"), c["at"].alias("at"), F.concat(c["text"], piece).alias("text"))).alias("cells"),
        s["out"].alias("out"))))
    outside = (s["depth"] == 0) & (kind != "table")  # a parser drops rows and cells outside a table
    return F.when(s["over"] | outside, s).when(kind == "", text).otherwise(tag)


def table_rows(html: Column) -> Column:
    """array<struct<row, n, c>> of the first table: rows after the first one with at least two ``td`` cells, in
    order; ``row`` is the row's place, ``n`` its number of cells, ``c`` the texts of the first ``CELLS``."""
    found = tokens(html)
    start = F.expr("named_struct('depth', 0, 'next', 0, 'over', false, 'rows', array(), 'cells', array(), 'out', array())").cast(_STATE)
    last = F.array(F.struct(F.lit("/all").alias("kind"), F.lit(None).cast("string").alias("text")))
    folded = F.aggregate(F.concat(found, last), start, lambda s, t: _step(s, t).cast(_STATE), lambda s: s["out"])
    in_order = F.array_sort(folded)
    nothing = F.array().cast("array<struct<row:int,n:int,c:array<string>>>")
    return F.when(F.regexp_like(html, F.lit(r"(?i)<table\b")), in_order).otherwise(nothing)
