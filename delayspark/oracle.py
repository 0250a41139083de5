"""DuckDB SQL for the correctness check.

Each registered query has an equivalent SQL text over the driver's views.
The adapters and the pipeline layers are written once as CTEs here; a query
names the layers it needs and adds its final SELECT.  Output columns follow
one convention on both sides: integers as BIGINT, floating values rounded as
``round(x * 1e6) / 1e6 + 0.0`` (same IEEE steps in both engines, no -0.0).
"""

from __future__ import annotations


# --- layer CTEs (name -> (dependencies, body)) ------------------------------
LAYERS: dict[str, tuple[list[str], str]] = {}


def layer(name: str, deps: list[str], body: str) -> None:
    LAYERS[name] = (deps, body)


layer("inc", [], r"""
SELECT upper(event_type) AS "Vehicle_Type",
       CAST(ts AS DATE) AS "Date",
       CAST(user_id AS VARCHAR) AS "Line",
       CASE WHEN date_part('second', ts) = 0 THEN strftime(ts, '%H:%M') ELSE strftime(ts, '%H:%M:%S') END AS "Time",
       strftime(ts, '%A') AS "Day",
       CASE WHEN user_id >= 10 THEN 'Stop ' || right(CAST(user_id AS VARCHAR), 2) END AS "Station",
       upper(substring(event_type, 1, 4)) AS "Code",
       CASE WHEN regexp_full_match(CAST(value AS VARCHAR), '\d+[.]\d\d') THEN value END AS "Min Delay",
       TRY_CAST(regexp_extract(props, '\d\d') AS DOUBLE) AS "Min Gap",
       CASE right(regexp_extract(props, '\d+'), 1) WHEN '1' THEN 'N' WHEN '3' THEN 'S' WHEN '7' THEN 'E' WHEN '9' THEN 'W' END AS "Bound",
       CASE WHEN user_id >= 10 THEN user_id END AS "Vehicle"
FROM events""")

layer("uni", ["inc"], """
SELECT * FROM inc WHERE "Date" >= DATE '2017-01-01' AND "Date" < DATE '2026-01-01'""")

# M2 clean: Unknown fills, vehicle mode per type (ties: smallest, none: 0),
# medians per type, undated rows dropped.
layer("fill1", ["uni"], """
SELECT * REPLACE (coalesce("Bound", 'Unknown') AS "Bound", coalesce("Line", 'Unknown') AS "Line",
                  coalesce("Station", 'Unknown') AS "Station")
FROM uni""")
layer("vmode", ["fill1"], """
SELECT "Vehicle_Type", "Vehicle" AS vm FROM (
  SELECT "Vehicle_Type", "Vehicle",
         row_number() OVER (PARTITION BY "Vehicle_Type" ORDER BY count(*) DESC, "Vehicle") AS rn
  FROM fill1 WHERE "Vehicle" IS NOT NULL GROUP BY 1, 2) WHERE rn = 1""")
layer("meds", ["fill1"], """
SELECT "Vehicle_Type", quantile_cont("Min Delay", 0.5) AS md, quantile_cont("Min Gap", 0.5) AS mg
FROM fill1 GROUP BY 1""")
layer("cln", ["fill1", "vmode", "meds"], """
SELECT f.* REPLACE (coalesce(f."Vehicle", v.vm, 0) AS "Vehicle",
                    coalesce(f."Min Delay", m.md) AS "Min Delay",
                    coalesce(f."Min Gap", m.mg) AS "Min Gap")
FROM fill1 f LEFT JOIN vmode v ON f."Vehicle_Type" = v."Vehicle_Type"
LEFT JOIN meds m ON f."Vehicle_Type" = m."Vehicle_Type"
WHERE f."Date" IS NOT NULL""")


def _features_body(src: str) -> str:
    return f"""
SELECT s.*,
  CAST(year("Date") AS BIGINT) AS "Year", CAST(month("Date") AS BIGINT) AS "Month",
  CAST(isodow("Date") - 1 AS BIGINT) AS "DayOfWeek", strftime("Date", '%A') AS "DayName",
  CAST(day("Date") AS BIGINT) AS "DayOfMonth", CAST(weekofyear("Date") AS BIGINT) AS "WeekOfYear",
  CAST(hour(try_strptime("Time", '%H:%M:%S')) AS BIGINT) AS "Hour",
  CAST(minute(try_strptime("Time", '%H:%M:%S')) AS BIGINT) AS "Minute"
FROM {src} s"""


def _features2_body(src: str) -> str:
    return f"""
SELECT t.*,
  sin(2 * pi() * "Hour" / 24.0) AS "Hour_sin", cos(2 * pi() * "Hour" / 24.0) AS "Hour_cos",
  sin(2 * pi() * "DayOfWeek" / 7.0) AS "DayOfWeek_sin", cos(2 * pi() * "DayOfWeek" / 7.0) AS "DayOfWeek_cos",
  sin(2 * pi() * "Month" / 12.0) AS "Month_sin", cos(2 * pi() * "Month" / 12.0) AS "Month_cos",
  CASE WHEN "DayOfWeek" >= 5 THEN 1 ELSE 0 END AS "IsWeekend",
  CASE WHEN "Hour" BETWEEN 7 AND 9 OR "Hour" BETWEEN 17 AND 19 THEN 1 ELSE 0 END AS "IsRushHour",
  CASE WHEN "Hour" BETWEEN 6 AND 10 OR "Hour" BETWEEN 15 AND 20 THEN 1 ELSE 0 END AS "IsPeakHour",
  CASE WHEN "Hour" BETWEEN 22 AND 23 OR "Hour" BETWEEN 0 AND 5 THEN 1 ELSE 0 END AS "IsNight",
  CASE WHEN "Month" BETWEEN 3 AND 5 THEN 'Spring' WHEN "Month" BETWEEN 6 AND 8 THEN 'Summer'
       WHEN "Month" BETWEEN 9 AND 11 THEN 'Fall' ELSE 'Winter' END AS "Season",
  CASE WHEN "Min Gap" + 1 <> 0 THEN "Min Delay" / ("Min Gap" + 1) END AS "Delay_Ratio",
  CASE WHEN "Vehicle_Type" IS NULL THEN -1
       ELSE dense_rank() OVER (ORDER BY "Vehicle_Type") - 1 END AS "Vehicle_Type_Encoded",
  CASE WHEN "Min Delay" > 0 AND "Min Delay" <= 5 THEN 'Low (0-5min)'
       WHEN "Min Delay" > 5 AND "Min Delay" <= 15 THEN 'Medium (5-15min)'
       WHEN "Min Delay" > 15 AND "Min Delay" <= 30 THEN 'High (15-30min)'
       WHEN "Min Delay" > 30 THEN 'Very High (30+min)' END AS "Delay_Category"
FROM {src} t"""


layer("feat0", ["cln"], _features_body("cln"))
layer("feat", ["feat0"], _features2_body("feat0"))

# M4 scale: parameters fitted on the whole featured table.
layer("sparams", ["feat"], """
SELECT quantile_cont("Min Gap", 0.25) AS g25, quantile_cont("Min Gap", 0.5) AS g50,
       quantile_cont("Min Gap", 0.75) AS g75,
       quantile_cont("Delay_Ratio", 0.25) AS r25, quantile_cont("Delay_Ratio", 0.5) AS r50,
       quantile_cont("Delay_Ratio", 0.75) AS r75,
       avg("Vehicle") AS vmean, stddev_pop("Vehicle") AS vstd
FROM feat""")
layer("proc", ["feat", "sparams"], """
SELECT f.*,
  CASE WHEN "Min Delay" > -1 THEN ln(1 + "Min Delay") END AS "Min_Delay_Log",
  ("Min Gap" - g50) / CASE WHEN g75 - g25 = 0 THEN 1 ELSE g75 - g25 END AS "Min_Gap_Scaled",
  ("Vehicle" - vmean) / CASE WHEN vstd = 0 OR vstd IS NULL THEN 1 ELSE vstd END AS "Vehicle_Scaled",
  ("Delay_Ratio" - r50) / CASE WHEN r75 - r25 = 0 THEN 1 ELSE r75 - r25 END AS "Delay_Ratio_Scaled"
FROM feat f, sparams""")

# Features on the raw (uncleaned) incidents, for the per-function queries.
layer("rfeat0", ["uni"], _features_body("uni"))
layer("rfeat", ["rfeat0"], _features2_body("rfeat0"))

# --- orders adapter: raw yearly frames, conformed and unified ---------------
_ORD_COMMON = """
  strftime(CAST(o_orderdate AS DATE) + INTERVAL 21 YEAR, '%Y-%m-%d') AS d_txt,
  o_orderpriority AS line,
  CAST(o_orderkey % 24 AS VARCHAR) || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') || ':'
     || lpad(CAST((o_orderkey * 7) % 60 AS VARCHAR), 2, '0') AS tm,
  strftime(CAST(o_orderdate AS DATE) + INTERVAL 21 YEAR, '%A') AS dy,
  'Stn ' || CAST(o_custkey % 100 AS VARCHAR) AS stn,
  'C' || CAST(o_orderkey % 50 AS VARCHAR) AS code,
  round(o_totalprice / 10000.0, 2) AS delay,
  CASE WHEN o_totalprice >= 100000 AND o_totalprice < 1000000 THEN CAST(floor(o_totalprice / 100000) AS DOUBLE) END AS gap,
  ['N','S','E','W'][o_orderkey % 4 + 1] AS bound,
  CASE WHEN o_custkey >= 10 THEN o_custkey END AS vehicle,
  o_orderkey AS oid, o_orderstatus AS st"""
layer("ordraw", [], f"SELECT {_ORD_COMMON} FROM orders")
layer("ordinc", ["ordraw"], """
SELECT CASE st WHEN 'F' THEN 'BUS' WHEN 'O' THEN 'STREETCAR' WHEN 'P' THEN 'SUBWAY' END AS "Vehicle_Type",
       CAST(try_strptime(d_txt, '%Y-%m-%d') AS DATE) AS "Date", line AS "Line", tm AS "Time", dy AS "Day",
       stn AS "Station", code AS "Code", delay AS "Min Delay", gap AS "Min Gap", bound AS "Bound",
       vehicle AS "Vehicle"
FROM ordraw WHERE st IN ('F', 'O', 'P')""")
layer("ouni", ["ordinc"], """
SELECT * FROM ordinc WHERE "Date" >= DATE '2017-01-01' AND "Date" < DATE '2026-01-01'""")
layer("oyear", ["ouni"], """
SELECT *, CAST(year("Date") AS BIGINT) AS "Year" FROM ouni""")


def with_layers(names: list[str], final: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause holding ``names`` and their dependencies (then the
    ``extra`` (name, body) CTEs), followed by ``final``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in LAYERS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    bodies = [(n, LAYERS[n][1]) for n in order] + list(extra or [])
    if not bodies:
        return final
    ctes = ",\n".join(f"{n} AS ({b}\n)" for n, b in bodies)
    return f"WITH {ctes}\n{final}"


def col_out(name: str, kind: str, expr: str | None = None) -> str:
    """Output column in the shared convention (kind: s=string/date, i=int, d=double, b=bool)."""
    e = expr or f'"{name}"'
    if kind == "i":
        return f'CAST({e} AS BIGINT) AS "{name}"'
    if kind == "d":
        return f'round(CAST({e} AS DOUBLE) * 1000000.0) / 1000000.0 + 0.0 AS "{name}"'
    return f'{e} AS "{name}"'


def select_out(cols: list[tuple], src: str, tail: str = "") -> str:
    parts = [col_out(*c) for c in cols]
    return f"SELECT {', '.join(parts)} FROM {src} {tail}"


# Kinds of the standard and processed columns.
STD_KINDS = {"Vehicle_Type": "s", "Date": "s", "Line": "s", "Time": "s", "Day": "s", "Station": "s",
             "Code": "s", "Min Delay": "d", "Min Gap": "d", "Bound": "s", "Vehicle": "i"}
FEAT_KINDS = dict(STD_KINDS, **{
    "Year": "i", "Month": "i", "DayOfWeek": "i", "DayName": "s", "DayOfMonth": "i", "WeekOfYear": "i",
    "Hour": "i", "Minute": "i", "Hour_sin": "d", "Hour_cos": "d", "DayOfWeek_sin": "d",
    "DayOfWeek_cos": "d", "Month_sin": "d", "Month_cos": "d", "IsWeekend": "i", "IsRushHour": "i",
    "IsPeakHour": "i", "IsNight": "i", "Season": "s", "Delay_Ratio": "d", "Vehicle_Type_Encoded": "i",
    "Delay_Category": "s"})
PROC_KINDS = dict(FEAT_KINDS, **{"Min_Delay_Log": "d", "Min_Gap_Scaled": "d", "Vehicle_Scaled": "d",
                                 "Delay_Ratio_Scaled": "d"})


def cols_of(names: list[str], kinds: dict[str, str]) -> list[tuple]:
    return [(n, kinds[n]) for n in names]
