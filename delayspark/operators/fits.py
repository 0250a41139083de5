"""Fit statistics inside the plan: modes, quantiles and moments as scalar subqueries.

Nothing here runs a job.  A fitted value is an uncorrelated scalar subquery of the plan that uses it, so
column pruning drops the fit together with a column that nobody reads, and Spark runs equal fits once.

Exact quantiles come from histograms of ordered bits.  A double becomes the signed 64-bit integer that sorts as it
does (:func:`ordered_bits`); a pass counts rows per (group, leading bits) map-side, a running sum finds the bins that
hold the target ranks, and the next pass, to which these few bins are broadcast, counts further bits of the rows in them.  Three passes (22, 21 and
21 bits) end at the values themselves: no exchange carries a row's value, only counts, at most 2**22 for a group
and target in each task; the running sum of a group and target sees as many.  Each pass reads the key and one column.

Statistics of groups are looked up in a map of at most ``MAX_GROUPS`` groups (vehicle types, categories); a key
with more groups is an error that names the way for them, ``lookup="join"``.

Spark optimizes every subquery of a plan, and those inside it, before it prunes any.  A fit on a table that holds fits
is therefore best given a narrow input, one that derives the fitted column and no other (see ``plans.pipelines``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_GROUPS = 1000
_SHIFTS = (42, 21, 0)           # bits still open after each pass
_FRACTION = 1 << 52
_LEAST_NORMAL = 2.0 ** -1022
_LEAST = 5e-324


# --- doubles as ordered integers ------------------------------------------------------------------
# Each step is the output of a generator: the optimizer would write a projected expression out wherever its
# alias is read, and never does with a generator's.
_BITS = f"""
x0 AS (SELECT {{keep}}, x FROM {{source}} LATERAL VIEW explode(array(CAST({{value}} AS DOUBLE))) g AS x),
x1 AS (SELECT {{keep}}, s FROM x0 LATERAL VIEW explode(array(named_struct('x', x, 'a', abs(x), 'g', CAST(floor(log2(
  CASE WHEN abs(x) >= {_LEAST_NORMAL!r}D AND abs(x) < double('inf') THEN abs(x) END)) AS INT)))) g AS s),
x2 AS (SELECT {{keep}}, t FROM x1 LATERAL VIEW explode(array(named_struct('x', s.x, 'a', s.a, 'e',
  CASE WHEN pow(2.0D, s.g + 1) <= s.a THEN s.g + 1 WHEN pow(2.0D, s.g) > s.a THEN s.g - 1 ELSE s.g END))) g AS t),
bits AS (SELECT {{keep}}, b FROM x2 LATERAL VIEW explode(array(CASE WHEN t.x < 0 THEN -1L ELSE 1L END * CASE
  WHEN isnan(t.x) THEN {(2047 << 52) + 1}L WHEN t.a = double('inf') THEN {2047 << 52}L
  WHEN t.a < {_LEAST_NORMAL!r}D THEN CAST(t.a / {_LEAST!r}D AS BIGINT)
  ELSE CAST(t.e + 1023 AS BIGINT) * {_FRACTION}L + CAST((t.a / pow(2.0D, t.e) - 1) * {float(_FRACTION)!r}D AS BIGINT) END)) g AS b)"""


def ordered_bits(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the IEEE bits of the double column ``value`` as a long that sorts like it.

    Magnitude bits are rebuilt from exact arithmetic - the exponent by logarithm, mended by comparison with powers
    of two, the fraction by division with one - and negated for negative values.  Both zeros are 0, NaN is
    the greatest, null stays null."""
    keep = ", ".join(f"`{c}`" for c in df.columns)
    steps = _BITS.format(keep=keep, source="{df}", value=f"`{value}`")
    return df.sparkSession.sql(f"WITH {steps} SELECT {keep}, b AS `{name}` FROM bits", df=df)


def double_of(bits: Column) -> Column:
    """The double whose :func:`ordered_bits` are ``bits``."""
    size = F.abs(bits)
    exponent = F.shiftright(size, 52).cast("int")
    fraction = size.bitwiseAND(F.lit(_FRACTION - 1)).cast("double")
    value = (F.when(exponent == 0, fraction * F.lit(_LEAST))
             .when(size > (2047 << 52), F.lit(float("nan"))).when(exponent == 2047, F.lit(float("inf")))
             .otherwise((1 + fraction / F.lit(float(_FRACTION))) * F.pow(F.lit(2.0), exponent - 1023)))
    return F.when(bits < 0, -value).otherwise(value)


# --- maps of groups -------------------------------------------------------------------------------
def group_map(table: DataFrame, key: str, value: Column, limit: int = MAX_GROUPS) -> Column:
    """key -> value of a table of one row per group, as a scalar subquery; more than ``limit`` groups are an error."""
    entries = table.limit(limit + 1).agg(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v"))).alias("e"))
    what = F.lit(f"more than {limit} groups for a map: use lookup='join'")
    return entries.select(F.when(F.size("e") > limit, F.raise_error(what)).otherwise(F.map_from_entries("e"))).scalar()


def bounded(table: DataFrame, limit: int = MAX_GROUPS) -> DataFrame:
    """``table`` for a broadcast, when it has at most ``limit`` rows, else an error: its bound is proven where it is broadcast."""
    rows = table.limit(limit + 1).agg(F.collect_list(F.struct("*")).alias("e"))
    what = F.lit(f"more than {limit} rows to broadcast: use lookup='join'")
    return F.broadcast(rows.select(F.inline(F.when(F.size("e") > limit, F.raise_error(what)).otherwise(F.col("e")))))


def look_up(fitted: Column, key: Column) -> Column:
    return F.try_element_at(fitted, key)


# --- quantiles ------------------------------------------------------------------------------------
def _rank_list(probs: Sequence[float]) -> str:
    at = [f"{float(p)!r}D * (n - 1)" for p in probs]
    return "array_distinct(array(" + ", ".join(f"CAST({f}({a}) AS BIGINT)" for a in at for f in ("floor", "ceil")) + "))"


def _passes(probs: Sequence[float]) -> str:
    """CTEs ``f0, f1, ...``: after each pass the bins (k, p, before, n, upto) that hold a target rank.

    ``c`` counts bins, ``f`` keeps those with a rank between the rows before and up to them, ``t`` is what the next
    pass gets by broadcast: at most two bins for each probability and group, else an error."""
    limit = 2 * len(probs) * MAX_GROUPS
    what = f"more than {limit} bins to broadcast: use lookup=''join''".replace("''", "\\'")
    out = []
    for i, shift in enumerate(_SHIFTS):
        if i == 0:
            out.append(f"c0 AS (SELECT k, shiftright(b, {shift}) AS p, count(b) AS c FROM bits GROUP BY 1, 2)")  # a null is a bin without a count
            summed = "SELECT k, p, c, sum(c) OVER (PARTITION BY k) AS n, sum(c) OVER (PARTITION BY k ORDER BY p ROWS UNBOUNDED PRECEDING) AS upto FROM c0"
        else:
            out.append(f"c{i} AS (SELECT /*+ BROADCAST(t{i}) */ bits.k, t{i}.p AS q, shiftright(b, {shift}) AS p, count(1) AS c, min(before) AS s, min(n) AS n "
                       f"FROM bits JOIN t{i} ON bits.k = t{i}.k AND shiftright(b, {_SHIFTS[i - 1]}) = t{i}.p GROUP BY 1, 2, 3)")
            summed = f"SELECT k, p, c, n, s + sum(c) OVER (PARTITION BY k, q ORDER BY p ROWS UNBOUNDED PRECEDING) AS upto FROM c{i}"
        out.append(f"f{i} AS (SELECT k, p, n, upto - c AS before, upto FROM ({summed}) "
                   f"WHERE exists({_rank_list(probs)}, r -> r >= upto - c AND r < upto))")
        out.append(f"t{i + 1} AS (SELECT inline(CASE WHEN size(e) > {limit} THEN raise_error('{what}') ELSE e END) FROM "
                   f"(SELECT collect_list(struct(k, p, before, n)) AS e FROM (SELECT * FROM f{i} LIMIT {limit + 1})))")
    return ",\n".join(out[:-1])


def quantile_table(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(__k, q): the linearly interpolated quantiles of the non-null values of every group, as an array.

    ``__k`` is the struct of ``by`` (a constant without one).  Groups without a value are absent."""
    key = f"struct({', '.join(f'`{c}`' for c in by)})" if by else "struct(0 AS all)"
    steps = _BITS.format(keep="k", source=f"(SELECT {key} AS k, `{col}` AS v FROM {{df}})", value="v")
    last = len(_SHIFTS) - 1
    found = df.sparkSession.sql(f"""WITH {steps},
{_passes(probs)}
SELECT k AS __k, max(n) AS n, collect_list(struct(r, p)) AS at FROM (
  SELECT k, p, n, explode(filter({_rank_list(probs)}, r -> r >= before AND r < upto)) AS r FROM f{last}) GROUP BY k""", df=df)
    values = found.select("__k", "n", F.map_from_entries(F.transform("at", lambda x: F.struct(x["r"], double_of(x["p"])))).alias("m"))

    def between(p: float) -> str:
        at = f"({float(p)!r}D * (n - 1))"
        low, high = (f"m[CAST({f}{at} AS BIGINT)]" for f in ("floor", "ceil"))
        return f"CASE WHEN {low} = {high} THEN {low} ELSE {low} + ({high} - {low}) * ({at} - floor({at})) END"

    return values.selectExpr("__k", f"array({', '.join(between(p) for p in probs)}) AS q")


def group_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str]) -> Column:
    """Scalar subquery: struct of ``by`` -> array of quantiles."""
    return group_map(quantile_table(df, col, probs, by), "__k", F.col("q"))


def quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> Column:
    """Scalar subquery: array of the quantiles of a column; null without a value."""
    return quantile_table(df, col, probs).select("q").scalar()


# --- other fits -----------------------------------------------------------------------------------
def mode_table(df: DataFrame, col: str, key: str, alias: str = "mode") -> DataFrame:
    """(key, alias): the most frequent non-null value of every group, the smallest of equally frequent ones; null without a value."""
    pairs = df.select(F.col(f"`{key}`").alias("__k"), F.col(f"`{col}`").alias("__v"))
    counts = pairs.groupBy("__k", "__v").agg(F.count("__v").alias("__c"))
    order = F.when(F.col("__v").isNotNull(), F.struct((-F.col("__c")).alias("c"), F.col("__v").alias("v")))
    return counts.groupBy(F.col("__k").alias(key)).agg(F.min_by("__v", order).alias(alias))


def group_modes(df: DataFrame, col: str, key: str) -> Column:
    """Scalar subquery: key -> mode; null keys have none."""
    return group_map(mode_table(df, col, key).where(F.col(f"`{key}`").isNotNull()), key, F.col("mode"))


def moments(df: DataFrame, col: str) -> Column:
    """Scalar subquery: struct of mean and population standard deviation."""
    c = F.col(f"`{col}`")
    return df.agg(F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"))).scalar()


def sorted_values(df: DataFrame, col: str, limit: int = MAX_GROUPS) -> Column:
    """Scalar subquery: the distinct non-null values in ascending order, an error beyond ``limit``."""
    values = (df.select(F.col(f"`{col}`").alias("v")).groupBy("v").agg(F.count("v").alias("c")).where("c > 0").limit(limit + 1)
              .agg(F.array_sort(F.collect_list("v")).alias("a")))
    what = F.lit(f"more than {limit} values for a list: use lookup='join'")
    return values.select(F.when(F.size("a") > limit, F.raise_error(what)).otherwise(F.col("a"))).scalar()


class FitStore:
    """Fits of one input, run once and kept as one-row tables below ``path`` in the shared folder.

    ``store[name]`` is a scalar subquery on the kept row, to be used wherever the fit itself could be; reports that
    share a store do not fit again, and a lost executor costs nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._tables = spark, path, {}

    def put(self, **fitted: Column) -> FitStore:
        """Run these fits (one job) and keep their values."""
        name = f"{self.path}/{len(self._tables)}-{'-'.join(sorted(fitted))[:80]}"
        self.spark.range(1).select(*[c.alias(n) for n, c in fitted.items()]).write.mode("overwrite").parquet(name)
        kept = self.spark.read.parquet(name)
        self._tables |= dict.fromkeys(fitted, kept)
        return self

    def names(self) -> list[str]:
        return list(self._tables)

    def __getitem__(self, name: str) -> Column:
        return self._tables[name].select(name).scalar()
