"""Fit statistics shared by the cleaning and scaling operators.

Scale notes
-----------
* Exact quantiles are histograms of ordered bits inside the plan (:mod:`.fits`): no job is run to build them and
  no exchange carries a value.  ``approx=True`` uses the fixed-size ``percentile_approx`` sketch instead.
* Modes are two-level aggregations in the column's own type (count per value,
  then ``min_by``), never a value -> count map inside one task.
* Statistics of groups are looked up in a bounded map that the plan itself fits (``lookup="map"``, the default: vehicle
  types, categories).  ``lookup="join"`` is the way for any number of groups: distributed rank selections
  (:func:`select_quantiles`) and a join that broadcasts only below a measured bound; it runs jobs when it is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import fits

# A statistic table above this many rows or bytes is joined by shuffle, not broadcast.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20


def checked_broadcast(small: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Checkpoint an aggregated table, measure it, and mark it for broadcast only if
    it has at most ``max_rows`` rows and ``MAX_BROADCAST_BYTES`` (as text); larger tables
    go through a shuffle join."""
    small = cut_lineage(small)
    n, size = small.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(small) if n <= max_rows and (size or 0) <= MAX_BROADCAST_BYTES else small


def weighted_values(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., col, __w): non-null values with their multiplicity (map-side combined)."""
    return (df.where(F.col(col).isNotNull())
              .groupBy(*by, col)
              .agg(F.count(F.lit(1)).alias("__w")))


def stacked_weighted(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., __col, __v, __w): the non-null values of several columns with
    their multiplicity, from ONE shuffle (rows are fanned out per column and
    combined map-side before the exchange)."""
    items = F.array(*[F.struct(F.lit(c).alias("__col"), F.col(f"`{c}`").cast("double").alias("__v")) for c in cols])
    stacked = df.select(*by, F.explode(items).alias("__s")).select(*by, "__s.__col", "__s.__v")
    return (stacked.where(F.col("__v").isNotNull())
                   .groupBy(*by, "__col", "__v").agg(F.count(F.lit(1)).alias("__w")))


def group_fill_stats(df: DataFrame, medians: Sequence[str] = (), modes: Sequence[str] = (),
                     key: str = "Vehicle_Type", approx: bool = False) -> DataFrame:
    """Per group: the median of each ``medians`` column (all from one weighted table) and the mode
    (ties: smallest, in the column's own type) of each ``modes`` column, for any number of groups.
    Wide result: (key, <col>__fill ...)."""
    out = df.where(F.col(key).isNotNull()).select(key).distinct()
    if medians and approx:
        for c in medians:
            out = out.join(exact_quantiles(df, c, [0.5], [key], prefix="__m", approx=True)
                           .withColumnRenamed("__m0", f"{c}__fill"), key, "left")
    elif medians:
        med = select_quantiles(stacked_weighted(df, list(medians), [key]), "__v", [0.5], [key, "__col"], prefix="__m")
        wide = med.groupBy(key).agg(*[F.max(F.when(F.col("__col") == c, F.col("__m0"))).alias(f"{c}__fill") for c in medians])
        out = out.join(wide, key, "left")
    for c in modes:
        out = out.join(group_mode(df, c, [key], f"{c}__fill"), key, "left")
    return out


def fill_maps(df: DataFrame, medians: Sequence[str] = (), modes: Sequence[str] = (), key: str = "Vehicle_Type",
              approx: bool = False) -> dict[str, Column]:
    """Per column a scalar subquery: group -> fill value."""
    def median(c: str) -> Column:
        table = exact_quantiles(df, c, [0.5], [key], prefix="__m", approx=approx)
        return fits.group_map(table.where(F.col(f"`{key}`").isNotNull()), key, F.col("__m0"))

    return {c: median(c) for c in medians} | {c: fits.group_modes(df, c, key) for c in modes}


def fill_with_group_stats(df: DataFrame, medians: Sequence[str] = (), modes: Sequence[str] = (),
                          key: str = "Vehicle_Type", mode_default=0, approx: bool = False, lookup: str = "map",
                          fitted: dict[str, Column] | None = None) -> DataFrame:
    """D1 for several columns at once: NULL -> the group's median / mode
    (a group without any value: median stays NULL, mode becomes
    ``mode_default``).

    With ``lookup="map"`` every fit is a subquery of its column alone, and a column that is not read
    costs nothing; ``fitted`` gives such maps from elsewhere (a fit store).  ``lookup="join"`` fits all
    columns at once and joins them, for any number of groups."""
    medians = [c for c in medians if c in df.columns]
    modes = [c for c in modes if c in df.columns]
    if not medians and not modes:
        return df
    if lookup == "map":
        maps = fill_maps(df, medians, modes, key, approx) if fitted is None else fitted
        source, fill = df, {c: fits.look_up(maps[c], F.col(f"`{key}`")) for c in [*medians, *modes]}
    else:
        small = checked_broadcast(group_fill_stats(df, medians, modes, key, approx))
        source, fill = df.join(small, key, "left"), {c: F.col(f"`{c}__fill`") for c in [*medians, *modes]}
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in medians:
            out.append(F.coalesce(c, fill[f.name].cast(f.dataType)).alias(f.name))
        elif f.name in modes:
            out.append(F.coalesce(c, fill[f.name].cast(f.dataType), F.lit(mode_default).cast(f.dataType)).alias(f.name))
        else:
            out.append(c)
    return source.select(*out)


def select_quantiles(wv: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (),
                     prefix: str = "q", partitions: int | None = None) -> DataFrame:
    """Exact linear quantiles by distributed rank selection.

    ``wv`` holds (by..., col, __w): distinct values with their weights.  It is
    range-partitioned on (by, value) - a group with many distinct values is
    spread over many partitions - and written as a reliable checkpoint so the
    partition of every row is fixed.  Per-partition weight totals (a table of
    partitions x groups rows) give each target rank's partition and offset;
    only those partitions are scanned again with a running weight sum.  No
    task ever holds more than one range partition; the driver only sees the
    small partition summary.
    """
    spark = wv.sparkSession
    if not by:  # one group, so that every join below has a key
        return select_quantiles(wv.withColumn("__all", F.lit(0)), col, probs, ["__all"], prefix, partitions).drop("__all")
    by = list(by)
    n_part = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    parted = (wv.repartitionByRange(n_part, *[F.col(c) for c in by], F.col(col))
                .withColumn("__pid", F.spark_partition_id()))
    parted = cut_lineage(parted)
    summ = parted.groupBy("__pid", *by).agg(F.sum("__w").alias("__c"))
    grp = Window.partitionBy(*by)
    summ = (summ.withColumn("__end", F.sum("__c").over(grp.orderBy("__pid")))
                .withColumn("__n", F.sum("__c").over(grp))
                .withColumn("__start", F.col("__end") - F.col("__c")))
    # ranks needed: floor and ceil of p * (n - 1) for every probability
    pos = F.explode(F.array(*[F.struct(F.lit(i).alias("__i"), (F.lit(float(p)) * (F.col("__n") - 1)).alias("__pos"))
                              for i, p in enumerate(probs)])).alias("__t")
    targets = summ.select(*by, "__n").distinct().select(*by, pos).select(*by, "__t.__i", "__t.__pos")
    ranks = targets.select(*by, "__i", "__pos", F.explode(F.array_distinct(F.array(
        F.floor("__pos").cast("long"), F.ceil("__pos").cast("long")))).alias("__r"))
    loc = ranks.join(summ.select(*by, "__pid", "__start", "__end"), by, "inner")
    loc = loc.where((F.col("__r") >= F.col("__start")) & (F.col("__r") < F.col("__end")))
    loc = loc.select(*by, "__i", "__pos", "__r", "__pid", (F.col("__r") - F.col("__start")).alias("__local"))
    loc = checked_broadcast(loc)
    keys = ["__pid", *by]
    needed = parted.join(loc.select(*keys).distinct(), keys, "left_semi")
    run = needed.withColumn("__cum", F.sum("__w").over(
        Window.partitionBy(*keys).orderBy(col).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hit = run.join(loc, keys).where((F.col("__cum") - F.col("__w") <= F.col("__local")) &
                                    (F.col("__local") < F.col("__cum")))
    vals = hit.select(*by, "__i", "__pos", "__r", F.col(col).cast("double").alias("__v"))
    per = vals.groupBy(*by, "__i").agg(
        F.min_by("__v", "__r").alias("__lo"), F.max_by("__v", "__r").alias("__hi"), F.first("__pos").alias("__pos"))
    q = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("__pos") - F.floor("__pos"))
    wide = per.groupBy(*by).agg(*[F.max(F.when(F.col("__i") == i, q)).alias(f"{prefix}{i}")
                                  for i in range(len(probs))])
    return wide


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (),
                    prefix: str = "q", approx: bool = False, accuracy: int = 10_000, lookup: str = "map") -> DataFrame:
    """Linear-interpolated quantiles (numpy/pandas default) per group.

    Returns ``by...`` plus one column per probability named ``{prefix}{i}``.
    Groups whose values are all NULL are absent.  ``approx`` uses the fixed-size sketch; ``lookup="join"`` is for
    more than ``fits.MAX_GROUPS`` groups.
    """
    if approx:
        agg = F.percentile_approx(F.col(col), F.array(*[F.lit(float(p)) for p in probs]), accuracy)
        base = df.where(F.col(col).isNotNull()).groupBy(*by).agg(agg.alias("__q"))
        return base.select(*by, *[F.col("__q")[i].alias(f"{prefix}{i}") for i in range(len(probs))])
    if lookup == "join":
        return select_quantiles(weighted_values(df, col, by), col, probs, by, prefix)
    table = fits.quantile_table(df, col, probs, by)
    return table.select(*[F.col(f"__k.`{c}`").alias(c) for c in by], *[F.col("q")[i].alias(f"{prefix}{i}") for i in range(len(probs))])


def group_mode(df: DataFrame, col: str, by: Sequence[str], alias: str = "mode") -> DataFrame:
    """Most frequent non-null value per group; ties go to the smallest value."""
    counted = weighted_values(df, col, by)
    return counted.groupBy(*by).agg(
        F.min_by(F.col(col), F.struct(-F.col("__w"), F.col(col))).alias(alias))


def mode_by_type(df: DataFrame, col: str = "Vehicle", by: str = "Vehicle_Type",
                 default=0, alias: str = "mode") -> DataFrame:
    """Mode per type; a type with no value gets ``default``."""
    types = df.select(by).where(F.col(by).isNotNull()).distinct()
    modes = group_mode(df, col, [by], alias)
    return types.join(modes, by, "left").select(
        by, F.coalesce(F.col(alias), F.lit(default)).cast(df.schema[col].dataType).alias(alias))


def median_by_type(df: DataFrame, col: str, by: str = "Vehicle_Type", alias: str = "median",
                   approx: bool = False) -> DataFrame:
    """Interpolated median per type over non-null values; all-NULL types
    get NULL."""
    types = df.select(by).where(F.col(by).isNotNull()).distinct()
    med = exact_quantiles(df, col, [0.5], [by], prefix="__m", approx=approx)
    return types.join(med, by, "left").select(by, F.col("__m0").alias(alias))


def fill_from_group_stat(df: DataFrame, col: str, stat: DataFrame, key: str = "Vehicle_Type",
                         stat_col: str = "stat", lookup: str = "map") -> DataFrame:
    """Replace NULLs of ``col`` with the statistic of the row's group.

    ``stat`` is a (key, stat_col) table of one row per group, looked up in a bounded map of the plan;
    with ``lookup="join"``, for any number of groups, through a checked broadcast.  The incident table is never
    shuffled for the lookup below that bound."""
    if lookup == "map":
        given = stat.where(F.col(f"`{key}`").isNotNull())
        source, fill = df, fits.look_up(fits.group_map(given, key, F.col(f"`{stat_col}`")), F.col(f"`{key}`"))
    else:
        small = checked_broadcast(stat.select(key, F.col(stat_col).alias("__fill")))
        source, fill = df.join(small, key, "left"), F.col("__fill")
    dtype = df.schema[col].dataType
    return source.select(*[F.coalesce(F.col(f"`{c}`"), fill.cast(dtype)).alias(c) if c == col else F.col(f"`{c}`") for c in df.columns])
