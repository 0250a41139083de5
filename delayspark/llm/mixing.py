"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

A source's target is ``min(max_epochs * size, level * weight)`` with one water level for all sources,
so that the targets add up to the budget.  The level is found by rounds: clamp every source above
its cap, share what is left among the others by weight, repeat until none is above.  A round is one
aggregate over the table of sources; only its three sums reach the driver.

A document is taken ``floor(target / source size)`` times, and once more when its seeded hash
bucket lies below its source's threshold.  The threshold is read from word counts per (source, one
of 4096 buckets): buckets are taken in order while their middle lies below the missing words, so
the words taken differ from the target by at most half a bucket (half of one document where buckets
hold single documents).  Documents are never cut.

Skew: sources are only ever aggregated map-side; the parameter table joins back by a broadcast whose
row count is checked, else by a shuffle join that AQE splits.

Defined results: null text has size 0; a null source is a source of its own, last in order; a
source of size 0 has target 0; rows that repeat the same id and text share one bucket, so they are
sampled together; an empty table gives an empty mix; extra columns are ignored by :func:`plan_mix`
and passed through by :func:`sample`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, fresh, ranked, words_of, written

BUCKETS = 4096            # three hexadecimal digits of the seeded hash
MAX_BROADCAST_SOURCES = 50_000


def bucket(seed: int, id_col: Column, text: Column) -> Column:
    """Seeded bucket of a document, from the first three hex digits of an MD5 of seed, id and text."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")),
                      F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 3), 16, 10).cast("int")


def sizes(docs: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """Narrow table ``doc_id, source, size, bucket``, written once (the only pass over the texts)."""
    text = F.col(text_col)
    return written(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.size(words_of(text)).cast("long").alias("size"),
        bucket(seed, F.col(id_col), text).alias("bucket")), "mix-sizes")


def cyclic_weights(sources: DataFrame, cycle: list[float]) -> DataFrame:
    """Adds ``weight``: the cycle repeated over the sources in code point order, null last."""
    pattern = F.array(*[F.lit(float(c)) for c in cycle])
    order = ranked(sources, [F.col("source").asc_nulls_last()], "rank", parts=8)
    return order.withColumn("weight", F.get(pattern, (F.col("rank") % len(cycle)).cast("int"))).drop("rank")


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to ``source, source_size, weight``: the capped shares of
    ``share`` times all sizes.  Rounds raise the water level until no source is above its cap."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        above = F.lit(False) if level is None else (F.lit(level) * F.col("weight") > cap)
        clamped, weight, n = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(above, 1))).first()
        if level is not None and n == last:
            break
        last = n
        if not weight:  # every source is at its cap: the budget cannot be met
            level = float("inf")
            break
        level = (total * float(share) - clamped) / weight
    return sources.withColumn("target", F.when(cap == 0, F.lit(0.0)).otherwise(
        F.least(cap, F.lit(level) * F.col("weight"))))


def thresholds(histogram: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: ``whole`` repetitions, and ``below``: buckets under it are taken once more."""
    per = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(
        F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket")
                              .rowsBetween(Window.unboundedPreceding, 0))
    cut = (histogram.withColumn("upto", upto).withColumnRenamed("source", "__source")
           .join(per, F.col("__source").eqNullSafe(F.col("source")))
           .where(F.col("upto") * 2 - F.col("size") < rest * 2)
           .groupBy(F.col("source").alias("__source")).agg(F.max("bucket").alias("__top")))
    return (per.join(cut, F.col("__source").eqNullSafe(F.col("source")), "left")
            .select("source", "source_size", "weight", "target", "whole",
                    (F.coalesce("__top", F.lit(-1)) + 1).alias("below")))


def source_params(narrow: DataFrame, cycle: list[float], share: float, max_epochs: float,
                  weights: DataFrame | None = None) -> DataFrame:
    """One row per source (``__source`` and the columns of :func:`thresholds`), ready for the join back."""
    histogram = written(narrow.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mix-histogram")
    sources = histogram.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        sources = cyclic_weights(sources, cycle)
    else:
        w = weights.select(F.col("source").alias("__source"), F.col("weight").cast("double"))
        sources = (sources.join(w, F.col("__source").eqNullSafe(F.col("source")), "left")
                   .select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight")))
    sources = written(sources, "mix-sources")
    params = written(thresholds(histogram, water_fill(sources, share, max_epochs)), "mix-targets")
    return bounded(params.withColumnRenamed("source", "__source"), MAX_BROADCAST_SOURCES)


def copies_of(bucket_col: str) -> Column:
    return (F.col("whole") + F.when(F.col(bucket_col) < F.col("below"), 1).otherwise(0)).cast("long")


def plan_mix(docs: DataFrame, cycle: list[float], share: float = 1.5, max_epochs: float = 2.0, seed: int = 17,
             weights: DataFrame | None = None, **columns: str) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every document.

    ``weights`` (``source, weight``) replaces the cyclic weights; sources without one weigh 0.
    """
    narrow = sizes(docs, seed, **columns)
    params = source_params(narrow, cycle, share, max_epochs, weights)
    return (narrow.join(params, F.col("__source").eqNullSafe(F.col("source")))
            .select("doc_id", narrow["source"], "size", "source_size", "target", copies_of("bucket").alias("copies"),
                    (F.col("size") * copies_of("bucket")).alias("taken")))


def sample(docs: DataFrame, cycle: list[float], share: float = 1.5, max_epochs: float = 2.0, seed: int = 17,
           id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: each row of ``docs`` repeated as often as the plan takes it, columns unchanged.

    The bucket is a function of the row, so each row is compared with its source's parameters; texts
    are not shuffled (while the parameters fit the checked broadcast).
    """
    narrow = sizes(docs, seed, id_col, text_col, source_col)
    params = source_params(narrow, cycle, share, max_epochs)
    row, n = fresh(docs, "__row"), fresh(docs, "__n")
    # the row travels as one struct, so no column of docs can clash with the parameters
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    df = (df.withColumn("__bucket", bucket(seed, F.col(row)[id_col], F.col(row)[text_col]))
          .join(params, F.col("__source").eqNullSafe(F.col(row)[source_col]))
          .withColumn(n, F.explode(F.array_repeat(F.lit(1), copies_of("__bucket").cast("int")))))
    return df.select(f"{row}.*")
