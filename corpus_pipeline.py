"""Corpus pipeline: five stages from raw documents to token-id files, each stage one operator of ``delayspark.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but the
last return the columns of ``docs``.  :func:`run` writes each stage's result as Parquet to the shared
folder and rereads it, so a lost executor never costs more than the running stage.

Null, empty, long and repeated rows have the results that the operators' docstrings state; an empty
table passes through all stages and gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from delayspark.llm import decontamination, mixing, quality_rules, simhash, token_ids
from delayspark.llm.common import drop_path, scratch_path, ship, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that the rules reject go."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    ship(spark)
    return simhash.one_per_group(docs, shingle=3, max_bits=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeat as often as the mix takes them."""
    return mixing.sample(docs, cycle=[5, 2, 1], share=1.5, max_epochs=2.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files; returns what they hold of each document (id, start, tokens, checksum)."""
    ship(spark)
    path = scratch_path(spark, "corpus")
    token_ids.write_corpus(docs, path, token_ids.default_vocabulary())
    return token_ids.read_corpus(spark, path)


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontaminate),
          ("mixing sources to target weights", mix), ("token-ID / binary output", encode)]

# XXH64 shingle fingerprints, CGK walks and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage-" + name.split()[0].lower())
        made = stage(spark, docs, sf_dir)
        made.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
