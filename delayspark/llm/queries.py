"""Registered queries of the training-data operators: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import decontamination, language_id, lexical_search, merkle, mixing, quality_rules, secret_scan, simhash, substring_dedup, token_ids, toxicity, url_filter, warc
from . import queries_sql as SQL
from .common import scratch_path, ship, table, written

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op5_quality_rules", SQL.OP5)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first quality verdict of every document."""
    return quality_rules.score(table(spark, sf_dir, "documents"))


@register("op1_mixing", SQL.OP1)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources (weights 5, 2, 1; 150 % of all words; two epochs at most) takes per document."""
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"), cycle=[5, 2, 1], share=1.5, max_epochs=2.0)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


@register("op3_warc", SQL.OP3)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page (response or revisit), written to archives and read back."""
    path = scratch_path(spark, "warc")
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.col("url").alias("uri"), F.col("html").alias("payload"))
    warc.write_archive(warc.resolve_revisits(pages), path)
    heads = written(warc.read_archive(spark, path), "warc-heads")
    return warc.resolved(heads).select(
        F.col("source_id").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@register("op6_token_ids")
def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document tokenized, written as frequency-ranked variable-length ids and read back."""
    path = scratch_path(spark, "token-ids")
    token_ids.write_corpus(table(spark, sf_dir, "documents"), path, token_ids.default_vocabulary())
    return token_ids.read_corpus(spark, path)


URL_RULES = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"),
             url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/"),
             url_filter.Rule("block", "net", "/fr/")]


@register("op10_url_filter", SQL.OP10)
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page: its rule's, else its alias class's."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@register("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 35-word windows that occur elsewhere."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@register("op2_decontamination")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document: the pair, its edit distance and where it stands."""
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = docs.withColumn("held_out", F.coalesce(held, F.lit(False)))
    train = docs.where("not held_out and lang is not null and text is not null")
    model = language_id.train(train.select("lang", "text", "doc_id"), F.col("doc_id"))
    return language_id.predict(docs, model, keep=["doc_id", "held_out"])


@register("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of every document, with the forest's verdict."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules, near-dedup, decontamination, mixing and token-id output over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


@register("op11_merkle_manifest", SQL.OP11)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document; where 3 divides the id's crc32 the text is tampered with."""
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf(merkle.lower_az(F.col("text"))))
    leaves = docs.select(merkle.tree_key(F.col("lang")).alias("tree"), F.col("doc_id").alias("id"),
                         leaf(F.col("text")).alias("digest"), tampered.alias("tampered"))
    return merkle.manifest(leaves).withColumnRenamed("id", "doc_id")


@register("op12_lexical_search", SQL.OP12)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=20)


@register("op13_toxicity")
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and toxic spans of every document, learned from the labels that are not held out."""
    held = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held())
    field = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held()))
    return toxicity.score(docs, field, keep=["doc_id", "held_out"])
