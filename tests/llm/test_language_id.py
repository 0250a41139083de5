import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from delayspark.llm import language_id as G
from delayspark.llm.queries import QUERIES
from tests.llm.conftest import SF


def test_held_out_accuracy(spark):
    got = QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.join(truth, "doc_id").where("held_out and lang is not null")
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.97
    assert got.where("held_out <> (crc32(cast(doc_id as string)) % 4 = 2) or score < 0 or score > 1").count() == 0


def test_places_match_plain_counting():
    text = "Ab, c1é\n zz"
    (_, _, counts), = G.counted(G.lowered(pa.array([text])))
    folded = G._FOLD[np.frombuffer(text.lower().encode(), np.uint8)].tolist()
    want = np.zeros(G.DIMS, int)
    bits = 32 - int(np.log2(G.DIMS))
    for a, b, c in zip(folded, folded[1:], folded[2:], strict=False):
        if (a, b) != (32, 32):
            want[((a << 8 | b) * 0x9E3779B1 % 2**32) >> bits] += 1
        if b != 32:
            want[((a << 16 | b << 8 | c) * 0x85EBCA6B % 2**32) >> bits] += 1
    assert (counts[0] == want).all()


def test_text_of_no_language_is_rejected_and_edges(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = G.train(docs.select("lang", "text", "doc_id").where("lang is not null and text is not null"), F.col("doc_id"))
    assert len(model.languages) <= G.CLUSTERS * 4 and set(model.languages) == {"en", "fr", "de", "es"}
    lang, score, accepted = model.predict(pa.array([None, "", "12 34 !!", "qqxzj vkqzx wwqjx " * 30]))
    assert lang[:3] == ["und"] * 3 and score[:3].tolist() == [0, 0, 0] and not accepted.any()
    assert lang[3] in model.languages
    a, b = (model.predict(pa.array([t]))[1][0] for t in ("wörter und sätze " * 40_000, "wörter und sätze " * 40_000))
    assert a == b
    assert G.predict(edge_docs, model, keep=["doc_id", "kept"]).count() == edge_docs.count()
    assert G.predict(no_docs, model, keep=["doc_id"]).count() == 0


def test_nothing_learned(spark, no_docs, edge_docs):
    model = G.train(no_docs.select("lang", "text", "doc_id"), F.col("doc_id"))
    assert {r["lang_pred"] for r in G.predict(edge_docs, model).collect()} == {"und"}


def test_the_fitting_sample_is_bounded(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"), F.lit("t").alias("text"), "id")
    assert {r["lang"]: r["n"] for r in G.fitting_sample(rows, F.col("id"), 100).groupBy("lang").agg(F.count("*").alias("n")).collect()} \
        == {"a": 100, "b": 100}
