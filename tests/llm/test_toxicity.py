"""Toxic spans: sums against all state sequences, spans against the texts, held-out accuracy on planted texts."""
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from delayspark.llm import queries
from delayspark.llm import toxicity as X

SF = "/root/testdata/sf0.01"


def brute(field, feats):
    """Marginals by adding up every sequence of states."""
    n = len(feats)
    emit = field.weights[feats].sum(axis=1)
    total, toxic = 0.0, np.zeros(n)
    for states in itertools.product((0, 1), repeat=n):
        s = field.start * states[0] + sum(emit[t] for t in range(n) if states[t])
        s += sum(field.move[a, b] for a, b in zip(states, states[1:]))
        total += np.exp(s)
        toxic += np.exp(s) * np.array(states)
    return toxic / total


def some_field(seed=1):
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 0.5, X.PLACES + 1)
    w[-1] = 0
    return X.Field(w, -0.7, rng.normal(0, 1, (2, 2)))


def test_marginals_equal_the_sum_over_all_sequences():
    field = some_field()
    texts = ["one Two", "", "three four five six!", "x", "a b c d e f g h i j", None, "ÄÖ é"]
    for lo, hi, _, first, feats in X.chunks(pa.array(texts)):
        p = field.marginals(feats, first[:-1])
        for a, b in zip(first, first[1:]):
            if b > a:
                assert np.allclose(p[a:b], brute(field, feats[a:b]))


def test_gradient_sums_equal_those_of_the_scoring_code():
    field = some_field(2)
    texts = [" ".join(f"w{i * j % 17}" for i in range(n)) for j, n in enumerate([64, 3, 40, 1], 1)]
    ((_, _, _, first, feats),) = X.chunks(pa.array(texts))
    p = field.marginals(feats, first[:-1])
    emit, real = np.zeros((4, 64)), np.zeros((4, 64), bool)
    for k, (a, b) in enumerate(zip(first, first[1:])):
        emit[k, :b - a], real[k, :b - a] = field.weights[feats[a:b]].sum(axis=1), True
    q, _, _ = X._expected(emit, real, np.append(field.start, field.move.ravel()))
    assert np.allclose(q[real], p)


def test_features_do_not_depend_on_the_neighbouring_texts():
    texts = ["Alpha beta", "gamma", "", "Ünd so weiter"]
    ((_, _, _, first, together),) = X.chunks(pa.array(texts))
    for k, t in enumerate(texts):
        for _, _, _, _, alone in X.chunks(pa.array([t])):
            assert (together[first[k]:first[k + 1]] == alone).all()
    ((_, _, _, _, low),) = X.chunks(pa.array(["ünd SO weiter"]))
    assert (low == together[first[3]:first[4]]).all()


def planted(rnd, n):
    """Texts of two languages; toxic ones hold insults: fixed words, and a stem with endings of its own."""
    def word():
        return "".join(rnd.choice(["an", "er", "th", "ou", "ne", "se", "la", "é"]) for _ in range(rnd.randrange(1, 5)))

    rows = []
    for i in range(n):
        ws = [word() for _ in range(rnd.choice([5, 60, 400]))]
        toxic = rnd.random() < 0.25
        if toxic:
            for _ in range(rnd.randrange(1, 5)):
                ws[rnd.randrange(len(ws))] = rnd.choice(["Grobian", "schuft,"]) if i % 2 else "lump" + word()
        rows.append((i, " ".join(ws), int(toxic)))
    return rows


def test_planted_texts_are_found_with_their_spans(spark):
    rows = planted(random.Random(8), 900)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if i % 3], "doc_id long, toxic int")
    field = X.train(docs, labels)
    got = {r["doc_id"]: r for r in X.score(docs, field, ["doc_id"]).collect()}
    held = [(got[i], t, x) for i, t, x in rows if i % 3 == 0]
    assert sum(r["predicted"] == x for r, _, x in held) >= 0.98 * len(held)
    insults = ("grobian", "schuft", "lump")
    spans = [(t[s["start"]:s["end"]].lower()) for r, t, _ in held for s in r["spans"]]
    assert sum(s.startswith(insults) for s in spans) >= 0.97 * len(spans)
    hoped = sum(w.lower().startswith(insults) for _, t, x in held for w in t.split())
    assert len(spans) >= 0.9 * hoped - 5
    # the same texts dealt otherwise
    again = {r["doc_id"]: r["score"] for r in X.score(docs.repartition(2), X.train(docs.repartition(2), labels), ["doc_id"]).collect()}
    assert sum((again[i] >= 0.5) == (got[i]["score"] >= 0.5) for i in got) >= 0.99 * len(got)


def test_held_out_documents_of_the_tables(spark):
    out = queries.QUERIES["op13_toxicity"](spark, SF)
    assert out.schema["score"].dataType.simpleString() == "double" and out.schema["predicted"].dataType.simpleString() == "int"
    got = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got) and len(got) > 50
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.97 * len(got)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_edge_texts(spark, edge_docs, no_docs):
    rows = planted(random.Random(9), 200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    field = X.train(docs, labels)
    got = X.score(edge_docs, field, ["doc_id", "text", "key", "size"])
    assert got.count() == edge_docs.count()
    seen = [r for r in got.collect() if not r["text"] or not r["text"].strip()]
    assert seen and all(r["predicted"] == 0 and r["spans"] == [] and r["score"] < 0.2 for r in seen)
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert X.score(no_docs, field, ["doc_id"]).collect() == []
    clash = X.score(edge_docs.withColumn("score", F.lit("a")).withColumn("spans", F.lit(1)), field, ["doc_id", "score", "spans"])
    assert clash.columns == ["doc_id", "score", "predicted", "spans"] and clash.count() == edge_docs.count()


@pytest.mark.parametrize("kind", [0, 1, None])
def test_nothing_learned_without_both_labels(spark, kind):
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, kind) for i in range(20)], "doc_id long, toxic int")
    assert X.train(docs, labels) is None
    assert {tuple(r) for r in X.score(docs, None, ["doc_id"]).select("score", "predicted").collect()} == {(0.0, 0)}
