import hashlib
import random

import pytest
from pyspark.sql import functions as F

from delayspark.llm import secret_scan as X
from delayspark.llm.common import written


def corpus(spark, n=300):
    """Documents with known secrets (hash-like values behind names) and known others (numbers, files, long words)."""
    rnd, rows, truth = random.Random(6), [], {}
    for i in range(n):
        value = hashlib.sha1(str(i).encode()).hexdigest()
        number = str(rnd.randrange(10**15, 10**16))
        word = "internationalization2"
        kind = i % 4
        secret = kind == 0
        text = {0: f'set the {rnd.choice(["token", "api_key", "password"])} = "{value}" before the start of it',
                1: f"order {number} was sent to the house", 2: f"see http://host.example/assets/{value[:24]}.png for the picture",
                3: f"the word {word} is long and means a lot"}[kind]
        rows.append((i, f"plain words stand here . {text} . and more words stand there"))
        truth[i] = secret
    return spark.createDataFrame(rows, "doc_id long, text string"), truth


def test_forest_separates_findings_it_was_not_trained_on(spark):
    docs, truth = corpus(spark)
    found = written(X.candidates(docs), "test-found")
    rows = written(X.rule_labels(X.features(found, X.dictionary(docs))), "test-rows")
    model = X.fit(rows.withColumn("label", F.when(F.col("doc_id") % 3 != 0, F.col("label"))))
    got = X.score(rows.where("doc_id % 3 = 0"), model).collect()
    right = sum(r["secret"] == truth[r["doc_id"]] for r in got)
    assert len(got) > 50 and right / len(got) > 0.97


def test_candidates_match_brute_force(spark, edge_docs):
    import re
    want = []
    for r in edge_docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        want += [(r["doc_id"], i, m.group()) for i, x in enumerate(w) for m in re.finditer(X.CANDIDATE, x)]
    got = [tuple(r) for r in X.candidates(edge_docs).select("doc_id", "word_index", "finding").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and want


def test_features_of_a_finding(spark):
    docs = spark.createDataFrame([(1, "my token = \"ab12Cd34wordwordEF56\" here")] + [(i, "a word and a word") for i in range(9)], "doc_id long, text string")
    r = X.features(X.candidates(docs), X.dictionary(docs)).first()
    assert (r["length"], r["named"], r["assigned"], r["quoted"], r["in_file"]) == (20.0, 1.0, 1.0, 1.0, 0.0)
    assert r["transitions"] == 7.0 and r["digit_share"] == pytest.approx(0.3) and r["n_before2"] == "token"


def test_without_labels_nothing_is_removed_and_edges(spark, edge_docs, no_docs):
    one = spark.createDataFrame([(1, "number 1234567890123456 here")], "doc_id long, text string")
    assert [tuple(r) for r in X.scan(one).collect()] == [(1, 1, "1234567890123456", 0, None, True)]
    assert X.scan(no_docs).count() == 0
    assert X.scan(edge_docs).count() == X.candidates(edge_docs).count()


def test_no_python_in_the_plan(edge_docs):
    for df in (X.candidates(edge_docs), X.dictionary(edge_docs)):
        plan = df.explain  # the plan is checked as text below
        text = df._jdf.queryExecution().executedPlan().toString()
        assert plan and "Python" not in text and "Arrow" not in text
