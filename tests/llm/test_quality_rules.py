from collections import Counter

import pytest
from pyspark.sql import functions as F

from delayspark.llm import quality_rules as Q
from tests.llm.conftest import edge_texts


def base_figures(text):
    import re
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i:i + 5])] > 1:
            covered.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in Q.SYMBOLS), dup, len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_base_figures_match_brute_force(spark):
    texts = edge_texts() + ["a b c d e f a b c d e f a b c d e", "r " * 7, "p q r s t u\np q r s t u\n" * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:7] for r in Q.score(df).collect()}
    assert got == {i: base_figures(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("line, fails", [
    ("A sentence that ends well.", False), ("And one that goes on. Without an end", False), ("no closed sentence", True),
    ("Home | About | Contact.", True), ("All rights reserved.", True), ("We USE cookies here.", True), ("   ", False), ("", False),
    ("Buy*** now### it&&& is%%% cheap.", True), ("Well! Really! Yes! It is so and that is quite all there is to say of it now.", False),
])
def test_line_rules(spark, line, fails):
    df = spark.createDataFrame([(line,)], "line string")
    assert df.select(Q.line_fails(F.col("line"))).first()[0] is fails


def test_lines_go_and_documents_that_lose_too_much_go(spark):
    good = "This line is a sentence of eleven words and it stays."
    more = "Another one says something else and is not removed either."
    docs = spark.createDataFrame([(1, f"{good}\nHome | About | Shop\n{more}", 0), (2, f"{good}\n" + " ".join(f"x{i} y{i} |" for i in range(9)), 0),
                                  (3, "too short.", 0)], "doc_id long, text string, n_chars int")
    kept = Q.clean(docs).collect()
    assert [tuple(r) for r in kept] == [(1, f"{good}\n{more}", len(good) + len(more) + 1)]
    assert {r["doc_id"]: (r["base_failed"], r["kept"]) for r in Q.score(docs).collect()} == {
        1: (False, True), 2: (False, False), 3: (True, False)}


def test_edges(edge_docs, no_docs):
    assert Q.score(edge_docs).count() == edge_docs.count() and Q.score(no_docs).count() == 0
    out = Q.clean(edge_docs)
    assert out.schema.simpleString() == edge_docs.schema.simpleString() and out.count() > 0
    assert Q.clean(no_docs).count() == 0


def test_no_python_in_the_plan(edge_docs):
    plan = Q.score(edge_docs.where("doc_id > 0"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Exchange hash" not in plan
