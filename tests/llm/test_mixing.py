import random

from pyspark.sql import functions as F

from delayspark.llm import mixing as M
from delayspark.llm.common import written


def water_fill(sizes, weights, share, cap):
    """Targets by rounds of clamping."""
    budget, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        left = budget - sum(cap * sizes[s] for s in capped)
        total = sum(weights[s] for s in free)
        if not free or not total:
            return {s: cap * sizes[s] if s in capped else 0.0 for s in sizes}
        target = {s: left * weights[s] / total for s in free}
        above = {s for s in free if target[s] > cap * sizes[s]}
        if not above:
            return target | {s: cap * sizes[s] for s in capped}
        capped |= above


def corpus(spark, n=3000, seed=1):
    rnd = random.Random(seed)
    rows = [(i, "w " * rnd.choice([1, 5, 20, 200]), None if i % 17 == 0 else f"s{min(rnd.randrange(12), rnd.randrange(12)):02d}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_are_capped_shares_and_are_met(spark):
    plan = written(M.plan_mix(corpus(spark), [5, 2, 1]), "test-plan")
    per = {r["source"]: r for r in plan.groupBy("source").agg(
        F.sum("size").alias("size"), F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    order = sorted((s for s in per if s is not None)) + [None]
    want = water_fill({s: per[s]["size"] for s in order}, {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}, 1.5, 2)
    for s in order:
        assert abs(per[s]["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(per[s]["taken"] - want[s]) <= max(200, 0.01 * per[s]["size"])
    assert abs(sum(want.values()) - 1.5 * sum(r["size"] for r in per.values())) < 1e-3
    assert plan.where("taken > 2 * size").count() == 0


def test_reruns_agree_whatever_the_partitions(spark):
    a, b = (sorted(map(tuple, M.plan_mix(corpus(spark).repartition(k), [5, 2, 1]).collect()), key=str) for k in (2, 7))
    assert a == b


def test_sample_repeats_rows_as_planned(spark):
    docs = corpus(spark, 500)
    want = {r["doc_id"]: r["copies"] for r in M.plan_mix(docs, [5, 2, 1]).collect()}
    got = {r["doc_id"]: r["n"] for r in M.sample(docs, [5, 2, 1]).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert {k: v for k, v in want.items() if v} == got


def test_given_weights_and_a_budget_that_cannot_be_met(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x"), (2, "a b", "y"), (3, "a", "z")], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("x", 1.0), ("y", 3.0)], "source string, weight double")
    got = {r["source"]: r["target"] for r in M.plan_mix(docs, [], share=5.0, max_epochs=2.0, weights=weights).collect()}
    assert got == {"x": 8.0, "y": 4.0, "z": 2.0}


def test_edges(edge_docs, no_docs):
    plan = M.plan_mix(edge_docs, [5, 2, 1])
    assert plan.count() == edge_docs.count() and plan.where("size = 0 and taken <> 0").count() == 0
    assert M.sample(edge_docs, [5, 2, 1]).schema.simpleString() == edge_docs.schema.simpleString()
    assert M.plan_mix(no_docs, [5, 2, 1]).count() == 0 and M.sample(no_docs, [5, 2, 1]).count() == 0
