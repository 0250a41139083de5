"""Merkle manifest against a plain recursive tree."""
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from delayspark.llm import merkle as M


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, i):
    out = []
    for row in levels[:-1]:
        run = row[i // 8 * 8:i // 8 * 8 + 8]
        out += run[:i % 8] + run[i % 8 + 1:]
        i //= 8
    return out


def postorder(n):
    """(level, index) of all nodes by a walk of the tree."""
    width = M.widths(n)
    out = []

    def walk(level, i):
        if level:
            for c in range(8 * i, min(8 * i + 8, width[level - 1])):
                walk(level - 1, c)
        out.append((level, i))

    walk(len(width) - 1, 0)
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 512, 513, 585, 4097])
def test_positions_are_those_of_a_walk(n):
    for at, (level, i) in enumerate(postorder(n)):
        assert M.position(level, np.array([i]), n)[0] == at


@pytest.mark.parametrize("n", [1, 5, 8, 9, 64, 65, 511, 512])
def test_builders_write_in_postorder(n):
    leaves = [sha(str(i)) for i in range(n)]
    made = list(M.completed(leaves, 0, 0, n))
    assert [x[:2] for x in made] == postorder(n)
    assert [x[2] for x in made][-1] == levels_of(leaves)[-1][0]


def leaf(*fields):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def expected(rows):
    """rows: (id, group, text, tampered or not) -> sorted result tuples."""
    trees = defaultdict(list)
    for key, group, text, bad in rows:
        trees[group].append((key is not None, key or 0, leaf(key, group, text), key,
                             leaf(key, group, None if text is None else text.translate(str.maketrans(M._UPPER, M._UPPER.lower()))) if bad else None))
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    built = {}
    for g in order:
        trees[g].sort(key=lambda x: x[:3])
        built[g] = levels_of([x[2] for x in trees[g]])
    top = levels_of([built[g][-1][0] for g in order])
    root, out = top[-1][0], []
    for at, g in enumerate(order):
        above = siblings(top, at)
        for i, (_, _, was, key, now) in enumerate(trees[g]):
            beside = siblings(built[g], i) + above
            out.append((key, was, built[g][-1][0], root, sha("".join(beside)), now is None or now == was))
    return sorted(out, key=str)


def result(spark, rows):
    df = spark.createDataFrame(rows, "key long, grp string, text string, bad boolean").repartition(5)
    digest = M.leaf_digest(F.col("key"), F.col("grp"), F.col("text"))
    changed = F.when(F.col("bad"), M.leaf_digest(F.col("key"), F.col("grp"), M.lower_az(F.col("text"))))
    got = M.manifest(df.select(M.tree_key(F.col("grp")).alias("tree"), F.col("key").alias("id"), digest.alias("digest"),
                               changed.alias("tampered"))).collect()
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)
    return sorted(((r["id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"]) for r in got), key=str)


def test_manifest_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for group, n in (("en", 700), ("é", 65), ("z", 8), (None, 9), ("", 1), ("de", 64)):
        rows += [(rnd.randrange(10**12), group, rnd.choice(["Text Á", "abc", "", None, "X" * 40]) , rnd.random() < 0.3) for _ in range(n)]
    rows += rows[:3] * 30 + [(None, "en", "a", False), (None, "en", "B", True), (2**60 + 1, "en", "b", False)]
    assert result(spark, rows) == expected(rows)


def test_many_groups(spark):
    rows = [(i, f"g{i % 75:03d}", "T", i % 7 == 0) for i in range(200)]
    assert result(spark, rows) == expected(rows)


def test_one_row_and_no_row(spark):
    assert result(spark, [(3, None, "A", True)]) == expected([(3, None, "A", True)])
    none = spark.createDataFrame([], "tree string, id long, digest binary, tampered binary")
    assert M.manifest(none).collect() == []


def test_edge_documents(spark, edge_docs):
    leaf_of = M.leaf_digest(F.col("doc_id"), F.col("text"))
    got = M.manifest(edge_docs.select(M.tree_key(F.col("lang")).alias("tree"), F.col("doc_id").alias("id"), leaf_of.alias("digest"),
                                      F.lit(None).cast("binary").alias("tampered"))).collect()
    assert len(got) == edge_docs.count() and all(r["verified"] for r in got)


def test_the_log_holds_every_node_once_at_its_place(spark):
    rows = [("=a", i) for i in range(600)] + [("=b", i) for i in range(3)]
    df = spark.createDataFrame(rows, "tree string, id long").withColumn("digest", M.leaf_digest(F.col("id")))
    log, widest = M.append_log(M.numbered(df.withColumn("tampered", F.lit(None).cast("binary"))))
    assert widest == 600 and len(log) == 2
    nodes = [r for part in log for r in part.where("tree = '=a'").collect()]
    assert sorted(r["pos"] for r in nodes) == list(range(sum(M.widths(600))))
    assert {(r["level"], r["idx"]): r["pos"] for r in nodes} == {x: k for k, x in enumerate(postorder(600))}
