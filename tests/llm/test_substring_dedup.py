import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from delayspark.llm import substring_dedup as S
from tests.llm.conftest import SF


def brute(docs):
    cut = [(d, (t or "").encode().split()) for d, t in docs]
    seen = Counter(b" ".join(w[p:p + 35]) for _, w in cut for p in range(len(w) - 34))
    out = []
    for d, w in cut:
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - 34):
            if seen[b" ".join(w[p:p + 35])] > 1:
                gone[p:p + 35] = True
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


def odd_texts():
    """Runs, periods, shared passages of 33 to 90 words, small alphabets, repeated rows, nulls."""
    rnd = random.Random(5)
    docs = [(None, None), (1, ""), (2, " \n ")]
    base = [rnd.choice(["a", "b", "cc"]) for _ in range(400)]
    for _ in range(150):
        at = rnd.randrange(300)
        w = rnd.choice([
            ["x"] * rnd.randint(1, 200), (["p", "q"] * 100)[:rnd.randint(1, 200)], base[at:at + rnd.randint(30, 90)],
            [rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 120))],
            [rnd.choice("xyzuvw") for _ in range(rnd.randint(0, 20))] + base[at:at + rnd.randint(33, 60)] + ["x"] * rnd.randint(0, 60),
            ["x"] * rnd.randint(0, 3) + (["p", "p", "q"] * 100)[:rnd.randint(1, 100)] + ["y"]])
        docs.append((rnd.randrange(60), rnd.choice([" ", "\n", "  ", "\t\r"]).join(w)))
    return docs + docs[:20]


@pytest.mark.parametrize("flush", [400_000, 50])
def test_odd_texts_match_brute_force(spark, monkeypatch, flush):
    monkeypatch.setattr(S, "FLUSH", flush)
    docs = odd_texts()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, S.remove_repeats(df).collect())) == brute(docs)


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_groups_are_settled_before_the_last_batch(size):
    rnd = np.random.default_rng(1)
    near = np.sort(rnd.integers(-2**62, 2**62, 60)[rnd.integers(0, 60, 300)])
    whole = rnd.integers(0, 3, 300)
    order = np.lexsort((whole, near))
    rows = np.stack([near, whole[order], np.arange(300), S._pack(np.arange(300), 0, S.SINGLE, 0)], axis=1)
    got = []

    def batches():
        for lo in range(0, 300, size):
            if lo:  # all groups but the one that the rows so far end in
                assert len(got) == len(S.settle(rows[:lo][near[:lo] < near[lo - 1]]))
            yield S._batch(list(rows[lo:lo + size].T), ["near", "whole", "key", "packed"])

    for batch in S._settle_task(batches()):
        got += [tuple(r.values()) for r in batch.to_pylist()]
    assert Counter(got) == Counter(map(tuple, S.settle(rows).tolist())) and got


def test_documents_match_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([tuple(r) for r in df.select("doc_id", "text").collect()])
    assert Counter(map(tuple, S.remove_repeats(df).collect())) == want
    assert sum(k[2] * n for k, n in want.items()) > 0


def test_edges(edge_docs, no_docs):
    got = Counter(map(tuple, S.remove_repeats(edge_docs).collect()))
    assert got == brute([(r["doc_id"], r["text"]) for r in edge_docs.collect()])
    assert S.remove_repeats(no_docs).count() == 0


def test_interior_symbols_do_not_depend_on_what_is_around():
    rnd = random.Random(8)
    for _ in range(300):
        inner = [rnd.choice([1, 2, 3, 10**6 + rnd.randrange(30)]) for _ in range(35)]
        starts = []
        for _ in range(2):
            left = [rnd.choice([1, 2, 3]) for _ in range(rnd.randrange(6))]
            right = [rnd.choice([1, 2, 3]) for _ in range(rnd.randrange(6))]
            text = np.array(left + inner + right, np.uint64)
            names, at = S.recompress(text, np.zeros(len(text), int))
            inside = (at >= len(left) + S.LOSS) & (at <= len(left) + 35 - S.LOSS - S.SPAN)
            starts.append(list(zip(names[inside].tolist(), (at[inside] - len(left)).tolist(), strict=True)))
        assert starts[0] == starts[1] and starts[0]
