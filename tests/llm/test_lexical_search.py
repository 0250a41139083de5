"""Ranked lexical search against a plain scan of all documents."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from delayspark.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(docs, items, top=20):
    """Every item's best (item, rank, doc, score) by scoring all documents."""
    rows = [(d, Counter(t), len(t)) for d, t in ((d, terms(t)) for d, t in docs) if t]
    n_docs, total = len(rows), sum(r[2] for r in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        q = Counter(terms(text))
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in q}
        scored = []
        for d, c, n in rows:
            m = 100 - 25 + (25 * n * n_docs) // total
            s = sum(k * w[t] * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in q.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, parts=4, **kw):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, id int").repartition(parts)
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in S.search(d, q, **kw).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(rnd, n):
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünï", "日本語", "x1y2"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(rnd.randrange(10**12), " ".join(rnd.choices(vocabulary, weights, k=rnd.choice([0, 1, 5, 40, 200])))) for _ in range(n)]
    items = [(i, " ".join(rnd.choices(vocabulary, weights, k=rnd.choice([1, 3, 30])))) for i in range(25)]
    for item, text in items[:8]:  # passages, whole and cut, in long and short documents
        docs += [(rnd.randrange(10**12), text), (rnd.randrange(10**12), docs[item][1] + " " + text[:40])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_best_documents_equal_a_full_scan(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "SEED", 40)
    docs, items = corpus(random.Random(seed), 700)
    assert found(spark, docs, items) == plain(docs, items)


def test_blocks_of_items_give_the_same(spark):
    docs, items = corpus(random.Random(3), 120)
    assert found(spark, docs, items, max_items=9, max_terms=60) == plain(docs, items)


def test_ties_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "SEED", 10)
    docs = [(i, "alpha beta gamma") for i in range(200, 0, -1)] + [(7, "alpha beta gamma")] * 5 + [(None, "alpha beta gamma")] * 3
    docs += [(1000 + i, "delta") for i in range(400)] + [(2000, "alpha delta")]
    items = [(1, "alpha beta"), (2, "delta"), (3, "beta beta ALPHA")]
    assert found(spark, docs, items) == plain(docs, items)


def test_nulls_empty_and_odd_texts(spark, edge_docs, no_docs):
    q = spark.createDataFrame([(1, "one two words token"), (2, None), (3, ""), (4, "!! ??"), (None, "Two"), (6, "nowhere")], "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    want = plain(docs, [(r["item_id"], r["text"]) for r in q.collect()])
    assert sorted((tuple(r) for r in S.search(edge_docs, q).collect()), key=str) == want
    assert S.search(no_docs, q).collect() == [] and S.search(edge_docs, q.limit(0)).collect() == []


def test_terms_of_long_texts_are_cut_between_terms(monkeypatch):
    text = " ".join(f"Word{i}é" for i in range(1000)).encode()
    whole = [t for part in S.terms_of(text) for t in part]
    monkeypatch.setattr(S, "SLICE", 50)
    assert [t for part in S.terms_of(text) for t in part] == whole and len(whole) == 1000


def test_bounds_drop_buckets_and_documents_but_no_result():
    """The search prunes: it scores far fewer documents than there are, with the same best."""
    rnd = np.random.default_rng(5)
    block = S.Block([1], {b"%d" % i: i for i in range(6)}, np.array([0, 6]), np.arange(6, dtype=np.int32), np.ones(6, np.int64))
    weights = np.array([4000, 3000, 2000, 900, 50, 9], np.int64)
    n = 4000
    tfs = rnd.integers(0, 3, (n, 6)) * (rnd.random((n, 6)) < [0.02, 0.05, 0.2, 0.4, 0.9, 0.9])
    tfs[rnd.integers(0, n, 25)] = 2
    m = rnd.integers(75, 400, n)
    value = weights * S.impacts(np.maximum(tfs, 1), m[:, None]) * (tfs > 0)
    norm = np.sqrt((S.impacts(np.maximum(tfs, 1), m[:, None]).astype(float) ** 2 * weights * (tfs > 0)).sum(axis=1))
    order = np.argsort(-norm)
    order = order[norm[order] > 0]
    one = S.Searcher(block, weights, np.ones(1, np.int64), 20)
    scored, buckets, bounded = 0, 0, one._bounded

    def counting(*a):
        nonlocal scored, buckets
        kept = bounded(*a)
        scored, buckets = scored + int(kept.sum()), buckets + 1
        return kept

    one._bounded = counting
    for a in range(0, len(order), 100):
        part = order[a:a + 100]
        row, term = np.nonzero(tfs[part])
        one.bucket([int(i) for i in part], m[part], norm[part], term, tfs[part][row, term], (tfs[part] > 0).sum(axis=1))
    want = sorted(((int(s), i) for i, s in enumerate(value.sum(axis=1)) if s > 0), key=S.better)[:20]
    assert one.best[0] == want
    assert scored < 0.3 * len(order) and buckets < len(order) / 100
