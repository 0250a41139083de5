import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from delayspark.llm import simhash as S
from delayspark.llm.graph import components


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def plain_simhash(text, shingle=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    grams = [" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values):
    """Smallest linked value of each value, by all pairs."""
    u = np.unique(np.array(values, np.int64)).view(np.uint64)
    p = list(range(len(u)))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1:] ^ u[i]) <= 3) + i + 1:
            a, b = root(i), root(int(j))
            p[max(a, b)] = min(a, b)
    return {int(u[i].view(np.int64)): root(i) for i in range(len(u))}


def ball(rnd, n):
    """A dense group around one fingerprint, lone ones, and pairs at 1 to 5 bits."""
    base, out = rnd.getrandbits(64), set()
    for _ in range(n):
        x = base
        for _ in range(rnd.randint(0, 6)):
            x ^= 1 << rnd.choice([1, 3, 5, 9, 14, 17, 20, 28, 33, 40, 41, 47, 50, 55, 59, 63])
        out |= {signed(x), signed(rnd.getrandbits(64))}
    for a in list(out)[:200]:
        x = a & (2**64 - 1)
        for _ in range(rnd.randint(1, 5)):
            x ^= 1 << rnd.randrange(64)
        out.add(signed(x))
    return sorted(out)


@pytest.mark.parametrize("limit, sample", [(2048, 64), (20, 64), (5, 1)])
def test_links_give_the_components_of_all_pairs(spark, monkeypatch, limit, sample):
    monkeypatch.setattr(S, "SAMPLE", sample)
    monkeypatch.setattr(S, "HOT_SHARE", 200)
    values = ball(random.Random(3), 700)
    links = S.links(spark.createDataFrame([(x,) for x in values], "fp long"), 3, limit)
    found = {r["node"]: r["root"] for r in components(links, "a", "b").collect()}
    truth = classes(values)

    def parts(of):
        groups = defaultdict(set)
        for x in values:
            groups[of(x)].add(x)
        return {frozenset(g) for g in groups.values()}
    assert parts(lambda x: found.get(x, x)) == parts(truth.__getitem__)
    if limit == 2048:  # a dense bucket leaves its task as a star
        assert links.count() < 40 * len(values)


def test_documents_match_brute_force(spark, edge_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    got = S.near_duplicates(edge_docs).collect()
    fp = [signed(plain_simhash(t)) for _, t in rows]
    cls = classes(fp)
    first = defaultdict(list)
    for (d, _), x in zip(rows, fp, strict=True):
        first[cls[x]].append(d)
    want = [(d, x, min((y for y in first[cls[x]] if y is not None), default=None)) for (d, _), x in zip(rows, fp, strict=True)]
    assert sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in got), key=str) == sorted(want, key=str)


def test_one_document_of_each_group_stays(edge_docs, no_docs):
    kept = S.one_per_group(edge_docs)
    assert kept.schema.simpleString() == edge_docs.schema.simpleString()
    found = S.near_duplicates(edge_docs).collect()
    groups = {r["first_key"] for r in found}
    assert kept.count() == len(groups)
    assert {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in found}
    assert S.near_duplicates(no_docs).count() == 0 and S.one_per_group(no_docs).count() == 0


def test_more_bits_than_the_blocks_cover_is_an_error(spark):
    with pytest.raises(ValueError):
        S.links(spark.createDataFrame([(1,)], "fp long"), 4)
