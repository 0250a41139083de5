import random

import pyarrow as pa
import pytest

from delayspark.llm import decontamination as D
from tests.llm.conftest import SF


def distance(item, text):
    """Smallest edit distance between the item's words and any stretch of the text's."""
    prev = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        cur = [i + 1]
        for j, y in enumerate(text):
            cur.append(min(prev[j] + (x != y), prev[j + 1] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def edited(rnd, words, edits, vocabulary):
    out = list(words)
    for _ in range(edits):
        p, what = rnd.randrange(len(out)), rnd.randrange(3)
        if what == 0:
            out[p] = rnd.choice(vocabulary)
        elif what == 1:
            out.insert(p, rnd.choice(vocabulary))
        else:
            del out[p]
    return out


@pytest.fixture(scope="module")
def bench(spark):
    return [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


@pytest.fixture(scope="module")
def vocabulary(spark):
    return [w for r in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect() for w in r["text"].lower().split()]


def test_recall_and_distance_of_edited_copies(bench, vocabulary):
    rnd, items = random.Random(2), D.Items(*map(list, zip(*bench, strict=True)))
    found = total = 0
    for _ in range(12):
        for key, text in bench:
            w = text.split()
            copy = edited(rnd, w, int(0.2 * len(w) + 1e-9), vocabulary)
            around = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(50))] for _ in range(2)]
            doc = around[0] + copy + around[1]
            got = {items.ids[m[1]]: m for m in D.search(items, pa.array([" ".join(doc)]))}
            total += 1
            if key in got:
                found += 1
                assert got[key][2] == distance([x.lower() for x in w], [x.lower() for x in doc])
    assert found / total >= D.TARGET_RECALL


@pytest.mark.parametrize("size", [*range(5, 31), 39, 59])
def test_recall_of_each_item_length(size, vocabulary):
    rnd, many = random.Random(size), 150
    words = [[rnd.choice(vocabulary) for _ in range(size)] for _ in range(many)]
    items = D.Items(list(range(many)), [" ".join(w) for w in words])
    docs = [" ".join([rnd.choice(vocabulary) for _ in range(rnd.randrange(30))] + edited(rnd, w, size // 5, vocabulary)
                     + [rnd.choice(vocabulary) for _ in range(rnd.randrange(30))]) for w in words]
    got = {m[:2]: m[2] for m in D.search(items, pa.array(docs))}
    found = [i for i in range(many) if (i, i) in got]
    assert all(got[i, i] == distance(words[i], docs[i].split()) for i in found)
    assert len(found) / many >= (1 if size < 24 else D.TARGET_RECALL)


@pytest.mark.parametrize("size", [10, 15, 20, 30, 59])
@pytest.mark.parametrize("before", [[], ["", None, "", "", None, "", "", "", "", "", "", "", ""], ["a b"] * 5, ["x " * 40]])
def test_copies_without_their_first_words_whatever_stands_before(size, before):
    words = [f"w{i}" for i in range(size)]
    items, most = D.Items([1], [" ".join(words)]), size // 5
    for cut in range(1, most + 1):
        docs = [*before, " ".join(words[cut:]), "", "y z"]
        assert list(D.search(items, pa.array(docs))) == [(len(before), 0, cut, 0, size - cut)]


def test_exact_copies_are_always_found_and_others_never(bench, vocabulary):
    rnd = random.Random(3)
    texts = [t for _, t in bench] + ["alpha beta gamma", "one", "p q r s t u v", " ", None]
    items = D.Items(list(range(len(texts))), texts)
    assert len(items.ids) == len(bench) + 3
    for key, text in zip(items.ids, [t for t in texts if t and t.strip()], strict=True):
        doc = " ".join(rnd.choice(vocabulary) for _ in range(20)) + "\n" + text + " tail"
        hits = {items.ids[m[1]]: m for m in D.search(items, pa.array([None, doc, ""]))}
        assert hits[key][0] == 1 and hits[key][2] == 0 and hits[key][3:] == (20, len(text.split()))
    for _ in range(200):
        w = rnd.choice(bench)[1].lower().split()
        far = edited(rnd, w, int(0.6 * len(w)), vocabulary)
        for m in D.search(items, pa.array([" ".join(far)])):
            assert distance(items.words[m[1]].tolist(), D.word_names(*next(iter(D.text_chunks(pa.array([" ".join(far)]))))[2:])[0][:-1].tolist()) == m[2]


def test_documents_match_all_alignments(spark, bench):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in
           D.matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet"), block=15).collect()}
    want = {}
    for r in docs.collect():
        w = r["text"].lower().split()
        held = set(w)
        for key, text in bench:
            item = text.lower().split()
            most = int(0.2 * len(item) + 1e-9)
            if sum(x not in held for x in item) <= most and (d := distance(item, w)) <= most:
                want[r["doc_id"], key] = d
    assert got == want and want


def test_clean_leaves_the_other_documents(spark, edge_docs, no_docs, bench):
    item = " ".join(f"w{i}" for i in range(40))
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    dirty = spark.createDataFrame([(100, f"before {item} after", "en", "s", 1, 1, "k", 2, True, 3, 4, 5.0, 6, 7)], edge_docs.schema)
    out = D.clean(edge_docs.unionByName(dirty), benchmark)
    assert out.schema.simpleString() == edge_docs.schema.simpleString() and out.count() == edge_docs.count()
    assert D.matches(edge_docs.unionByName(dirty), benchmark).select("doc_id", "item_id", "distance").collect() == [(100, 1, 0)]
    assert D.clean(no_docs, benchmark).count() == 0 and D.matches(no_docs, benchmark).count() == 0
    assert D.clean(edge_docs, benchmark.limit(0)).count() == edge_docs.count() and D.matches(edge_docs, benchmark.limit(0)).count() == 0
