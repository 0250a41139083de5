"""The pipeline against a plain-Python version of its five stages on a small fixture."""
import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as C
from delayspark.llm import quality_rules as Q
from delayspark.llm import token_ids as K
from delayspark.llm.common import written
from tests.llm.conftest import words
from tests.llm.test_decontamination import distance
from tests.llm.test_mixing import water_fill
from tests.llm.test_simhash import classes, plain_simhash, signed


def fixture_rows():
    rnd, rows = random.Random(21), []
    item = " ".join(words(rnd, 30, 10**6))
    for i in range(80):
        text = "\n".join(" ".join(words(rnd, 12, 10**6)) + "." for _ in range(rnd.randint(2, 8)))
        if i % 9 == 1:
            text = rows[-1][1]                               # exact copy
        if i % 9 == 2:
            text = "Home | About | Shop\n" + text            # a line that goes
        if i % 11 == 3:
            text = text + "\n" + item + "."                  # a benchmark passage
        if i % 13 == 4:
            text = "a b | c d | e f | g h | i j | k l | m n"  # rejected
        if i % 17 == 5:
            text = None
        rows.append((i, text, "en", None if i % 10 == 0 else f"s{i % 4}", len(text or "")))
    return rows, item


def write(spark, path, rows, item):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3) \
        .write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_match_plain_python(spark, tmp_path):
    rows, item = fixture_rows()
    write(spark, tmp_path, rows, item)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at = {}
    for name, stage in C.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), "test-stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        at[name] = docs.collect()
    verdict = {r["doc_id"]: r["kept"] for r in Q.score(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    first = at["quality rules"]
    assert {r["doc_id"] for r in first} == {k for k, v in verdict.items() if v} and all("|" not in r["text"] for r in first)
    assert all(r["n_chars"] == len(r["text"]) for r in first)
    fp = {r["doc_id"]: signed(plain_simhash(r["text"])) for r in first}
    cls = classes(list(fp.values()))
    second = {}
    for r in sorted(first, key=lambda r: r["doc_id"]):
        second.setdefault(cls[fp[r["doc_id"]]], r)
    assert sorted(r["doc_id"] for r in at["SimHash near-dedup"]) == sorted(r["doc_id"] for r in second.values())
    third = [r for r in second.values() if distance(item.lower().split(), r["text"].lower().split()) > 6]
    assert len(third) < len(second)
    assert sorted(r["doc_id"] for r in at["benchmark decontamination"]) == sorted(r["doc_id"] for r in third)
    size = {r["doc_id"]: len(r["text"].split()) for r in third}
    per = {}
    for r in third:
        per.setdefault(r["source"], []).append(r)
    order = sorted(s for s in per if s is not None) + [None]
    target = water_fill({s: sum(size[r["doc_id"]] for r in per[s]) for s in order}, {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}, 1.5, 2)
    want = {}
    for s in order:
        total = sum(size[r["doc_id"]] for r in per[s])
        whole, upto, buckets = int(target[s] // total), 0, {}
        for r in per[s]:
            key = f"17:{r['doc_id']}:{r['text']}"
            buckets.setdefault(int(hashlib.md5(key.encode()).hexdigest()[:3], 16), []).append(r["doc_id"])
        for b in sorted(buckets):
            n = sum(size[d] for d in buckets[b])
            more = 2 * upto + n < 2 * (target[s] - whole * total)
            upto += n
            for d in buckets[b]:
                want[d] = whole + more
    got = {}
    for r in at["mixing sources to target weights"]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {d: n for d, n in want.items() if n}
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(K.default_vocabulary())
    start, files = 0, []
    for r in sorted(at["mixing sources to target weights"], key=lambda r: r["doc_id"]):
        ids = t.encode(r["text"], add_special_tokens=False).ids + [2]
        files.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, C.run(spark, str(tmp_path)).collect())) == files


def test_empty_and_edge_tables(spark, tmp_path, edge_docs, no_docs):
    _, item = fixture_rows()
    for name, docs in (("none", no_docs), ("edge", edge_docs)):
        docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = C.run(spark, f"{tmp_path}/{name}")
        assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and (out.count() > 0) == (name == "edge")
    assert out.agg(F.min("start")).first()[0] == 0
