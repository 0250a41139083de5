import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from delayspark.llm import token_ids as K
from delayspark.llm.common import scratch_path

VOCABULARY = K.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(VOCABULARY)


def expected(rows, library):
    at, out = 0, []
    made = [(d, library.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows]
    for d, ids in sorted(made, key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]), zlib.crc32(np.array(x[1], "<u2").tobytes()))):
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def test_pieces_give_the_librarys_ids(library):
    rnd, p = random.Random(1), K.PieceTokenizer(VOCABULARY)
    parts = list("abs  \n\n\t\u00a0\u3000\x1c.,'é×÷1<|\u2009\u2019\x85ا") + [" a", "b.", "\nA", "'s", "<|endoftext|>", "  "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(20_000)]
    for t, ids in zip(texts, p.encode_all(pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_coding_round_trip():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        r = (rnd.integers(0, 2**32, n) >> rnd.integers(0, 32, n).astype(np.int64)).astype(np.uint32)
        control, data = K.encode_ranks(r)
        assert len(control) == -(-n // 4) and (K.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == r).all()


def test_files_hold_every_text(spark, monkeypatch, edge_docs, library):
    monkeypatch.setattr(K, "BLOCK_IDS", 50)
    path = scratch_path(spark, "tokens-test")
    K.write_corpus(edge_docs, path, VOCABULARY)
    got = sorted((tuple(r) for r in K.read_corpus(spark, path).collect()), key=str)
    assert got == expected([(r["doc_id"], r["text"]) for r in edge_docs.collect()], library)


def test_empty_table(spark, no_docs):
    path = scratch_path(spark, "tokens-empty")
    K.write_corpus(no_docs, path, VOCABULARY)
    assert K.read_corpus(spark, path).count() == 0


def test_frequent_ids_take_one_byte():
    counts = np.zeros(1000, np.int64)
    counts[[7, 900, 3]] = [5, 50, 5]
    assert K.rank_order(counts)[:3].tolist() == [900, 3, 7]
