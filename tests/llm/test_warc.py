import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from delayspark.llm import warc as W
from delayspark.llm.common import scratch_path

X = "x" * 120
TRAP = "é" * 60 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
ROWS = [(5, "http://a", X), (3, "http://b\r\nEvil: 1", X), (3, "http://b2", X), (None, None, X), (7, None, None), (8, "u", "short"),
        (9, "u", "short"), (9, "u", "short"), (10, "u", TRAP), (11, "v", "y" * 99), (12, "v", "y" * 99), (13, "w", "y" * 100),
        (14, "w", "y" * 100), (None, "q", "z" * 200), (None, "q2", "z" * 200)]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_round_trip_and_revisits(spark, monkeypatch, broadcast):
    monkeypatch.setattr(W, "MAX_BROADCAST_REPEATED", broadcast)
    df = spark.createDataFrame(ROWS, "id long, uri string, payload string").repartition(3)
    path = scratch_path(spark, "warc-test")
    W.write_archive(W.resolve_revisits(df), path, records_per_file=2)
    got = W.resolved(W.read_archive(spark, path)).collect()
    by = {}
    for r in got:
        by.setdefault(r["source_id"], []).append(r)
    assert len(got) == len(ROWS)
    for key, _, text in ROWS:
        data = (text or "").encode()
        for r in by[None if key is None else str(key)]:
            if r["payload_bytes"] == len(data):
                assert r["digest"] == hashlib.sha256(data).hexdigest()
    kinds = {k: sorted((r["record_type"], r["refers_to"]) for r in v if r["payload_bytes"] == 120) for k, v in by.items()}
    assert kinds["5"] == [("revisit", "3")] and kinds["3"] == [("response", None), ("revisit", "3")] and kinds[None] == [("revisit", "3")]
    assert [r["record_type"] for k in ("8", "9", "11", "12", "13", "7") for r in by[k]] == ["response"] * 7
    assert [(r["record_type"], r["refers_to"]) for r in by["14"]] == [("revisit", "13")]
    assert sorted(r["record_type"] for r in by[None] if r["payload_bytes"] == 200) == ["response", "revisit"]
    payloads = {r["source_id"]: bytes(r["payload"]) for r in W.read_archive(spark, path, payload=True).collect() if r["payload"] is not None}
    assert payloads["10"] == TRAP.encode()
    assert [r["uri"] for r in by["3"] if r["record_type"] == "response"] == ["http://b%0D%0AEvil: 1"]


def test_a_changed_payload_and_a_cut_archive_are_errors():
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (h, block), = W.parse_records(head.encode())
    with pytest.raises(ValueError):
        W._rows(h, block, False)
    with pytest.raises(ValueError):
        list(W.parse_records(head.encode()[:-6]))


def test_empty_tables_and_extra_columns(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        pages = docs.select("*", F.col("doc_id").alias("id"), F.col("source").alias("uri"), F.col("text").alias("payload"))
        path = scratch_path(spark, "warc-edge")
        W.write_archive(W.resolve_revisits(pages), path)
        assert W.read_archive(spark, path).count() == docs.count()


def test_files_are_gzip_with_few_records(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", str(i)) for i in range(10)], "id long, uri string, payload string").coalesce(1)
    W.write_archive(W.resolve_revisits(df), str(tmp_path / "a"), records_per_file=4)
    files = sorted((tmp_path / "a").glob("part-*.gz"))
    assert [len(list(W.parse_records(gzip.decompress(f.read_bytes())))) for f in files] == [4, 4, 2]
