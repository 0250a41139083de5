"""Ranked lexical search by norm buckets: the best documents of every query item, exactly.

A document is a sparse vector of impacts, an item one of term counts, and a score their inner product.  Vectors
are ordered by length and searched in buckets of ``BUCKET`` consecutive ones:

* an item skips a bucket when the Cauchy-Schwarz product of its length and that of the longest vector is below its threshold;
* inside a bucket, the item's ``FOCUS`` largest coordinates bound each document: a normalised coordinate outside the
  interval that the threshold leaves, or a partial product plus the Cauchy-Schwarz product of what remains below the
  threshold, discards it;
* survivors are scored in 64-bit integers.

The square root of a term's weight goes to either side, which only the bounds (in doubles, with a margin) see.  An item's
threshold starts as its ``top``-th best score among the ``SEED`` longest vectors and grows in each task with what
that task has found.  A task returns at most ``top`` rows of an item.

Items are taken in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_TERMS`` different terms (one item at
least).  One block's items, its terms' weights and thresholds are what the driver and each task hold; every block
is one pass over the documents.  Vectors hold the terms of the block only, and no text is shuffled.

Defined results: a null or term-free text is no candidate and not counted; a null or term-free item has no row; every
row is a document or an item of its own, so repeated rows are ranked one after another; equal scores go by
ascending id, null last; empty tables give no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_path, scratch_path, written

TOP = 20
BUCKET = 4096          # vectors
FOCUS = 4              # coordinates that bound a document
SEED = 2048            # longest vectors that the first thresholds come from
BLOCK_ITEMS = 20_000
BLOCK_TERMS = 1_000_000
SLICE = 4_000_000      # bytes of a text that are split at a time
MARGIN = 1e-9          # relative error allowed for in the bounds

# bytes of a term: digits, letters (A-Z as a-z) and everything outside ASCII; all others separate
_FOLD = bytearray(b" " * 128 + bytes(range(128, 256)))
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _FOLD[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _FOLD[_c] = _c + 32
_FOLD = bytes(_FOLD)


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    folded = text.translate(_FOLD)
    at = 0
    while at < len(folded):
        end = at + SLICE
        if end < len(folded):
            cut = folded.rfind(b" ", at, end)
            if cut < 0:
                cut = folded.find(b" ", end)
            end = cut + 1 if cut >= 0 else len(folded)
        yield folded[at:end].split()
        at = end


# --- items --------------------------------------------------------------------------------------
@dataclass
class Block:
    """Some items: their ids, and their terms as numbers of ``vocabulary`` with counts, row after row."""

    keys: list
    vocabulary: dict[bytes, int]
    starts: np.ndarray
    terms: np.ndarray
    counts: np.ndarray


def blocks(items: DataFrame, key: str, text: str, max_items: int = BLOCK_ITEMS, max_terms: int = BLOCK_TERMS) -> Iterator[Block]:
    """The items in blocks, in the order of their partitions."""
    keys, vocabulary, starts, terms, counts = [], {}, [0], [], []
    for row in items.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).where("t is not null").toLocalIterator():
        had: dict[bytes, int] = {}
        for part in terms_of(bytes(row["t"])):
            for term in part:
                had[term] = had.get(term, 0) + 1
        if not had:
            continue
        new = sum(t not in vocabulary for t in had)
        if keys and (len(keys) >= max_items or len(vocabulary) + new > max_terms):
            yield Block(keys, vocabulary, np.array(starts), np.array(terms, np.int32), np.array(counts, np.int64))
            keys, vocabulary, starts, terms, counts = [], {}, [0], [], []
        keys.append(row["k"])
        for term, n in had.items():
            terms.append(vocabulary.setdefault(term, len(vocabulary)))
            counts.append(n)
        starts.append(len(terms))
    if keys:
        yield Block(keys, vocabulary, np.array(starts), np.array(terms, np.int32), np.array(counts, np.int64))


# --- vectors --------------------------------------------------------------------------------------
def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs) of every document with a term: all its terms' number, and those of ``vocabulary``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for batch in batches:
            at, n, lens, terms, tfs = [], [], [0], [], []
            for row, text in enumerate(batch.column("t")):
                size, places = 0, []
                for part in terms_of(text.as_buffer().to_pybytes()) if text.is_valid else ():
                    size += len(part)
                    found = [p for p in map(known, part) if p is not None]
                    if found:
                        places.append(np.unique(np.array(found, np.int32), return_counts=True))
                if not size:
                    continue
                if len(places) > 1:
                    both = np.concatenate([p[0] for p in places])
                    which, back = np.unique(both, return_inverse=True)
                    tf = np.zeros(len(which), np.int64)
                    np.add.at(tf, back, np.concatenate([p[1] for p in places]))
                    places = [(which, tf)]
                at.append(row)
                n.append(size)
                if places:
                    terms.append(places[0][0])
                    tfs.append(places[0][1])
                lens.append(lens[-1] + (len(places[0][0]) if places else 0))
            if at:
                offsets = pa.array(lens, pa.int32())
                flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (terms, tfs)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at)), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(flat[0].astype(np.int32))),
                     pa.ListArray.from_arrays(offsets, pa.array(flat[1].astype(np.int64)))], ["id", "n", "terms", "tfs"])

    schema = T.StructType([docs.schema["id"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())),
                           T.StructField("tfs", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(run, schema)


def lists_of(col: pa.ListArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of an array column."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False), col.value_lengths().to_numpy(zero_copy_only=False)


def measures(n: list[int], docs: int, total: int) -> np.ndarray:
    """Length measure ``m`` of documents of ``n`` terms; whole numbers of any size."""
    return np.array([100 - 25 + 25 * int(x) * docs // total for x in n], np.int64)


def impacts(tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tfs // (1000 * tfs + 12 * m)


def vectors(found: DataFrame, weights: np.ndarray, docs: int, total: int) -> DataFrame:
    """(id, m, norm, terms, tfs): the documents that hold a term of weight, with the length of their impact vector."""
    root = np.sqrt(weights.astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, lens = lists_of(batch.column("terms"), np.int64)
            tfs, _ = lists_of(batch.column("tfs"), np.int64)
            m = measures(batch.column("n").to_pylist(), docs, total)
            rows = np.repeat(np.arange(batch.num_rows), lens)
            value = root[terms] * impacts(tfs, m[rows])
            norm = np.sqrt(np.bincount(rows, value * value, batch.num_rows))
            made = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(m), pa.array(norm), batch.column("terms"),
                                               batch.column("tfs")], ["id", "m", "norm", "terms", "tfs"])
            yield made.filter(pa.array(norm > 0))

    schema = T.StructType([found.schema["id"], T.StructField("m", T.LongType()), T.StructField("norm", T.DoubleType()),
                           found.schema["terms"], found.schema["tfs"]])
    return found.mapInArrow(run, schema)


# --- search ---------------------------------------------------------------------------------------
def better(a: tuple[int, object]) -> tuple:
    """Sort key of (score, id): highest score first, then ascending id, null last."""
    return -a[0], a[1] is None, 0 if a[1] is None else a[1]


class Searcher:
    """The items of a block against buckets of vectors."""

    def __init__(self, block: Block, weights: np.ndarray, least: np.ndarray, top: int):
        self.block, self.weights, self.top = block, weights, top
        self.root = np.sqrt(weights.astype(float))
        self.least = least.copy()  # a document below this score of an item cannot be among its best
        self.best: list[list[tuple[int, object]]] = [[] for _ in block.keys]
        value = block.counts * self.root[block.terms]
        item = np.repeat(np.arange(len(block.keys)), np.diff(block.starts))
        self.value, self.norm = value, np.sqrt(np.bincount(item, value * value, len(block.keys)))
        self.focus = []
        for a, b in zip(block.starts[:-1], block.starts[1:]):
            self.focus.append(a + np.argsort(-value[a:b], kind="stable")[:FOCUS])

    def bucket(self, ids: list, m: np.ndarray, norm: np.ndarray, terms: np.ndarray, tfs: np.ndarray, lens: np.ndarray) -> None:
        longest = norm.max()
        alive = np.flatnonzero((self.norm * longest * (1 + MARGIN) >= self.least) & (self.norm > 0))
        if not len(alive):
            return
        rows = np.repeat(np.arange(len(ids)), lens)
        order = np.argsort(terms, kind="stable")
        rows, terms = rows[order], terms[order]
        impact = impacts(tfs[order], m[rows])
        score = self.weights[terms] * impact
        coordinate = self.root[terms] * impact
        known, first = np.unique(terms, return_index=True)
        ends = np.append(first[1:], len(terms))
        at = np.searchsorted(known, self.block.terms)
        at[at == len(known)] = 0
        here = known[at] == self.block.terms
        for q in alive:
            kept = self._bounded(q, longest, norm, rows, coordinate, at, here, first, ends)
            if not kept.any():
                continue
            total = np.zeros(len(ids), np.int64)
            for k in range(self.block.starts[q], self.block.starts[q + 1]):
                if here[k]:
                    part = slice(first[at[k]], ends[at[k]])
                    total[rows[part]] += self.block.counts[k] * score[part]
            hits = np.flatnonzero(kept & (total >= self.least[q]))
            if len(hits):
                found = sorted(self.best[q] + [(int(total[i]), ids[i]) for i in hits], key=better)[:self.top]
                self.best[q] = found
                if len(found) == self.top:
                    self.least[q] = max(self.least[q], found[-1][0])

    def _bounded(self, q, longest, norm, rows, coordinate, at, here, first, ends) -> np.ndarray:
        """Which vectors of the bucket the item's largest coordinates leave."""
        kept = np.ones(len(norm), bool)
        own, least = self.norm[q], float(self.least[q]) * (1 - MARGIN)
        cosine = min(1.0, least / (own * longest))  # no document of the bucket needs less
        partial, rest = np.zeros(len(norm)), norm * norm
        left = own * own
        for k in self.focus[q]:
            mine = np.zeros(len(norm))
            if here[k]:
                part = slice(first[at[k]], ends[at[k]])
                mine[rows[part]] = coordinate[part]
            share = self.value[k] / own
            spread = math.sqrt(max(0.0, 1 - cosine * cosine) * max(0.0, 1 - share * share)) + MARGIN
            place = mine / norm
            kept &= (place >= share * cosine - spread) & (place <= self._upper(share, cosine, spread))
            partial += self.value[k] * mine
            rest -= mine * mine
            left -= self.value[k] ** 2
        bound = partial + np.sqrt(np.maximum(rest, 0) + MARGIN * norm * norm) * math.sqrt(max(left, 0.0) + MARGIN * own * own)
        return kept & (bound >= least)

    @staticmethod
    def _upper(share: float, cosine: float, spread: float) -> float:
        """Largest coordinate of a unit vector with at least this cosine; 1 where the item's own coordinate is reached."""
        return 1.0 + MARGIN if share >= cosine else share * cosine + spread


def found_in(vecs: DataFrame, block: Block, weights: np.ndarray, least: np.ndarray, top: int) -> DataFrame:
    """(q, id, score): the best of every task, at most ``top`` of an item."""
    shared = vecs.sparkSession.sparkContext.broadcast((block, weights, least))
    id_field = vecs.schema["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Searcher(*shared.value, top)
        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            for a in range(0, batch.num_rows, BUCKET):
                part = batch.slice(a, BUCKET)
                terms, lens = lists_of(part.column("terms"), np.int64)
                tfs, _ = lists_of(part.column("tfs"), np.int64)
                one.bucket(part.column("id").to_pylist(), part.column("m").to_numpy(), part.column("norm").to_numpy(), terms, tfs, lens)
        rows = [(q, key, score) for q, best in enumerate(one.best) for score, key in best]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind),
                                              pa.array([r[2] for r in rows], pa.int64())], ["q", "id", "score"])

    return vecs.select("id", "m", "norm", "terms", "tfs").mapInArrow(
        run, T.StructType([T.StructField("q", T.LongType()), id_field, T.StructField("score", T.LongType())]))


def ranked_best(found: DataFrame, top: int) -> DataFrame:
    """``found`` with ``rank``, the first ``top`` of every item."""
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_block(docs: DataFrame, block: Block, top: int) -> DataFrame:
    """(q, rank, id, score) of one block, as a written table."""
    spark = docs.sparkSession
    paths = [scratch_path(spark, "impacts"), scratch_path(spark, "vectors")]
    made = counted(docs, block.vocabulary)
    made.write.option("compression", "zstd").parquet(paths[0])
    made = spark.read.schema(made.schema).parquet(paths[0])
    n_docs, total = made.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(block.vocabulary), np.int64)
    for r in made.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[r["term"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    vecs = vectors(made, weights, n_docs, total or 1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal lengths (copies) are dealt to several partitions
    (vecs.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(parts, F.col("norm").desc(), "__row")
         .sortWithinPartitions(F.col("norm").desc(), "__row").drop("__row")
         .write.option("compression", "zstd").parquet(paths[1]))
    vecs = spark.read.schema(vecs.schema).parquet(paths[1])
    least = np.ones(len(block.keys), np.int64)  # a score of 0 is no match
    if n_docs > SEED:
        longest = vecs.agg(F.percentile_approx("norm", F.lit(1 - SEED / n_docs), F.lit(100_000))).first()[0]
        seeds = ranked_best(found_in(vecs.where(F.col("norm") >= F.lit(longest or 0.0)), block, weights, least, top), top)
        for r in seeds.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") == top).toLocalIterator():
            least[r["q"]] = r["s"]
    out = written(ranked_best(found_in(vecs, block, weights, least, top), top).select("q", "rank", "id", "score"), "ranked-best")
    for p in paths:
        drop_path(spark, p)
    return out


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", max_items: int = BLOCK_ITEMS, max_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item, best first."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField(item_id, items.schema[item_id].dataType), T.StructField("rank", T.IntegerType()),
                           T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("score", T.LongType())])
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("t"))
    out = spark.createDataFrame([], schema)
    for block in blocks(items, item_id, item_text, max_items, max_terms):
        best = _search_block(docs, block, top)
        keys = spark.createDataFrame([(q, k) for q, k in enumerate(block.keys)],
                                     T.StructType([T.StructField("q", T.LongType()), T.StructField("__item", schema[0].dataType)]))
        out = out.unionByName(best.join(F.broadcast(keys), "q").select(  # at most BLOCK_ITEMS rows
            F.col("__item").alias(item_id), "rank", F.col("id").alias(doc_id), "score"))
    return out
