"""SimHash near-duplicates with pivot distance tables.

1. Every text gets a 64-bit SimHash of its word shingles (one pass, narrow result, written once).
2. Equal fingerprints become one row (map-side aggregation), with the table of its Hamming distances
   to ``PIVOTS`` reference fingerprints, packed into one 64-bit number.
3. Two fingerprints that differ in at most ``MAX_BITS`` bits agree on three of six bit blocks, so each
   fingerprint is dealt to 20 buckets (choices of three blocks).  Inside a bucket rows are sorted by
   the first pivot distance; a pair is looked at only while the first distances differ by at most
   ``MAX_BITS``, discarded when any other coordinate differs by more (triangle inequality: no link
   is lost), and verified by counting differing bits.
4. A bucket leaves its task as stars (each fingerprint with the smallest it is linked to), never as
   all its pairs.  Buckets over ``BUCKET_ROWS`` are dealt again by choices of three of eight parts of
   their 32 free bits: such a bucket has at most 12 free bits, so 4,096 fingerprints, whatever the
   data.  The largest buckets are found from a sample of the fingerprints and dealt again before the
   first shuffle; the sample only moves work, never changes links.
5. Stars are joined to components; the component's id is its smallest document id.

Defined results: null and blank texts have fingerprint 0, linked like any other; fewer words than a
shingle use the whole sequence; a component of null ids has a null id; repeated rows repeat their
result; an empty table gives no row; extra columns are ignored by :func:`near_duplicates` and passed
through by :func:`one_per_group`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written
from .graph import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BUCKET_ROWS = 2048
HOT_SHARE = 5000          # a bucket with over 1/HOT_SHARE of all dealt rows is dealt again at once
SAMPLE = 64               # one in so many fingerprints is counted to find those buckets
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]  # (lowest bit, bits)
PARTS = 8                 # of the free bits of a large bucket
PIVOTS = np.random.default_rng(64).integers(0, 2**64, 8, dtype=np.uint64)  # reference fingerprints


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _tables() -> list[tuple[int, list[int]]]:
    """(bits that a bucket's members share, their free bits) of each choice of three blocks."""
    out = []
    for kept in combinations(range(len(BLOCKS)), 3):
        shared = [b for k in kept for b in range(BLOCKS[k][0], sum(BLOCKS[k]))]
        out.append((_mask(shared), [b for b in range(64) if b not in set(shared)]))
    return out


def _subtables(free: list[int]) -> list[int]:
    """Masks that leave three of ``PARTS`` parts of the free bits open."""
    parts = [list(p) for p in np.array_split(np.array(free), PARTS)]
    every = (1 << 64) - 1
    return [every & ~_mask([int(b) for p in open_ for b in parts[p]]) for open_ in combinations(range(PARTS), 3)]


TABLES = _tables()


# --- fingerprints -----------------------------------------------------------------------------------
def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of the shingles of the lower-cased (A-Z) words of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[shingle - 1:].tolist(), strict=False) if len(words) >= shingle else [(0, len(joined))]
    hashes = np.fromiter([digest(joined[a:b], seed) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):  # a long text is counted in slices
        part = hashes[lo:lo + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def row_key(id_col: Column, text: Column) -> Column:
    """128-bit key of a row's id and text."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(id_col.cast("string"), F.lit("-")), F.coalesce(text, F.lit("")))))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key, fp`` of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((simhash(t.as_py(), shingle) for t in batch.column(2)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], ["doc_id", "key", "fp"])
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("key"),
                         F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, key binary, fp long")


# --- links --------------------------------------------------------------------------------------------
def pivot_table(fp: Column) -> Column:
    """Distances to the pivots, one byte each, the first one lowest."""
    out = F.lit(0).cast("long")
    for k, p in enumerate(PIVOTS):
        out = out.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(_signed(int(p))))).cast("long"), 8 * k))
    return out


def _stars(bucket: np.ndarray, fp: np.ndarray, pivots: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest linked member) of rows sorted by (bucket, first pivot distance).

    ``bucket`` numbers the buckets; all rows of a bucket are present.
    """
    n = len(fp)
    table = pivots.view(np.uint8).reshape(-1, 8).astype(np.int8)
    first = table[:, 0]
    left, right = [], []
    at = np.arange(n)
    for step in range(1, n):
        at = at[at + step < n]
        other = at + step
        near = (bucket[at] == bucket[other]) & (first[other] - first[at] <= max_bits)
        at = at[near]  # sorted, so a row that is out of reach stays so
        if not len(at):
            break
        other = at + step
        keep = np.abs(table[at] - table[other]).max(axis=1) <= max_bits
        a, b = at[keep], other[keep]
        close = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
        left.append(a[close])
        right.append(b[close])
    if not left:
        return fp[:0], fp[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            break
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


LINK_SCHEMA = "a long, b long, t int"


def _link_task(max_bits: int, limit: int | None):
    """Streams sorted rows (t, bucket, fp, pivots): links as (a, b, null); rows of buckets over
    ``limit`` come back as (fp, null, t) to be dealt again."""
    def out(a, b, t):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(t, pa.int32())],
                                          ["a", "b", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []   # rows of the bucket that the last batch ended in
        over = None                   # key of a bucket that is being passed on
        for batch in list_and_end(batches):
            rows = np.concatenate([*held, batch]) if batch is not None and held else (
                batch if batch is not None else (np.concatenate(held) if held else None))
            held = []
            if rows is None or not len(rows):
                continue
            change = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
            starts = np.concatenate(([0], change))
            sizes = np.diff(np.concatenate((starts, [len(rows)])))
            number = np.repeat(np.arange(len(starts)), sizes)
            large = sizes > limit if limit else np.zeros(len(starts), bool)
            if over is not None:
                large[0] |= (int(rows[0, 0]), int(rows[0, 1])) == over
            over = None
            end = len(rows)
            if batch is not None:  # the last bucket may go on in the next batch
                if large[-1]:
                    over = (int(rows[-1, 0]), int(rows[-1, 1]))
                else:
                    end = int(starts[-1])
                    held = [rows[end:]]
            passed = large[number[:end]]
            if passed.any():
                p = rows[:end][passed]
                yield out(p[:, 2], [None] * len(p), p[:, 0])
            rest = rows[:end][~passed]
            if len(rest):
                a, b = _stars(number[:end][~passed], rest[:, 2].copy().view(np.uint64), rest[:, 3].copy(), max_bits)
                if len(a):
                    yield out(a.view(np.int64), b.view(np.int64), [None] * len(a))

    def list_and_end(batches):
        for batch in batches:
            yield np.stack([np.asarray(c.cast(pa.int64())) for c in batch.columns], axis=1)
        yield None

    return run


def _dealt(rows: DataFrame, max_bits: int, limit: int | None) -> DataFrame:
    """Rows ``t, bucket, fp, pivots`` brought together by bucket and linked."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (rows.repartition(parts, "t", "bucket")
            .sortWithinPartitions("t", "bucket", F.col("pivots").bitwiseAND(F.lit(255)), "fp"))
    return rows.mapInArrow(_link_task(max_bits, limit), LINK_SCHEMA)


def _again(rows: DataFrame) -> DataFrame:
    """Rows ``t, fp`` of large buckets, dealt by the sub-tables of their table."""
    masks = F.array(*[F.array(*[F.lit(_signed(m)) for m in _subtables(free)]) for _, free in TABLES])
    return (rows.withColumn("masks", masks[F.col("t")])
            .select("t", "fp", F.posexplode("masks").alias("sub", "mask"))
            .select((F.col("t") * 1000 + F.col("sub")).cast("int").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"),
                    "fp", pivot_table(F.col("fp")).alias("pivots")))


def links(fps: DataFrame, max_bits: int = MAX_BITS, limit: int = BUCKET_ROWS) -> DataFrame:
    """``a, b``: stars whose components are those of all pairs of the distinct ``fp`` of ``fps``
    that differ in at most ``max_bits`` (3 at most) bits."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("three blocks are shared only up to 3 differing bits")
    fp = F.col("fp")
    tables = F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("bucket"))
                       for t, (m, _) in enumerate(TABLES)])
    keyed = fps.select(fp, pivot_table(fp).alias("pivots"), F.explode(tables).alias("x")).select("x.t", "x.bucket", "fp", "pivots")
    # the few largest buckets, at most HOT_SHARE of them by their share of the sample
    counted = keyed.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).groupBy("t", "bucket").agg(F.count("*").alias("n"))
    counted = written(counted.where(F.col("n") * SAMPLE > limit), "hot-buckets")
    total = fps.count() * len(TABLES)
    hot = F.broadcast(counted.where(F.col("n") * SAMPLE > total / HOT_SHARE).select(
        F.col("t").alias("ht"), F.col("bucket").alias("hb")))
    same = (F.col("t") == F.col("ht")) & (F.col("bucket") == F.col("hb"))
    first = written(_dealt(keyed.join(hot, same, "left_anti"), max_bits, limit), "links")
    large = first.where("b is null").select("t", F.col("a").alias("fp"))
    large = large.unionByName(keyed.join(hot, same, "left_semi").select("t", "fp"))
    second = _dealt(_again(large), max_bits, None)
    return first.where("b is not null").select("a", "b").unionByName(second.select("a", "b"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, key, fp, component_id, first_key`` (row key of the document that stands for the component)."""
    fps = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    # smallest id first, null last; the key decides between rows of one id
    rank = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("key").alias("k"))
    classes = written(fps.groupBy("fp").agg(F.min(rank).alias("first")), "fingerprint-classes")
    comps = components(links(classes.select("fp"), max_bits), "a", "b")
    rooted = (classes.join(comps, F.col("fp") == F.col("node"), "left")
              .select("fp", F.coalesce("root", "fp").alias("root"), "first"))
    best = rooted.groupBy("root").agg(F.min("first").alias("best")).withColumnRenamed("root", "r")
    by_fp = (rooted.join(best, F.col("root") == F.col("r"))
             .select(F.col("fp").alias("f"), F.col("best.d").alias("component_id"), F.col("best.k").alias("first_key")))
    return fps.join(by_fp, F.col("fp") == F.col("f")).drop("f")


def one_per_group(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One document of each component (smallest id; of rows that repeat it, one), columns unchanged."""
    found = near_duplicates(docs, shingle, max_bits, id_col, text_col)
    stays = found.where(F.col("key") == F.col("first_key")).select(F.col("key").alias("__stay")).distinct()
    key, n = fresh(docs, "__key"), fresh(docs, "__n")
    df = (docs.withColumn(key, row_key(F.col(id_col), F.col(text_col)))
          .join(stays, F.col(key) == F.col("__stay"))
          .withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(id_col))))
    return df.where(F.col(n) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
