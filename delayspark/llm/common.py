"""Helpers shared by the training-data operators: shared scratch tables, ranks, byte-level word scans."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# A word is a run of bytes other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
NOT_WORD = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of this application (once), as ``--py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="delayspark-code-")) / "delayspark_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


# --- written intermediate tables -------------------------------------------------------------
def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps survive lost executors
    and never recompute it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table whose rows have been written elsewhere."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


# --- column helpers ---------------------------------------------------------------------------
def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value`` evaluated once per row (a lambda variable, never inlined)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NOT_WORD), lambda w: w != F.lit(""))


def ranked(df: DataFrame, order: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``df`` with its 0-based position in ``order``, without a single-task window.

    Rows are range-partitioned and sorted, numbered inside each partition, written once, and
    shifted by the row counts of the partitions before (one row per partition).
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .withColumn("__id", F.monotonically_increasing_id()))
    made = written(made, "ranked")
    part = F.shiftright("__id", 33)
    before = (made.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
              .withColumn("__before", F.sum("__n").over(
                  Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
              .select("__part", F.coalesce("__before", F.lit(0)).alias("__before")))
    at = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return (made.withColumn("__part", part).join(F.broadcast(before), "__part")
            .withColumn(name, (at + F.col("__before")).cast("long")).drop("__id", "__part", "__before"))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``rows`` rows, else left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# --- byte-level scans of Arrow text columns -----------------------------------------------------
CHUNK_BYTES = 2_000_000  # working memory of one numpy step; a longer text is a chunk of its own
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POW: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for chunks of ordinary size."""
    had = _POW.get(int(base))
    if had is None or len(had) < n:
        had = np.full(max(n, CHUNK_BYTES // 2), base, np.uint64)
        had[0] = 1
        np.multiply.accumulate(had, out=had)
        if len(had) <= 2 * CHUNK_BYTES:
            _POW[int(base)] = had
    return had[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_chunks(col: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of consecutive rows with about ``size`` bytes; null is empty."""
    col = col.fill_null("") if col.null_count else col
    if len(col) == 0:
        return
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, len(col))
        yield lo, hi, raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each row's first word (rows + 1 entries)."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    is_word = _IS_WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = is_word.copy()
    first[1:] &= ~is_word[:-1] | edge[1:-1]
    last = is_word
    last[:-1] &= first[1:] | ~is_word[1:]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit content hash of each byte span."""
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[data] * powers(_P, len(data)), out=total[1:])
        return mix64((total[ends] - total[starts]) * powers(_P_INV, len(data) + 1)[starts]
                     + (ends - starts).astype(np.uint64))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
