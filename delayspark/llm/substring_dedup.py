"""Substring dedup by recompression: remove words of long windows that occur elsewhere.

Naming.  The words of a text are level 0.  Each round names runs or pairs of neighbouring symbols:
a run round joins the maximal runs of one symbol, a pair round joins neighbours whose coins (a bit of
their names) fall left and right.  A name is a 64-bit hash of what it stands for, so equal strings get
equal names in every task and no naming table has to be shuffled.  Joined symbols have at most the
round's cap of words, so a round can change at most (cap or longest span before) words at either end
of a shared string: after all rounds the symbols of a ``WINDOW``-word string that start
``LOSS`` words inside it are the same wherever it occurs.

Anchors.  Every window picks the smallest name among its interior symbols; neighbouring windows pick
the same one, so about one word in ten is an anchor and stands for a range of windows.  An anchor
row has two keys: the 18 words around the symbol that any window picking it must hold, and all words
of its range of windows.

Revealing and verifying.  Anchors meet by the first key.  Where it is alone, no window of the range
occurs twice.  Where the second key repeats, all windows of the range do.  The rest (the edges of
repeats) is verified window by window on 128-bit hashes of their words.

Hot strings: each task combines the anchors it has seen before anything is shuffled, so a passage or
copy in a third of all documents reaches the shuffle once per task.  Texts are shuffled once to meet
their ranges; only documents at the edge of a repeat are kept for the last step.

Defined results: null and blank texts have no words (the SHA-256 of nothing); texts under ``WINDOW``
words lose nothing; rows that repeat id and text are other occurrences of each other; an empty table
gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, powers, span_hashes, text_chunks, word_spans, written

WINDOW = 35
ROUNDS = [("run", 2), ("pair", 3), ("pair", 4)]  # (kind, most words of a joined symbol)
LOSS = 2 + 2 + 3      # words at either end of a shared string whose symbols may differ
SPAN = 4              # longest symbol
PICK = WINDOW - 2 * LOSS - SPAN + 1   # positions at which a window's interior symbols start
LEFT, RIGHT = LOSS, WINDOW - LOSS - (PICK - 1)  # words around a picked symbol that its windows share
FLUSH = 400_000       # anchors that a task combines before it lets them go

SINGLE, REPEATED, MIXED, FULL, SHOWN, OPEN = range(6)  # kinds of a row
_Q = np.uint64(0xD6E8FEB86659FD93)
_Q_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))
_MANY = np.uint64(2**64 - 1)
_U = np.uint64


# --- names ----------------------------------------------------------------------------------------
def recompress(names: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the symbols after all rounds; ``row`` numbers each word's document."""
    start = np.arange(len(names))
    span = np.ones(len(names), np.int64)
    with np.errstate(over="ignore"):
        for level, (kind, cap) in enumerate(ROUNDS, 1):
            if len(names) < 2:
                break
            if kind == "run":
                new = np.concatenate(([True], (names[1:] != names[:-1]) | (row[1:] != row[:-1])))
                head = np.flatnonzero(new)
                size = np.diff(np.append(head, len(names)))
                total = size * span[head]
                split = np.repeat((total > cap) | (size == 1), size)  # longer runs stay as they are
                keep = new | split
                count = np.where(split, 1, np.repeat(size, size))[keep]
                names = np.where(count > 1, mix64(names[keep] + _U(level) * _Q + count.astype(_U)), names[keep])
                span = span[keep] * count
            else:
                coin = (mix64(names + _U(level)) & _U(1)).astype(bool)
                join = coin[:-1] & ~coin[1:] & (row[1:] == row[:-1]) & (span[:-1] + span[1:] <= cap)
                pair = np.append(join, False)
                keep = ~np.concatenate(([False], join))
                right = np.append(names[1:], _U(0))
                joined = mix64(names * _Q + mix64(right ^ _U(level)))
                names = np.where(pair, joined, names)[keep]
                span = np.where(pair, span + np.append(span[1:], 0), span)[keep]
            start, row = start[keep], row[keep]
    return names, start


class Words:
    """Word hashes of a chunk of rows and hashes of any run of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.first = word_spans(data, offsets)
        self.names = span_hashes(data, starts, ends)
        self.n = len(self.names)
        self._sums: dict[int, np.ndarray] = {}

    def run_hash(self, a: np.ndarray, b: np.ndarray, kind: int = 0) -> np.ndarray:
        """Hash of the words a..b-1; another ``kind`` is an independent hash."""
        with np.errstate(over="ignore"):
            if kind not in self._sums:
                w = self.names if not kind else mix64(self.names ^ _U(0x5851F42D4C957F2D * kind % 2**64))
                c = np.empty(self.n + 1, np.uint64)
                c[0] = 0
                np.cumsum(w * powers(_Q, self.n), out=c[1:])
                self._sums[kind] = c
            c = self._sums[kind]
            return mix64((c[b] - c[a]) * powers(_Q_INV, self.n + 1)[a] + (b - a).astype(np.uint64) * _U(0x2545F4914F6CDD1D))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours (len - width + 1 values)."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (width - have)], x[width - have:]) if width > have else x


def anchors(words: Words) -> tuple[np.ndarray, ...]:
    """(document row, first window, last window less first, first key, second key) of every anchor of a chunk."""
    n, first = words.n, words.first
    empty = np.empty(0, np.int64)
    if n < WINDOW:
        return empty, empty, empty, empty, empty
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    names, start = recompress(words.names, row)
    key = np.full(n, _MANY, np.uint64)
    key[start] = (names & _U(0xFFFFFFFF00000000)) | start.astype(np.uint64)
    lowest = sliding_min(key, PICK)
    p = np.flatnonzero(row[:n - WINDOW + 1] == row[WINDOW - 1:])   # windows inside one document
    if not len(p):
        return empty, empty, empty, empty, empty
    at = (lowest[p + LOSS] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (row[p[1:]] != row[p[:-1]])))
    head = np.flatnonzero(new)
    low, x = p[head], at[head]
    high = p[np.append(head[1:], len(p)) - 1]
    near = words.run_hash(x - LEFT, x + RIGHT)
    with np.errstate(over="ignore"):
        whole = mix64(words.run_hash(low, high + WINDOW) + (x - low).astype(np.uint64) * _Q)
    doc = row[low]
    return doc, low - first[doc], high - low, near.view(np.int64), whole.view(np.int64)


# --- rows: (near, whole, key, packed); packed = first window | width << 32 | kind << 38 | check << 41
def _pack(low, width, kind, check) -> np.ndarray:
    return low | width << 32 | kind << 38 | check << 41


def _kind(packed: np.ndarray) -> np.ndarray:
    return packed >> 38 & 7


def _with_kind(packed: np.ndarray, kind) -> np.ndarray:
    return packed & ~(7 << 38) | np.int64(kind) << 38


def _groups(near: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the groups of equal ``near`` and of equal (near, whole) in sorted rows."""
    g = near[1:] != near[:-1]
    c = g | (whole[1:] != whole[:-1])
    return np.cumsum(np.append(False, g)), np.cumsum(np.append(False, c))


def combine(rows: np.ndarray) -> np.ndarray:
    """What a task lets go of its own anchors: singles, one row for each shared first key, and the
    rows whose outcome is known (they get a random first key, so they spread over all tasks)."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    g, c = _groups(rows[:, 0], rows[:, 1])
    in_g, in_c = np.bincount(g), np.bincount(c)
    g_of_c = g[np.flatnonzero(np.append(True, c[1:] != c[:-1]))]
    mixed = (np.bincount(g_of_c) > 1)[g]
    shared = in_g[g] > 1
    first_g, first_c = np.append(True, g[1:] != g[:-1]), np.append(True, c[1:] != c[:-1])
    out = [rows[~shared]]
    rep = rows[first_g & shared].copy()
    rep[:, 3] = np.where(mixed[first_g & shared], _with_kind(rep[:, 3], MIXED), _with_kind(rep[:, 3], REPEATED))
    out.append(rep)
    full = shared & (in_c[c] > 1)
    for which, kind in ((full, FULL), (full & mixed & first_c, SHOWN), (shared & ~full, OPEN)):
        out.append(_known(rows[which], kind))
    return np.concatenate(out)


def _known(rows: np.ndarray, kind: int) -> np.ndarray:
    rows = rows.copy()
    with np.errstate(over="ignore"):
        rows[:, 0] = mix64((rows[:, 2] ^ rows[:, 3]).view(np.uint64)).view(np.int64)
    rows[:, 1] = 0
    rows[:, 3] = _with_kind(rows[:, 3], kind)
    return rows


def settle(rows: np.ndarray) -> np.ndarray:
    """(key, packed) with kinds FULL, SHOWN or OPEN, from rows sorted by both keys (whole groups)."""
    kind = _kind(rows[:, 3])
    known = rows[kind >= FULL][:, 2:]
    rows, kind = rows[kind < FULL], kind[kind < FULL]
    if not len(rows):
        return known
    g, c = _groups(rows[:, 0], rows[:, 1])
    weight = np.where(kind == SINGLE, 1, 2)
    in_g = np.bincount(g, weight)
    own = kind != MIXED  # the row of a mixed group stands for no class
    in_c = np.bincount(c, np.where(own, weight, 0))
    first_c = np.append(True, c[1:] != c[:-1])
    classes = np.bincount(g[first_c])  # of second keys
    mixed = ((classes > 1) | (np.bincount(g, kind == MIXED) > 0))[g]
    shared, repeated = in_g[g] > 1, in_c[c] > 1
    show = np.zeros(len(rows), bool)
    can = np.flatnonzero(mixed & repeated & own)
    show[can[np.append(True, c[can][1:] != c[can][:-1])] if len(can) else can] = True
    out = [known]
    for which, k in ((shared & (kind == SINGLE) & (repeated | ~mixed), FULL), (show, SHOWN),
                     (shared & (kind == SINGLE) & mixed & ~repeated, OPEN)):
        part = rows[which][:, 2:].copy()
        part[:, 1] = _with_kind(part[:, 1], k)
        out.append(part)
    return np.concatenate(out)


# --- tasks ------------------------------------------------------------------------------------------
def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    names = ["near", "whole", "key", "packed"]
    for batch in batches:
        key, check = (np.asarray(batch.column(k)).astype(np.int64) for k in (0, 1))
        for lo, _, data, offsets in text_chunks(batch.column(2)):
            doc, low, width, near, whole = anchors(Words(data, offsets))
            if len(doc):
                held.append(np.stack([near, whole, key[lo + doc], _pack(low, width, SINGLE, check[lo + doc])], axis=1))
                n += len(doc)
            if n >= FLUSH:
                yield _batch(list(combine(np.concatenate(held)).T), names)
                held, n = [], 0
    if held:
        yield _batch(list(combine(np.concatenate(held)).T), names)


def _settle_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # rows of the group that the last batch ended in: one per task that met its string
    for batch in batches:
        rows = np.stack([np.asarray(c) for c in batch.columns], axis=1)
        rows = rows if held is None else np.concatenate([held, rows])
        if not len(rows):
            continue
        cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # rows come sorted
        held = rows[cut:]
        if cut:
            yield _batch(list(settle(rows[:cut]).T), ["key", "packed"])
    if held is not None:
        yield _batch(list(settle(held).T), ["key", "packed"])


def _removed(n: int, ranges: np.ndarray, singles: np.ndarray) -> np.ndarray:
    """Mask of the words covered by ranges (first, width) of windows and by single windows."""
    edge = np.zeros(n + 1, np.int64)
    if len(ranges):
        np.add.at(edge, ranges & 0xFFFFFFFF, 1)
        np.add.at(edge, (ranges & 0xFFFFFFFF) + (ranges >> 32 & 63) + WINDOW, -1)
    if len(singles):
        np.add.at(edge, singles, 1)
        np.add.at(edge, singles + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def _outcome(text: str | None, ranges: np.ndarray, singles: np.ndarray) -> tuple[int, int, str]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    gone = 0
    total = len(words)
    if len(ranges) or len(singles):
        mask = _removed(total, ranges, singles)
        gone = int(mask.sum())
        words = [words[i] for i in np.flatnonzero(~mask)]
    return total, gone, hashlib.sha256(b" ".join(words)).hexdigest()


_NONE = np.empty(0, np.int64)


def _numbers(x: pa.Scalar) -> np.ndarray:
    return np.asarray(x.values).astype(np.int64) if x.is_valid else _NONE


def _meet():
    """Documents with their ranges: finished ones, and those with open windows (text kept, windows named)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out = [[] for _ in range(9)]
                for doc_id, key, check, text, packed in zip(*part.columns, strict=True):
                    marks = _numbers(packed)
                    kind = _kind(marks)
                    ranges, todo = marks[kind == FULL], marks[kind >= SHOWN]
                    text = text.as_py()
                    at = a = b = _NONE
                    if len(todo):
                        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                        words = Words(data, np.array([0, len(data)]))
                        width = (todo >> 32 & 63) + 1
                        at = np.repeat((todo & 0xFFFFFFFF) - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
                        a, b = (words.run_hash(at, at + WINDOW, k).view(np.int64) for k in (0, 1))
                    open_ = bool((kind == OPEN).any())
                    result = (None, None, None) if open_ else _outcome(text, ranges, _NONE)
                    for col, v in zip(out, (*result, text if open_ else None, ranges if open_ else _NONE, at, a, b), strict=False):
                        col.append(v)
                types = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int64())] * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2)]
                    + [pa.array(c, t) for c, t in zip(out, types, strict=False)],
                    ["doc_id", "key", "check", "n_words", "n_removed", "kept_sha256", "text", "ranges", "at", "a", "b"])
    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            got = [_outcome(t.as_py(), _numbers(r), _numbers(s)) for t, r, s in zip(*part.columns[1:], strict=True)]
            n, gone, sha = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("key"),
                        F.hash(text, F.col(id_col)).bitwiseAND(F.lit((1 << 22) - 1)).cast("long").alias("check"), text.alias("text"))
    found = keyed.select("key", "check", "text").mapInArrow(_find, "near long, whole long, key long, packed long")
    settled = (found.repartition(parts, "near").sortWithinPartitions("near", "whole")
               .mapInArrow(_settle_task, "key long, packed long"))
    per_doc = (settled.groupBy("key", F.shiftright("packed", 41).alias("check"))
               .agg(F.collect_list("packed").alias("packed"))
               .select(F.col("key").alias("k"), F.col("check").alias("c"), "packed"))
    met = keyed.join(per_doc, (F.col("key") == F.col("k")) & (F.col("check") == F.col("c")), "left")
    met = written(met.select("doc_id", "key", "check", "text", "packed").mapInArrow(
        _meet(), f"doc_id {kind}, key long, check long, n_words long, n_removed long, kept_sha256 string, "
                     "text string, ranges array<long>, at array<long>, a array<long>, b array<long>"), "substring-met")
    windows = (met.where(F.size("at") > 0)
               .select("key", "check", F.explode(F.arrays_zip("at", "a", "b")).alias("w")).select("key", "check", "w.*"))
    twice = (windows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
             .select(F.col("a").alias("a2"), F.col("b").alias("b2")))
    hits = (windows.join(twice, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")))
            .groupBy("key", "check").agg(F.collect_set("at").alias("singles"))
            .select(F.col("key").alias("k"), F.col("check").alias("c"), "singles"))
    last = (met.where("text is not null").join(hits, (F.col("key") == F.col("k")) & (F.col("check") == F.col("c")), "left")
            .select("doc_id", "text", "ranges", "singles")
            .mapInArrow(_finish, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"))
    return met.where("text is null").select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(last)
