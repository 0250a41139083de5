"""Benchmark decontamination: CGK embedding, repeated bit-sampling LSH, exact edit verification.

Embedding.  A random walk reads a window of words: at step j it writes the word it stands on and
moves on when coin j of that word (a bit of its hash) says so.  Words are inserted, deleted or changed
at the price of a few steps, so a small edit distance becomes a small Hamming distance of the written
words.  All windows of a chunk of documents walk at once (one gather and one addition a step).

Hashing.  A key is a fixed choice of steps of the walk (``SAMPLES``); several choices repeat the
trial.  Every item of ``LONG`` words or more is cut into windows at all its offsets, so an item of m words
gets about ``len(SAMPLES) * (m - WINDOW + 1)`` trials; a copy with a fifth of its words edited leaves many
windows untouched where an untouched window collides in every sample.

Shorter items have too few such windows.  They are cut into one piece more than they may have edits, so
every allowed copy holds a piece word for word (pigeonholes), and the key is that run of words: nothing is lost.
Recall of copies with the largest allowed number of random edits is tested at each item length to be at
least ``TARGET_RECALL``.

Verification.  Colliding windows must agree in ``MIN_AGREE`` of all steps of the walk; the text around a
colliding piece must hold as many of the item's words as an allowed copy keeps.  What is left is aligned
exactly: the item against the item-sized stretch of the document around the window (bit-parallel
dynamic programming, free ends in the document).  A match has an edit distance in words of at most
``1 - SIMILARITY`` of the item's words.

The benchmark is a stated query set: it is read in blocks of about ``BLOCK_ITEMS`` items, and each
block is tested against all documents in one pass without a shuffle.  Documents are only scanned.

Defined results: words are compared in lower case; null and blank texts match nothing; items
without words are never matched; items under ``SHORT`` words must occur word for word; every item is
compared on its own, also when texts repeat; repeated documents repeat their matches; empty tables give
no match; extra columns are ignored by :func:`matches` and passed through by :func:`clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, span_hashes, text_chunks, word_spans

SIMILARITY = 0.8
TARGET_RECALL = 0.98
STEPS = 24
SAMPLES = [(0, 4, 8, 12), (1, 7, 13, 19), (2, 8, 14, 20), (0, 6, 12, 18), (3, 9, 16, 23), (0, 3, 6, 9)]
WINDOW = 13           # the first sample never leaves this many words
LONG = 24             # items of fewer words are searched by pieces
SHORT = 5             # items of fewer words must match exactly
MIN_AGREE = 0.35      # of the steps that an item's window makes inside the item
BLOCK_ITEMS = 5000
_BITS = 20            # of the first look-up table
_U = np.uint64
_FACTORS = np.random.default_rng(11).integers(0, 2**63, STEPS, dtype=np.uint64) * _U(2) + _U(1)


def word_names(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of rows with a stop (0) after each row, and the rows' first places."""
    starts, ends, first = word_spans(data, offsets)
    names = mix64(span_hashes(data, starts, ends)) | _U(1)
    rows = len(offsets) - 1
    out = np.zeros(len(names) + rows, np.uint64)
    out[np.arange(len(names)) + np.repeat(np.arange(rows), np.diff(first))] = names
    return out, first + np.arange(rows + 1)


def walk(names: np.ndarray, at: np.ndarray, steps: set[int]) -> dict[int, np.ndarray]:
    """Words written at ``steps`` by walks that start at ``at``; a stop is never left."""
    out = {}
    at = at.copy()
    for j in range(max(steps) + 1):
        word = names[at]
        if j in steps:
            out[j] = word
        at += ((word >> _U(j + 8)) & _U(1)).astype(at.dtype) & (word != 0)
    return out


def _key(written: dict[int, np.ndarray], sample: tuple[int, ...]) -> np.ndarray:
    with np.errstate(over="ignore"):
        k = _U(len(sample)) * _FACTORS[0]
        for j in sample:
            k = (k + written[j]) * _FACTORS[j]
    return mix64(k)


def run_keys(names: np.ndarray, at: np.ndarray, lengths: set[int]) -> dict[int, np.ndarray]:
    """Keys of the runs of so many words that start at ``at``; a run over a stop has no item's key."""
    out, k = {}, np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(max(lengths, default=0)):
            k = (k + names[np.minimum(at + j, len(names) - 1)]) * _FACTORS[j]
            if j + 1 in lengths:
                out[j + 1] = mix64(k)
    return out


@dataclass
class Table:
    """Keys of one sample (or, without one, of runs of ``run`` words): sorted, with the item windows that have them."""
    sample: tuple[int, ...]
    run: int
    keys: np.ndarray
    window: np.ndarray
    first: np.ndarray  # whether the top bits of a key occur

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into keys, window) of every collision."""
        maybe = np.flatnonzero(self.first[(keys >> _U(64 - _BITS)).astype(np.int64)])
        k = keys[maybe]
        lo, hi = np.searchsorted(self.keys, k, "left"), np.searchsorted(self.keys, k, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(maybe, n), self.window[at]


class Items:
    """A block of items ready to be searched for."""

    def __init__(self, ids: list, texts: list[str], similarity: float = SIMILARITY):
        col = pc.utf8_lower(pa.array(texts, pa.string()))
        self.ids, self.words = [], []
        for lo, hi, data, offsets in text_chunks(col, 1 << 62):
            names, first = word_names(data, offsets)
            for k in range(lo, hi):
                w = names[first[k - lo]:first[k - lo + 1] - 1]
                if len(w):
                    self.ids.append(ids[k])
                    self.words.append(w)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.most = np.floor(self.size * (1 - similarity) + 1e-9).astype(np.int64)
        self.most[self.size < SHORT] = 0
        self._windows()
        self.peq = [{} for _ in self.words]
        for masks, w in zip(self.peq, self.words, strict=True):
            for i, x in enumerate(w.tolist()):
                masks[x] = masks.get(x, 0) | 1 << i

    def _windows(self) -> None:
        item, offset, run = [], [], []
        for i, (n, most) in enumerate(zip(self.size.tolist(), self.most.tolist(), strict=True)):
            if n >= LONG:
                at = list(range(n - WINDOW + 1))
                run += [0] * len(at)
            else:
                pieces = min(most + 1, n)
                cut = [n * k // pieces for k in range(pieces + 1)]
                at = cut[:-1]
                run += np.diff(cut).tolist()
            item += [i] * len(at)
            offset += at
        self.item, self.offset, run = (np.array(x, np.int64) for x in (item, offset, run))
        names = np.concatenate([np.append(w, _U(0)) for w in self.words]) if self.words else np.zeros(1, np.uint64)
        base = np.concatenate(([0], np.cumsum(self.size + 1)[:-1])) if self.words else np.zeros(0, np.int64)
        start = base[self.item] + self.offset if len(item) else np.zeros(0, np.int64)
        written = walk(names, start, set(range(STEPS)))
        self.embedded = np.stack([written[j] for j in range(STEPS)], axis=1) if len(item) else np.zeros((0, STEPS), np.uint64)
        self.short = np.zeros((len(self.words), LONG - 1), np.uint64)  # words of the items that are searched by pieces
        for i in np.flatnonzero(self.size < LONG).tolist():
            self.short[i, :self.size[i]] = self.words[i]
        self.tables = []
        for sample in SAMPLES:
            # a walk that has left the item cannot collide
            use = np.flatnonzero((run == 0) & (written[sample[-1]] != 0)) if len(item) else np.zeros(0, np.int64)
            self._add(sample, 0, use, _key({j: written[j][use] for j in sample}, sample))
        for n in sorted(set(run.tolist()) - {0}):
            use = np.flatnonzero(run == n)
            self._add((), n, use, run_keys(names, start[use], {n})[n])

    def _add(self, sample: tuple[int, ...], run: int, use: np.ndarray, keys: np.ndarray) -> None:
        if len(use):
            order = np.argsort(keys, kind="stable")
            first = np.zeros(1 << _BITS, bool)
            first[(keys >> _U(64 - _BITS)).astype(np.int64)] = True
            self.tables.append(Table(sample, run, keys[order], use[order], first))

    def _agree(self, names: np.ndarray, at: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Whether the walks from ``at`` agree with those of the windows in enough steps."""
        own = walk(names, at, set(range(STEPS)))
        theirs = self.embedded[window]
        same = sum((own[j] == theirs[:, j]) & (theirs[:, j] != 0) for j in range(STEPS))
        return same >= MIN_AGREE * (theirs != 0).sum(axis=1)

    def _hold(self, names: np.ndarray, at: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Whether the text that a copy with a piece at ``at`` can cover holds the words that the copy must keep."""
        item = self.item[window]
        size, most = self.size[item], self.most[item]
        span = np.arange((size + 2 * most).max())
        places = (at - self.offset[window] - most)[:, None] + span
        text = np.where(span < (size + 2 * most)[:, None], names[np.clip(places, 0, len(names) - 1)], _U(0))
        held = np.zeros(len(at), np.int64)
        for j in range(size.max()):
            word = self.short[item, j]
            held += (word != 0) & (text == word[:, None]).any(axis=1)
        return held >= size - most

    def candidates(self, names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, row, place in ``names`` where it should start) of windows and pieces that pass both tests.

        The row is that of the colliding word: a copy without its first words should start before its row."""
        if not len(names) or not self.tables:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        places = np.arange(len(names))
        steps = {j for t in self.tables for j in t.sample}
        written = walk(names, places, steps) if steps else {}
        runs = run_keys(names, places, {t.run for t in self.tables if t.run})
        found = []
        for t in self.tables:
            at, window = t.lookup(runs[t.run] if t.run else _key({j: written[j] for j in t.sample}, t.sample))
            much = 20_000 if t.run else 200_000
            for lo in range(0, len(at), much):
                a, w = at[lo:lo + much], window[lo:lo + much]
                ok = self._hold(names, a, w) if t.run else self._agree(names, a, w)
                a, w = a[ok], w[ok]
                row = np.searchsorted(first, a, "right") - 1
                found.append(np.stack([self.item[w], row, a - self.offset[w]], axis=1))
        got = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        if len(got):
            # starts of one item in one row within its slack are verified together
            slack = np.maximum(1, self.most[got[:, 0]])
            near = np.stack([got[:, 0], got[:, 1], got[:, 2] // slack], axis=1)
            got = got[np.unique(near, axis=0, return_index=True)[1]]
        return got[:, 0], got[:, 1], got[:, 2]

    def align(self, item: int, words: list[int], start: int, low: int, high: int) -> tuple[int, int, int] | None:
        """(distance, first word, words) of the best alignment of the item near ``start`` in
        ``words[low:high]`` if its distance is allowed: bit-parallel edit distance, free ends in the text."""
        m, most, peq = int(self.size[item]), int(self.most[item]), self.peq[item]
        a, b = max(low, start - 2 * most), min(high, start + m + 2 * most)
        end, best = _best_end(peq, m, words[a:b], most)
        if end < 0:
            return None
        # the same backwards from the best end gives the longest-matching start
        rev = {x: int(format(v, f"0{m}b")[::-1], 2) for x, v in peq.items()}
        back, _ = _best_end(rev, m, words[a:a + end + 1][::-1], most)
        return best, a + end - back, back + 1


def _best_end(peq: dict[int, int], m: int, text: list[int], most: int) -> tuple[int, int]:
    """(last word, distance) of the best approximate occurrence in ``text``; (-1, .) when none is allowed."""
    full = (1 << m) - 1
    top = 1 << (m - 1)
    pv, mv, score = full, 0, m
    where, best = -1, most + 1
    for i, x in enumerate(text):
        eq = peq.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            where, best = i, score
    return where, best


def search(items: Items, col: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, distance, first word, words) of the best match of each item in each row."""
    for lo, _, data, offsets in text_chunks(pc.utf8_lower(col)):
        names, first = word_names(data, offsets)
        item, row, start = items.candidates(names, first)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        words: dict[int, list[int]] = {}
        for i, r, s in zip(item.tolist(), row.tolist(), start.tolist(), strict=True):
            a, b = int(first[r]), int(first[r + 1]) - 1
            if r not in words:
                words[r] = names[a:b].tolist()
            got = items.align(i, words[r], s - a, 0, b - a)
            if got and got < best.get((r, i), (1 << 30, 0, 0)):
                best[r, i] = got
        for (r, i), (d, s, n) in sorted(best.items()):
            yield lo + r, i, d, s, n


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block: int) -> Iterator[Items]:
    """The benchmark in blocks of about ``block`` items; one block at a time is on the driver."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    many = max(1, -(-rows.count() // block))
    for b in range(many):
        got = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(many)) == b).collect()
        items = Items([r["id"] for r in got], [r["text"] for r in got])
        if items.ids:
            yield items


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_id: str = "item_id", item_text: str = "text", block: int = BLOCK_ITEMS) -> DataFrame:
    """``doc_id, item_id, distance, first_word, n_words``: best match of each item in each document."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = (f"doc_id {docs.schema[id_col].dataType.simpleString()}, "
              f"item_id {benchmark.schema[item_id].dataType.simpleString()}, distance int, first_word long, n_words int")
    out = spark.createDataFrame([], schema)
    for items in _blocks(benchmark, item_id, item_text, block):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = list(search(shared.value, batch.column(1)))
                if got:
                    row, i, d, s, n = (list(c) for c in zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array([shared.value.ids[k] for k in i]),
                         pa.array(d, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int32())],
                        ["doc_id", "item_id", "distance", "first_word", "n_words"])
        out = out.unionByName(narrow.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text", block: int = BLOCK_ITEMS) -> DataFrame:
    """The documents in which no item was found, columns unchanged (one pass for each block)."""
    at = docs.columns.index(text_col)
    for items in _blocks(benchmark, item_id, item_text, block):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in search(shared.value, batch.column(at))]] = False
                yield batch.filter(pa.array(keep))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
