"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Words are runs of letters and digits.  A word's features are itself, its first 3 to 6 and last 3 bytes, its length, the
words beside it and a constant, all of them hashed to ``PLACES`` weights; case does not count in ASCII and Latin-1.
Two states, toxic and other, with weights of first states and transitions; forward-backward gives each word's
marginal.  The sums run over all words of a chunk of texts at once, as products of 2 x 2 matrices in lanes.

Labels of documents become labels of words: a word form or beginning counts in how many of the toxic
and clean sample texts it occurs (G2), and the words of a toxic text whose best form reaches ``NEAR`` of the text's
strongest are labelled toxic; what a longer text shares with it by chance stays below that.  All words of clean texts
are labelled other.  The field is fitted on segments of ``SEGMENT`` words: those of clean texts, and of toxic texts those
with a labelled word; then once more with the clean segments that this field finds most toxic.  A document's score is
a logistic function of its greatest marginal and of the expected number of toxic words, fitted on the sample.

Bounded, documented samples: at most ``MAX_FIT`` labelled ids of each label (smallest seeded hashes), ``MAX_SEGMENTS``
different segments of each kind and choice and ``MAX_CALIBRATE`` scored texts of each label.  These, and at most ``PLACES``
counts, are what reaches the driver.  Scoring is one scan of whole texts without a shuffle.

Defined results: null, empty and word-free texts have the score of no toxic word and no span; without
labels of both kinds nothing is learned and every score is 0; an id labelled both ways, or with null, is not learned
from; equal texts get equal scores; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, bounded, mix64, powers, text_chunks, written

PLACES = 1 << 18
MAX_FIT = 20_000       # labelled ids of each label
MAX_SEGMENTS = 4_000   # segments of each kind
MAX_CALIBRATE = 4_000  # scored texts of each label
SEGMENT = 64           # words
NEAR = 0.25            # of the strongest form of a text
LEAST_TEXTS = 3        # toxic texts that a form needs
STEPS, BATCH, RATE, DECAY = 240, 512, 0.05, 2e-3
SEED = 11

# Word bytes: ASCII letters and digits, all others outside ASCII.
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _WORD[_lo:_hi] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_P = np.uint64(0xD6E8FEB86659FD93)
_P_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))
_SALT = _RNG.integers(0, 2**64, 16, dtype=np.uint64)
BEGINNINGS = (3, 4, 5, 6)
FORMS = 1 + len(BEGINNINGS)  # the first features: the word itself and its beginnings
WIDTH = FORMS + 5            # ending, length, word before, word after, constant


# --- words and features ---------------------------------------------------------------------------
def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the Latin-1 capitals of UTF-8 in lower case; no length changes."""
    out = _LOW[data]
    if len(out) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][second] += 32
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each row's first word (rows + 1 entries)."""
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(words, WIDTH) places; PLACES where a feature does not apply."""
    n = len(starts)
    out = np.full((n, WIDTH), PLACES, np.int32)
    if not n:
        return out
    shift = np.uint64(64 - int(np.log2(PLACES)))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_P, len(data)), out=total[1:])
        back = powers(_P_INV, len(data) + 1)

        def name(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
            return mix64((total[b] - total[a]) * back[a] + _SALT[salt])

        lens = ends - starts
        words = name(starts, ends, 0)
        out[:, 0] = words >> shift
        for k, size in enumerate(BEGINNINGS, 1):
            at = np.flatnonzero(lens > size)
            out[at, k] = name(starts[at], starts[at] + size, k) >> shift
        at = np.flatnonzero(lens > 3)
        out[at, FORMS] = name(ends[at] - 3, ends[at], 6) >> shift
        out[:, FORMS + 1] = mix64(np.minimum(lens, 24).astype(np.uint64) + _SALT[7]) >> shift
        opens = np.zeros(n + 1, bool)
        opens[first] = True
        at = np.flatnonzero(~opens[1:n]) + 1 if n > 1 else np.empty(0, np.int64)
        out[at, FORMS + 2] = mix64(words[at - 1] + _SALT[8]) >> shift
        out[at - 1, FORMS + 3] = mix64(words[at] + _SALT[9]) >> shift
        out[:, FORMS + 4] = _SALT[10] >> shift
    return out


def chunks(col: pa.Array) -> Iterator[tuple]:
    """(first row, end row, words, rows' first words, features) of consecutive texts; words are their lower-case
    bytes, the rows' offsets in them, and the words' starts and ends."""
    for lo, hi, data, offsets in text_chunks(col, CHUNK_BYTES // 2):
        data = lowered(data)
        starts, ends, first = word_spans(data, offsets)
        yield lo, hi, (data, offsets, starts, ends), first, features(data, starts, ends, first)


# --- forward-backward -------------------------------------------------------------------------------
def chained(m: np.ndarray) -> np.ndarray:
    """Running products ``m[0] @ ... @ m[t]`` of non-negative 2 x 2 matrices, each scaled to a sum of 1.

    The sequence is laid out in lanes; lanes advance together, then the lane before is carried over."""
    n = len(m)
    length = max(1, int(np.sqrt(n)))
    lanes = -(-n // length)
    padded = np.empty((lanes * length, 2, 2))
    padded[:n] = m
    padded[n:] = np.eye(2)
    run = padded.reshape(lanes, length, 2, 2)

    def times(a, b):
        c = np.empty(np.broadcast_shapes(a.shape, b.shape))
        for i in (0, 1):
            for j in (0, 1):
                c[..., i, j] = a[..., i, 0] * b[..., 0, j] + a[..., i, 1] * b[..., 1, j]
        c /= c.sum(axis=(-1, -2), keepdims=True)
        return c

    for t in range(1, length):
        run[:, t] = times(run[:, t - 1], run[:, t])
    for lane in range(1, lanes):
        run[lane] = times(run[lane - 1, -1][None], run[lane])
    return run.reshape(-1, 2, 2)[:n]


@dataclass
class Field:
    """A conditional random field of two states (0 other, 1 toxic) and the document's logistic function."""

    weights: np.ndarray   # of toxic, one for each place and a last 0
    start: float          # of toxic as first state
    move: np.ndarray      # 2 x 2 transitions
    line: tuple[float, float, float] = (-8.0, 1.0, 0.0)

    def marginals(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of toxic of every word; ``first`` marks the words that begin a text."""
        n = len(feats)
        if not n:
            return np.empty(0)
        emit = np.clip(self.weights[feats].sum(axis=1), -30, 30)
        opens = np.zeros(n, bool)
        opens[first[first < n]] = True
        opens[0] = True
        e = np.stack([np.ones(n), np.exp(emit)], axis=1)
        step = np.exp(self.move)
        forth = step[None] * e[:, None, :]
        forth[opens] = (np.array([1.0, np.exp(self.start)]) * e[opens])[:, None, :]
        alpha = chained(forth).sum(axis=1)
        # the chain from behind: a text's last word is followed by nothing
        back = np.empty((n, 2, 2))
        back[:-1] = step[None] * e[1:, None, :]
        back[:-1][opens[1:]] = 1.0
        back[-1] = 1.0
        beta = chained(back[::-1].transpose(0, 2, 1)).sum(axis=1)[::-1]
        both = alpha * beta
        return both[:, 1] / both.sum(axis=1)

    def score(self, greatest: np.ndarray, expected: np.ndarray) -> np.ndarray:
        a, b, c = self.line
        return 1 / (1 + np.exp(-np.clip(a + b * logit(greatest) + c * np.log1p(expected), -35, 35)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


# --- training -----------------------------------------------------------------------------------
def fit_field(feats: np.ndarray, labels: np.ndarray) -> Field:
    """Penalised likelihood by Adam steps over batches of segments.

    ``feats`` is (segments, SEGMENT, WIDTH), padded with PLACES throughout a word; ``labels`` (segments, SEGMENT), -1 where padded."""
    rng = np.random.default_rng(SEED)
    n = len(feats)
    size = PLACES + 1
    w, theta = np.zeros(size), np.zeros(5)  # theta: start, then the transitions
    mw, vw, mt, vt = np.zeros(size), np.zeros(size), np.zeros(5), np.zeros(5)
    for step in range(1, STEPS + 1):
        pick = rng.permutation(n)[:BATCH] if n > BATCH else np.arange(n)
        x, y = feats[pick], labels[pick]
        real = y >= 0
        emit = np.clip(w[x].sum(axis=2), -30, 30)
        p, pairs, seen = _expected(emit, real, theta)
        gap = np.where(real, p - (y == 1), 0.0)
        used = real[:, :, None] & (x < PLACES)
        g = np.bincount(x[used], np.broadcast_to(gap[:, :, None], x.shape)[used], size) / len(pick)
        gt = np.empty(5)
        gt[0] = (p[:, 0] - (y[:, 0] == 1)).sum()
        gt[1:] = (pairs - seen(y)).ravel()
        gt /= len(pick)
        touched = np.zeros(size, bool)
        touched[x[used]] = True
        g += DECAY * w / 64
        mw, vw = 0.9 * mw + 0.1 * g, 0.99 * vw + 0.01 * g * g
        mt, vt = 0.9 * mt + 0.1 * gt, 0.99 * vt + 0.01 * gt * gt
        fix1, fix2 = 1 - 0.9 ** step, 1 - 0.99 ** step
        w -= RATE * (mw / fix1) / (np.sqrt(vw / fix2) + 1e-4)
        theta -= RATE * (mt / fix1) / (np.sqrt(vt / fix2) + 1e-4)
        w[PLACES] = 0.0
    return Field(w, float(theta[0]), theta[1:].reshape(2, 2))


def _expected(emit: np.ndarray, real: np.ndarray, theta: np.ndarray):
    """Marginals and expected transitions of padded segments, all segments a step at a time."""
    n, length = emit.shape
    step = np.exp(theta[1:].reshape(2, 2))
    e = np.stack([np.ones_like(emit), np.exp(emit)], axis=2)
    alpha, beta = np.empty((n, length, 2)), np.empty((n, length, 2))
    alpha[:, 0] = np.array([1.0, np.exp(theta[0])]) * e[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        new = (alpha[:, t - 1] @ step) * e[:, t]
        new /= new.sum(axis=1, keepdims=True)
        alpha[:, t] = np.where(real[:, t, None], new, alpha[:, t - 1])
    beta[:, -1] = 1.0
    for t in range(length - 2, -1, -1):
        new = (beta[:, t + 1] * e[:, t + 1]) @ step.T
        new /= new.sum(axis=1, keepdims=True)
        beta[:, t] = np.where(real[:, t + 1, None], new, 1.0)
    both = alpha * beta
    p = both[:, :, 1] / both.sum(axis=2)
    joint = alpha[:, :-1, :, None] * step * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    pairs = joint[real[:, 1:]].sum(axis=0)

    def seen(y: np.ndarray) -> np.ndarray:
        a, b = y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]
        return np.bincount(2 * a + b, minlength=4).reshape(2, 2).astype(float)

    return p, pairs, seen


def fit_line(greatest: np.ndarray, expected: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on the two figures of a text by Newton's steps."""
    x = np.stack([np.ones(len(toxic)), logit(greatest), np.log1p(expected)], axis=1)
    weight = np.full(len(toxic), 1 / max(1, len(toxic)))
    penalty = np.diag([1e-4, 1e-3, 1e-3])
    b = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - toxic)) + penalty @ b
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        b -= np.linalg.solve(hess, grad)
    return tuple(float(v) for v in b)


def sample_labels(labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic", limit: int = MAX_FIT) -> DataFrame:
    """(id, toxic) of at most ``limit`` ids of each label, written: those with the smallest seeded hashes."""
    one = (labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id"))
           .agg(F.min(label).alias("toxic"), F.max(label).alias("most"), F.count_if(F.col(label).isNull()).alias("gaps"))
           .where("toxic = most and gaps = 0"))
    by = F.xxhash64(F.lit(SEED), F.col("id"))
    parts = [one.where(F.col("toxic") == k).orderBy(by, "id").limit(limit).select("id", F.col("toxic").cast("int").alias("toxic")) for k in (0, 1)]
    return written(parts[0].unionByName(parts[1]), "toxic-labels")


def _labelled(docs: DataFrame, sample: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(t, toxic) of the sampled documents; the sample has at most 2 x MAX_FIT rows."""
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where("t is not null")
    return docs.join(bounded(sample, 2 * MAX_FIT), "id").select("t", "toxic")


def form_counts(train: DataFrame) -> dict[int, float]:
    """Place -> G2 of the word forms and beginnings that are more frequent in toxic texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, PLACES), np.int64)
        texts = np.zeros(2, np.int64)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for lo, hi, _, first, feats in chunks(batch.column("t")):
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                places = feats[:, :FORMS].astype(np.int64)
                pairs = (row[:, None] * PLACES + places)[places < PLACES]
                pairs = np.unique(pairs)
                of = toxic[lo:hi][pairs // PLACES]
                for k in (0, 1):
                    total[k] += np.bincount(pairs[of == k] % PLACES, minlength=PLACES)
                texts += np.bincount(toxic[lo:hi], minlength=2)[:2]
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(total[0, at], texts[0])), pa.array(np.append(total[1, at], texts[1]))],
            ["place", "clean", "toxic"])

    counts = (train.mapInArrow(run, "place long, clean long, toxic long").groupBy("place")
              .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    counts = written(counts, "toxic-forms")
    whole = counts.where("place = -1").first()
    if whole is None or not whole["clean"] or not whole["toxic"]:
        return {}
    n0, n1 = whole["clean"], whole["toxic"]
    rate = F.col("toxic") / F.lit(float(n1)), F.col("clean") / F.lit(float(n0))
    rows = counts.where((F.col("place") >= 0) & (F.col("toxic") >= LEAST_TEXTS) & (rate[0] > 4 * rate[1])).collect()  # at most PLACES

    def g2(a: int, b: int) -> float:
        cells = ((a, n1), (b, n0), (n1 - a, n1), (n0 - b, n0))
        share = (a + b) / (n0 + n1)
        hoped = (share * n1, share * n0, (1 - share) * n1, (1 - share) * n0)
        return 2 * sum(c * np.log(c / h) for (c, _), h in zip(cells, hoped) if c > 0)

    return {r["place"]: g2(r["toxic"], r["clean"]) for r in rows}


def label_words(feats: np.ndarray, first: np.ndarray, forms: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for the words of toxic texts that are labelled toxic, else 0."""
    strength = forms[feats[:, :FORMS]].max(axis=1) if len(feats) else np.empty(0)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    top = np.zeros(len(first) - 1)
    np.maximum.at(top, row, strength)
    return ((toxic[row] == 1) & (strength > 0) & (strength >= NEAR * top[row])).astype(np.int8)


def segments(train: DataFrame, forms: dict[int, float], field: Field | None = None, limit: int = MAX_SEGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``limit`` different segments of each kind: clean texts', and toxic texts' with a toxic word.

    They are chosen by a seeded hash; with a ``field``, only clean texts' segments are, those that it finds most toxic."""
    table = np.zeros(PLACES + 1)
    for place, g in forms.items():
        table[place] = g
    shared = train.sparkSession.sparkContext.broadcast((table, field))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, field = shared.value
        held: list[dict[int, tuple[bytes, bytes]]] = [{}, {}]
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for lo, hi, _, first, feats in chunks(batch.column("t")):
                if not len(feats):
                    continue
                marks = label_words(feats, first, table, toxic[lo:hi])
                within = np.arange(len(feats)) - np.repeat(first[:-1], np.diff(first))
                a = np.flatnonzero(within % SEGMENT == 0)
                b = np.append(a[1:], len(feats))
                with np.errstate(over="ignore"):
                    named = mix64(feats[:, 0].astype(np.uint64) * _SALT[11] + within.astype(np.uint64) % np.uint64(SEGMENT) * _SALT[12])
                    order = mix64(np.add.reduceat(named, a)).astype(np.int64)
                if field is not None:
                    least = np.maximum.reduceat(field.marginals(feats, first[:-1]), a)
                    order = ((1 - least) * 2**20).astype(np.int64) << 42 | order & (2**42 - 1)
                kind = toxic[lo:hi][np.repeat(np.arange(hi - lo), np.diff(first))[a]]
                any_toxic = np.add.reduceat(marks, a, dtype=np.int64) > 0
                for k in (0, 1) if field is None else (0,):
                    at = np.flatnonzero((kind == k) & (any_toxic if k else True))
                    at = at[np.argsort(order[at], kind="stable")[:limit]]
                    for s in at:
                        held[k][int(order[s])] = feats[a[s]:b[s]].tobytes(), marks[a[s]:b[s]].tobytes()
                    if len(held[k]) > 2 * limit:
                        held[k] = dict(sorted(held[k].items())[:limit])
        rows = [(o, k, *x) for k in (0, 1) for o, x in sorted(held[k].items())[:limit]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                                             ["place", "kind", "feats", "marks"])

    found = written(train.mapInArrow(run, "place long, kind int, feats binary, marks binary"), "toxic-segments").dropDuplicates(["kind", "place"])
    rows = [r for k in (0, 1) for r in found.where(F.col("kind") == k).orderBy("place").limit(limit).collect()]
    feats = np.full((len(rows), SEGMENT, WIDTH), PLACES, np.int32)
    marks = np.full((len(rows), SEGMENT), -1, np.int8)
    for i, r in enumerate(rows):
        one = np.frombuffer(bytes(r["feats"]), np.int32).reshape(-1, WIDTH)
        feats[i, :len(one)] = one
        marks[i, :len(one)] = np.frombuffer(bytes(r["marks"]), np.int8)
    return feats, marks


def figures(docs: DataFrame, field: Field, keep: list[Column], text: Column, spans: bool) -> DataFrame:
    """``keep``, greatest marginal, expected number of toxic words and, if asked for, the toxic spans (code points, end excluded)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    source = docs.select(*keep, text.alias("__t"))
    names = source.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            greatest, expected = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            lists: list[list[dict]] = [[] for _ in range(batch.num_rows)] if spans else []
            for lo, hi, words, first, feats in chunks(batch.column("__t")):
                p = field.marginals(feats, first[:-1])
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                np.maximum.at(greatest, lo + row, p)
                np.add.at(expected, lo + row, p)
                if spans:
                    _spans(lists, lo, p, row, words)
            score = field.score(greatest, expected)
            out = [*[batch.column(c) for c in names], pa.array(greatest), pa.array(expected), pa.array(score)]
            labels = [*names, "greatest", "expected", "score"]
            if spans:
                out.append(pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))))
                labels.append("spans")
            yield pa.RecordBatch.from_arrays(out, labels)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
                       + ["greatest double", "expected double", "score double"]
                       + ["spans array<struct<start:bigint,end:bigint,probability:double>>"] * spans)
    return source.mapInArrow(run, schema)


def _spans(lists: list[list[dict]], lo: int, p: np.ndarray, row: np.ndarray, words: tuple) -> None:
    """Append runs of neighbouring words with a marginal of one half or more to their rows' lists."""
    hot = np.flatnonzero(p >= 0.5)
    if not len(hot):
        return
    data, offsets, starts, ends = words
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    opens = np.append(True, (np.diff(hot) > 1) | (row[hot][1:] != row[hot][:-1]))
    at = np.flatnonzero(opens)
    for a, b in zip(at, [*at[1:], len(hot)]):
        i, j = hot[a], hot[b - 1]
        base = points[offsets[row[i]]]
        lists[lo + row[i]].append({"start": int(points[starts[i]] - base), "end": int(points[ends[j]] - base),
                                   "probability": float(p[i:j + 1].max())})


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Field | None:
    """The field learned from the labelled documents; None when a label is missing."""
    sample = sample_labels(labels, doc_id, label)
    rows = written(_labelled(docs, sample, doc_id, text), "toxic-sample")
    forms = form_counts(rows)
    if not forms:
        return None
    feats, marks = segments(rows, forms)
    if not (marks == 1).any() or not (marks == 0).any():
        return None
    field = fit_field(feats, marks)
    more = segments(rows, forms, field)
    field = fit_field(np.concatenate([feats, more[0]]), np.concatenate([marks, more[1]]))
    seen = figures(rows, field, [F.col("toxic")], F.col("t"), spans=False)
    by = F.xxhash64(F.lit(SEED), "greatest", "expected")
    seen = written(seen.withColumn("__by", by), "toxic-seen")
    got = [r for k in (0, 1) for r in seen.where(F.col("toxic") == k).orderBy("__by").limit(MAX_CALIBRATE).collect()]
    field.line = fit_line(np.array([r["greatest"] for r in got]), np.array([r["expected"] for r in got]), np.array([r["toxic"] for r in got]))
    return field


def score(docs: DataFrame, field: Field | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with ``score`` (0 to 1), ``predicted`` and the toxic ``spans`` of every document; kept columns
    with one of these names give way to them."""
    keep = [c for c in keep if c.lower() not in ("score", "predicted", "spans")]
    if field is None:
        empty = F.array().cast("array<struct<start:bigint,end:bigint,probability:double>>")
        return docs.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), empty.alias("spans"))
    found = figures(docs, field, [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)], F.col(text), spans=True)
    return found.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
