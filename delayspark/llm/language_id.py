"""Language identification by nearest centroid.

A text becomes the n-gram vector of its lower-cased letters (byte pairs and triples, hashed to
``DIMS`` places, punctuation, digits and white space as one space), weighted by TF-IDF (logarithmic term frequency) and
normalised.  Each language has up to ``CLUSTERS`` centroids (spherical k-means of its training texts).  A text
gets the language of the centroid with the greatest cosine; it is accepted when its distance
(1 - cosine) is not above that of nearly all training texts of the centroid.

Training: document frequencies are counted over all training texts; the centroids are fitted on a
bounded sample, the ``MAX_FIT`` texts of each language with the smallest seeded hashes.  What reaches the
driver is bounded by parameters: ``DIMS`` counts, and ``MAX_FIT`` sparse vectors of each language.
Prediction is one scan with no shuffle; texts are read whole, in chunks.

Defined results: null texts and texts without a letter are ``und`` with score 0, not accepted; so
are all texts when nothing was learned; ties go to the first language in code point order; equal
texts get equal results; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_chunks

DIMS = 8192
CLUSTERS = 3
MAX_FIT = 600         # texts of one language that centroids are fitted on
ROUNDS = 12
SLACK = 0.02          # added to the greatest distance but one percent of the training texts
CHUNK = 1_000_000     # bytes
ROWS = 128            # dense vectors at a time
UNDETERMINED = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:65] = 32
_FOLD[65:91] += 32
_FOLD[91:97] = 32
_FOLD[123:128] = 32


def gram_places(data: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every byte pair and triple of some folded texts, those of only spaces left out."""
    a, b, c = data[:-2].astype(np.uint32), data[1:-1].astype(np.uint32), data[2:].astype(np.uint32)
    two = (a << np.uint32(8) | b) * np.uint32(0x9E3779B1)
    three = (a << np.uint32(16) | b << np.uint32(8) | c) * np.uint32(0x85EBCA6B)
    bits = np.uint32(32 - int(np.log2(DIMS)))
    inside = row[:-2] == row[2:]
    near = inside & (a != 32) | (inside & (b != 32))
    far = inside & (b != 32)
    return (np.concatenate([row[:-2][near], row[:-2][far]]),
            np.concatenate([(two >> bits)[near], (three >> bits)[far]]).astype(np.int64))


def counted(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, counts of each row and place) of consecutive rows of lower-cased texts."""
    for lo, hi, data, offsets in text_chunks(col, CHUNK):
        for a in range(0, hi - lo, ROWS):
            b = min(a + ROWS, hi - lo)
            part = _FOLD[data[offsets[a]:offsets[b]]]
            n = np.diff(offsets[a:b + 1])
            total = np.zeros((b - a) * DIMS, np.int64)
            for at in range(0, len(part), 4 * CHUNK):  # a very long text is counted in slices
                piece = part[at:at + 4 * CHUNK + 2]
                if len(piece) > 2:
                    row = (np.zeros(len(piece), np.int64) if b - a == 1
                           else np.repeat(np.arange(b - a), n)[at:at + 4 * CHUNK + 2])
                    r, place = gram_places(piece, row)
                    total += np.bincount(r * DIMS + place, minlength=len(total))
            yield lo + a, lo + b, total.reshape(b - a, DIMS)


def lowered(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(col.fill_null(""))


@dataclass
class Model:
    languages: list[str]      # of each centroid
    centroids: np.ndarray     # (centroids, DIMS), normalised
    farthest: np.ndarray      # accepted distance of each centroid
    idf: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return weighted(counts, self.idf)

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and acceptance of each text."""
        n = len(col)
        lang, score, accepted = np.full(n, UNDETERMINED, object), np.zeros(n), np.zeros(n, bool)
        letters = np.asarray(pc.match_substring_regex(col.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False), bool)
        if len(self.languages):
            names = np.array(self.languages, object)
            for lo, hi, counts in counted(lowered(col)):
                cosine = self.vectors(counts) @ self.centroids.T
                best = cosine.argmax(axis=1)
                top = np.clip(cosine[np.arange(hi - lo), best], 0, 1)
                ok = letters[lo:hi]
                lang[lo:hi] = np.where(ok, names[best], UNDETERMINED)
                score[lo:hi] = np.where(ok, top, 0.0)
                accepted[lo:hi] = ok & (1 - top <= self.farthest[best])
        return list(lang), score, accepted


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts.astype(np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that have each place, and all texts (one row per place and task is summed)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, counts in counted(lowered(batch.column(0))):
                total += (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.concatenate(([n], total)))], ["place", "n"])
    rows = texts.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS + 1, np.int64)
    for r in rows:
        out[r["place"] + 1] = r["n"]
    return out[1:], int(out[0])


def fitting_sample(train: DataFrame, key: Column, bound: int) -> DataFrame:
    """The ``bound`` rows of each language with the smallest seeded hashes of ``key``.

    The hash range is cut in proportion to the language's rows before the ranking window, so a
    language with a third of all rows sends about twice ``bound`` rows to it, whatever its size.
    """
    sizes = train.groupBy("lang").agg(F.count("*").alias("n")).withColumnRenamed("lang", "l")
    draw = F.pmod(F.xxhash64(F.lit("fit"), key), F.lit(1 << 40))
    cut = train.withColumn("draw", draw).join(F.broadcast(sizes), F.col("lang") == F.col("l"))
    cut = cut.where(F.col("draw") * F.col("n") <= F.lit(float(1 << 40)) * (2 * bound + 50))
    return (cut.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("draw")))
            .where(F.col("r") <= bound).select("lang", "text"))


def _sparse(sample: DataFrame) -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, counts in counted(lowered(batch.column(1))):
                hit = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([h.astype(np.int32) for h in hit], pa.list_(pa.int32())),
                     pa.array([c[h].astype(np.int32) for c, h in zip(counts, hit, strict=True)], pa.list_(pa.int32()))],
                    ["lang", "place", "n"])
    out: dict[str, list] = {}
    for r in sample.mapInArrow(run, "lang string, place array<int>, n array<int>").collect():
        out.setdefault(r["lang"], []).append((np.array(r["place"], np.int64), np.array(r["n"], np.int64)))
    return out


def cluster(vectors: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` normalised centroids: spherical k-means from the mean and the texts farthest from what is chosen."""
    mean = vectors.mean(axis=0)
    centres = [mean / max(np.linalg.norm(mean), 1e-12)]
    while len(centres) < min(k, len(vectors)):
        nearest = (vectors @ np.array(centres).T).max(axis=1)
        centres.append(vectors[int(nearest.argmin())])
    centres = np.array(centres)
    for _ in range(ROUNDS):
        own = (vectors @ centres.T).argmax(axis=1)
        new = np.array([vectors[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres


def train(labelled: DataFrame, key: Column) -> Model:
    """A model from ``lang, text`` (both not null) and the columns that ``key`` hashes."""
    found, n = document_frequencies(labelled.select("text"))
    idf = (np.log((1 + n) / (1 + found)) + 1).astype(np.float32)
    languages, centroids, farthest = [], [], []
    for lang, rows in sorted(_sparse(fitting_sample(labelled, key, MAX_FIT)).items()):
        rows = sorted((r for r in rows if len(r[0])), key=lambda r: (r[0].tobytes(), r[1].tobytes()))
        if not rows:
            continue
        counts = np.zeros((len(rows), DIMS), np.int64)
        for c, (place, m) in zip(counts, rows, strict=True):
            c[place] = m
        vectors = weighted(counts, idf)
        centres = cluster(vectors, CLUSTERS)
        cosine = vectors @ centres.T
        own = cosine.argmax(axis=1)
        for j, c in enumerate(centres):
            if (own == j).any():
                languages.append(lang)
                centroids.append(c)
                farthest.append(np.quantile(1 - cosine[own == j, j], 0.99) + SLACK)
    shape = np.array(centroids, np.float32) if centroids else np.zeros((0, DIMS), np.float32)
    return Model(languages, shape, np.array(farthest), idf)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``lang_pred, score, accepted``."""
    keep = keep or []
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x CLUSTERS x DIMS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, accepted = shared.value.predict(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(lang, pa.string()), pa.array(score), pa.array(accepted)],
                [*keep, "lang_pred", "score", "accepted"])
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*[f"`{c}`" for c in keep], text_col).mapInArrow(
        run, ", ".join([*fields, "lang_pred string", "score double", "accepted boolean"]))
