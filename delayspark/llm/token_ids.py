"""Token ids in byte-aligned variable-length coding, ranked by frequency.

Ids are replaced by their frequency rank in the whole corpus (most frequent first, ties by id) and
written as 1 to 4 little-endian bytes; the lengths stand apart in control bytes, two bits per id.
A shard file is a run of blocks, each followed by one line feed:

    magic "FRVB", then six little-endian 64-bit numbers: partition, ids before the block in its
    partition, documents, ids, control bytes, data bytes; then per document its id (64 bits), 1 byte
    (0: null id) and id count (64 bits); then all control bytes; then all data bytes.

The rank table (ids in rank order, 32 bits each) is a file of its own beside the shards.  Spark's
writers write all files (commit protocol, any file system); partitions are ranges of the document id,
so shards hold documents in ascending id order and no task sees more than its range.

Texts are tokenized once; the ids wait in a written table while frequencies are counted.  The
tokenizer is called once per distinct piece of text between white space and kept in a bounded cache:
byte-level pre-tokenization never joins a character with a space behind it, so cutting a text before
a single space that follows a non-space character cannot change its ids.

Defined results: null text has only the end id; null ids come first; rows with equal ids are ordered
by token count and checksum; an empty table writes only the rank table; extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import span_hashes, text_chunks, written

END_ID = 2
CACHE_PIECES = 1_500_000   # distinct pieces whose ids a worker keeps (about 30 bytes each)
SLOT_BITS = 22
CHUNK = 500_000            # bytes of text whose arrays stay in a processor's cache
JOINED = 100               # new pieces encoded at once
BATCH_ROWS = 500           # documents handed back to Spark at a time
BLOCK_IDS = 1_000_000      # a block ends with the document that reaches this many ids
BLOCKS_PER_FILE = 8

# --- fixed values of the format -------------------------------------------------------------------
MAGIC = b"FRVB"
HEADER = struct.Struct("<4s6Q")

_LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)  # control byte -> four lengths
_STATE: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)  # ASCII marks that end a word: no letter, digit, white space or apostrophe
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
# lead bytes of characters that may be white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 on, U+3000
_DOUBTFUL = np.zeros(256, bool)
_DOUBTFUL[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def cut_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the pieces of some texts that lie one after the other, and which bytes are
    surely no white space.

    A piece may begin (all exact, as the pre-tokenizer's pattern never looks back and never matches
    across these places): at a text's start; at a space or line feed behind a character that is
    surely no white space; behind a line feed with such characters on both sides; and at an ASCII
    mark behind a Latin letter (contractions begin with an apostrophe, which is left alone).
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid = ~_WHITE[data]
    doubtful = np.flatnonzero(_DOUBTFUL[data])
    for k in range(3):  # all bytes of doubtful characters
        at = doubtful[(data[doubtful] >= 0xE0) | (k < 2)] + k
        solid[at[at < n]] = False
    letter = _LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut = edge[:-1].copy()
    cut[1:] |= solid[:-1] & ((data[1:] == 32) | (data[1:] == 10))
    cut[1:] |= letter[:-1] & _MARK[data[1:]]
    if n > 2:
        cut[2:] |= (data[1:-1] == 10) & solid[:-2] & solid[2:] & ~edge[1:-2] & ~edge[2:-1]
    return np.flatnonzero(cut), solid


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with room for ``n`` values, at least doubled when it grows."""
    if n <= len(x):
        return x
    out = np.empty(max(n, 2 * len(x)), x.dtype)
    out[:len(x)] = x
    return out


class PieceTokenizer:
    """A tokenizer called once per distinct piece of text, with a bounded cache of pieces' ids.

    Pieces are told apart by their 64-bit hash.  New pieces are encoded many at a time: those that
    are a space and a word are joined as they are (their first token, and no other, starts with the
    space), others without white space by single line feeds; the ids fall apart at those tokens.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.model._resize_cache(0)  # pieces come once: the library's own cache only costs time
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        n = self.tokenizer.get_vocab_size()
        self.code = "H" if n <= 1 << 16 else "I"
        self.opens = np.zeros(n, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.feed = np.zeros(n, bool)
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed[feed] = len(feed) == 1
        self._empty()

    def _whole(self, raw: bytes, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """``starts`` without those inside texts that hold a special token: such texts stay whole."""
        rows = set()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                rows.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(token, at + 1)
        if not rows:
            return starts
        row = np.searchsorted(offsets, starts, "right") - 1
        return starts[~np.isin(row, list(rows)) | np.isin(starts, offsets)]

    def _empty(self) -> None:
        """Cached pieces in the order of learning: hash, first id in ``flat``, ids.  ``slot`` has the
        piece of each value of a hash's top bits; pieces whose slot was taken are kept sorted apart."""
        self.size = self.used = 0  # pieces, ids in flat; the arrays have room to grow
        self.keys = np.empty(1 << 16, np.uint64)
        self.start = np.empty(1 << 16, np.int32)
        self.count = np.empty(1 << 16, np.int32)
        self.flat = np.empty(1 << 18, self.code)
        self.slot = np.full(1 << SLOT_BITS, -1, np.int32)
        self.other_keys, self.other = np.empty(0, np.uint64), np.empty(0, np.int32)

    def _joined(self, pieces: list[str], glue: str, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each piece) of pieces encoded many at a time; ``first`` marks the ids that open
        a piece (or are the glue)."""
        flat, counts = [], []
        groups = [pieces[k:k + JOINED] for k in range(0, len(pieces), JOINED)]
        made = self.tokenizer.encode_batch_fast([glue.join(g) for g in groups], add_special_tokens=False)
        for g, e in zip(groups, made, strict=True):
            ids = np.array(e.ids, self.code)
            opens = first[ids]
            at = np.flatnonzero(opens)
            if glue:
                n = np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1
                ids = ids[~opens]
            else:
                n = np.diff(np.append(at, len(ids))) if len(at) and at[0] == 0 else at
            if len(n) != len(g):
                ids, n = self._alone(g)
            flat.append(ids)
            counts.append(n)
        return np.concatenate(flat), np.concatenate(counts)

    def _alone(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return (np.fromiter((x for y in ids for x in y), self.code), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _learn(self, keys: np.ndarray, pieces: list[str], kind: np.ndarray) -> None:
        """New pieces (by rising key) into the cache; ``kind``: 0 a space and a word, 1 no white space, 2 other."""
        self.keys, self.start, self.count = (_room(x, self.size + len(keys)) for x in (self.keys, self.start, self.count))
        piece = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        start, count = self.start[self.size:self.size + len(keys)], self.count[self.size:self.size + len(keys)]
        for k, encode in ((0, lambda g: self._joined(g, "", self.opens)), (1, lambda g: self._joined(g, "\n", self.feed)),
                          (2, self._alone)):
            at = np.flatnonzero(kind == k)
            if len(at):
                ids, n = encode([pieces[i] for i in at.tolist()])
                count[at] = n
                start[at] = np.cumsum(n) - n + self.used
                self.flat = _room(self.flat, self.used + len(ids))
                self.flat[self.used:self.used + len(ids)] = ids
                self.used += len(ids)
        self.keys[self.size:self.size + len(keys)] = keys
        self.size += len(keys)
        place = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        free = self.slot[place] < 0
        self.slot[place[free]] = piece[free]
        late = np.flatnonzero(self.slot[place] != piece)  # keys come sorted
        at = np.searchsorted(self.other_keys, keys[late])
        self.other_keys, self.other = np.insert(self.other_keys, at, keys[late]), np.insert(self.other, at, piece[late])

    def _find(self, names: np.ndarray) -> np.ndarray:
        """Cached piece of each hash, -1 for unknown ones."""
        piece = self.slot[(names >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        miss = np.flatnonzero((piece < 0) | (self.keys[piece] != names))
        piece[miss] = -1
        if len(miss) and len(self.other_keys):
            at = np.minimum(np.searchsorted(self.other_keys, names[miss]), len(self.other_keys) - 1)
            hit = self.other_keys[at] == names[miss]
            piece[miss[hit]] = self.other[at[hit]]
        return piece

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text."""
        for lo, hi, data, offsets in text_chunks(texts, CHUNK):
            if self.size > CACHE_PIECES:
                self._empty()
            raw = data.tobytes()
            starts, solid = cut_points(data, offsets)
            starts = self._whole(raw, offsets, starts)
            ends = np.append(starts[1:], len(data)) if len(starts) else starts
            names = span_hashes(data, starts, ends)
            piece = self._find(names)
            unknown = np.flatnonzero(piece < 0)
            if len(unknown):
                keys, where, back = np.unique(names[unknown], return_index=True, return_inverse=True)
                first, last = starts[unknown[where]], ends[unknown[where]]
                white = np.concatenate(([0], np.cumsum(~solid)))
                white = white[last] - white[first]
                kind = np.where((white == 1) & (data[first] == 32) & (last - first > 1), 0, np.where(white == 0, 1, 2))
                had = self.size
                self._learn(keys, [raw[a:b].decode("utf-8", "replace")
                                   for a, b in zip(first.tolist(), last.tolist(), strict=True)], kind)
                piece[unknown] = had + back
            count = self.count[piece]
            upto = np.cumsum(count, dtype=np.int64)
            begin, total = upto - count, int(upto[-1]) if len(upto) else 0
            shift = (self.start[piece] - begin).astype(np.int32 if total < 1 << 31 else np.int64)
            ids = self.flat[np.repeat(shift, count) + np.arange(total, dtype=shift.dtype)]
            edges = np.append(begin, total)[np.searchsorted(starts, offsets)]
            yield from (ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True))


def tokenize(docs: DataFrame, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``doc_id, n, check, ids`` (ids as little-endian 16- or 32-bit numbers, the end id last)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _STATE.get("vocabulary") != vocabulary:
            _STATE.update(vocabulary=vocabulary, tokenizer=PieceTokenizer(vocabulary))
        t = _STATE["tokenizer"]
        end = array(t.code, [end_id]).tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(lo, BATCH_ROWS)
                ids = [x.tobytes() + end for x in t.encode_all(part.column(1))]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(x) // len(end) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "n", "check", "ids"])
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n long, check long, ids binary")


def vocabulary_size(vocabulary: str, end_id: int = END_ID) -> tuple[int, str]:
    """Ids that can occur, and the numpy type of a stored id."""
    from tokenizers import Tokenizer
    n = Tokenizer.from_file(vocabulary).get_vocab_size()
    return max(n, end_id + 1), "<u2" if n <= 1 << 16 else "<u4"


def count_ids(tokens: DataFrame, n_ids: int, dtype: str) -> np.ndarray:
    """Occurrences of every id (one row per id and task is summed; the result is as long as the vocabulary)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                ids = [np.frombuffer(x.as_buffer(), dtype) for x in batch.column(0).slice(lo, BATCH_ROWS)]
                total += np.bincount(np.concatenate(ids), minlength=n_ids)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["id", "n"])
    rows = (tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))).collect()
    counts = np.zeros(n_ids, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def rank_order(counts: np.ndarray) -> np.ndarray:
    """Ids by falling count, ties by id."""
    return np.lexsort((np.arange(len(counts)), -counts)).astype(np.uint32)


# --- the coding -----------------------------------------------------------------------------------
def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of 32-bit ranks."""
    r = ranks.astype("<u4")
    size = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    padded = np.ones(-(-len(r) // 4) * 4, np.uint8)
    padded[:len(r)] = size
    quads = (padded - 1).reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    start = np.cumsum(size, dtype=np.int64) - size
    data = np.empty(int(size.sum(dtype=np.int64)), np.uint8)
    data[start] = r & np.uint32(0xFF)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        data[start[more] + k] = r[more] >> np.uint32(8 * k) & np.uint32(0xFF)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Ranks from control and data bytes, by table lookup of four lengths per control byte."""
    size = _LENGTHS[control].reshape(-1)[:n]
    start = np.cumsum(size, dtype=np.int64) - size
    out = data[start].astype(np.uint32) if n else np.empty(0, np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= data[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_block(partition: int, before: int, doc_ids: list, ranks: list[np.ndarray]) -> bytes:
    counts = [len(r) for r in ranks]
    control, data = encode_ranks(np.concatenate(ranks))
    table = b"".join(struct.pack("<qBQ", d or 0, d is not None, n) for d, n in zip(doc_ids, counts, strict=True))
    return HEADER.pack(MAGIC, partition, before, len(counts), sum(counts), len(control), len(data)) + table + control + data


def read_blocks(content: bytes) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray]]:
    """(partition, ids before, document ids, id counts, ranks) of each block of a shard file."""
    at = 0
    while at < len(content):
        magic, partition, before, docs, n, n_control, n_data = HEADER.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEADER.size
        rows = list(struct.iter_unpack("<qBQ", content[at:at + 17 * docs]))
        at += 17 * docs
        ranks = decode_ranks(np.frombuffer(content, np.uint8, n_control, at),
                             np.frombuffer(content, np.uint8, n_data, at + n_control), n)
        at += n_control + n_data + 1
        yield partition, before, [d if known else None for d, known, _ in rows], np.array([r[2] for r in rows]), ranks


def _write_blobs(df: DataFrame, path: str, per_file: int) -> None:
    """One binary value after the other, each followed by a line feed."""
    (df.select(F.col("blob").cast("string").alias("value")).write.option("lineSep", "\n")
     .option("maxRecordsPerFile", per_file).text(path))


def write_shards(tokens: DataFrame, order: np.ndarray, dtype: str, path: str) -> None:
    """Write ``path/ranks`` and ``path/shards``."""
    spark = tokens.sparkSession
    table = spark.createDataFrame([(bytearray(order.astype("<u4").tobytes()),)], "blob binary")
    _write_blobs(table, f"{path}/ranks", 1)
    rank_of = np.empty(len(order), np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    rank_of = spark.sparkContext.broadcast(rank_of)  # as long as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, partition, before, held, ids, ranks = rank_of.value, TaskContext.get().partitionId(), 0, 0, [], []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack_block(partition, before, ids, ranks)], pa.binary())], ["blob"])

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(d)
                ranks.append(table[np.frombuffer(x.as_buffer(), dtype)])
                held += len(ranks[-1])
                if held >= BLOCK_IDS:
                    yield block()
                    before, held, ids, ranks = before + held, 0, [], []
        if ids:
            yield block()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_by = [F.col("doc_id").asc_nulls_first(), F.col("n"), F.col("check")]
    sorted_ = (tokens.select("doc_id", "n", "check", "ids").repartitionByRange(parts, *order_by)
               .sortWithinPartitions(*order_by).select("doc_id", "ids"))
    _write_blobs(sorted_.mapInArrow(run, "blob binary"), f"{path}/shards", BLOCKS_PER_FILE)


def write_corpus(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Tokenize ``docs`` and write them in the format above below ``path``."""
    n_ids, dtype = vocabulary_size(vocabulary, end_id)
    tokens = written(tokenize(docs, vocabulary, end_id, id_col, text_col), "tokens")
    write_shards(tokens, rank_order(count_ids(tokens, n_ids, dtype)), dtype, path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files."""
    table = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/ranks")
    blob = max((bytes(r["content"]) for r in table.select("content").collect()), key=len)  # one row, as long as the vocabulary
    id_of = spark.sparkContext.broadcast(np.frombuffer(blob[:len(blob) // 4 * 4], "<u4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for partition, before, docs, counts, ranks in read_blocks(content.as_py()):
                    ids = id_of.value[ranks].astype("<u4")
                    ends = np.cumsum(counts)
                    starts = ends - counts
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(docs, pa.int64()), pa.array(np.full(len(docs), partition, np.int64)),
                        pa.array(before + starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    shards = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards").select("content")
    rows = shards.mapInArrow(run, "doc_id long, part long, at long, n_tokens long, ids_crc32 long")
    rows = written(rows, "token-digests")
    # one row per range partition: ids of all partitions before it
    base = (rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
            .withColumn("base", F.coalesce(F.sum("n").over(
                Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n"))
    return (rows.join(F.broadcast(base), "part")
            .select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"))
