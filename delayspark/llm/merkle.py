"""Merkle manifest of a dataset, kept as a postorder append log.

Rows are leaves of one tree per group; the subroots of the groups are the leaves of the tree above.  In a
tree, every ``RUN`` consecutive nodes (the last run may be shorter, down to one) have a parent, until one is
left; a lone leaf is its own subroot.  A digest covers the hex digests below it, concatenated.

* Builders own aligned blocks of ``RUN ** SPAN`` nodes and write nodes in the order in which they are complete: a
  parent follows its last child.  The next round builds on the block roots, so that no task ever holds more
  than a block, whatever the size of a group.
* :func:`position` gives the place of any node in the postorder of its tree in closed form, from subtree sizes alone.
  Proof extraction addresses siblings by that place: first those above the highest blocks, then block by block
  downwards, each block taking the path above it as one row.  No row is asked for by more than one block.

What reaches the driver is one number (the widest tree) and the root.

Defined results: null fields hash as ``-``; a null group is a group of its own and the first; null ids come
first; rows of equal id are ordered by digest, and equal rows are leaves of their own; an empty table has no
leaf, no root and no row; a table of one row has the leaf as root and an empty proof; columns that are not fields are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, written

RUN = 8            # children of a node
SPAN = 3           # levels that one builder adds
BLOCK = RUN ** SPAN
MAX_RANGES = 100_000  # rows of (tree, partition) counts that are broadcast

LOG = "tree string, n long, level int, idx long, pos long, digest binary"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# --- shape of a tree --------------------------------------------------------------------------
def widths(n: int) -> list[int]:
    """Nodes of each level, from the leaves to the root."""
    out = [int(n)]
    while out[-1] > 1:
        out.append(-(-out[-1] // RUN))
    return out


def position(level: int, idx: np.ndarray, n: int) -> np.ndarray:
    """Places of nodes in the postorder of a tree of ``n`` leaves.

    A node comes after its own subtree and all nodes left of it: at each level below, those up to the end of
    its subtree; at its own, those before it; at each level above, those whose subtree ends before it starts."""
    idx = np.asarray(idx, np.int64)
    pos = idx.copy()
    for k, width in enumerate(widths(n)):
        if k < level:
            pos += np.minimum((idx + 1) * RUN ** (level - k), width)
        elif k > level:
            pos += idx // RUN ** (k - level)
    return pos


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def completed(digests: list[str], first: int, base: int, n: int) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of the nodes of one block in the order of their completion.

    ``digests`` are consecutive nodes of level ``base`` from index ``first`` on.  A run closes with its last
    node, which is the eighth or the last one of its level."""
    width = widths(n)
    runs: list[list[str]] = [[] for _ in range(SPAN)]
    for i, digest in enumerate(digests, first):
        step = 0
        while True:
            yield base + step, i, digest
            if step == SPAN or width[base + step] == 1:
                break
            runs[step].append(digest)
            if len(runs[step]) < RUN and i + 1 < width[base + step]:
                break
            digest = sha("".join(runs[step]))
            runs[step] = []
            step, i = step + 1, i // RUN


# --- sorted groups that run over several batches -------------------------------------------------
def by_block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each (tree, block) of a sorted partition, one frame each."""
    held: list[pd.DataFrame] = []
    key = None
    for f in frames:
        if not len(f):
            continue
        f = f.reset_index(drop=True)
        same = (f.tree.eq(f.tree.shift()) & f.block.eq(f.block.shift())).to_numpy()
        cuts = np.flatnonzero(~same)
        for a, b in zip(cuts, [*cuts[1:], len(f)]):
            here = (f.tree.iat[a], f.block.iat[a])
            if held and here != key:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            key = here
            held.append(f.iloc[a:b])
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def per_block(df: DataFrame, order: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_block(frames):
            yield fn(group)

    return (df.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)
            .mapInPandas(run, schema))


# --- leaves -------------------------------------------------------------------------------------
def field(c: Column) -> Column:
    """A value as it is hashed: ``-`` for null, else its bytes' count, ``:`` and its text."""
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in fields]), 256))


def lower_az(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def tree_key(group: Column) -> Column:
    """A group's name as tree: sorts like the group with null first, bytewise."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string")))


def numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, id, digest, ...) with ``idx`` in their tree and its size ``n``, written once.

    Rows are range-partitioned on (tree, id, digest, row), so that neither a large tree nor a repeated row makes a large
    partition, and shifted by the counts of the partitions before (one row per tree and partition)."""
    leaves = written(leaves.withColumn("__row", F.monotonically_increasing_id()), "merkle-leaves")
    order = [F.col("tree"), F.col("id").asc_nulls_first(), F.col("digest"), F.col("__row")]
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = written(leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                   .withColumn("__at", F.monotonically_increasing_id()), "merkle-order")
    made = made.withColumn("__part", F.shiftright("__at", 33))
    per = made.groupBy("tree", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__c"))
    tree = Window.partitionBy("tree")
    per = (per.withColumn("__before", F.coalesce(F.sum("__c").over(
               tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("n", F.sum("__c").over(tree)).drop("__c"))
    return (made.join(bounded(per, MAX_RANGES), ["tree", "__part"])
            .withColumn("idx", F.col("__at") - F.col("__first") + F.col("__before"))
            .drop("__part", "__first", "__before", "__at", "__row"))


# --- the log ------------------------------------------------------------------------------------
def _build(nodes: DataFrame, base: int) -> DataFrame:
    """One round: aligned builders add up to ``SPAN`` levels to nodes (tree, n, idx, digest) of level ``base``."""
    def grow(g: pd.DataFrame) -> pd.DataFrame:
        n = int(g.n.iat[0])
        made = [x for x in completed([bytes(d).hex() for d in g.digest], int(g.idx.iat[0]), base, n)
                if base == 0 or x[0] > base]  # the nodes of a higher base are in the log already
        out = pd.DataFrame(made, columns=["level", "idx", "digest"])
        pos = np.zeros(len(out), np.int64)
        for level in out.level.unique():
            at = (out.level == level).to_numpy()
            pos[at] = position(int(level), out.idx[at], n)
        return pd.DataFrame({"tree": g.tree.iat[0], "n": n, "level": out.level, "idx": out.idx, "pos": pos,
                             "digest": [bytes.fromhex(d) for d in out.digest]})

    blocks = nodes.select("tree", "n", "idx", "digest", F.floor(F.col("idx") / BLOCK).cast("long").alias("block"))
    return per_block(blocks, ["idx"], grow, LOG)


def append_log(leaves: DataFrame) -> tuple[list[DataFrame], int]:
    """The log of all trees over numbered ``leaves`` (tree, n, idx, digest), as one written table per round,
    and the number of leaves of the widest tree."""
    widest = leaves.agg(F.max("n")).first()[0] or 0
    log, nodes, base = [], leaves, 0
    while base == 0 or base < len(widths(widest)) - 1:
        made = written(_build(nodes, base), "merkle-log")
        log.append(made)
        base += SPAN
        nodes = made.where(F.col("level") == base)
    return log, widest


def top_level(n: Column) -> Column:
    """Level of the root of a tree of ``n`` leaves."""
    level = F.lit(0)
    for k in range(21):  # RUN ** 21 is beyond a 64-bit count
        level = level + (n > F.lit(RUN ** k)).cast("int") if RUN ** k < 2**63 else level
    return level


def roots(log: list[DataFrame]) -> DataFrame:
    """(tree, n, digest) of every tree."""
    whole = log[0]
    for part in log[1:]:
        whole = whole.unionByName(part)
    return whole.where(F.col("level") == top_level(F.col("n"))).select("tree", "n", "digest")


# --- proofs -------------------------------------------------------------------------------------
# A path is one "left:right" per level, joined by commas: the hex digests beside the node in its run.
class Segment:
    """The log rows of one block, addressed by postorder place."""

    def __init__(self, pos: np.ndarray, digests: list[str], n: int):
        self.pos, self.digests, self.n, self.width = pos, digests, n, widths(n)
        self.runs: dict[tuple[int, int], list[str]] = {}

    def run(self, level: int, k: int) -> list[str]:
        """Digests of the ``k``-th run of a level."""
        if (level, k) not in self.runs:
            idx = np.arange(RUN * k, min(RUN * (k + 1), self.width[level]))
            at = np.searchsorted(self.pos, position(level, idx, self.n))
            self.runs[level, k] = [self.digests[i] for i in at]
        return self.runs[level, k]

    def path(self, base: int, idx: int) -> list[str]:
        """Siblings of a node of level ``base`` up to the root of the block or the tree."""
        out = []
        for level in range(base, min(base + SPAN, len(self.width) - 1)):
            run, own = self.run(level, idx // RUN), idx % RUN
            out.append("".join(run[:own]) + ":" + "".join(run[own + 1:]))
            idx //= RUN
        return out


def fold(digest: str, path: str) -> str:
    """The root that a digest leads to along a path."""
    for beside in path.split(",") if path else ():
        left, right = beside.split(":")
        digest = sha(left + digest + right)
    return digest


ABOVE, NODE, ASKED = 0, 1, 2


def _descend(log: list[DataFrame], base: int, above: DataFrame, asked: DataFrame | None,
             answer: Callable, schema) -> DataFrame:
    """Paths of the nodes of level ``base``: their block's siblings, found in its part of the log, and the path above.

    ``above`` has (tree, block, path).  ``answer(segment, path above, asked rows)`` makes the rows of one block; without
    ``asked`` rows it is called for all nodes of the level."""
    rows = [above.withColumns({"kind": F.lit(ABOVE), "pos": F.lit(-1).cast("long")})]
    levels = F.col("level").between(base, base + SPAN - 1)
    size = F.element_at(F.array(*[F.lit(RUN ** (SPAN - k)) for k in range(SPAN)]), F.col("level") - base + 1)
    for part in log[max(0, base // SPAN - 1):base // SPAN + 1]:
        rows.append(part.where(levels).select("tree", "n", "level", "idx", "pos", "digest", F.lit(NODE).alias("kind"),
                                              F.floor(F.col("idx") / size).cast("long").alias("block")))
    if asked is not None:
        rows.append(asked.withColumns({"kind": F.lit(ASKED), "pos": F.col("idx"),
                                       "block": F.floor(F.col("idx") / BLOCK).cast("long")}))
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r, allowMissingColumns=True)
    some = asked is not None

    def run(g: pd.DataFrame) -> pd.DataFrame:
        nodes = g[g.kind == NODE]
        segment = Segment(nodes.pos.to_numpy(np.int64), [bytes(d).hex() for d in nodes.digest], int(nodes.n.iat[0]))
        path = g.path[g.kind == ABOVE].iat[0]
        return answer(segment, path, g[g.kind == ASKED] if some else nodes[nodes.level == base])

    return per_block(whole, ["kind", "pos"], run, schema)


def paths_above(log: list[DataFrame], widest: int, top: DataFrame) -> DataFrame:
    """(tree, block, path) of every block of leaves, from ``top`` (tree, path: that of the tree's root)."""
    above = top.select("tree", F.lit(0).cast("long").alias("block"), "path")
    for base in range(SPAN * (len(log) - 1), 0, -SPAN):
        # trees that end below this round keep their one block
        def answer(segment: Segment, path: str, nodes: pd.DataFrame, base: int = base) -> pd.DataFrame:
            found = [",".join(segment.path(base, int(i)) + ([path] if path else [])) for i in nodes.idx]
            return pd.DataFrame({"tree": nodes.tree.to_numpy(), "block": nodes.idx.to_numpy(np.int64), "path": found})

        whole = log[0]
        for part in log[1:]:
            whole = whole.unionByName(part)
        deep = whole.where((F.col("level") == base) & (F.col("idx") == 0)).select("tree")
        low = above.join(deep, "tree", "left_anti")
        high = above.join(deep, "tree", "left_semi")
        above = written(low.unionByName(_descend(log, base, high, None, answer, "tree string, block long, path string")),
                        "merkle-paths")
    return above


def manifest(leaves: DataFrame) -> DataFrame:
    """Proof of every leaf.

    ``leaves`` has (tree, id, digest, tampered): the digest of the row as it was, and of the row as it
    is now where that differs (else null).  Returns id, leaf, subroot, root, proof_sha256 (of all siblings
    from the leaf to the root, left to right), folded_root (from the row as it is now) and verified."""
    spark = leaves.sparkSession
    id_type = leaves.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type)] + [
        T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
        + [T.StructField("verified", T.BooleanType())])
    leaves = written(numbered(leaves), "merkle-numbered")
    log, widest = append_log(leaves.select("tree", "n", "idx", "digest"))
    if not widest:
        return spark.createDataFrame([], schema)
    subroots = written(roots(log).select(F.col("tree").alias("id"), "digest"), "merkle-subroots")
    over = written(numbered(subroots.withColumn("tree", F.lit(""))), "merkle-groups")
    over_log, trees = append_log(over.select("tree", "n", "idx", "digest"))
    root = bytes(roots(over_log).first()["digest"]).hex()

    def group_path(segment: Segment, path: str, asked: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tree": asked.id.to_numpy(), "path": [
            ",".join(segment.path(0, int(i)) + ([path] if path else [])) for i in asked.idx]})

    first = spark.createDataFrame([("", "")], "tree string, path string")
    top = written(_descend(over_log, 0, paths_above(over_log, trees, first),
                           over.select("tree", "n", "idx", "id"), group_path, "tree string, path string"), "merkle-top")

    def proof(segment: Segment, path: str, asked: pd.DataFrame) -> pd.DataFrame:
        beyond = path.split(",") if path else []
        out = []
        for i, key, was, now in zip(asked.idx, asked.id, asked.digest, asked.tampered):
            beside = segment.path(0, int(i)) + beyond
            was = bytes(was).hex()
            folded = fold(was if now is None else bytes(now).hex(), ",".join(beside))
            out.append((key, was, sha("".join(beside).replace(":", "")), folded))
        made = pd.DataFrame(out, columns=["id", "leaf", "proof_sha256", "folded_root"])
        made["tree"] = asked.tree.to_numpy()
        return made

    # as text: a frame's column of numbers with gaps would be one of floats
    asked = leaves.select("tree", "n", "idx", "digest", "tampered", F.col("id").cast("string").alias("id"))
    found = _descend(log, 0, paths_above(log, widest, top), asked, proof,
                     "id string, leaf string, proof_sha256 string, folded_root string, tree string")
    groups = subroots.select(F.col("id").alias("tree"), F.lower(F.hex("digest")).alias("subroot"))
    return (found.join(bounded(groups, MAX_RANGES), "tree")
            .select(F.col("id").cast(id_type).alias("id"), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
                    (F.col("folded_root") == F.lit(root)).alias("verified")))
