"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf; the leaves of a group (language) form one tree, the roots
of the groups, in order, another one above them.

A tree is a graph whose nodes are labelled (level, place), and a node can be
computed once its children's digests have reached it.  The forward sweep takes
the messages of a priority queue in label order: all messages for one label
are one node's children, their digest is sent on to the parent's label.  The
reversed sweep takes labels from the root down: a node that has received its
proof suffix (its siblings and those of its ancestors) sends each child that
suffix with the child's own siblings in front.

The queue is external: labels of one block of ``BLOCK`` neighbouring nodes and
the levels above them inside the block stay in a heap of one task; messages
that leave the block wait in a table and are dealt to the next tier's blocks by
a shuffle.  A tree of n leaves takes log(n) / log(BLOCK) tiers each way, whatever
its share of the rows, and no task holds more than a block.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.common import materialize
from skillgrid.operators.numbering import number_rows

BLOCK = 1024  # nodes of one level that a task sweeps at a time, at most
PROOF = "array<string>"  # of each level "left:right", the digests of the siblings on either side, run together


def field(c: Column) -> Column:
    """A value as it goes into a leaf: ``-`` for null, else its UTF-8 length, a colon and itself."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*values: Column | str) -> Column:
    return F.sha2(F.concat(*[field(F.col(f"`{v}`") if isinstance(v, str) else v) for v in values]), 256)


def proof_digest(proof: Column | str = "proof") -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.replace(F.concat_ws("", proof), F.lit(":"), F.lit("")), 256)


def folded_root(leaf: Column, proof: Column | str = "proof") -> Column:
    """The root that a leaf gives with the siblings of a proof."""
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(F.replace(s, F.lit(":"), d), 256))


def _h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(nodes: int, fanout: int, most: int) -> int:
    """Levels above ``nodes`` nodes up to a single one, ``most`` at most."""
    up = 0
    while nodes > 1 and up < most:
        nodes, up = -(-nodes // fanout), up + 1
    return up


def sweep_up(first: int, digests: list[str], levels: int, fanout: int) -> list[list[str]]:
    """Digests of ``levels`` levels over neighbouring nodes, the first at place ``first`` of its level."""
    found: list[list[str]] = [digests] + [[] for _ in range(levels)]
    queue = [(1, (first + i) // fanout, first + i, d) for i, d in enumerate(digests)] if levels else []
    while queue:  # in label order from the start, so it is a heap
        level, place, _, d = heapq.heappop(queue)
        children = [d]
        while queue and queue[0][:2] == (level, place):
            children.append(heapq.heappop(queue)[3])
        mine = _h(children)
        found[level].append(mine)
        if level < levels:
            heapq.heappush(queue, (level + 1, place // fanout, place, mine))
    return found


def sweep_down(first: int, found: list[list[str]], fanout: int, suffix: list[str]) -> list[list[str]]:
    """Proof of each node of the lowest level, given that of the single node of the highest."""
    top = len(found) - 1
    starts = [first // fanout ** i for i in range(top + 1)]
    queue: list[tuple] = [(-top, -starts[top], tuple(suffix))]
    out: dict[int, list[str]] = {}
    while queue:
        level, place, proof = heapq.heappop(queue)
        level, place = -level, -place
        if not level:
            out[place] = list(proof)
            continue
        lo = max(place * fanout, starts[level - 1])
        run = found[level - 1][lo - starts[level - 1]:(place + 1) * fanout - starts[level - 1]]
        for i in range(len(run)):
            own = "".join(run[:i]) + ":" + "".join(run[i + 1:])
            heapq.heappush(queue, (1 - level, -(lo + i), (own, *proof)))
    return [out[first + i] for i in range(len(found[0]))]


def _blocks(fanout: int) -> tuple[int, int]:
    """(levels, nodes) of a block."""
    levels = 1
    while fanout ** (levels + 1) <= BLOCK:
        levels += 1
    return levels, fanout ** levels


def _tiers(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """``nodes`` (tree, pos, digest, n) and the tiers above it, the last with one node for each tree."""
    levels, size = _blocks(fanout)

    def up(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        n = t.column("n")[0].as_py()
        first = t.column("pos")[0].as_py()
        top = sweep_up(first, t.column("digest").to_pylist(), _levels(n, fanout, levels), fanout)[-1]
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int64()), pa.array(top),
                         pa.array([-(-n // size)], pa.int64())], names=["tree", "pos", "digest", "n"])

    tiers = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        slim = tiers[-1].select("tree", "pos", "digest", "n")
        above = slim.groupBy("tree", F.floor(F.col("pos") / size).alias("block")).applyInArrow(
            up, "tree string, pos long, digest string, n long")
        tiers.append(materialize(nodes.sparkSession, above, "merkle_tier"))
        most = -(-most // size)
    return tiers


def _proofs(tiers: list[DataFrame], roots: DataFrame, fanout: int) -> DataFrame:
    """The first tier with ``proof``, ``subroot`` and ``root``, from ``roots`` (tree, pos, proof, subroot, root)."""
    levels, size = _blocks(fanout)
    above = roots
    for depth in range(len(tiers) - 1, 0, -1):
        tier = tiers[depth - 1]
        names = [c for c in tier.columns if c not in ("tree", "pos", "digest", "n")]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tier.schema)

        def down(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
            t = t.sort_by("pos")
            first, n = t.column("pos")[0].as_py(), t.column("n")[0].as_py()
            found = sweep_up(first, t.column("digest").to_pylist(), _levels(n, fanout, levels), fanout)
            proofs = sweep_down(first, found, fanout, told.column("proof")[0].as_py())
            rows = t.num_rows
            return (t.append_column("proof", pa.array(proofs, pa.list_(pa.string())))
                    .append_column("subroot", pa.array([told.column("subroot")[0].as_py()] * rows))
                    .append_column("root", pa.array([told.column("root")[0].as_py()] * rows)))

        left = tier.select("tree", "pos", "digest", "n", *names).groupBy("tree", F.floor(F.col("pos") / size).alias("block"))
        got = left.cogroup(above.groupBy("tree", F.col("pos").alias("block"))).applyInArrow(
            down, f"{schema}, proof {PROOF}, subroot string, root string")
        above = got if depth == 1 else materialize(tier.sparkSession, got.select("tree", "pos", "proof", "subroot", "root"),
                                                   "merkle_proofs")
    if len(tiers) == 1:  # single leaves only
        return tiers[0].join(above.drop("pos"), "tree")
    return above


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             id_col: str = "doc_id", group_col: str = "lang", fanout: int = 2,
             carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, group, leaf, subroot, root, proof) of every row, with the ``carry`` columns, computed on the row.

    Leaves ascend by id (nulls first) inside a group; equal ids are in the
    order of their digests, so repeated rows, which have equal digests, may
    stand for each other.  Groups ascend bytewise, the null group first.
    Neighbours in runs of ``fanout`` become their digest until one is left; a
    node alone in the last run is digested too, a lone leaf is its own root.
    Nulls, empty and long values are told apart by ``field``.  Columns other
    than ``fields`` are not looked at; an empty table has no rows.
    """
    spark = docs.sparkSession
    group = F.col(f"`{group_col}`").cast("string")
    rows = materialize(spark, docs.select(
        F.col(f"`{id_col}`").alias("id"), group.alias("group"), F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"),
        leaf_digest(*fields).alias("digest"),
        *[c.alias(f"with_{k}") for k, c in (carry or {}).items()]), "merkle_leaves")
    leaves = number_rows(rows, ["id", "digest"], "pos", by=("tree",), name="merkle_order")
    leaves = materialize(spark, leaves.join(leaves.groupBy(F.col("tree").alias("t")).agg(F.count(F.lit(1)).alias("n")),
                                            F.col("tree") == F.col("t")).drop("t"), "merkle_tier")
    tiers = _tiers(leaves, fanout)
    subroots = tiers[-1].select(F.col("tree").alias("below"), "digest")
    # the trees of the groups are the leaves of one tree more: "" (null) sorts first, "=" + name bytewise
    top = number_rows(subroots, ["below"], "pos", name="merkle_roots")
    top = materialize(spark, top.crossJoin(F.broadcast(subroots.agg(F.count(F.lit(1)).alias("n")))).select(
        F.lit("").alias("tree"), "pos", "digest", "n", "below"), "merkle_tier")
    above = _tiers(top, fanout)
    root = above[-1].select("tree", "pos", F.array().cast(PROOF).alias("proof"), F.lit("").alias("subroot"),
                            F.col("digest").alias("root"))
    groups = _proofs(above, root, fanout).select(
        F.col("below").alias("tree"), F.lit(0).cast("long").alias("pos"), "proof", F.col("digest").alias("subroot"), "root")
    groups = materialize(spark, groups, "merkle_groups")
    return _proofs(tiers, groups, fanout).select(
        "id", "group", F.col("digest").alias("leaf"), "subroot", "root", "proof",
        *[F.col(f"with_{k}").alias(k) for k in carry or {}])
