"""SimHash near-duplicates found by meeting in the middle of the Hamming ball.

Every fingerprint emits all its variants within half the maximum distance; two
fingerprints within the maximum distance share a variant.  Variants are
shuffled by their leading bits: a fingerprint goes once to each bucket that
one of its variants falls into, and the variants themselves are made there, so
the shuffle carries tens of rows for a fingerprint instead of thousands.
Buckets with too many variants are dealt again by further bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgrid.llm.common import materialize
from skillgrid.llm.components import components

BITS = 64
BUCKET_FINGERPRINTS = 500  # aimed at, on average
BUCKET_VARIANTS = 6_000_000  # above this a bucket is dealt by further bits
DEEPER_BITS = 6


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of the lower-cased words; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        whole = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[s:e], 42) for s, e in
                  zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 65536):  # bounded memory on very long texts
        h = np.array(hashes[lo:lo + 65536], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, *, shingle: int = 4, text_col: str = "text",
                      keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all by default) with ``fp``, the fingerprint as a signed long."""
    names = [c for c in (keep if keep is not None else docs.columns) if c != "fp"]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.empty(b.num_rows, np.uint64)
            for lo in range(0, b.num_rows, 256):
                for i, t in enumerate(b.column(0).slice(lo, 256).to_pylist()):
                    fps[lo + i] = fingerprint(t, shingle)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps.view(np.int64))], [f.name for f in schema])

    # a clashing "fp" column of the input is replaced
    return docs.select(F.col(f"`{text_col}`").alias("body"), *[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def _masks(positions: range, radius: int) -> np.ndarray:
    """All 64-bit masks with at most ``radius`` of the given bits set."""
    out = [sum(1 << p for p in chosen) for k in range(radius + 1) for chosen in combinations(positions, k)]
    return np.array(out, dtype=np.uint64)


def _deal(items: DataFrame, depth: int, more: int, radius: int) -> DataFrame:
    """Send (fp, used) items to the buckets of the next ``more`` bits below ``depth``.

    ``used`` counts the bits a variant has changed so far; at most ``radius``.
    """
    masks = _masks(range(BITS - depth - more, BITS - depth), radius).view(np.int64).tolist()
    flip = F.explode(F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>"))
    dealt = items.select("fp", "used", "path", flip.alias("mask")).withColumn(
        "used", (F.col("used") + F.bit_count("mask")).cast("int")).where(F.col("used") <= radius)
    path = F.col("path").bitwiseXOR(F.col("mask"))
    return dealt.select("fp", "used", path.alias("path"), F.shiftrightunsigned(path, BITS - depth - more).alias("bucket")
                        if depth + more else F.lit(0).cast("long").alias("bucket"))


def _collide(depth: int, radius: int):
    """Meet of one bucket: (a, b) links that span each group of fingerprints with a common variant.

    Members of such a group are all within twice the radius of each other, so
    a star of links loses nothing; stars are then contracted to one root for
    each connected part of the bucket.
    """
    left = BITS - depth
    low = np.uint64((1 << left) - 1) if left < BITS else np.uint64(2**64 - 1)

    def run(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        used = table.column("used").to_numpy()
        order = np.argsort(fps, kind="stable")
        fps, used = fps[order], used[order]
        values, owners = [], []
        for k in range(radius + 1):
            own = np.flatnonzero(used == k)
            masks = _masks(range(left), radius - k)
            values.append(((fps[own] & low)[:, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(own.astype(np.int32), len(masks)))
        value, owner = np.concatenate(values), np.concatenate(owners)
        at = np.argsort(value, kind="stable")
        value, owner = value[at], owner[at]
        same = np.flatnonzero(value[1:] == value[:-1])
        a, b = owner[same], owner[same + 1]  # neighbours in a run of equal variants
        # every member of a run is within 2 * radius of the others; checked all the same
        near = np.bitwise_count(fps[a] ^ fps[b]) <= 2 * radius
        root = _contract(len(fps), a[near], b[near])
        linked = np.flatnonzero(root != np.arange(len(fps)))
        return pa.table({"a": fps[linked].view(np.int64), "b": fps[root[linked]].view(np.int64)})

    return run


def _contract(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable, for each of n nodes."""
    root = np.arange(n)
    if len(a):
        code = np.unique(np.minimum(a, b).astype(np.int64) * n + np.maximum(a, b))
        a, b = code // n, code % n
    while len(a):
        m = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        np.minimum.at(new, root[a], m)
        np.minimum.at(new, root[b], m)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def near_links(fps: DataFrame, *, max_bits: int = 4) -> DataFrame:
    """Links (a, b) that span all pairs of the distinct ``fp`` values within ``max_bits`` bits.

    ``max_bits`` is even, so that the two half balls meet exactly.
    """
    if max_bits % 2:
        raise ValueError("max_bits must be even: both fingerprints emit variants within half of it")
    radius, n = max_bits // 2, fps.count()
    depth = min(BITS - DEEPER_BITS, max(0, math.ceil(math.log2(max(1, n / BUCKET_FINGERPRINTS)))))
    items = _deal(fps.select("fp", F.lit(0).alias("used"), F.col("fp").alias("path")), 0, depth, radius)
    spark, out = fps.sparkSession, None
    while True:
        sizes = [len(_masks(range(BITS - depth), radius - k)) for k in range(radius + 1)]
        weight = F.sum(F.element_at(F.array(*[F.lit(s).cast("long") for s in sizes]), F.col("used") + 1))
        full = items.groupBy("bucket").agg(weight.alias("n")).where(F.col("n") > BUCKET_VARIANTS).select("bucket")
        full = materialize(spark, full, "full_buckets")
        last = depth >= BITS - DEEPER_BITS or full.isEmpty()
        here = items if last else items.join(full, "bucket", "left_anti")
        found = here.select("bucket", "fp", "used").groupBy("bucket").applyInArrow(_collide(depth, radius), "a long, b long")
        out = found if out is None else out.union(found)
        if last:
            return out.distinct()
        deeper = items.join(full, "bucket", "left_semi").select("fp", "used", "path")
        items = materialize(spark, _deal(deeper, depth, DEEPER_BITS, radius), "deeper_buckets")
        depth += DEEPER_BITS


def near_groups(fps: DataFrame, *, max_bits: int = 4) -> DataFrame:
    """(fp, group) for the distinct ``fp`` values: the smallest fingerprint reachable over near links."""
    roots = components(near_links(fps, max_bits=max_bits))
    joined = fps.select("fp").join(roots, F.col("fp") == F.col("node"), "left")
    return joined.select("fp", F.coalesce("root", "fp").alias("group"))


def simhash_components(docs: DataFrame, *, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the smallest id reachable.

    Texts without words have fingerprint 0 and are linked like any other.
    Repeated rows fall into one component.  Rows with a null id have the
    component of their fingerprint; a component of null ids only has a null id.
    """
    spark = docs.sparkSession
    rows = materialize(spark, with_fingerprints(docs, shingle=shingle, text_col=text_col, keep=[id_col]), "fingerprints")
    each = materialize(spark, rows.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprint_ids")
    groups = materialize(spark, each.join(near_groups(each, max_bits=max_bits), "fp"), "fingerprint_groups")
    least = groups.groupBy("group").agg(F.min("least").alias("component_id"))
    named = materialize(spark, groups.join(least, "group").select("fp", "component_id"), "fingerprint_components")
    return rows.join(named, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, *, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every near-duplicate group, that with the smallest id.

    Null ids come last; rows with equal ids are told apart by a number given
    once, when the fingerprinted rows are written.
    """
    spark = docs.sparkSession
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    rows = with_fingerprints(packed, shingle=shingle, keep=["row"]).withColumn("uid", F.monotonically_increasing_id())
    rows = materialize(spark, rows, "fingerprinted")
    order = F.struct(F.col("row")[id_col].isNull().alias("none"), F.col("row")[id_col].alias("id"), "uid")
    first = materialize(spark, rows.groupBy("fp").agg(F.min(order).alias("first")), "fingerprint_first")
    groups = first.join(near_groups(first, max_bits=max_bits), "fp")
    stay = groups.groupBy("group").agg(F.min("first").alias("first")).select(F.col("first.uid").alias("uid"))
    return rows.join(stay, "uid", "left_semi").select(*[F.col("row")[c].alias(c) for c in names])
