"""Hard negatives by inner product, from cover trees over norm-augmented candidates.

With one coordinate more, sqrt(M^2 - |x|^2), all candidates of a tree have the
norm M, and an inner product becomes a distance: |q' - x'|^2 = |q|^2 + M^2 - 2<q, x>.
A node of the tree has a centre and a covering radius, the largest distance to
a point below it; each level covers its points with a radius ``BASE`` times
smaller, by centres that lie further apart than that.  Centre distance and
radius bound every inner product below a node from both sides.

Search is best first: the node that may improve some query most is opened
next; queries whose window of scores lies outside a node's bounds, or whose
bound does not reach their last result, do not go down.  Points of opened
leaves are scored exactly, in whole numbers.

Candidates are dealt to regions, the nearest of at most ``REGIONS`` centres
(fitted on a bounded sample), and regions by hash to trees of about ``TREE``
points, so a region of any size is many trees.  Each task holds one tree at a
time and the queries of one block, and keeps the best results over its trees.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillgrid.llm.common import materialize

SAMPLE = 2048  # candidates that the region centres are fitted on, those of smallest hash
REGIONS = 32
TREE = 512  # points of a tree, about
LOOSE = 32  # points that a node holds without nodes of their own
BASE = 1.5
QUERIES_PER_BLOCK = 4096
_NONE = -(1 << 62)


def padded(vectors: list[list[int]], width: int) -> np.ndarray:
    """Rows of equal length; a shorter vector goes on with zeros."""
    if vectors and all(len(v) == width for v in vectors):
        return np.array(vectors, np.int64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows; they have to fit 64 bits."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T if most < 1 << 63 else (a.astype(object) @ b.T.astype(object)).astype(np.int64)


def farthest_first(y: np.ndarray, radius: float, most: int | None = None) -> tuple[list[int], np.ndarray]:
    """(centres, owner of each row): centres further apart than ``radius`` that cover all rows within it."""
    centres = [0]
    near, owner = np.linalg.norm(y - y[0], axis=1), np.zeros(len(y), np.int64)
    while near.max() > radius and (most is None or len(centres) < most):
        f = int(near.argmax())
        d = np.linalg.norm(y - y[f], axis=1)
        closer = d < near
        near[closer], owner[closer] = d[closer], len(centres)
        centres.append(f)
    return centres, owner


class CoverTree:
    """Nodes (centre, covering radius, children, loose points) over the rows of ``x``."""

    def __init__(self, x: np.ndarray):
        self.x, self.f = x, x.astype(np.float64)
        squares = (self.f * self.f).sum(axis=1)
        self.most = float(squares.max(initial=0.0))
        y = np.concatenate([self.f, np.sqrt(np.maximum(self.most - squares, 0))[:, None]], axis=1)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.loose: list[np.ndarray] = []
        work = [(0, np.arange(len(x)), -1)]
        while work:
            c, points, parent = work.pop()
            away = np.linalg.norm(y[points] - y[c], axis=1)
            r, me = float(away.max()), len(self.centre)
            self.centre.append(c)
            self.radius.append(r)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(me)
            if len(points) <= LOOSE or r == 0:
                self.loose.append(points)
                continue
            at = int(np.flatnonzero(points == c)[0])
            order = np.concatenate([[at], np.delete(np.arange(len(points)), at)])  # the node is its own first child
            points = points[order]
            centres, owner = farthest_first(y[points], r / BASE)
            sizes = np.bincount(owner)
            self.loose.append(points[sizes[owner] <= LOOSE // 8])  # too few for a node: scored with the node itself
            for i in np.flatnonzero(sizes > LOOSE // 8):
                work.append((int(points[centres[i]]), points[owner == i], me))


class Search:
    """Best ``k`` results of each item = (query, score window, same label or another), over any number of trees."""

    def __init__(self, queries: np.ndarray, labels: np.ndarray, keys: np.ndarray, item: np.ndarray, low: np.ndarray,
                 high: np.ndarray, same: bool, k: int):
        self.q, self.qf, self.labels, self.keys = queries, queries.astype(np.float64), labels, keys
        self.squares = (self.qf * self.qf).sum(axis=1)
        self.item, self.low, self.high, self.same, self.k = item, low, high, same, k
        self.score = np.full((len(item), k), _NONE, np.int64)
        self.id = np.zeros((len(item), k), np.int64)
        self.own = np.zeros((len(item), k), bool)
        self.opened = self.verified = 0

    def _floor(self, items: np.ndarray) -> np.ndarray:
        """What a score has to reach to matter for an item."""
        return np.maximum(self.score[items, -1], self.low[items])

    def tree(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, keys: np.ndarray) -> None:
        """Add the results among the points of one tree."""
        t = CoverTree(x)
        total = self.squares + t.most
        slack = 1e-9 * (float(total.max(initial=0.0)) + 1) + 1e-6
        queue: list[tuple] = []

        def offer(items: np.ndarray, nodes: list[int]) -> None:
            who, back = np.unique(self.item[items], return_inverse=True)
            away = np.sqrt(np.maximum(total[who][:, None] - 2 * (self.qf[who] @ t.f[[t.centre[n] for n in nodes]].T), 0))
            r = np.array([t.radius[n] for n in nodes])
            upper = ((total[who][:, None] - np.maximum(away - r, 0) ** 2) / 2 + slack)[back]
            lower = ((total[who][:, None] - (away + r) ** 2) / 2 - slack)[back]
            floor, high = self._floor(items)[:, None], self.high[items][:, None]
            gain = np.where((upper >= floor) & (lower <= high), np.minimum(upper, high) - floor, -1.0)
            for i, n in enumerate(nodes):
                on = gain[:, i] >= 0
                if on.any():
                    heapq.heappush(queue, (-float(gain[:, i].max()), n, items[on], upper[on, i]))

        if len(self.item) and len(x):
            offer(np.arange(len(self.item)), [0])
        while queue:
            _, n, items, upper = heapq.heappop(queue)
            items = items[upper >= self._floor(items)]  # results may have come closer since
            if not items.size:
                continue
            self.opened += 1
            if len(t.loose[n]):
                self._verify(items, t.loose[n], t, ids, labels, keys)
            if t.children[n]:
                offer(items, t.children[n])

    def _verify(self, items: np.ndarray, points: np.ndarray, t: CoverTree, ids: np.ndarray, labels: np.ndarray,
                keys: np.ndarray) -> None:
        who, back = np.unique(self.item[items], return_inverse=True)
        for lo in range(0, len(points), 256):
            p = points[lo:lo + 256]
            p = p[np.argsort(ids[p], kind="stable")]
            self.verified += len(who) * len(p)
            s = products(self.q[who], t.x[p])[back]
            fits = ((labels[p][None, :] == self.labels[who][:, None]) == self.same)[back]
            fits &= (s >= self._floor(items)[:, None]) & (s <= self.high[items][:, None])
            on = np.flatnonzero(fits.any(axis=1))
            if not on.size:
                continue
            s = np.where(fits[on], s[on], _NONE)
            first = np.argsort(-s, axis=1, kind="stable")[:, :self.k]  # equal scores stay in the order of ids
            at = items[on]
            score = np.concatenate([self.score[at], np.take_along_axis(s, first, 1)], axis=1)
            found = np.concatenate([self.id[at], ids[p][first]], axis=1)
            own = np.concatenate([self.own[at], keys[p][first] == self.keys[self.item[at]][:, None]], axis=1)
            best = np.lexsort((found, -score), axis=1)[:, :self.k]
            self.score[at], self.id[at], self.own[at] = (np.take_along_axis(a, best, 1) for a in (score, found, own))


def _regions(points: DataFrame) -> list[list[float]]:
    """Centres of the regions, spread over a bounded sample of the points."""
    sample = points.orderBy(F.xxhash64("gid"), "id").limit(SAMPLE).select("vec").toArrow().column(0).to_pylist()
    if not sample:
        return []
    y = padded(sample, max(map(len, sample))).astype(np.float64)
    centres, _ = farthest_first(y, 0.0, REGIONS)
    return y[centres].tolist()


def _forest(points: DataFrame) -> DataFrame:
    """``points`` with the tree of each (region, part)."""
    centres = _regions(points)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = b.column(3).to_pylist()
            width = max(len(centres[0]), *map(len, rows))
            c = np.zeros((len(centres), width))
            c[:, :len(centres[0])] = centres
            x = padded(rows, width).astype(np.float64)
            region = ((c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region, pa.int32())], [*b.schema.names, "region"])

    if not centres:
        return points.select("id", "label", "key", "vec", F.lit(0).alias("region"), F.lit(0).cast("long").alias("part"))
    placed = materialize(points.sparkSession, points.select("id", "label", "key", "vec").mapInArrow(
        nearest, "id long, label long, key long, vec array<long>, region int"), "negatives_placed")
    sizes = placed.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / F.lit(TREE)).alias("parts"))
    return placed.join(sizes, "region").select(
        "id", "label", "key", "vec", "region", F.expr("pmod(xxhash64(key, id), parts)").alias("part"))


def search(forest: DataFrame, items: list[tuple], *, same: bool, k: int, tasks: int) -> DataFrame:
    """(query, low, high, score, id, own): the best ``k`` of each item (query, key, label, vector, low, high).

    ``items`` is one block of queries and goes to every task; each task answers
    for its trees, and the answers of the tasks are merged by rank.
    """
    spark = forest.sparkSession
    names = sorted({i[0] for i in items})
    place = {q: n for n, q in enumerate(names)}
    of = {i[0]: i for i in items}
    given = spark.sparkContext.broadcast((
        names, [of[q][1] for q in names], [of[q][2] for q in names], [of[q][3] for q in names],
        [place[i[0]] for i in items], [i[4] for i in items], [i[5] for i in items]))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys, labels, vectors, item, low, high = given.value
        wide = max(map(len, vectors))
        found = None
        held: list[pa.RecordBatch] = []

        def take() -> None:
            nonlocal found
            t = pa.Table.from_batches(held)
            rows = t.column("vec").to_pylist()
            width = max(wide, *map(len, rows))
            if found is None or found.q.shape[1] < width:
                fresh = Search(padded(vectors, width), np.array(labels, np.int64), np.array(keys, np.int64),
                               np.array(item), np.array(low, np.int64), np.array(high, np.int64), same, k)
                if found is not None:
                    fresh.score, fresh.id, fresh.own = found.score, found.id, found.own
                found = fresh
            num = lambda c: t.column(c).to_numpy()
            found.tree(padded(rows, found.q.shape[1]), num("id"), num("label"), num("key"))
            held.clear()

        last = None
        for b in batches:
            at = list(zip(b.column("region").to_pylist(), b.column("part").to_pylist()))
            lo = 0
            for i, tree in enumerate(at):
                if tree != last:
                    if i > lo:
                        held.append(b.slice(lo, i - lo))
                    if held:
                        take()
                    lo, last = i, tree
            if len(at) > lo:
                held.append(b.slice(lo))
        if held:
            take()
        if found is None:
            return
        i, j = np.nonzero(found.score > _NONE)
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[n] for n in found.item[i]]), pa.array(found.low[i]), pa.array(found.high[i]),
             pa.array(found.score[i, j]), pa.array(found.id[i, j]), pa.array(found.own[i, j])],
            ["query", "low", "high", "score", "id", "own"])

    dealt = forest.repartition(tasks, "region", "part").sortWithinPartitions("region", "part", "id")
    got = dealt.mapInArrow(answer, "query string, low long, high long, score long, id long, own boolean")
    rank = Window.partitionBy("query", "low", "high").orderBy(F.desc("score"), "id")
    return got.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k)


def _bounds(low: int, high: int) -> tuple:
    """Window of negative scores n of a positive score p, in whole numbers: low * p <= 100 * n <= high * p."""
    hundreds, rest = F.expr("(positive_score - pmod(positive_score, 100L)) div 100"), F.expr("pmod(positive_score, 100L)")
    return hundreds * low + F.ceil(rest * low / F.lit(100)), hundreds * high + F.floor(rest * high / F.lit(100))


def mine(rows: DataFrame, *, is_anchor, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100),
         id_col: str = "id", label_col: str = "label", vector_col: str = "vec") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has a whole-number vector in each row; ``is_anchor`` is a condition
    on its columns.  An anchor's positives are the best ``positives`` other rows
    of its label by inner product; the negatives of each are the best
    ``negatives`` rows of other labels whose score is between the ``window``
    per cents of the positive's.  Equal scores are in the order of ids.

    Rows without id, label or vector take no part, nor do vectors with a null
    component.  Rows that repeat each other wholly count once.  A shorter
    vector goes on with zeros, an empty one scores 0 with all.  Scores have to
    fit 64 bits.  Other columns are not looked at; an anchor without positives,
    or a positive without negatives, has no rows, nor has an empty table.

    Of rows with equal vector and label only the first ids can be results, so
    a vector that many rows share is a few points, and one query.
    """
    spark = rows.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    vec = F.col(f"`{vector_col}`").cast("array<long>")
    whole = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                        vec.alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    whole = whole.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
                        & ~F.exists("vec", lambda x: x.isNull()))
    text = F.concat_ws(",", F.col("vec").cast("array<string>"))
    whole = materialize(spark, whole.groupBy("id", "label", "vec").agg(F.max("anchor").alias("anchor")).select(
        "*", F.md5(F.concat_ws("|", F.col("label").cast("string"), text)).alias("gid"),
        F.xxhash64("vec", "label").alias("key")), "negatives_rows")
    keep = max(positives + 1, negatives)
    first = Window.partitionBy("gid").orderBy("id")
    points = materialize(spark, whole.withColumn("n", F.row_number().over(first)).where(F.col("n") <= keep).select(
        "gid", "key", "id", "label", "vec"), "negatives_points")
    anchors = whole.where("anchor").select("gid", F.col("id").alias("anchor_id"))
    asked = materialize(spark, whole.where("anchor").groupBy("gid").agg(
        *[F.first(c).alias(c) for c in ("key", "label", "vec")]), "negatives_queries")
    forest = materialize(spark, _forest(points), "negatives_forest")
    blocks = max(1, -(-asked.count() // QUERIES_PER_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("gid"), F.lit(blocks)))
    out = None
    for n in range(blocks):
        block = asked.where(F.col("block") == n)
        queries = [tuple(r) for r in block.select("gid", "key", "label", "vec").collect()]  # about QUERIES_PER_BLOCK
        if not queries:
            continue
        best = search(forest, [(*q, _NONE + 1, 1 << 62) for q in queries], same=True, k=positives + 1, tasks=tasks)
        best = materialize(spark, best.select(F.col("query").alias("gid"), "score", F.col("id").alias("positive_id"), "own"),
                           "negatives_best")
        of_anchor = Window.partitionBy("gid", "anchor_id").orderBy(F.desc("score"), "positive_id")
        low, high = _bounds(*window)
        pairs = anchors.join(best, "gid").where(~(F.col("own") & (F.col("positive_id") == F.col("anchor_id"))))
        pairs = materialize(spark, pairs.withColumn("n", F.row_number().over(of_anchor)).where(
            F.col("n") <= positives).select("gid", "anchor_id", "positive_id", F.col("score").alias("positive_score")).select(
            "*", low.cast("long").alias("low"), high.cast("long").alias("high")).where("low <= high"), "negatives_pairs")
        by_gid = {q[0]: q for q in queries}
        items = [(*by_gid[r.gid], r.low, r.high) for r in pairs.select("gid", "low", "high").distinct().collect()]
        if not items:
            continue
        items.sort(key=lambda i: (i[0], i[4], i[5]))
        found = search(forest, items, same=False, k=negatives, tasks=tasks).select(
            F.col("query").alias("gid"), "low", "high", F.col("place").alias("rank"), F.col("id").alias("negative_id"),
            F.col("score").alias("negative_score"))
        part = materialize(spark, pairs.join(found, ["gid", "low", "high"]).select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives_found")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame(
        [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
