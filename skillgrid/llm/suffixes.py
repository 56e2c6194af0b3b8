"""Removal of long repeated byte strings by a distributed sort of suffixes.

Every string of ``span`` bytes is represented by one suffix: the one that
starts at its anchor, the least hashed k-gram inside it.  Equal strings have
their anchors at the same place, so it is enough to sort the suffixes at
anchors, and of these only those whose k-gram occurs elsewhere.

* Map: each task sorts its suffixes into runs, front-codes them (the length of
  the prefix shared with the previous one, then the rest) and cuts them by a
  second hash of the k-gram, so that all suffixes of a k-gram meet.
* Equal contexts in one run are repeats of each other: their places travel with
  the run, and one of them is sorted on.
* A k-gram with very many anchors is split: strings whose anchor lies within a
  range of distances from their start share all bytes that this range leaves
  certain, on both sides of the k-gram, and a hash of these deals them to groups.
* Reduce: the runs of a part are merged by a loser tree that carries known
  common prefixes and compares bytes beyond them only.
* The merged order gives the prefix lengths shared by neighbours; with the
  same for the bytes left of the anchors, every represented string is known to
  be unique or repeated.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgrid.llm.common import materialize, row_key, text_of
from skillgrid.llm.wordhash import _INV, _MULT, _mix, _powers, small_batches

SPAN = 400
GRAM = 96
RUN_BYTES = 8 << 20  # of the contexts in one sorted run
RANGE_SUFFIXES = 20_000  # aimed at, for one merge
CELLS = 1 << 22  # of the class matrix held at once
HOT_GRAM = 4_000  # anchors of one k-gram; beyond, they are split by the bytes around it
HOT_PIECES = 8  # that the distances from string start to anchor are then cut into
RUN_COLUMNS = ["part", "numbers", "rest", "left", "owners", "places", "repeat_owners", "repeat_places"]


class Anchors:
    """Finds, for every ``span`` bytes of a text, the least k-gram inside (the leftmost of equal ones)."""

    def __init__(self, span: int, gram: int):
        self.span, self.gram, self.width = span, gram, span - gram + 1
        self.up, self.down = _powers(_MULT, 1), _powers(_INV, 1)

    def hashes(self, buf: np.ndarray) -> np.ndarray:
        if len(buf) >= len(self.up):
            self.up, self.down = _powers(_MULT, 2 * len(buf)), _powers(_INV, 2 * len(buf))
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(buf * self.up[:len(buf)], dtype=np.uint64)])
            return _mix((total[self.gram:] - total[:-self.gram]) * self.down[:len(buf) - self.gram + 1])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(text number, anchor, first start, last start, k-gram hash); starts are the strings an anchor stands for."""
        long = [i for i, t in enumerate(texts) if len(t) >= self.span]
        if not long:
            return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
        buf = np.frombuffer(b"".join(texts[i] for i in long), np.uint8)
        h, w = self.hashes(buf), self.width
        # least hash of each window: minima from the left and from the right inside blocks of the window size
        pad = -len(h) % w
        blocks = np.concatenate([h, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, w)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(h) - w + 1
        least = np.minimum(right[:n], left[w - 1:w - 1 + n])
        sizes = np.array([len(texts[i]) for i in long])
        begin = np.cumsum(sizes) - sizes
        # runs of starts with one least value, inside one text
        change = np.concatenate([begin, np.flatnonzero(least[1:] != least[:-1]) + 1])
        lo = np.unique(change[change < n])
        text = np.searchsorted(begin, lo, side="right") - 1
        last = begin[text] + sizes[text] - self.span  # last start in the text
        hi = np.minimum(np.append(lo[1:], n) - 1, last)
        keep = lo <= hi
        lo, hi, text = lo[keep], hi[keep], text[keep]
        at = np.empty(len(lo), np.int64)
        for a in range(0, len(lo), 2048):
            view = lo[a:a + 2048, None] + np.arange(w)[None, :]
            at[a:a + 2048] = lo[a:a + 2048] + h[view].argmin(axis=1)
        tied = np.flatnonzero(at < hi)  # the anchor leaves the window and an equal k-gram follows
        if len(tied):
            parts = [(text, at, lo, hi)]
            ok = np.ones(len(lo), bool)
            ok[tied] = False
            parts = [(text[ok], at[ok], lo[ok], hi[ok])]
            for r in tied.tolist():
                a, b = int(lo[r]), int(hi[r])
                x = a + np.flatnonzero(h[a:b + w] == least[a])
                first = np.concatenate([[a], x[:-1] + 1])
                final = np.minimum(x, b)
                good = first <= b
                parts.append((np.full(good.sum(), text[r]), x[good], first[good], final[good]))
            text, at, lo, hi = (np.concatenate([p[i] for p in parts]) for i in range(4))
        off = begin[text]
        return np.array(long)[text], at - off, lo - off, hi - off, h[at]


def _pack_place(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Anchor, and its distances to the first and last start, in one number."""
    return at << 32 | (at - lo) << 16 | (at - hi)


def _anchor_rows(docs: DataFrame, id_col: str, text_col: str, span: int, gram: int) -> DataFrame:
    """(rk, kh, place): the anchors of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(span, gram)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in small_batches(texts):
                which, at, first, last, kh = find([t.encode("utf-8", "replace") for t in texts[lo:hi]])
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(which + lo)), pa.array(kh.view(np.int64)),
                    pa.array(_pack_place(at, first, last))], ["rk", "kh", "place"])

    return docs.select(row_key(id_col, text_col).alias("rk"), text_of(text_col).alias("body")).mapInArrow(
        run, "rk binary, kh long, place long")


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, step = known, 16
    while a[lo:lo + step] == b[lo:lo + step]:
        lo += step
        step *= 2
    while step > 1:
        half = step // 2
        if a[lo:lo + half] == b[lo:lo + half]:
            lo += half
            step -= half
        else:
            step = half
    return lo


class PrefixMerge:
    """Loser tree over sorted runs of (shared prefix with the previous of the run, key).

    Each entry carries the prefix it shares with the last winner.  Of two
    entries, that with the longer one is the smaller; only for equal lengths
    are bytes compared, and only beyond them.  Yields (shared prefix with the
    last winner, run, key).
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes]]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.head: list[bytes | None] = [None] * self.k
        self.known = [0] * self.k
        self.losers = [0] * self.k
        for i in range(len(runs)):
            self._next(i)
            self.known[i] = 0
        winners = list(range(self.k))
        tree = {self.k + i: i for i in winners}
        for n in range(self.k - 1, 0, -1):
            tree[n], self.losers[n] = self._match(tree[2 * n], tree[2 * n + 1])
        self.winner = tree[1] if self.k > 1 else 0

    def _next(self, i: int) -> None:
        got = next(self.runs[i], None)
        self.known[i], self.head[i] = got if got is not None else (0, None)

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix length is then that with the winner."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        p, q = self.known[a], self.known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        s = shared_prefix(x, y, p)
        a_first = s == len(x) or (s < len(y) and x[s] < y[s])
        win, lose = (a, b) if a_first else (b, a)
        self.known[lose] = s
        return win, lose

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        while self.head[self.winner] is not None:
            at = self.winner
            yield self.known[at], at, self.head[at]
            self._next(at)
            n = (at + self.k) // 2
            while n >= 1 and self.k > 1:
                at, self.losers[n] = self._match(at, self.losers[n])
                n //= 2
            self.winner = at


def _lcp(keys: list[bytes]) -> list[int]:
    return [0] + [shared_prefix(a, b) for a, b in zip(keys, keys[1:])]


def encode_run(records: list[tuple[bytes, bytes, bytes, int]]) -> tuple[bytes, ...]:
    """Sorted (key, left, row key, place) records as front-coded columns."""
    shared = _lcp([r[0] for r in records])
    rest = [r[0][s:] for r, s in zip(records, shared)]
    numbers = np.array([shared, [len(x) for x in rest], [len(r[1]) for r in records]], np.int32)
    return (zlib.compress(numbers.tobytes(), 1), zlib.compress(b"".join(rest), 1),
            zlib.compress(b"".join(r[1] for r in records), 1), b"".join(r[2] for r in records),
            np.array([r[3] for r in records], np.int64).tobytes())


def decode_run(numbers: bytes, rest: bytes, left: bytes, owners: bytes, places: bytes) -> tuple:
    """(iterator over (shared prefix, key), lefts, row keys, places) of a run."""
    shared, sizes, lefts = np.frombuffer(zlib.decompress(numbers), np.int32).reshape(3, -1).tolist()
    rest, left = zlib.decompress(rest), zlib.decompress(left)
    width = len(owners) // len(shared)

    def keys() -> Iterator[tuple[int, bytes]]:
        at, last = 0, b""
        for s, n in zip(shared, sizes):
            last = last[:s] + rest[at:at + n]
            at += n
            yield s, last

    cut = np.cumsum([0, *lefts]).tolist()
    return (keys(), [left[a:b] for a, b in zip(cut, cut[1:])],
            [owners[i * width:(i + 1) * width] for i in range(len(shared))], np.frombuffer(places, np.int64).tolist())


def _pieces(raw: bytes, kh: int, at: int, far: int, near: int, span: int,
            gram: int) -> Iterator[tuple[int, int, int]]:
    """(group, far, near): the starts of a frequent k-gram's anchor by ranges of their distance to it.

    A string that starts ``d`` bytes left of the anchor, ``low <= d <= high``, holds the ``low``
    bytes left of it and ``span - high`` from it on, so equal strings have equal groups.
    """
    step = -(-(span - gram + 1) // HOT_PIECES)
    for low in range(near - near % step, far + 1, step):
        high = min(low + step - 1, span - gram)
        known = raw[at - low:at + span - high]
        group = hashlib.blake2b(known, digest_size=8, key=low.to_bytes(4, "big")).digest()
        yield int.from_bytes(group, "big") ^ kh & 0xFFFFFFFFFFFFFFFF, min(far, high), max(near, low)


def _ranges(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[list[tuple[bytes, bytes, bytes, int]]]:
    """Unsorted runs of (group and key, left, row key, place) of the listed anchors, of bounded size."""
    out, size = [], 0
    for b in batches:
        for rk, body, hashes, places, hot in zip(*(b.column(i) for i in range(5))):
            raw, owner = body.as_py().encode("utf-8", "replace"), rk.as_py()
            for kh, place, often in zip(hashes.as_py(), places.as_py(), hot.as_py()):
                at, far, near = place >> 32, place >> 16 & 0xFFFF, place & 0xFFFF
                whole = ((kh & 0xFFFFFFFFFFFFFFFF, far, near),)
                for group, f, n in _pieces(raw, kh, at, far, near, span, gram) if often else whole:
                    out.append((group.to_bytes(8, "big") + raw[at:at - n + span], raw[at - f:at][::-1], owner,
                                at << 32 | f << 16 | n))
                    size += span + f - n
            if size >= RUN_BYTES:
                yield out
                out, size = [], 0
    if out:
        yield out


def _spans(owners: list[bytes], starts: list[int], ends: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(owners, pa.binary()), pa.array(starts, pa.int64()),
                                       pa.array(ends, pa.int64())], ["rk", "start", "end"])


def _part(group: np.ndarray, parts: int) -> np.ndarray:
    """Merge part of each group.  An anchor is the least of many hashes, so its bits are mixed again to spread evenly."""
    h = _mix(group + np.uint64(_MULT))
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _sorted_runs(span: int, gram: int, parts: int):
    """One record for each distinct context, sorted, cut by group and front-coded; with it the owners and places of
    all contexts that occur more than once in the run, which are repeated at every start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in _ranges(batches, span, gram):
            records.sort(key=lambda r: r[:2])
            part_of = _part(np.array([int.from_bytes(r[0][:8], "big") for r in records], np.uint64), parts).tolist()
            by_part: dict[int, tuple[list, list]] = {}
            for (_, same), p in zip(groupby(records, key=lambda r: r[:2]), _firsts(records, part_of)):
                one, *more = same
                firsts, repeats = by_part.setdefault(p, ([], []))
                firsts.append(one)
                if more:
                    repeats += [one, *more]
            coded = [(*encode_run(firsts), b"".join(r[2] for r in repeats),
                      np.array([r[3] for r in repeats], np.int64).tobytes()) for firsts, repeats in by_part.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(by_part), pa.int32()),
                 *(pa.array([c[i] for c in coded], pa.binary()) for i in range(len(RUN_COLUMNS) - 1))], RUN_COLUMNS)
    return run


def _firsts(records: list[tuple], values: list) -> Iterator:
    """The value of the first record of each context, of sorted records."""
    return (v for i, v in enumerate(values) if i == 0 or records[i][:2] != records[i - 1][:2])


def _cluster_spans(shared: list[int], lefts: list[bytes], places: list[int], span: int) -> list[tuple[int, int, int]]:
    """(member, start, end) of the repeated strings in a cluster of suffixes in sorted order.

    A string that starts d bytes left of an anchor is repeated if another member
    shares d bytes to the left and span - d to the right.  Members that share
    at least s bytes on one side are runs in sorted order, so both sides give a
    class number for each d, and equal pairs of classes are equal strings.
    """
    m = len(places)
    at = np.array([p >> 32 for p in places])
    far, near = np.array([p >> 16 & 0xFFFF for p in places]), np.array([p & 0xFFFF for p in places])
    if m == 2:
        lo = max(span - shared[1], int(near.max()))
        hi = min(shared_prefix(lefts[0], lefts[1]), int(far.min()))
        return [(i, int(at[i]) - hi, int(at[i]) - lo + span) for i in range(2)] if lo <= hi else []
    order = sorted(range(m), key=lefts.__getitem__)
    left_shared = np.array(_lcp([lefts[i] for i in order]))
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    right_shared = np.array([0, *shared[1:]])
    out: list[tuple[int, int, int]] = []
    last_start = np.full(m, -1)  # of an open run of distances
    step = max(1, CELLS // m)
    for a in range(int(near.min()), int(far.max()) + 2, step):
        d = np.arange(a, min(a + step, int(far.max()) + 2))
        right = np.cumsum(right_shared[:, None] < span - d[None, :], axis=0)
        left = np.cumsum(left_shared[:, None] < d[None, :], axis=0)[rank]
        code = right * (m + 1) + left
        off = (d[None, :] < near[:, None]) | (d[None, :] > far[:, None])
        code[off] = -1 - np.broadcast_to(np.arange(m)[:, None], code.shape)[off]
        by = np.argsort(code, axis=0, kind="stable")
        s = np.take_along_axis(code, by, axis=0)
        same = s[1:] == s[:-1]
        hit = np.zeros_like(off)
        np.put_along_axis(hit, by, np.concatenate([same, np.zeros((1, len(d)), bool)]) |
                          np.concatenate([np.zeros((1, len(d)), bool), same]), axis=0)
        for j in np.flatnonzero((hit != np.concatenate([(last_start >= 0)[:, None], hit[:, :-1]], axis=1)).any(axis=0)):
            for i in np.flatnonzero(hit[:, j] != (last_start >= 0)).tolist():
                if hit[i, j]:
                    last_start[i] = d[j]
                else:
                    out.append((i, int(at[i] - d[j] + 1), int(at[i] - last_start[i] + span)))
                    last_start[i] = -1
    return out


def _repeat_spans(owners: bytes, places: bytes, span: int) -> pa.RecordBatch:
    place = np.frombuffer(places, np.int64)
    width = len(owners) // max(1, len(place))
    at = place >> 32
    return _spans([owners[i * width:(i + 1) * width] for i in range(len(place))],
                  at - (place >> 16 & 0xFFFF), at - (place & 0xFFFF) + span)


def _merge(span: int, gram: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        runs = [decode_run(*(table.column(c)[i].as_py() for c in RUN_COLUMNS[1:6])) for i in range(table.num_rows)]
        taken = [0] * len(runs)
        found: tuple[list, list, list] = ([], [], [])
        group: list[tuple[int, int, int]] = []  # (shared with the previous, run, place in the run)

        def close() -> None:
            if len(group) > 1:
                mine = [runs[r] for _, r, _ in group]
                places = [x[3][i] for x, (_, _, i) in zip(mine, group)]
                lefts = [x[1][i] for x, (_, _, i) in zip(mine, group)]
                for member, start, end in _cluster_spans([s - 8 for s, _, _ in group], lefts, places, span):
                    found[0].append(mine[member][2][group[member][2]])
                    found[1].append(start)
                    found[2].append(end)

        for s, r, _ in PrefixMerge([x[0] for x in runs]):
            if s < 8 + gram:  # less than any string needs right of its anchor
                close()
                group = []
            group.append((s, r, taken[r]))
            taken[r] += 1
        close()
        return pa.Table.from_batches([_spans(*found), *(
            _repeat_spans(table.column("repeat_owners")[i].as_py(), table.column("repeat_places")[i].as_py(), span)
            for i in range(table.num_rows))])
    return run


def repeated_spans(docs: DataFrame, *, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(rk, start, end): bytes of document rows that are covered by repeated strings of ``span`` bytes."""
    spark = docs.sparkSession
    anchors = _anchor_rows(docs, id_col, text_col, span, gram)
    often = materialize(spark, anchors.groupBy("kh").count().where("count > 1").select(
        "kh", (F.col("count") > HOT_GRAM).alias("hot")), "repeated_grams")
    # a set: rows of equal id and text have one key, and each of them meets the anchors of one
    listed = materialize(spark, anchors.join(often, "kh").groupBy("rk").agg(
        F.collect_set(F.struct("kh", "place", "hot")).alias("anchors")).select(
        "rk", *[F.col("anchors")[c].alias(c) for c in ("kh", "place", "hot")]), "anchor_lists")
    total = listed.agg(F.coalesce(F.sum(F.size("place")), F.lit(0))).first()[0]
    parts = max(1, -(-total // RANGE_SUFFIXES))
    texts = docs.select(row_key(id_col, text_col).alias("rk"), text_of(text_col).alias("body"))
    with_lists = texts.join(listed.hint("shuffle_hash"), "rk").select("rk", "body", "kh", "place", "hot")
    return with_lists.mapInArrow(
        _sorted_runs(span, gram, parts), "part int, " + ", ".join(f"{c} binary" for c in RUN_COLUMNS[1:])
    ).groupBy("part").applyInArrow(_merge(span, gram), "rk binary, start long, end long")


def remove_repeats(docs: DataFrame, *, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``docs`` without text, with ``kept`` (the remaining bytes), ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    Each byte covered by a ``span``-byte string that also starts anywhere
    else goes; strings do not cross documents, and are judged on the input.
    Null, empty and shorter texts lose nothing.  Repeated rows are repeats of
    each other.
    """
    spark = docs.sparkSession
    found = materialize(spark, repeated_spans(docs, span=span, gram=gram, id_col=id_col, text_col=text_col),
                        "repeated_spans")
    lists = found.groupBy("rk").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    new = ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    cols = [c for c in docs.columns if c != text_col and c not in new]
    joined = docs.select(row_key(id_col, text_col).alias("rk"), text_of(text_col).alias("body"),
                         F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in cols]).alias("row")).join(
        lists.hint("shuffle_hash"), "rk", "left").select("row", "body", "spans")
    schema = T.StructType([joined.schema["row"], T.StructField("kept", T.BinaryType()),
                           *[T.StructField(c, T.LongType()) for c in new[1:4]], T.StructField(new[4], T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_cut(t.as_py().encode("utf-8", "replace"), s.as_py()) for t, s in zip(b.column(1), b.column(2))]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["row", *new])

    return joined.mapInArrow(run, schema).select(*[F.col("row")[c].alias(c) for c in cols], *new)


def _cut(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int, int, int, str]:
    kept, at, removed, n = [], 0, 0, 0
    for s in sorted((x["start"], x["end"]) for x in spans or ()):
        if s[0] > at or n == 0:
            kept.append(raw[at:s[0]])
            n, at, removed = n + 1, s[1], removed + s[1] - s[0]
        elif s[1] > at:
            removed, at = removed + s[1] - at, s[1]
    kept.append(raw[at:])
    out = b"".join(kept)
    return out, len(raw), removed, n, hashlib.sha256(out).hexdigest()
