"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over fixed passages of all documents.
2. A randomised SVD of the TF-IDF passage matrix A, distributed: tasks form
   Y = A Omega and add up Z = A^T Y; the driver gets that one matrix of fixed
   size and takes the right singular vectors of A from it (the Nystrom form of
   the randomised decomposition, so one pass is enough).  A word's weight is
   its inverse frequency over the length of its column, so that the frequent
   words of a language do not fill the whole latent space.
3. Every window of every document is folded into the latent space and compared
   by cosine with the benchmark items of about its length: with those that it
   would cover, and with those that it would lie inside of (a passage among
   words of another language is found by the latter).
4. Candidates are checked on their words: longest common subsequence, and for
   paraphrases also the item's answer part.

The benchmark is the query set: it is sent to the tasks in blocks of bounded
size, and each block is searched against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.common import materialize
from skillgrid.llm.wordhash import PUNCTUATION, WordHasher, small_batches

DIMS = 1 << 14  # hashed vocabulary
RANK, SKETCH = 64, 80  # latent dimensions; columns of the random test matrix, some more for accuracy
PASSAGE = 32  # words of a training passage
STRIDE = 8  # words between window starts
SIGNS = 8  # 64-bit numbers of a region's word bits
BESIDE = 4  # windows whose missing words are counted at once
MARGIN = 4  # words allowed beyond an item's own length when words are compared
BLOCK_ITEMS, BLOCK_BYTES = 4096, 8 << 20  # of the benchmark sent at once


@dataclass
class Rules:
    """Decision limits."""

    min_cosine: float = 0.2  # of a candidate, in the latent space; low, as the checks on the words are exact
    copy_share: float = 0.80  # common subsequence / item words: a copy
    paraphrase_share: float = 0.60  # from here a paraphrase, if the answer agrees
    answer_part: float = 0.25  # of the item, at its end, is its answer
    answer_share: float = 0.60  # common subsequence / answer words


def _features(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint64(50)).astype(np.int64)


def _passages(first: np.ndarray, size: int) -> np.ndarray:
    """Starts of consecutive runs of ``size`` words that do not cross texts."""
    return np.concatenate([np.arange(a, b, size) for a, b in zip(first[:-1], first[1:])] or [np.zeros(0, np.int64)])


def _texts(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 20):
    for b in batches:
        texts = b.column(column).to_pylist()
        for lo, hi in small_batches(texts, limit):
            yield b, lo, texts[lo:hi]


def _hashed(hasher: WordHasher, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words and the first word of each text, in runs of texts that fit the cache."""
    ids, first, n = [], [np.zeros(1, np.int64)], 0
    for lo, hi in small_batches(texts, 1 << 16):
        words, starts = hasher(texts[lo:hi])
        ids.append(words)
        first.append(starts[1:] + n)
        n += len(words)
    return np.concatenate(ids), np.concatenate(first)


def passage_frequencies(docs: DataFrame, *, text_col: str = "text") -> np.ndarray:
    """Weight of each hashed word, from the passages of all documents that hold it.

    The inverse passage frequency, divided by the (binary) length of the word's column.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, n = WordHasher(drop=PUNCTUATION), np.zeros(DIMS, np.int64), 0
        for _, _, texts in _texts(batches, 0):
            ids, first = _hashed(hasher, texts)
            starts = _passages(first, PASSAGE)
            which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
            pairs = np.sort(which * DIMS + _features(ids))  # (passage, word), each counted once
            seen += np.bincount(pairs[np.diff(pairs, prepend=-1) != 0] % DIMS, minlength=DIMS)
            n += len(starts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS, dtype=np.int32)),
                                          pa.array(np.concatenate([[n], seen]))], ["f", "n"])

    rows = docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n"))
    count = np.zeros(DIMS + 1)
    for r in rows.collect():  # DIMS + 1 rows
        count[r.f + 1] = r.n
    return np.log((1 + count[0]) / (1 + count[1:])) / np.sqrt(1 + count[1:])


def _test_matrix() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((DIMS, SKETCH)).astype(np.float32)


def _add_sketch(z: np.ndarray, omega: np.ndarray, f: np.ndarray, starts: np.ndarray) -> None:
    """Add A^T (A Omega) of some passages to ``z``; both matrices have a row for each column of Omega.

    One column at a time: its numbers stay in the cache, and no words x columns array is formed.
    """
    which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(f))))
    order = np.argsort(f.astype(np.uint16), kind="stable")  # rows of A Omega are added up by word
    sorted_f, passage = f[order], which[order]
    at = np.flatnonzero(np.diff(sorted_f, prepend=-1))
    words, held = sorted_f[at], np.empty(len(f), np.float32)
    for column, total in zip(omega, z):
        y = np.add.reduceat(np.take(column, f, out=held, mode="clip"), starts)
        total[words] += np.add.reduceat(np.take(y, passage, out=held, mode="clip"), at)


def latent_map(docs: DataFrame, idf: np.ndarray, *, text_col: str = "text") -> np.ndarray:
    """DIMS x RANK map into the latent space, by a randomised SVD over all passages.

    Columns are right singular vectors with the word weights folded in, so a
    window's place is the plain sum over its words.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(idf)  # DIMS numbers
    cols = [f"z{i}" for i in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        omega = np.ascontiguousarray((_test_matrix() * weight[:, None]).astype(np.float32).T)
        hasher, z = WordHasher(drop=PUNCTUATION), np.zeros((SKETCH, DIMS))
        for _, _, texts in _texts(batches, 0, 1 << 21):
            ids, first = _hashed(hasher, texts)
            if not len(ids):
                continue
            _add_sketch(z, omega, _features(ids), _passages(first, PASSAGE))
        z *= weight
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS, dtype=np.int32)), *map(pa.array, z)], ["f", *cols])

    # tasks' matrices are added row by row, so no reducer holds more than its running sums
    rows = docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "f int, " + ", ".join(f"{c} double" for c in cols))
    table = rows.groupBy("f").agg(*[F.sum(c).alias(c) for c in cols]).toArrow()  # DIMS rows
    if not table.num_rows:
        return np.zeros((DIMS, RANK), np.float32)
    z = np.zeros((DIMS, SKETCH))
    z[table.column("f").to_numpy()] = np.stack([table.column(c).to_numpy() for c in cols], axis=1)
    core = _test_matrix().astype(np.float64).T @ z  # Omega^T (A^T A) Omega
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > max(value.max(), 0) * 1e-10
    if not good.any():
        return np.zeros((DIMS, RANK), np.float32)
    u, _, _ = np.linalg.svd(z @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    out = np.zeros((DIMS, RANK))
    out[:, :min(RANK, u.shape[1])] = u[:, :RANK]
    return (out * idf[:, None]).astype(np.float32)


@dataclass
class Items:
    """A block of the benchmark, ready for the search."""

    numbers: list
    words: list = field(default_factory=list)  # ids of each item's words
    windows: dict = field(default_factory=dict)  # strides of a window: the items sought by it
    places: np.ndarray | None = None

    @classmethod
    def build(cls, rows: list[tuple], latent: np.ndarray) -> Items:
        ids, first = WordHasher(drop=PUNCTUATION)([t for _, t in rows])
        spans = [(n, ids[a:b]) for (n, _), a, b in zip(rows, first[:-1], first[1:]) if b > a]
        out = cls([n for n, _ in spans], [w for _, w in spans])
        for i, w in enumerate(out.words):
            for size in _windows(len(w)):
                out.windows.setdefault(size, []).append(i)
        if spans:
            p = np.stack([latent[_features(w)].sum(axis=0) for w in out.words])
            out.places = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
        return out


def _windows(n_words: int) -> set[int]:
    """Strides of the windows an item is sought by.

    The larger covers the item wherever it starts, in steps of about a third;
    the smaller lies wholly inside it.
    """
    need, size = -(-n_words // STRIDE), 1
    while size < need:
        size = max(size + 1, size * 4 // 3)
    return {size + (1 if n_words > STRIDE else 0), max(1, (n_words - STRIDE + 1) // STRIDE)}


def _margin(n_words: int, size: int) -> int:
    """Words around a window that can belong to the item."""
    return max(0, n_words - size * STRIDE) + MARGIN


def common_subsequence(masks: dict[int, int], full: int, words: list[int]) -> int:
    """Length of the longest common subsequence; ``masks`` has the places of each word of the item as bits."""
    v = full
    for w in words:
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return full.bit_count() - v.bit_count()


def _masks(words: np.ndarray) -> tuple[dict[int, int], int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out, (1 << len(words)) - 1


def _signs(f: np.ndarray) -> np.ndarray:
    """One of 64 * SIGNS bits for each hashed word, as SIGNS numbers."""
    out = np.zeros((len(f), SIGNS), np.uint64)
    out[np.arange(len(f)), (f >> 6) & (SIGNS - 1)] = np.uint64(1) << (f & 63).astype(np.uint64)
    return out


def _stride_sums(place: np.ndarray, f: np.ndarray, starts: np.ndarray, block: int = 4096) -> np.ndarray:
    """Sum of the places of each stride's words, by the words' place in the stride, in blocks that fit the cache."""
    out = np.empty((len(starts), place.shape[1]), np.float32)
    sizes = np.diff(np.append(starts, len(f)))
    whole, held = np.flatnonzero(sizes == STRIDE), np.empty((min(block, len(starts)), place.shape[1]), np.float32)
    for lo in range(0, len(whole), block):
        some = whole[lo:lo + block]
        at, row = starts[some], held[:len(some)]
        rest = place[f[at + 1]]
        for j in range(2, STRIDE):
            rest += np.take(place, f[at + j], axis=0, out=row, mode="clip")
        out[some] = np.take(place, f[at], axis=0, out=row, mode="clip") + rest
    cut = np.flatnonzero(sizes != STRIDE)  # at the end of a text
    if len(cut):
        n = sizes[cut]
        edge = np.cumsum(n) - n
        out[cut] = np.add.reduceat(place[f[np.arange(n.sum()) - np.repeat(edge - starts[cut], n)]], edge, axis=0)
    return out


def _near(cosine: np.ndarray, min_cosine: float, missing: np.ndarray, wanted: np.ndarray,
          limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) of the pairs that are near enough and may have enough of the item's words.

    ``missing`` has, for each window, the bits that no word of its region sets:
    a bit that the item wants there is a word it lacks.  What no region of
    ``BESIDE`` neighbours sets is counted first, for all of them at once.
    """
    n = len(missing)
    shared = np.full((-(-n // BESIDE), BESIDE, SIGNS), ~np.uint64(0))
    shared.reshape(-1, SIGNS)[:n] = missing
    shared = np.ascontiguousarray(np.bitwise_and.reduce(shared, axis=1).T)
    at, item = [], []
    bits, count = np.empty(shared.shape[1], np.uint64), np.empty(shared.shape[1], np.uint8)
    for i, most in enumerate(limit):
        lacks = np.zeros(shared.shape[1], np.uint8)  # past 255 it starts anew, and only lets a pair through
        for row, want in zip(shared, wanted[i]):
            if want:
                lacks += np.bitwise_count(np.bitwise_and(row, want, out=bits), out=count)
        some = (np.flatnonzero(lacks <= most)[:, None] * BESIDE + np.arange(BESIDE)).ravel()
        some = some[some < n]
        at.append(some[cosine[some, i] >= min_cosine])
        item.append(np.full(len(at[-1]), i))
    at, item = np.concatenate(at), np.concatenate(item)
    can = np.bitwise_count(missing[at] & wanted[item]).sum(axis=1, dtype=np.int64) <= limit[item]
    return at[can], item[can]


def _local_words(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each item: number of a hashed word within the item (the last column: not in it), and how often it occurs."""
    wide = max(len(np.unique(_features(w))) for w in words) + 1
    local, counts = np.full((len(words), DIMS), wide - 1, np.int16), np.zeros((len(words), wide), np.int64)
    for i, w in enumerate(words):
        f, n = np.unique(_features(w), return_counts=True)
        local[i, f] = np.arange(len(f))
        counts[i, :len(f)] = n
    return local, counts


def _words_in_common(f: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, local: np.ndarray,
                     counts: np.ndarray, block: int = 8192) -> np.ndarray:
    """Size of the multiset intersection of each region's words with its item's, taken in blocks."""
    out, wide = np.zeros(len(begin), np.int64), counts.shape[1]
    for lo in range(0, len(begin), block):
        b, e, i = begin[lo:lo + block], end[lo:lo + block], item[lo:lo + block]
        row = np.repeat(np.arange(len(b)), e - b)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(e - b) - (e - b), e - b) + b[row]
        seen = np.bincount(row * wide + local[i[row], f[pos]], minlength=len(b) * wide).reshape(-1, wide)
        out[lo:lo + block] = np.minimum(seen, counts[i]).sum(axis=1)
    return out


def search(docs: DataFrame, items: Items, latent: np.ndarray, rules: Rules, *, id_col: str, text_col: str) -> DataFrame:
    """One row per (document, item of this block) that is found, the best place of the pair.

    Columns: id, item, share, answer, cosine, word (first word of the window).
    """
    sc = docs.sparkSession.sparkContext
    # block size is bounded; the map is of fixed size.  Plain lists and arrays: a broadcast class would be
    # sent by name, and executors need not have this package
    shared = sc.broadcast((items.numbers, items.words, items.windows, items.places, latent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *parts, place = shared.value
        block = Items(*parts)
        hasher = WordHasher(drop=PUNCTUATION)
        masks = [_masks(w) for w in block.words]
        answers = [_masks(w[len(w) - max(1, round(len(w) * rules.answer_part)):]) for w in block.words]
        lengths = np.array([len(w) for w in block.words])
        local, counts = _local_words(block.words)
        wanted = np.stack([np.bitwise_or.reduce(_signs(_features(w)), axis=0) for w in block.words])
        for b, lo, texts in _texts(batches, 1):
            ids, first = _hashed(hasher, texts)
            if not len(ids):
                continue
            best: dict[tuple[int, int], tuple] = {}
            f, starts = _features(ids), _passages(first, STRIDE)
            owner = np.searchsorted(first, starts, side="right") - 1
            last = np.searchsorted(starts, first[owner + 1])  # strides before the end of the text
            sums = np.zeros((len(starts) + 1, place.shape[1]), np.float32)
            np.cumsum(_stride_sums(place, f, starts), axis=0, out=sums[1:])
            near_end = last - np.arange(len(starts))  # strides from here to the end of the text
            signs = np.bitwise_or.reduceat(_signs(f), starts, axis=0)
            ends = np.append(starts, len(ids))
            for size, group in block.windows.items():
                which = np.array(group)
                margin = np.array([_margin(n, size) for n in lengths])
                reach = -(-int(margin[which].max()) // STRIDE)
                hi = np.minimum(np.arange(len(starts)) + size, last)
                w = np.empty((len(starts), sums.shape[1]), np.float32)
                if len(starts) > size:
                    np.subtract(sums[size:], sums[:-size], out=w[:len(starts) - size + 1])
                short = np.flatnonzero(near_end < size)  # windows cut by the end of the text
                w[short] = sums[hi[short]] - sums[short]
                w /= np.maximum(np.sqrt(np.einsum("ij,ij->i", w, w)), 1e-12)[:, None]
                cosine = w @ block.places[which].T
                around = signs.copy()
                for step in range(-reach, size + reach):
                    lo_, hi_ = max(0, -step), min(len(starts), len(starts) - step)
                    around[lo_:hi_] |= signs[lo_ + step:hi_ + step]
                at, item = _near(cosine, rules.min_cosine, ~around, wanted[which],
                                 lengths[which] * (1 - rules.paraphrase_share))
                if not len(at):
                    continue
                near, item = cosine[at, item], which[item]
                begin = np.maximum(starts[at] - margin[item], first[owner[at]])
                end = np.minimum(ends[hi[at]] + margin[item], first[owner[at] + 1])
                need = lengths[item] * rules.paraphrase_share
                # the words in common, as multisets, bound the common subsequence from above
                can = _words_in_common(f, begin, end, item, local, counts) >= need
                for k in np.flatnonzero(can).tolist():
                    i, region = int(item[k]), ids[begin[k]:end[k]].tolist()
                    share = common_subsequence(*masks[i], region) / len(block.words[i])
                    if share < rules.paraphrase_share:
                        continue
                    answer = common_subsequence(*answers[i], region) / answers[i][1].bit_count()
                    if share < rules.copy_share and answer < rules.answer_share:
                        continue
                    d = int(owner[at[k]])
                    found = (share, answer, float(near[k]), -int(begin[k] - first[d]))
                    if found > best.get((d, i), (0.0,)):
                        best[d, i] = found
            if best:
                keys = list(best)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array([lo + d for d, _ in keys])),
                    pa.array([block.numbers[i] for _, i in keys], pa.int64()),
                    pa.array([best[k][0] for k in keys]), pa.array([best[k][1] for k in keys]),
                    pa.array([best[k][2] for k in keys]), pa.array([-best[k][3] for k in keys], pa.int64())],
                    ["id", "item", "share", "answer", "cosine", "word"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(
        run, f"id {kind}, item long, share double, answer double, cosine double, word long")


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in blocks of bounded count and bytes, each brought to the driver by itself."""
    rows = benchmark.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).where("t is not null")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    parts = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for p in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p)
        yield sorted(((r.i, r.t) for r in part.toLocalIterator()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, rules: Rules | None = None, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs (id, item) of documents that hold a benchmark item, with their scores.

    A pair is a copy if the common subsequence has ``copy_share`` of the item's
    words, or a paraphrase from ``paraphrase_share`` on if the item's answer is
    found too.  Empty or null texts and items match nothing; items with equal
    texts are all reported; repeated document rows give repeated pairs.
    """
    rules = rules or Rules()
    idf = passage_frequencies(docs, text_col=text_col)
    latent = latent_map(docs, idf, text_col=text_col)
    out = None
    for block in _blocks(benchmark, item_col, item_text_col):
        items = Items.build(block, latent)
        if not items.words:
            continue
        found = search(docs, items, latent, rules, id_col=id_col, text_col=text_col)
        out = found if out is None else out.union(found)
    if out is None:
        kind = docs.schema[id_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame(
            [], f"id {kind}, item long, share double, answer double, cosine double, word long")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, rules: Rules | None = None, id_col: str = "doc_id",
                  text_col: str = "text", **names) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item.

    Rows are told apart by a number given once, when the rows are written.
    """
    spark = docs.sparkSession
    cols = docs.columns
    rows = materialize(spark, docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"),
                                          F.col(f"`{text_col}`").alias("text"))
                       .withColumn("uid", F.monotonically_increasing_id()), "numbered")
    bad = contaminated(rows, benchmark, rules=rules, id_col="uid", text_col="text", **names)
    bad = materialize(spark, bad.select(F.col("id").alias("uid")).distinct(), "contaminated")
    return rows.join(bad, "uid", "left_anti").select(*[F.col("row")[c].alias(c) for c in cols])
