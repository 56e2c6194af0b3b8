"""Katz backoff scores of whole texts: a bigram model over the corpus itself.

Counts are discounted by Good-Turing, and a context's backoff weight is
normalised exactly, so that its probabilities add up to 1:

    P(w | h) = d(c) c(h, w) / c(h)        if the pair was seen in training
             = a(h) P(w)                  otherwise, with P(w) from the words

Texts are cut once into blocks of about a million tokens, kept as word numbers in
a table that is bucketed by block.  Each block asks for the counts of its
distinct words and pairs only; requests go to hash partitions, which add up the
training counts of all blocks and answer each block in its own order.  So the
shuffles carry one entry for each distinct word or pair of a block, not one
for each token, and no count table ever goes to the driver or into a broadcast.

Words are known by 64-bit hashes (48 bits of the second word of a pair).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.common import crc_mod, materialize
from skillgrid.llm.wordhash import WordHasher, small_batches
from skillgrid.session import ensure_checkpoint_dir

BLOCK_TOKENS = 1_200_000
BUCKETS = 64  # of the block table
DISCOUNTED = 5  # counts up to this are discounted
END, START = np.uint64(1), np.uint64(2)  # ids of the end of a text, and of the context before its first word
_W48 = np.uint64((1 << 48) - 1)


def _pack(a: np.ndarray) -> bytes:
    """Numbers by byte planes, so that small ones compress to almost nothing."""
    return zlib.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes(), 1) if len(a) else b""


def _unpack(b: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    if not b:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _parts(ids: np.ndarray, parts: int) -> np.ndarray:
    """First index of each partition in ascending ids; the partition is the leading part of the id."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(ids, edges), [len(ids)]]).astype(np.int64)


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing factors of the counts 0 to ``DISCOUNTED``; ``n[r]`` types occur r times.

    Katz's form, in which counts above ``DISCOUNTED`` stay as they are.  A
    factor outside (0, 1], as small tables can give, is replaced by 1.
    """
    k = DISCOUNTED
    out = np.ones(k + 1)
    if n[1] and n[1] > (k + 1) * n[k + 1]:
        common = (k + 1) * n[k + 1] / n[1]
        for r in range(1, k + 1):
            if n[r]:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                out[r] = d if 0 < d <= 1 else 1.0
    return out


@dataclass
class Words:
    """The unigram part of the model, as the few numbers that its probabilities need."""

    tokens: int
    types: int
    factor: np.ndarray
    unknown: float  # probability of the class of unknown words
    total: float

    @classmethod
    def of(cls, tokens: int, types: int, n: list[int]) -> Words:
        d = discounts(n)
        left = sum((1 - d[r]) * r * n[r] for r in range(1, DISCOUNTED + 1)) / tokens if tokens else 1.0
        if left > 0:
            return cls(tokens, types, d, left, float(max(tokens, 1)))
        return cls(tokens, types, np.ones(DISCOUNTED + 1), 1 / (tokens + 1), tokens + 1.0)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.factor[np.minimum(c, DISCOUNTED)] ** (c <= DISCOUNTED) * c / self.total, self.unknown)


def _blocks(docs: DataFrame, id_col: str, text_col: str, folds: int) -> DataFrame:
    """The bucketed block table: block, words (sorted ids), ids of the texts, held, sizes, at (word numbers)."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, made = WordHasher(), 0
        ids, held, sizes, tokens, size = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, held, sizes, tokens, size, made
            words, at = np.unique(np.concatenate([*tokens, np.array([END, START])]), return_inverse=True)
            out = pa.RecordBatch.from_arrays([
                pa.array([(TaskContext.get().partitionId() << 24) + made], pa.int64()),
                pa.array([words.tobytes()], pa.binary()), pa.array([ids], pa.list_(_arrow(kind))),
                pa.array([held], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int64())),
                pa.array([_pack(at[:-2].astype(np.uint32))], pa.binary())],
                ["block", "words", "ids", "held", "sizes", "at"])
            ids, held, sizes, tokens, size, made = [], [], [], [], 0, made + 1
            return out

        for b in batches:
            texts, keys, outs = (b.column(i).to_pylist() for i in (1, 0, 2))
            for lo, hi in small_batches(texts):
                found, first = hasher(texts[lo:hi])
                n = np.diff(first)
                with_end = np.insert(found, first[1:], END)
                ids += keys[lo:hi]
                held += outs[lo:hi]
                sizes += (n + 1).tolist()
                tokens.append(with_end)
                size += len(with_end)
                if size >= BLOCK_TOKENS:
                    yield flush()
        if size:
            yield flush()

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), (crc_mod(id_col, folds) == 0).alias("held_out"))
    table = rows.mapInArrow(run, f"block long, words binary, ids array<{kind.simpleString()}>, held array<boolean>, "
                                 "sizes array<long>, at binary")
    name = f"katz_blocks_{uuid.uuid4().hex[:12]}"
    path = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/tables/{name}"
    table.write.bucketBy(BUCKETS, "block").option("path", path).option("compression", "zstd").saveAsTable(name)
    return docs.sparkSession.table(name)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


@dataclass
class Block:
    """One row of the block table, opened."""

    words: np.ndarray
    held: np.ndarray
    sizes: np.ndarray
    at: np.ndarray  # word number of each token

    @classmethod
    def of(cls, b: pa.RecordBatch, i: int) -> Block:
        return cls(np.frombuffer(b.column("words")[i].as_buffer(), np.uint64),
                   np.array(b.column("held")[i].as_py(), bool), np.array(b.column("sizes")[i].as_py(), np.int64),
                   _unpack(b.column("at")[i].as_py(), np.uint32).astype(np.int64))

    def training(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes)

    def pairs(self) -> np.ndarray:
        """(context number, word number) of each token in one number; ascending numbers follow ascending ids."""
        before = np.empty_like(self.at)
        before[1:] = self.at[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = np.searchsorted(self.words, START)
        return before << 32 | self.at


def _ask_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = Block.of(b, i)
                counts = np.bincount(block.at[block.training()], minlength=len(block.words)).astype(np.uint32)
                cut = _parts(block.words, parts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(parts), pa.int32()), pa.array([b.column("block")[i].as_py()] * parts, pa.int64()),
                    pa.array([block.words[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary()),
                    pa.array([_pack(counts[x:y]) for x, y in zip(cut, cut[1:])], pa.binary())],
                    ["part", "block", "words", "counts"])
    return run


def _count_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[:DISCOUNTED + 2].tolist()


def _answer_words(key: tuple, table: pa.Table) -> pa.Table:
    """Add up the counts of a partition's words; answer every block; block -1 has the partition's statistics."""
    ids = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("words")]
    counts = [_unpack(x.as_py(), np.uint32) for x in table.column("counts")]
    words, back = np.unique(np.concatenate(ids), return_inverse=True)
    total = np.bincount(back, weights=np.concatenate(counts).astype(np.float64), minlength=len(words)).astype(np.int64)
    cut = np.cumsum([0, *map(len, ids)])
    stats = [int(total.sum()), int((total > 0).sum()), *_count_of_counts(total)]
    answers = [_pack(total[back[x:y]].astype(np.uint64)) for x, y in zip(cut, cut[1:])]
    part = key[0].as_py()
    return pa.table({"part": pa.array([part] * (len(ids) + 1), pa.int32()),
                     "block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()),
                     "counts": pa.array([*answers, b""], pa.binary()),
                     "stats": pa.array([None] * len(ids) + [stats], pa.list_(pa.int64()))})


def _joined(blocks: DataFrame, answers: DataFrame, *cols: str) -> DataFrame:
    """Blocks with the answers of all partitions; only the answers move, to the block table's buckets."""
    got = answers.where("block >= 0").groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("part", *cols))).alias("answers"))
    return blocks.join(got.hint("shuffle_hash"), "block")


def _all(answers: list[dict], col: str, kind) -> np.ndarray:
    return np.concatenate([_unpack(a[col], kind) for a in answers])


def _ask_pairs(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = Block.of(b, i)
                c_word = _all(b.column("answers")[i].as_py(), "counts", np.uint64)
                pairs, where = block.pairs(), block.training()
                order = np.argsort(pairs, kind="stable")
                sorted_pairs = pairs[order]
                first = np.flatnonzero(np.diff(sorted_pairs, prepend=-1))
                counts = np.add.reduceat(where[order].astype(np.int64), first).astype(np.uint32)
                h, w = sorted_pairs[first] >> 32, sorted_pairs[first] & 0xFFFFFFFF
                heads, at = np.unique(h, return_index=True)  # contexts, and their first pair
                lengths = np.diff(np.append(at, len(h))).astype(np.uint32)
                ids = block.words[heads]
                cut = _parts(ids, parts)
                pair_cut = np.append(at, len(h))[cut]
                low = (block.words[w] & _W48).view(np.uint8).reshape(-1, 8)[:, :6]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(parts), pa.int32()), pa.array([b.column("block")[i].as_py()] * parts, pa.int64()),
                    pa.array([ids[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary()),
                    pa.array([_pack(lengths[x:y]) for x, y in zip(cut, cut[1:])], pa.binary()),
                    pa.array([low[x:y].tobytes() for x, y in zip(pair_cut, pair_cut[1:])], pa.binary()),
                    pa.array([_pack(c_word[w[x:y]]) for x, y in zip(pair_cut, pair_cut[1:])], pa.binary()),
                    pa.array([_pack(counts[x:y]) for x, y in zip(pair_cut, pair_cut[1:])], pa.binary())],
                    ["part", "block", "heads", "lengths", "low", "words", "counts"])
    return run


def _answer_pairs(model: Words):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Add up the pair counts of a partition's contexts.  Answers: the count of each pair of a
        block, and of each of its contexts how many pairs occur 1 .. DISCOUNTED times, the tokens
        in more frequent pairs, and the word probability of all seen followers."""
        heads = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("heads")]
        lengths = [_unpack(x.as_py(), np.uint32) for x in table.column("lengths")]
        low = np.frombuffer(b"".join(x.as_py() for x in table.column("low")), np.uint8).reshape(-1, 6)
        w = np.zeros((len(low), 8), np.uint8)
        w[:, :6] = low
        w = w.view(np.uint64).ravel()
        ids, back = np.unique(np.concatenate(heads), return_inverse=True)
        h = np.repeat(back, np.concatenate(lengths))  # number of the context of each entry
        c = np.concatenate([_unpack(x.as_py(), np.uint32) for x in table.column("counts")]).astype(np.int64)
        c_word = np.concatenate([_unpack(x.as_py(), np.uint64) for x in table.column("words")]).astype(np.int64)
        order = np.lexsort((w, h))
        hs, ws = h[order], w[order]
        first = np.flatnonzero(np.append(True, (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1]))) if len(hs) else np.zeros(0, int)
        sums = np.add.reduceat(c[order], first) if len(first) else np.zeros(0, np.int64)
        entry = np.empty(len(h), np.int64)
        entry[order] = np.repeat(sums, np.diff(np.append(first, len(h))))
        of, seen = hs[first], sums > 0
        p = model.p(c_word[order[first]])
        few = [np.bincount(of[sums == r], minlength=len(ids)) for r in range(1, DISCOUNTED + 1)]
        many = np.bincount(of, weights=np.where(sums > DISCOUNTED, sums, 0), minlength=len(ids))
        mass = np.bincount(of, weights=np.where(seen, p, 0.0), minlength=len(ids))
        stats = _count_of_counts(sums)
        head_cut, pair_cut = np.cumsum([0, *map(len, heads)]), np.cumsum([0, *(int(x.sum()) for x in lengths)])
        n = len(heads)
        mine = [back[x:y] for x, y in zip(head_cut, head_cut[1:])]
        cols = {"part": pa.array([key[0].as_py()] * (n + 1), pa.int32()),
                "block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()),
                "counts": pa.array([*(_pack(entry[x:y].astype(np.uint32)) for x, y in zip(pair_cut, pair_cut[1:])), b""],
                                   pa.binary()),
                "few": pa.array([*(_pack(np.concatenate([f[m] for f in few]).astype(np.uint32)) for m in mine), b""],
                                pa.binary()),
                "many": pa.array([*(_pack(many[m].astype(np.uint64)) for m in mine), b""], pa.binary()),
                "mass": pa.array([*(_pack(mass[m]) for m in mine), b""], pa.binary()),
                "stats": pa.array([None] * n + [stats], pa.list_(pa.int64()))}
        return pa.table(cols)
    return run


def _score(model: Words, factor: np.ndarray, id_kind):
    """Evaluate every token of a block: its pair if seen, else the backoff weight and its word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = Block.of(b, i)
                c_word = _all(b.column("word_answers")[i].as_py(), "counts", np.uint64).astype(np.int64)
                got = b.column("answers")[i].as_py()
                c_pair = _all(got, "counts", np.uint32).astype(np.int64)
                many, mass = _all(got, "many", np.uint64).astype(np.float64), _all(got, "mass", np.float64)
                few = np.concatenate([_unpack(a["few"], np.uint32).reshape(DISCOUNTED, -1) for a in got], axis=1)
                r = np.arange(1, DISCOUNTED + 1)[:, None]
                context = (few * r).sum(axis=0) + many
                safe = np.maximum(context, 1)
                left = 1 - ((few * r * factor[1:, None]).sum(axis=0) + many) / safe
                full = left <= 1e-12  # nothing was discounted: make room for one unseen token
                base = np.where(full, context + 1, safe)
                left = np.where(full, 1 / (context + 1), left)
                with np.errstate(divide="ignore"):
                    backoff = np.where(context > 0, np.log10(left / (1 - mass)), 0.0)
                pairs, back = np.unique(block.pairs(), return_inverse=True)
                h, w = pairs >> 32, pairs & 0xFFFFFFFF
                head = np.cumsum(np.diff(h, prepend=h[:1]) != 0)  # number of the pair's context among the block's
                p_word = np.log10(model.p(c_word))
                seen = np.log10(factor[np.minimum(c_pair, DISCOUNTED)] ** (c_pair <= DISCOUNTED)
                                * np.maximum(c_pair, 1) / base[head])
                value = np.where(c_pair > 0, seen, backoff[head] + p_word[w])[back]
                plain = np.log10((c_word + 0.1) / (model.tokens + 0.1 * (model.types + 1)))[block.at]
                starts = np.cumsum(block.sizes) - block.sizes
                n = len(starts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(b.column("ids")[i].as_py(), id_kind), pa.array(block.held), pa.array(block.sizes),
                    pa.array(np.add.reduceat((c_word > 0)[block.at].astype(np.int64), starts)),
                    pa.array([model.tokens] * n, pa.int64()), pa.array(np.add.reduceat(plain, starts)),
                    pa.array(np.add.reduceat(value, starts))],
                    ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def katz_scores(docs: DataFrame, *, folds: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every row of ``docs``; learned from those with crc32(id) mod ``folds`` other than 0.

    Columns: id, held_out, n_tokens (words and the end), n_known, train_tokens,
    base_score (smoothed word model), score (log10 of the model's probability).
    A null or empty text is one end token.  Words never seen in training share
    the probability that Good-Turing leaves; without training texts it is 1.
    Repeated rows are counted and scored one by one.
    """
    spark = docs.sparkSession
    blocks = _blocks(docs, id_col, text_col, folds)
    n_blocks = blocks.count()
    parts = max(1, n_blocks)  # a partition then holds about as many entries as a block, at any size
    words = materialize(spark, blocks.select("block", "words", "held", "sizes", "at").mapInArrow(
        _ask_words(parts), "part int, block long, words binary, counts binary").groupBy("part").applyInArrow(
        _answer_words, "part int, block long, counts binary, stats array<long>"), "katz_words")
    total = [sum(x) for x in zip(*(r.stats for r in words.where("block < 0").select("stats").toLocalIterator()))]
    model = Words.of(total[0], total[1], total[2:]) if total else Words.of(0, 0, [0] * (DISCOUNTED + 2))
    asked = _joined(blocks, words, "counts").select("block", "words", "held", "sizes", "at", "answers")
    pairs = materialize(spark, asked.mapInArrow(
        _ask_pairs(parts), "part int, block long, heads binary, lengths binary, low binary, words binary, counts binary")
        .groupBy("part").applyInArrow(_answer_pairs(model), "part int, block long, counts binary, few binary, "
                                      "many binary, mass binary, stats array<long>"), "katz_pairs")
    seen = [sum(x) for x in zip(*(r.stats for r in pairs.where("block < 0").select("stats").toLocalIterator()))]
    factor = discounts(seen or [0] * (DISCOUNTED + 2))
    full = _joined(_joined(blocks, words, "counts").withColumnRenamed("answers", "word_answers"),
                   pairs, "counts", "few", "many", "mass")
    kind = docs.schema[id_col].dataType
    return full.mapInArrow(_score(model, factor, _arrow(kind)), f"id {kind.simpleString()}, held_out boolean, "
                           "n_tokens long, n_known long, train_tokens long, base_score double, score double")
