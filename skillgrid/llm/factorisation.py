"""Quality classifier: a factorisation machine over hashed words and text statistics.

score(x) = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the
pairwise part is taken in linear time as half of
sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2).

The model is fitted on a bounded sample of labelled rows (``max_train``
documents, those with the smallest id hashes) and then scores every whole text
in Arrow batches.  Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgrid.llm.common import crc_mod, text_of

WORD_DIMS = 1 << 15
STAT_NAMES = ("log_words", "chars_per_word", "symbols", "upper", "digits", "punctuation", "distinct_words",
              "repeated_lines", "top_word", "words_per_line", "distinct_pairs", "log_chars")
STAT_BINS = 16
DIMS = WORD_DIMS + len(STAT_NAMES) * STAT_BINS
MAX_TRAIN = 8000
_SYMBOLS = b"#*$%&|<>"
_PUNCTUATION = b".,;:!?()[]\"'"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"


def _share(part: float, whole: float) -> int:
    """Bin of a ratio: finer near 0, where clean and noisy texts part."""
    return min(STAT_BINS - 1, int(STAT_BINS * math.sqrt(part / whole))) if whole and part > 0 else 0


def features(text: str | None, n_chars: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values) of one text; ``n_chars`` is the metadata column, if there is one."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, lines = len(words), [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    size = len(raw)
    stats = (
        min(STAT_BINS - 1, n.bit_length()),
        min(STAT_BINS - 1, int(sum(map(len, words)) / n)) if n else 0,
        _share(size - len(raw.translate(None, _SYMBOLS)), size),
        _share(size - len(raw.translate(None, _UPPER)), size),
        _share(size - len(raw.translate(None, _DIGITS)), size),
        _share(size - len(raw.translate(None, _PUNCTUATION)), size),
        _share(len(counts), n),
        _share(len(lines) - len(set(lines)), len(lines)),
        _share(max(counts.values()), n) if n else 0,
        min(STAT_BINS - 1, (n // len(lines)).bit_length()) if lines else 0,
        _share(len(set(zip(words, words[1:]))), max(n - 1, 0)),
        min(STAT_BINS - 1, (len(text or "") if n_chars is None else max(0, int(n_chars))).bit_length()),
    )
    at = np.fromiter((zlib.crc32(w) % WORD_DIMS for w in counts), dtype=np.int64, count=len(counts))
    x = np.sqrt(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    if len(x):
        x /= np.sqrt((x * x).sum())
    stat_at = WORD_DIMS + np.arange(len(stats)) * STAT_BINS + np.array(stats)
    return np.concatenate([at, stat_at]), np.concatenate([x, np.full(len(stats), 1 / math.sqrt(len(stats)))])


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray  # DIMS
    factors: np.ndarray  # DIMS x rank

    def logits(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of rows laid end to end; row i starts at ``starts[i]`` and has a feature at least."""
        vx = self.factors[at] * x[:, None]
        sums, squares = np.add.reduceat(vx, starts, axis=0), np.add.reduceat(vx * vx, starts, axis=0)
        return self.bias + np.add.reduceat(self.weights[at] * x, starts) + 0.5 * (sums * sums - squares).sum(axis=1)

    def scores(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(at, x, starts), -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], *, rank: int = 8, epochs: int = 6, batch: int = 32,
        rate: float = 0.1, l2: float = 1e-5, seed: int = 7) -> FactorisationMachine:
    """AdaGrad on the logistic loss.  No rows, or one class only, give that class's smoothed prior."""
    rng = np.random.default_rng(seed)
    good = sum(y for *_, y in rows)
    prior = (good + 1) / (len(rows) + 2)
    fm = FactorisationMachine(math.log(prior / (1 - prior)), np.zeros(DIMS), rng.normal(0, 0.05, (DIMS, rank)))
    if not rows or good in (0, len(rows)):
        fm.factors[:] = 0
        return fm
    g_w, g_v, g_b = np.full(DIMS, 1e-6), np.full((DIMS, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), batch):
            part = [rows[i] for i in order[lo:lo + batch]]
            sizes = np.array([len(p[0]) for p in part])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            at, x = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            off = fm.scores(at, x, starts) - np.array([p[2] for p in part], dtype=np.float64)
            each = np.repeat(off, sizes) / len(part)
            vx = fm.factors[at] * x[:, None]
            sums = np.repeat(np.add.reduceat(vx, starts, axis=0), sizes, axis=0)
            step_v = (each * x)[:, None] * (sums - vx)
            here, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, weights=each * x) + l2 * fm.weights[here]
            dv = np.stack([np.bincount(back, weights=step_v[:, f]) for f in range(rank)], axis=1) + l2 * fm.factors[here]
            g_w[here] += dw * dw
            g_v[here] += dv * dv
            g_b += off.mean() ** 2
            fm.weights[here] -= rate * dw / np.sqrt(g_w[here])
            fm.factors[here] -= rate * dv / np.sqrt(g_v[here])
            fm.bias -= rate * off.mean() / math.sqrt(g_b)
    return fm


def training_sample(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, folds: int = 5,
                    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(body, n_chars, y) of at most ``max_train`` labelled documents outside the held-out fold.

    Ids are taken in the order of their hash, so the sample is the same in
    every run.  Its size is bounded, so it may be broadcast to the documents.
    """
    ids = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, folds) != 0))
           .groupBy(F.col(id_col).alias("t_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
           .orderBy(F.xxhash64("t_id"), "t_id").limit(max_train))
    meta = F.col("`n_chars`").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    body = docs.select(F.col(f"`{id_col}`").alias("d_id"), text_of(text_col).alias("body"), meta.alias("n_chars"))
    return body.join(F.broadcast(ids), F.col("d_id") == F.col("t_id")).select("d_id", "body", "n_chars", "y")


def train(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, rank: int = 8, epochs: int = 6,
          **names) -> FactorisationMachine:
    """Featurise the sample in tasks and fit on the bounded result."""
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t, c) for t, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.string()), b.column(3).cast(pa.int32()),
                 pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())),
                 pa.array([g[1].astype(np.float32) for g in got], pa.list_(pa.float32()))], ["id", "y", "at", "x"])

    sample = training_sample(docs, labels, max_train=max_train, **names)
    table = sample.mapInArrow(vectors, "id string, y int, at array<int>, x array<float>").toArrow()
    cols = [table.column(c).to_pylist() for c in ("id", "y")]
    at, x = table.column("at").combine_chunks(), table.column("x").combine_chunks()
    rows = [(cols[0][i], at[i].values.to_numpy().astype(np.int64), x[i].values.to_numpy().astype(np.float64), cols[1][i])
            for i in range(table.num_rows)]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[2].sum()))  # the order of arrival must not matter
    return fit([r[1:] for r in rows], rank=rank, epochs=epochs)


def score(docs: DataFrame, fm: FactorisationMachine, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score reaches ``threshold``).

    A null or empty text is scored by its statistics alone.
    """
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast((fm.bias, fm.weights, fm.factors))  # DIMS x (rank + 1) numbers, whatever the input
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    at_text = names.index(text_col)
    at_chars = names.index("n_chars") if "n_chars" in names else None
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("score", T.DoubleType()),
                                                             T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = FactorisationMachine(*model.value)
        for b in batches:
            scores = []
            for lo in range(0, b.num_rows, 256):  # bounded memory whatever the batch
                part = b.slice(lo, 256)
                chars = part.column(at_chars).to_pylist() if at_chars is not None else [None] * part.num_rows
                got = [features(t, c) for t, c in zip(part.column(at_text).to_pylist(), chars)]
                starts = np.concatenate([[0], np.cumsum([len(g[0]) for g in got])[:-1]])
                scores.append(m.scores(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), starts))
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())],
                [f.name for f in schema])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
