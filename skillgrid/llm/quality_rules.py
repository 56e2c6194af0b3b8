"""Rule signals and an n-gram likelihood-ratio verdict, in DataFrame functions only.

Words and word pairs are hashed into a fixed number of buckets.  Two
multinomials are counted over them, one on the trusted documents and one on
the whole corpus.  A document's score is the sum over its n-grams of
``log p_trusted - log p_corpus``, divided by the number of n-grams; it is kept
if the score reaches the threshold of its group (no random draw).  The trusted
multinomial is smoothed towards that of the corpus, so an n-gram too rare to be
expected among the trusted ones says next to nothing.  The thresholds are
quantiles of trusted documents scored without their own half of the counts.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.common import WORD, text_of

BUCKETS = 16384
SYMBOLS = "[#*$%&|<>]"
PRIOR = 10.0  # trusted occurrences of a bucket, as many as the corpus lets expect, taken as seen before counting
LOST = 0.01  # share of the trusted documents of a group that may fall below its threshold
MIN_TRUSTED = 20  # trusted documents of a group from which it has a threshold


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)


def _pairs(words: Column, n: Column, fn) -> Column:
    """fn(word, next word) for every adjacent pair."""
    m = F.greatest(n - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, m), F.slice(words, 2, m), fn)


def ngram_buckets(words: Column, buckets: int) -> Column:
    """Bucket of each word and of each pair of neighbouring words."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = _pairs(words, F.size(words), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def _ids(trusted: DataFrame, id_col: str) -> DataFrame:
    return trusted.select(F.col(f"`{id_col}`").alias("t_id")).where(F.col("t_id").isNotNull()).distinct()


def _half(body: Column) -> Column:
    """0 or 1, the same for equal texts."""
    return F.pmod(F.xxhash64(F.lit("half"), body), F.lit(2)).cast("int")


def _flagged(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(body, half): the half of trusted documents, null for others.

    The join shuffles at every size: the ids grow with the input, so they are never broadcast.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("d_id"), text_of(text_col).alias("body")).join(
        _ids(trusted, id_col).hint("shuffle_hash"), F.col("d_id") == F.col("t_id"), "left")
    return rows.select("body", F.when(F.col("t_id").isNotNull(), _half(F.col("body"))).alias("half"))


def _counts(flagged: DataFrame, buckets: int) -> tuple[list[int], list[list[int]]]:
    """Occurrences of each bucket in all documents, and in each half of the trusted ones."""
    grams = flagged.select("half", words_of(F.col("body")).alias("w")).select(
        "half", F.explode(ngram_buckets(F.col("w"), buckets)).alias("b"))
    counted = grams.groupBy("b").agg(F.count(F.lit(1)).alias("n"), *[
        F.coalesce(F.sum((F.col("half") == h).cast("long")), F.lit(0)).alias(f"g{h}") for h in range(2)]).collect()
    n, g = [0] * buckets, [[0] * buckets, [0] * buckets]
    for r in counted:
        n[r.b], g[0][r.b], g[1][r.b] = r.n, r.g0, r.g1
    return n, g


def _log_ratios(n: list[int], g: list[int], alpha: float) -> list[float]:
    """log(p_trusted / p_corpus): trusted over expected occurrences, ``PRIOR`` added to both."""
    total_n, total_g = sum(n) + alpha * len(n), sum(g)
    if not total_g:
        return [0.0] * len(n)
    return [math.log((y + PRIOR) / (total_g * (x + alpha) / total_n + PRIOR)) for x, y in zip(n, g)]


def bucket_log_ratios(docs: DataFrame, trusted: DataFrame, *, buckets: int = BUCKETS, alpha: float = 1.0,
                      id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """log(p_trusted / p_corpus) per bucket.

    ``trusted`` has the ids of the trusted documents.  The counts cover every
    document; only ``buckets`` sums come to the driver.
    """
    n, g = _counts(_flagged(docs, trusted, id_col, text_col), buckets)
    return _log_ratios(n, [x + y for x, y in zip(*g)], alpha)


def learn(docs: DataFrame, trusted: DataFrame, *, buckets: int = BUCKETS, alpha: float = 1.0, lost: float = LOST,
          min_words: int = 50, min_trusted: int = MIN_TRUSTED, id_col: str = "doc_id", text_col: str = "text",
          group_col: str = "lang") -> tuple[list[float], dict[str, float]]:
    """Log ratios of all trusted documents, and a threshold for each group.

    A trusted document is scored by the counts of the other half, as a new one
    would be; the threshold is the ``lost`` quantile of its group, so it moves
    with the size of the table and the share of labels as the scores do.  A
    group of fewer than ``min_trusted`` trusted documents gets none: the counts
    do not tell what is normal there.
    """
    group = F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit("")) if group_col in docs.columns else F.lit("")
    n, g = _counts(_flagged(docs, trusted, id_col, text_col), buckets)
    other = [_table(_log_ratios(n, g[1 - h], alpha)) for h in range(2)]
    body = text_of(text_col)
    mine = docs.select(F.col(f"`{id_col}`").alias("d_id"), group.alias("group"), _half(body).alias("half"),
                       words_of(body).alias("w")).where(F.size("w") >= min_words)
    # every document is scored where it lies, so that this pass shuffles no text
    scored = mine.select("d_id", "group", F.when(F.col("half") == 0, _score(F.col("w"), other[0], buckets)).otherwise(
        _score(F.col("w"), other[1], buckets)).alias("score")).join(
        _ids(trusted, id_col).hint("shuffle_hash"), F.col("d_id") == F.col("t_id"), "left_semi")
    found = scored.groupBy("group").agg(F.count(F.lit(1)).alias("n"),
                                        F.percentile_approx("score", lost, 10_000).alias("least")).collect()
    return (_log_ratios(n, [x + y for x, y in zip(*g)], alpha),
            {r["group"]: r["least"] for r in found if r["n"] >= min_trusted})


def _table(log_ratios: list[float]) -> Column:
    return F.split(F.lit(json.dumps(log_ratios)[1:-1]), ", ").cast("array<double>")


def _score(w: Column, table: Column, buckets: int) -> Column:
    n = F.size(w)
    total = F.aggregate(ngram_buckets(w, buckets), F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    return F.when(n == 0, 0.0).otherwise(total / F.greatest(2 * n - 1, F.lit(1)))


def quality_rules(docs: DataFrame, log_ratios: list[float], *, min_score: float | dict[str, float] = -0.04,
                  min_words: int = 50, max_repeat_pct: int = 50, id_col: str = "doc_id", text_col: str = "text",
                  group_col: str = "lang") -> DataFrame:
    """``docs`` (without text) with its signals, ``llr_score``, ``base_failed`` and ``kept``.

    * ``n_words``, ``word_chars`` (code points in words), ``n_symbols``
    * ``n_dup_lines``: lines with a word that equal an earlier line
    * ``n_repeat_words``: words inside 3-word windows that occur twice or more
    * ``base_failed``: under ``min_words`` words, or more than
      ``max_repeat_pct`` percent of them repeated

    ``min_score`` is one threshold, or one for each value of ``group_col``; a
    group without threshold is judged by the base rules only.  A null or empty
    text has no words, so it fails; its score is 0.
    """
    buckets = len(log_ratios)
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    s0 = docs.select(F.struct(*keep).alias("row"), text_of(text_col).alias("body"))
    s1 = s0.select("row", "body", words_of(F.col("body")).alias("w"))
    w, n = F.col("w"), F.size("w")
    windows = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    lines = F.filter(F.split("body", "\n"), lambda line: line.rlike(WORD))
    s2 = s1.select(
        "row", n.cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("body", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.char_length("body") - F.char_length(F.regexp_replace("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long")
        .alias("n_dup_lines"),
        F.transform(windows, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))).alias("h"),
        _score(w, _table(log_ratios), buckets).alias("llr_score"))
    # windows found twice or more: equal neighbours in sorted order
    s3 = s2.select("*", F.sort_array("h").alias("s"))
    m = F.greatest(F.size("s") - 1, F.lit(0))
    twice = F.array_distinct(F.filter(F.zip_with(F.slice("s", 1, m), F.slice("s", 2, m),
                                                 lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()))
    s4 = s3.select("*", twice.alias("twice"))
    covered = _covered(F.col("h"), F.col("twice"))
    s5 = s4.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                   F.when(F.size("twice") == 0, F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
                   "llr_score")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    out = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr_score")
    names = [c for c in docs.columns if c != text_col and c not in (*out, "base_failed", "kept")]
    if isinstance(min_score, dict):
        mine = F.coalesce(F.col("row")[group_col].cast("string"), F.lit("")) if group_col in docs.columns else F.lit("")
        limits = F.from_json(F.lit(json.dumps(min_score)), "map<string,double>")
        enough = F.col("llr_score") >= F.coalesce(F.try_element_at(limits, mine), F.lit(float("-inf")))
    else:
        enough = F.col("llr_score") >= min_score
    return s5.select(*[F.col("row")[c].alias(c) for c in names], *out, failed.alias("base_failed"),
                     (~failed & enough).alias("kept"))


def _covered(h: Column, twice: Column) -> Column:
    """Words covered by the windows whose hash is in ``twice``.

    The starts of such windows in ascending order cover min(3, gap to the next
    start) words each, the last one 3.  Few repeated values are looked up one
    by one; many are met by sorting (hash, start) pairs, so a long text stays
    at n log n.  Both give the same starts.
    """
    few = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())

    def by_sort(pairs: Column) -> Column:
        """pairs: (hash, start), sorted; starts whose hash equals a neighbour's."""
        m = F.size(pairs) - 1
        nxt = F.zip_with(F.slice(pairs, 1, m), F.slice(pairs, 2, m), lambda a, b: F.when(
            a["x"] == b["x"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
        return F.sort_array(F.array_distinct(F.flatten(nxt)))

    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    many = F.transform(F.array(pairs), by_sort)[0]
    starts = F.when(F.size(twice) <= 64, few).otherwise(many)

    def lengths(p: Column) -> Column:
        m = F.size(p) - 1
        gaps = F.zip_with(F.slice(p, 1, m), F.slice(p, 2, m), lambda a, b: F.least(F.lit(3), b - a))
        return F.aggregate(gaps, F.lit(3), lambda acc, g: acc + g)

    return F.transform(F.array(starts), lengths)[0]
