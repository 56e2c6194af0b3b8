"""Line deduplication over a whole corpus, in DataFrame functions only.

Lines are exploded, normalised and hashed; the documents that hold a hash are
counted; lines above the threshold are dropped from every document and the
others are put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.common import SPACE, ascii_lower, materialize, row_key, text_of


def line_keys(text: Column) -> Column:
    """Key of each line: A-Z lower-cased, ASCII white space stripped at both ends."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda line: F.btrim(line, F.lit(SPACE)))


def line_hash(key: Column) -> Column:
    """128-bit hash of a key, 16 bytes."""
    return F.unhex(F.md5(key))


def frequent_lines(docs: DataFrame, *, min_docs: int = 10, min_key_chars: int = 1,
                   text_col: str = "text") -> DataFrame:
    """Hashes (column ``h``) of line keys that at least ``min_docs`` documents hold.

    Each document gives a key once, so the count is of documents; partial
    counts are combined before the shuffle, and a key that every document
    holds is one row per map task.
    """
    each = docs.select(F.explode(F.array_distinct(line_keys(text_of(text_col)))).alias("k"))
    each = each.where(F.char_length("k") >= min_key_chars).select(line_hash(F.col("k")).alias("h"))
    return each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h")


def line_dedup(docs: DataFrame, *, min_docs: int = 10, min_key_chars: int = 1,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with frequent lines removed from ``text_col``.

    Adds ``n_lines`` (lines before dropping) and ``n_dropped`` (both long).
    A null or empty text is one empty line; an empty key is shorter than
    ``min_key_chars`` and stays.  A key repeated inside one document counts
    once, and all its copies go.  Repeated rows count as documents of their
    own.  An empty table gives an empty result.

    Only (row key, position) pairs of lines travel to the frequent hashes; the
    text itself is shuffled once, to meet its list of dropped positions.
    """
    spark = docs.sparkSession
    common = materialize(spark, frequent_lines(docs, min_docs=min_docs, min_key_chars=min_key_chars,
                                               text_col=text_col), "frequent_lines")
    text = text_of(text_col)
    lines = docs.select(row_key(id_col, text_col).alias("rk"), F.posexplode(line_keys(text)).alias("pos", "k"))
    lines = lines.where(F.char_length("k") >= min_key_chars).select("rk", "pos", line_hash(F.col("k")).alias("h"))
    drops = lines.join(common, "h", "left_semi").groupBy("rk").agg(F.collect_set("pos").alias("gone"))

    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       row_key(id_col, text_col).alias("rk"))
    joined = left.join(drops.hint("shuffle_hash"), "rk", "left")
    body = F.coalesce(F.col("row")[text_col], F.lit(""))
    n_lines = F.char_length(body) - F.char_length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    parts = F.array(F.struct(
        F.split(body, "\n").alias("lines"),
        F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("gone")).alias("stay")))
    kept = F.transform(parts, lambda p: F.array_join(F.transform(p["stay"], lambda i: p["lines"][i]), "\n"))[0]
    joined = joined.select("row", n_lines.cast("long").alias("n_lines"),
                           F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
                           F.when(F.col("gone").isNull(), body).otherwise(kept).alias("kept"))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*[F.col("kept").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in keep],
                         "n_lines", "n_dropped")
