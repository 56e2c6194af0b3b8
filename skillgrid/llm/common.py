"""Helpers shared by the text operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.sources.materialize import materialize

# the ASCII white space of the text rules: [\x20\x09-\x0D]
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["SPACE", "WORD", "read", "text_of", "ascii_lower", "row_key", "materialize", "crc_mod", "put"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(f"`{col}`"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII texts (as many bytes as characters)
    take the fast built-in; others keep every non-ASCII letter as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """16-byte key of a document row, made of its id and whole text.

    It does not depend on where a row is read, so a recomputed task gives the
    same key.  Rows share a key only if id and text are equal; operators count
    or collapse such repeats explicitly.
    """
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(ident, F.lit("|"), text_of(text_col))))


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(f"`{col}`").cast("string"), F.lit("")).cast("binary")) % n


def put(docs: DataFrame, **cols: Column) -> DataFrame:
    """``docs`` with columns added or replaced, resolved against ``docs`` first."""
    return docs.withColumns(cols)
