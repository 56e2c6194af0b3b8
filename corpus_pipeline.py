"""Corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns
of ``docs``; the last adds the mixing columns.  Between stages the rows are
written as Parquet and read again, so a stage never recomputes an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.llm import decontamination, factorisation, line_dedup, mixing, simhash
from skillgrid.llm.common import materialize, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = factorisation.train(docs, read(spark, sf_dir, "labels"))
    return factorisation.score(docs, model, threshold=0.3).where("predicted = 1").select(
        *[F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least 10 documents hold go; ``n_chars`` follows the text."""
    out = line_dedup.line_dedup(docs, min_docs=10)
    return out.select(*[F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`")
                        for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rate and the copies that bring the sources nearer to equal token weights.

    The ridge weighs a document more than the last part of a target, so few documents get rate 0 and go.
    """
    return mixing.mix(docs, read(spark, sf_dir, "labels"), ridge=0.03).where("copies > 0")


STAGES = [("quality", quality), ("line_dedup", lines), ("simhash", near_duplicates),
          ("decontamination", benchmark), ("mixing", mixture)]
# the classifier, the fingerprints and the latent search have no SQL form; tests compare each stage with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
