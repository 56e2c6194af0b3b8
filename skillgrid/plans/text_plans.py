"""Query plans over posting text: validation, cleaning, dedup, role and skill
resolution (Q1-Q10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.functions import text as T
from skillgrid.operators import dedup, ingest, resolve
from skillgrid.sources import dimensions as D
from skillgrid.sources.tables import document_postings, foreign_postings, table

DOCUMENT_JOB_ID = "job-documents"
UNRESOLVED_TOP = 20


def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: first rejection reason of every document posting (null = valid)."""
    v = ingest.validate_postings(document_postings(spark, sf_dir))
    return v.select("source_row_number", "external_id", "reason")


def quarantine_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: rejected rows as stored: job, row number, raw JSON payload, reason."""
    _, rejected = ingest.split_valid(ingest.validate_postings(document_postings(spark, sf_dir)))
    return ingest.quarantine_rows(rejected, DOCUMENT_JOB_ID)


def adapter_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: foreign layout (events) mapped onto canonical columns with reasons."""
    a = ingest.adapt_foreign(foreign_postings(spark, sf_dir))
    return a.select("source_row_number", "external_id", "source", "posted_at", "title", "company",
                    "employment_type", "salary_min", "reason")


def adapter_missing_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same layout without any url column."""
    a = ingest.adapt_foreign(foreign_postings(spark, sf_dir, with_url=False))
    return a.select("source_row_number", "external_id", "posted_at", "reason")


def clean_text_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: the text normalisers on whole documents."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select(
        "doc_id",
        T.collapse_whitespace("text").alias("collapsed"),
        T.strip_common_punctuation("text").alias("no_punctuation"),
        T.clean_text("text").alias("cleaned"),
        T.normalize_key("text").alias("alias_key"),
        T.normalize_role_hint_query("text").alias("role_query"),
    )


def title_token_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: title normaliser on part names prefixed with an abbreviation."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    prefix = (F.when(F.col("p_size") % 4 == 0, F.lit("Sr."))
              .when(F.col("p_size") % 4 == 1, F.lit("jr"))
              .when(F.col("p_size") % 4 == 2, F.lit("Dev-"))
              .otherwise(F.lit("ENG")))
    titled = p.select("p_partkey", F.concat(prefix, F.lit(" "), F.col("p_name")).alias("title_raw"))
    return titled.select("p_partkey", "title_raw", T.normalize_title("title_raw").alias("normalized_title"))


def skill_token_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: skill-token normaliser on whole documents."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", T.normalize_skill_token("text").alias("skill_tokens"))


def dedup_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7: one document per cleaned text (lowest doc_id), with the copy count."""
    d = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    keyed = d.select(F.sha2(T.clean_text("text"), 256).alias("text_key"), "doc_id", "source")
    return dedup.first_per_key(keyed, ["text_key"], "doc_id", payload=["doc_id", "source"], count_as="n_copies")


def _normalized_document_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = ingest.split_valid(ingest.validate_postings(document_postings(spark, sf_dir)))
    return ingest.normalize_postings(ingest.to_raw_posting(valid))


def posting_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid document postings deduplicated on (source, title, company, posted_at)."""
    norm = _normalized_document_postings(spark, sf_dir)
    surv = dedup.dedup_postings(norm)
    return surv.select("source_row_number", "external_id", "normalized_source", "normalized_title",
                       "normalized_company", "posted_at")


def _part_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name")
    k = F.col("p_partkey") % 3
    hint = (F.when(k == 0, F.upper("p_name"))
            .when(k == 1, F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")))
            .otherwise(F.regexp_replace("p_name", " ", "   ")))
    return p.select("p_partkey", hint.alias("role_hint"))


def role_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: part names as role hints against the role alias table."""
    r = resolve.resolve_roles(_part_hints(spark, sf_dir), D.role_aliases_df(spark))
    return r.select("p_partkey", "role_hint", "role_key", "role_id")


def role_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First five distinct unmatched hints in part order."""
    r = resolve.resolve_roles(_part_hints(spark, sf_dir), D.role_aliases_df(spark))
    return resolve.unmatched_examples(r, order="p_partkey")


def _classified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    skills = D.skills_df(spark)
    names = resolve.skill_name_lookup(skills)
    aliases = resolve.skill_alias_lookup(D.skill_aliases_df(spark), skills)
    return resolve.classify_signals(resolve.extract_signals(d, posting="doc_id", text="text"), names, aliases)


def skill_match_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: first hit of each skill in each document, with its tier."""
    hits = resolve.skill_hits(_classified_documents(spark, sf_dir))
    return resolve.first_hit_per_skill(hits, posting="doc_id")


def unresolved_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: every unresolved signal with its count and first place."""
    un = resolve.unresolved_signals(_classified_documents(spark, sf_dir))
    g = un.groupBy("signal_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("doc_id", "signal_pos"), F.struct("doc_id", "signal_pos")).alias("_f"))
    return g.select("signal_key", "n", F.col("_f.doc_id").alias("first_doc_id"),
                    F.col("_f.signal_pos").alias("first_signal_pos"))


def unresolved_signals_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent unresolved signals (a top-k report)."""
    return (unresolved_signals(spark, sf_dir)
            .orderBy(F.col("n").desc(), "first_doc_id", "first_signal_pos", "signal_key")
            .limit(UNRESOLVED_TOP))
