"""The registered queries of the text operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.llm import (
    decontamination, factorisation, hard_negatives, katz, line_dedup, merkle, mixing, pseudonyms, quality_rules, simhash, suffixes, token_files,
    warc,
)
from skillgrid.llm.common import crc_mod, read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines held by at least 10 documents go from every document."""
    out = line_dedup.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the scores of the pair."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contaminated(docs, read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("share").alias("lcs_share"),
                        F.col("answer").alias("answer_share"), "cosine", F.col("word").alias("first_word"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = simhash.simhash_components(read(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, max_bits=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and copies of every document, for equal token weights of the sources."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mix(docs, read(spark, sf_dir, "labels"), keep=["doc_id", "source"])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base signals of every document and the likelihood-ratio verdict."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    ratios, limits = quality_rules.learn(docs, good)
    return quality_rules.quality_rules(docs, ratios, min_score=limits).drop("lang")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document covered by 400-byte strings that also start elsewhere are removed."""
    out = suffixes.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), span=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz and base log10 probabilities of every document."""
    return katz.katz_scores(read(spark, sf_dir, "documents").select("doc_id", "text"), folds=10).withColumnRenamed("id", "doc_id")


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture history of the pages, from archives written and read back.  Pages have no
    capture time, so page n counts as captured n seconds after the start of 2024."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    second = F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + 1704067200)
    return warc.archive_and_index(pages, time=second).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp",
        "range", "place")


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal values replaced."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, key="corpus-release-1")


def op10_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = factorisation.train(docs, read(spark, sf_dir, "labels"))
    scored = factorisation.score(docs, model, threshold=0.3)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document in token-id files, from the files read back."""
    from public_tokenizers import path
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    index = token_files.write_and_read(docs, tokenizer=path("word_bpe_49k.json"), end_id=1)
    return index.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives just below each positive of every hundredth vector."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    fits = ~F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = rows.where(fits).select("vec_id", label.alias("label"), F.transform(
        "embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vec"))
    return hard_negatives.mine(whole, is_anchor=F.col("vec_id") % 100 == 0, id_col="vec_id")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; every seventh by checksum is tampered with and checked."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    forged = F.col("doc_id").isNotNull() & (crc_mod("doc_id", 7) == 0)
    claim = merkle.leaf_digest("doc_id", "source", "lang", F.col("n_chars") + F.when(forged, 1).otherwise(0), "text")
    rows = merkle.manifest(docs, carry={"claim": claim}).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"),
        merkle.folded_root(F.col("claim")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_decontamination, op3_simhash, op4_mixing, op5_quality_rules, op6_suffix_dedup, op7_katz_lm,
    op8_warc_index, op9_pseudonyms, op10_quality_fm, op11_token_files,
    op12_hard_negatives, op13_merkle_manifest)}
