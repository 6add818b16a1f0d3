"""The operators' queries over the given tables, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from doorflux.llm import (
    decontaminate,
    extraction,
    fingerprint,
    langid,
    licences,
    negatives,
    packing,
    pii,
    secret_scan,
    simhash,
    sql,
    toxicity,
    warc,
    whitening,
)
from doorflux.llm.common import crc_part, table

Query = Callable[[SparkSession, str], DataFrame]

#: The tokenizer's place is a parameter of the operator.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: For trials only; a real run takes its key from where secrets are kept.
PII_KEY = b"doorflux trial key"


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences.scan(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.array_join("licences", ",").alias("licenses"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.size("sentence_ids").cast("long").alias("n_sentences"), "unmatched",
    )


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.train(pages))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = crc_part("doc_id", 4)
    model = langid.fit(langid.sample(docs, part != 2))
    out = langid.predicted(docs.withColumn("held_out", part == 2), model, ("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    part = crc_part("doc_id", 3)
    model = toxicity.fit(toxicity.labelled_sample(docs, labels, part != 1))
    out = toxicity.scored(docs.withColumn("held_out", part == 1), model, ("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.protect(table(spark, sf_dir, "documents"), PII_KEY)


def op11_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, moved)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.read(warc.archive(table(spark, sf_dir, "pages")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_document_fingerprints, op2_license_scans, op3_simhash_near_dedup,
        op4_benchmark_decontamination, op5_packing, op6_html_extraction, op7_language_id,
        op8_toxicity, op9_secret_scans, op10_pii_pseudonyms, op11_hard_negative_mining,
        op12_embedding_whitening, op13_warc_bundles,
    )
}

#: What the other operators do is beyond SQL; tests hold them against brute force.
ORACLE: dict[str, str] = {
    "op9_secret_scans": sql.SECRET_REPORT,
    "op11_hard_negative_mining": sql.HARD_NEGATIVES,
    "op13_warc_bundles": sql.WARC_RECORDS,
}
