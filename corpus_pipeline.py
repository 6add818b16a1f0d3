"""A training corpus from ``documents``: five stages, each by one of the operators.

Each stage takes what the one before kept and returns the columns of ``documents``;
the last returns the packed sequences.

* rows that differ in any column are rows of their own; null texts are kept, as empty
  where a stage rewrites texts, and null ids stay
* extra columns of ``documents`` are dropped at the start
* an empty table, benchmark or label table is no error
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doorflux.llm import decontaminate, packing, secret_scan, simhash, toxicity
from doorflux.llm.common import crc_part, findable, shared_folder, table
from doorflux.llm.queries import VOCABULARY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A column of the stages' own; what it names is dropped before a stage returns.
KEY = "_row_key"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled rows of the query's part, and drops the documents whose score reaches the threshold."""
    findable(spark)
    docs = docs.select(*COLUMNS)
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit_all(docs, labels, crc_part("doc_id", 3) != 1)
    scored = toxicity.scored(docs, model, COLUMNS)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group."""
    findable(spark)
    return simhash.one_of_each(docs.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    findable(spark)
    keyed = docs.select(*COLUMNS).withColumn(KEY, F.xxhash64("doc_id", "text"))
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), KEY)
    return keyed.join(found.select(KEY), KEY, "left_anti").select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; each secret in its text is replaced by a mark."""
    findable(spark)
    hidden = secret_scan.redact(docs.select(*COLUMNS))
    return hidden.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    findable(spark)
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scans", without_secrets),
    ("packing", packed),
]

#: SQL cannot say what the stages do; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written to the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
