"""A training-data pipeline over ``documents``: five of the operators, each on what the last one kept.

Every stage takes nulls in any column, empty, very long and repeated texts, empty tables and extra
columns of any names; columns that it does not write keep their values.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from modweave.llm import langid, mixing, packing, secrets, simhash
from modweave.llm.folds import held_out
from modweave.llm.queries import TARGETS, domains, tokenizer_path
from modweave.runtime import cut, ensure_checkpoint_dir

#: Texts that take more bits for each byte than this under every language are no text in any of them.
MOST_BITS = 6.5
#: Rows to drop are broadcast up to this many, and joined by a shuffle beyond.
BROADCAST_IDS = 2_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without text, without letters or in no known language go.

    Learned outside the held-out fold. Rows with null ids stay if their text does; repeated rows
    share their fate. A table without any text and language teaches nothing, and all rows go.
    """
    model = langid.train(docs.filter(~held_out()))
    told = langid.identify(docs, model)
    return told.filter((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= MOST_BITS)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: one row of each component stays, the least by id (null first) and then a hash of the row.

    Rows that repeat all columns are one. Texts that are null or without words are one component.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = F.struct(F.col("doc_id"), F.xxhash64(*columns).alias("of"))
    found = cut(simhash.near_duplicates(docs.select(key.alias("key"), "text"), "key"))
    gone = found.filter("key <> component_id").select(F.col("key.doc_id").alias("_id"), F.col("key.of").alias("_of")).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    rows = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64(*columns).alias("_row"), F.struct(*columns).alias("_kept"))
    kept = rows.join(gone, rows["_doc"].eqNullSafe(gone["_id"]) & (rows["_row"] == gone["_of"]), "left_anti")
    if found.groupBy("key").count().filter("count > 1").limit(1).count():  # rows that repeat all columns
        kept = kept.dropDuplicates(["_doc", "_row"])
    return kept.select("_kept.*")


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: spans are masked, copied or not, so n_chars is counted anew (null for a null text)."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document as often as its copies say, repeated rows alike.

    A table without labelled documents, or without words, stays as it is.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    classifier = mixing.train(docs.select("doc_id", "text"), domains(labels))
    return mixing.resample(docs, classifier, TARGETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of all documents in sequences of at most 4096 tokens; an empty text is its end token, a null id stays null."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", scan_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Perplexities, fingerprint components and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again. Empty tables give no rows."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
