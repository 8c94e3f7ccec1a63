"""Corpus preparation: toxicity, near-duplicates, benchmark leaks, personal data, token ids.

Each stage takes the documents that its predecessor kept, whole, as a table read from Parquet.
"""

from __future__ import annotations

import public_tokenizers as vocab
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.llm.bpe import encode_texts
from tapeloom.llm.decontaminate import drop_contaminated
from tapeloom.llm.pii import mask_texts
from tapeloom.llm.similar import similar_documents
from tapeloom.llm.toxicity import score_texts, trained_on_labels
from tapeloom.sources import read_table, work_dir

#: Stages between SQL and brute force: a trained network, iterated links and vocabularies have no SQL form.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not call toxic; null and empty texts stay, and so do further columns of any name."""
    named = docs.toDF(*[f"__{c}" for c in docs.columns])
    scored = score_texts(named, trained_on_labels(spark, docs, sf_dir), named.columns, "__text")
    return scored.where("predicted = 0").select(*[F.col(f"__{c}").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; rows with a null id stay."""
    gone = similar_documents(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no item of the benchmark."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind and ``n_chars`` counted anew."""
    masked = mask_texts(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``ids``, ``n_tokens`` and the text decoded from the ids."""
    encoded = encode_texts(docs, vocab.path("byte_bpe_multi_50k.tiktoken"), vocab.PATTERN)
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.decode("decoded", "UTF-8").alias("text"))


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{work_dir(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
