"""Training-corpus pipeline: language ID, near-duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a DataFrame; all but the
last return the columns of documents. Between stages the rows are written as Parquet and read again, so a stage's plan
starts at a scan and a lost executor repeats one stage's task, not the whole chain.

* language: documents without a letter go, and those whose best label is hardly likelier than chance (one over the number
  of labels), or most of whose letters no training text had. Without labelled rows every document stays.
* near_duplicates: of each group linked by a similarity of 0.8 or more (five-word shingles) the document of the smallest
  id stays: links of SimHash's trie join, checked, and an exact join for what 64 bits can't tell.
* decontaminate: documents that hold a benchmark item, up to the error budget, go.
* secrets: every document stays; secrets in its text are replaced and n_chars follows.
* packing: sequences of at most 1024 tokens, with the token ids themselves (little-endian unsigned 32-bit).

Defined results, stage after stage: a null or empty text has no letter and goes at the first stage where there are labels,
else it is a copy of other such texts; of rows that repeat an id one stays; rows without an id stay; the least id wins
ties; an empty table gives no rows; very long texts are read whole; columns besides those of documents pass through all
but the last stage, whatever their names.

No SQL says what a trained network or a tokenizer does, so tests/llm hold each stage against a brute-force version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cairnlog.llm import decontam, langid, nearcopies, packing, secrets, simhash
from cairnlog.llm.common import remove, scratch, shared_dir, table
from cairnlog.llm.tokens import public_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.least_of_each(docs, nearcopies.near_copies(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_path("byte_bpe_50k.json"), end_id=0)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("secret_scan", hide_secrets), ("packing", packing_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the stages before it wrote, and their intermediate tables, are deleted on the way."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch(spark):
            docs = stage(spark, docs, sf_dir)
            schema = docs.schema
            docs.write.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        docs, before = spark.read.schema(schema).parquet(f"{folder}/{name}"), name
    return docs
