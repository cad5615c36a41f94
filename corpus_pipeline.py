"""The training-data pipeline: toxic documents out, copies and near copies out, benchmark passages out, the rest packed.

Each stage takes what its predecessor kept, as a table with the columns of ``documents``, and returns the rows that it keeps;
the last returns the places of all pieces in packed sequences. ``run`` writes every stage below the session's shared
checkpoint folder and reads it again, so a stage never computes an earlier one anew.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leasemill.llm import decontaminate, exactdedup, neardup, packing, rows, toxicity
from leasemill.llm.store import shipped, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled documents, scores below its threshold."""
    shipped(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    return docs.where(toxicity.score(docs, model) < toxicity.THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text but for white space the longest, then the one with the smallest doc_id."""
    shipped(spark)
    keyed = rows.with_keys(docs)
    found = exactdedup.exact_duplicates(keyed, carry=rows.KEYS).where("kept")
    first = found.groupBy("text_sha256").agg(F.min(F.struct(*rows.KEYS)).alias("k"), F.count("*").alias("n"))
    return rows.only_once(keyed, stored(first.select("k.*", "n"), "kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more: the one with the smallest doc_id."""
    shipped(spark)
    keyed = rows.with_keys(docs)
    found = neardup.near_duplicates(keyed.select(F.struct(*rows.KEYS).alias("doc_id"), "text"), width=5, percent=80)
    kept = found.where("kept").groupBy("doc_id").agg(F.count("*").alias("n"))
    return rows.only_once(keyed, stored(kept.select("doc_id.*", "n"), "kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten consecutive words of a benchmark item, or the whole of a shorter one."""
    shipped(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return docs.where(~decontaminate.is_contaminated(docs, items, width=10))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence of at most 1024 tokens and its offset there."""
    shipped(spark)
    path = public_tokenizers.path
    return packing.packed(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, size=1024, added_tokens=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The classifier and the tokenizer have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shipped(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
