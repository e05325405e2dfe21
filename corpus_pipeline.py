"""From raw documents to packed sequences, one stage after the other.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All stages but the last give the
columns of ``documents``; texts that a stage changes get their new ``n_chars``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stateglass.llm.common import table, written
from stateglass.llm.contamination import remove_contamination
from stateglass.llm.packing import pack_texts
from stateglass.llm.simhash import simhash_groups
from stateglass.llm.substring import remove_repeated_passages
from stateglass.llm.toxicity import score_toxicity, train

VOCABULARY = "word_bpe_49k.json"

# Stages train, search and pack, which no SQL says.
ORACLE_SQL = None


def quoted(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def free_name(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores as it takes to be no column of ``docs``."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold of their language.

    The model learns from the labelled documents that are still there.
    """
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    model = train(docs.select(F.col("doc_id").alias("id"), "text", "lang"), labels)
    name = free_name(docs, "toxicity")
    scored = score_toxicity(docs, model, name)
    return scored.where(~F.col(f"{name}.toxic")).select(*quoted(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of linked fingerprints.

    Rows that share an id stay or go together; rows with a null id stay.
    """
    groups = simhash_groups(docs)
    gone = written(groups.where("id != component").select("id").distinct(), "duplicates")
    name = free_name(docs, "gone")
    gone = gone.select(F.col("id").alias(name))
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti").select(*quoted(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 20 words that occur earlier; emptied ones go.

    Texts without such passages come back as they were.
    """
    cut = remove_repeated_passages(docs, layout=True)
    changed = F.size("spans") > 0
    cut = cut.where(~changed | (F.trim("kept") != ""))
    columns = {
        "text": F.col("kept"),
        "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row.n_chars")),
    }
    return cut.select([columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of benchmark items; mostly hit documents go."""
    clean = remove_contamination(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence, with its ids."""
    return pack_texts(docs, public_tokenizers.path(VOCABULARY)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
