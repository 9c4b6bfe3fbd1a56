"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the stage before it kept, and is a table of its own in the shared folder.
All but the last keep the columns of documents. A doc_id names one document: rows that repeat it
share a stage's decision, and rows that repeat an id with an equal text are one from the
second stage on. Null texts count as empty; a null doc_id passes through. Empty tables give empty
results. Columns that documents doesn't have are left out at the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import quality
from quillspark.llm.common import saved, shared_dir, table
from quillspark.llm.decontaminate import decontaminate
from quillspark.llm.exact_dedup import exact_dedup, normalised_digest
from quillspark.llm.near_join import near_join
from quillspark.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents that the quality classifier scores lower go.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the line field takes for good."""
    docs = docs.select(COLUMNS)
    score = quality.scorer(quality.train(docs, table(spark, sf_dir, "labels")))
    return docs.withColumn("_score", score("text")).filter(F.col("_score") >= LEAST_QUALITY).drop("_score")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the row with the smallest doc_id."""
    gone = exact_dedup(docs).filter(~F.col("kept")).select("doc_id", F.col("text_sha256").alias("_digest"))
    named = docs.withColumn("_digest", normalised_digest())
    kept = named.join(gone, ["doc_id", "_digest"], "left_anti")
    # repeated rows; a null id is no name, so those rows all stay
    known = kept.filter("doc_id is not null").dropDuplicates(["doc_id", "_digest"])
    return known.unionByName(kept.filter("doc_id is null")).select(COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, keeps the one with the smallest doc_id."""
    gone = near_join(docs, words=5, p=80, q=100).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of benchmark items; drops documents that are mostly such passages."""
    clean = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return clean.filter(~F.col("dropped")).withColumn("n_chars", F.when(F.col("n_cut") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens in sequences of 1024: one row per piece of a document."""
    pieces = pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]
#: No SQL can express the first stage's model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    at, docs = shared_dir(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"{at}/stage{k}")
    return docs
