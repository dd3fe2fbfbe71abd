"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread.

quality       documents that the classifier rejects go
line_dedup    repeated chunks of lines go; a document of which little and no whole passage is left goes
near_dedup    of each SimHash component the smallest doc_id stays
decontaminate documents that hold a benchmark passage go
pack          the rest is packed into sequences (the pieces are the result)

Each stage takes (spark, docs, sf_dir). All but the last return the columns of
``documents``. Repeated rows (same doc_id) are kept or dropped together; a null
doc_id never matches another row's decision, so such rows stay (by the last
stage null and empty texts are packed as their end id alone). Very long texts pass
each stage whole; extra columns, also those named like an operator's own, are carried
to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import decontaminate, line_dedup, packing, quality, queries, simhash
from veilscan.llm.common import crc_mod, work_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = queries.table(spark, sf_dir, "labels")
    net = quality.train(docs, labels, crc_mod(F.col("doc_id"), 5) != 0)
    scored = quality.score(docs, net, out="__score")
    return scored.where(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = line_dedup.dedup_lines(docs, prefix="__dedup_").where(~F.col("__dedup_copied"))
    shortened = F.when(F.col("__dedup_removed_chunks") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return made.withColumn("n_chars", shortened).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = simhash.near_duplicates(docs)
    gone = marked.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = decontaminate.find_leaks(docs, queries.table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.vocabulary(), markers=True)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pack", pack_stage),
]

#: SQL cannot express the classifier, the dedup stages, the alignment or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written before the next stage reads it."""
    docs = queries.table(spark, sf_dir, "documents")
    folder = work_dir(spark, "pipeline")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
