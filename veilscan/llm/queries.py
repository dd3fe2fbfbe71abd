"""The registered queries: each operator over its whole table, digest columns on top."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, collocations, decontaminate, line_dedup, ngram_lm, oracles, packing, prefix_trie, quality, reshard, simhash, toxicity, url_filter, winnowing
from .common import crc_mod

SHARDS = 16
NEIGHBOURS = 20
RULES = [url_filter.parse_rule(v, r) for v, r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("_metadata.file_path").alias("place"), F.col("_metadata.row_index").alias("line"))
    made = reshard.plan_reshard(docs, "place", SHARDS, row_col="line")
    rows = reshard.with_slots(reshard.assign(made).drop("text", "line"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "old_shard", (F.col("shard") != F.col("old_shard")).alias("moved"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    model = ngram_lm.train(docs, ~held_out)
    return ngram_lm.score(docs, model, held_out)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "removed_chunks", "removed_bytes", "copied", F.crc32(F.col("text").cast("binary")).alias("kept_crc32"), "text")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = quality.train(docs, labels, crc_mod(F.col("doc_id"), 5) != 0)
    scored = quality.score(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(table(spark, sf_dir, "pages"), RULES)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grammar = toxicity.train(docs, labels, crc_mod(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs.select("doc_id", "text"), grammar)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), NEIGHBOURS)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), markers=True)


def op11_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build_trie(table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


QUERIES = {
    "op1_reshard": op1_reshard,
    "op2_decontaminate": op2_decontaminate,
    "op3_ngram_lm": op3_ngram_lm,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_url_filter": op7_url_filter,
    "op8_toxicity": op8_toxicity,
    "op9_nearest": op9_nearest,
    "op10_pack": op10_pack,
    "op11_winnow": op11_winnow,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_collocations": op13_collocations,
}
ORACLE = oracles.ORACLE
