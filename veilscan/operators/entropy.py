"""High-entropy token detection (secrets no named rule knows).

Candidates come from one regex pass with offsets; the entropy itself is a
higher-order expression over the candidate's distinct characters, so only the
(short) candidate strings, never whole texts, go through interpreted lambdas.
The allowlist is an anti join on ``sha256:<hex>`` of the token.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.regex import matches_with_offsets

# Candidate token shape, hex shape and default thresholds.
TOKEN_PATTERN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
HEX_PATTERN = r"^[0-9a-fA-F]+$"
MIN_ENTROPY = 4.0
HEX_MIN_ENTROPY = 3.2
MIN_LENGTH = 24


def shannon_entropy(c: Column) -> Column:
    """Bits per character; 0 for the empty string.

    Distinct characters in first-occurrence order, so the float sum follows
    the same order as a left-to-right counting map.
    """
    n = F.length(c)
    chars = F.filter(F.array_distinct(F.split(c, "")), lambda x: F.length(x) > 0)

    def term(ch):
        cnt = n - F.length(F.replace(c, ch, F.lit("")))
        p = cnt / n
        return p * F.log2(p)

    h = F.aggregate(F.transform(chars, term), F.lit(0.0).cast("double"), lambda acc, x: acc - x)
    return F.when(n == 0, F.lit(0.0)).otherwise(h)


def looks_like_prose(c: Column) -> Column:
    vowels = F.length(c) - F.length(F.regexp_replace(c, "[aeiouAEIOU]", ""))
    return c.rlike("^[A-Za-z]+$") & (vowels / F.length(c) > 0.25)


def token_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def js_round2(x: Column) -> Column:
    """Math.round(x*100)/100 (half up toward +inf)."""
    return F.floor(x * 100 + 0.5) / 100


def high_entropy_tokens(df: DataFrame, text_col: str = "text", id_cols: Sequence[str] = ("doc_id",),
                        allowed: DataFrame | None = None, min_entropy: float = MIN_ENTROPY,
                        min_length: int = MIN_LENGTH) -> DataFrame:
    """(ids, token, entropy (2 dp), start, end, reason) per high-entropy token."""
    cols = list(id_cols)
    cands = df.select(*cols, matches_with_offsets(F.col(text_col), TOKEN_PATTERN).alias("_c"))
    ex = cands.select(*cols, F.explode_outer("_c").alias("_t")).where(F.col("_t").isNotNull())
    ex = ex.select(*cols, F.col("_t.m").alias("token"), F.col("_t.s").alias("start"), F.col("_t.e").alias("end"))
    ex = ex.where((F.length("token") >= min_length) & ~looks_like_prose(F.col("token")))
    if allowed is not None:
        ex = ex.withColumn("token_hash", token_hash(F.col("token")))
        ex = ex.join(allowed.select(F.col("token_hash")).distinct(), "token_hash", "left_anti").drop("token_hash")
    ex = ex.withColumn("_h", shannon_entropy(F.col("token"))).withColumn("_hex", F.col("token").rlike(HEX_PATTERN))
    ex = ex.where(F.col("_h") >= F.when(F.col("_hex"), F.lit(HEX_MIN_ENTROPY)).otherwise(F.lit(min_entropy)))
    reason = F.format_string("%s (%d chars, %s bits/char)",
                             F.when(F.col("_hex"), F.lit("high-entropy hex string")).otherwise(F.lit("high-entropy token")),
                             F.length("token"), F.format_string("%.2f", F.col("_h")))
    return ex.select(*cols, "token", js_round2(F.col("_h")).alias("entropy"), "start", "end", reason.alias("reason"))


def recurring_token_allowlist(tokens: DataFrame, id_col: str = "doc_id", min_docs: int = 2) -> DataFrame:
    """Allowlist of token hashes seen in >= ``min_docs`` distinct texts.

    Distinct (token, id) pairs are combined map-side first, so a token that
    appears in a third of all rows still aggregates in bounded memory.
    """
    pairs = tokens.select(token_hash(F.col("token")).alias("token_hash"), id_col).distinct()
    return (pairs.groupBy("token_hash").agg(F.count(F.lit(1)).alias("n"))
                 .where(F.col("n") >= min_docs).select("token_hash"))
