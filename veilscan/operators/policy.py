"""Prompt policy: the per-prompt decision ladder.

Scan, compression flag and optimisation are all row-local column expressions
on the prompt, so the whole ladder is one map-only pass with a single CASE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.functions.rules import ALL_RULES
from veilscan.operators.rewrite import compress_for_send, optimize_prompt
from veilscan.operators.scan import with_rule_hits


def prompt_policy(df: DataFrame, text_col: str = "text", block_on_secrets: bool = True,
                  block_on_pii: bool = False, block_on_optimize: bool = False,
                  compress_flags: bool = True) -> DataFrame:
    """Adds n_critical, n_noncritical, decision, reply_text.

    decision: ``pass`` (empty prompt or nothing to say), ``block_secrets``,
    ``compress``, ``block_pii``, ``warn``, ``block_optimize``, ``tip``.
    """
    t = F.col(text_col)
    ranks = F.array(*[F.lit(r.rank) for r in ALL_RULES])
    staged = with_rule_hits(df, text_col)
    rk = F.transform("_hits", lambda h: F.element_at(ranks, h["rule_ord"] + 1))
    staged = (staged.withColumn("n_critical", F.size(F.filter(rk, lambda r: r == 4)))
                    .withColumn("n_noncritical", F.size(F.filter(rk, lambda r: r != 4)))
                    .drop("_hits"))
    staged = compress_for_send(staged, text_col)
    opt = optimize_prompt(staged.select(*staged.columns), text_col)
    empty = t.isNull() | (F.length(t) == 0)
    opt_hit = F.col("should_suggest") & (F.col("tokens_saved") >= 3)
    decision = (F.when(empty, F.lit("pass"))
                 .when((F.col("n_critical") > 0) & F.lit(block_on_secrets), F.lit("block_secrets"))
                 .when(F.lit(compress_flags) & F.col("outcome").isNotNull(), F.lit("compress"))
                 .when((F.col("n_noncritical") > 0) & F.lit(block_on_pii), F.lit("block_pii"))
                 .when(F.col("n_critical") + F.col("n_noncritical") > 0, F.lit("warn"))
                 .when(opt_hit & F.lit(block_on_optimize), F.lit("block_optimize"))
                 .when(opt_hit, F.lit("tip"))
                 .otherwise(F.lit("pass")))
    reply = (F.when(decision == "compress", F.col("outcome.sent_text"))
              .when(decision.isin("block_optimize", "tip"), F.col("optimized_text")))
    return opt.withColumn("decision", decision).withColumn("reply_text", reply)
