"""Token cost estimates: each text row is expanded by the literal price list (six models); no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.operators.rewrite import approx_tokens

# ---------------------------------------------------------------------------
# Model prices in USD per 1,000,000 tokens, labels, date.
# ---------------------------------------------------------------------------
PRICING = [
    ("claude-opus-4-8", "Claude Opus 4.8", 5.0, 25.0),
    ("claude-opus-4-7", "Claude Opus 4.7", 5.0, 25.0),
    ("claude-sonnet-4-6", "Claude Sonnet 4.6", 3.0, 15.0),
    ("claude-haiku-4-5", "Claude Haiku 4.5", 1.0, 5.0),
    ("gpt-4o", "GPT-4o", 2.5, 10.0),
    ("gpt-4o-mini", "GPT-4o-mini", 0.15, 0.6),
]
PRICING_LAST_UPDATED = "2026-06-12"
OUTPUT_TOKEN_CAP = 1024


def round6(x: Column) -> Column:
    """Math.round(x * 1e6) / 1e6 (half up toward +inf)."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def _price_rows(models: list[str] | None, prices=None):
    table = list(prices) if prices is not None else PRICING
    known = {m for m, *_ in table}
    if models:
        bad = [m for m in models if m not in known]
        if bad:
            raise ValueError(f"unknown model(s): {bad}")
    return [p for p in table if not models or p[0] in models]


def estimate_cost(df: DataFrame, prices=None, text_col: str = "text",
                  models: list[str] | None = None, expected_output_tokens: Column | int | None = None,
                  token_counter=approx_tokens, rounded: bool = True) -> DataFrame:
    """One row per (text row, model): tokens and USD costs, rounded to six places unless told otherwise.

    The price list (built-in, or ``prices`` as (model, label, input, output)
    tuples) is a handful of literals: each text row is expanded with an
    ``explode`` of that literal array -- a projection, no join and nothing
    broadcast that could grow. Unknown models are rejected up front.
    """
    tok = df.withColumn("input_tokens", token_counter(F.col(text_col)))
    rows = _price_rows(models, prices)
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(i)).alias("input_usd_per_m"),
                             F.lit(float(o)).alias("output_usd_per_m")) for m, _l, i, o in rows])
    j = tok.select("*", F.explode(arr).alias("_p")).select(
        *tok.columns, "_p.model", "_p.input_usd_per_m", "_p.output_usd_per_m")
    if expected_output_tokens is None:
        out_tok = F.least(F.col("input_tokens"), F.lit(OUTPUT_TOKEN_CAP))
    else:
        out_tok = F.lit(expected_output_tokens) if isinstance(expected_output_tokens, int) else expected_output_tokens
    in_cost = F.col("input_tokens") / 1e6 * F.col("input_usd_per_m")
    out_cost = F.col("estimated_output_tokens") / 1e6 * F.col("output_usd_per_m")
    j = j.withColumn("estimated_output_tokens", out_tok.cast("int"))
    cost = round6 if rounded else (lambda x: x)
    return (j.withColumn("input_cost_usd", cost(in_cost))
             .withColumn("estimated_output_cost_usd", cost(out_cost))
             .withColumn("total_estimated_usd", cost(in_cost + out_cost))
             .withColumn("approximate", F.lit(True))
             .withColumn("pricing_last_updated", F.lit(PRICING_LAST_UPDATED))
             .drop("input_usd_per_m", "output_usd_per_m"))
