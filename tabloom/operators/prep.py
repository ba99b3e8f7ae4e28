"""Prompt and completion pairs from stored reasoning texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
STEP_MARKER = "Let's think step-by-step."
THINK_END = "</think>"
MAX_PROMPT_TOKENS = 16384
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def cot_split(df: DataFrame, reasoning: str) -> DataFrame:
    """Prompt up to the step marker, completion with the thinking part and the answer.

    Texts without both markers in this order are dropped.
    """
    text = F.col(reasoning)
    at = F.instr(text, STEP_MARKER)
    generated = F.substring(text, at + len(STEP_MARKER), F.length(text))
    end = F.instr(generated, THINK_END)
    return (
        df.filter((at > 0) & (end > 0))
        .withColumn("prompt", F.concat(F.substring(text, F.lit(1), at - 1), F.lit(STEP_MARKER)))
        .withColumn(
            "completion",
            F.concat(
                F.lit("<think>\n"), F.substring(generated, F.lit(1), end - 1), F.lit(THINK_END),
                F.substring(generated, end + len(THINK_END), F.length(text)),
            ),
        )
        .drop(reasoning)
    )


def token_estimate(text: Column) -> Column:
    """Words and single marks; stands in for the tokenizer of a model."""
    return F.size(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1))


def length_filter(df: DataFrame, limit: int = MAX_PROMPT_TOKENS) -> DataFrame:
    """Keep samples whose prompt fits and whose completion is not empty."""
    return df.filter((token_estimate(F.col("prompt")) < limit) & (token_estimate(F.col("completion")) > 0))
