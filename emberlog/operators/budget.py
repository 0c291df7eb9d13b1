"""Token use of conversations against a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.scalars import token_estimate

# --- fixed values -----------------------------------------------------------------
MESSAGE_OVERHEAD = 4
THRESHOLD = 0.75
# ----------------------------------------------------------------------------------


def message_tokens(content: Column) -> Column:
    """Tokens of one message; a missing text counts as empty."""
    return token_estimate(content) + MESSAGE_OVERHEAD


def messages_tokens(df: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Tokens per conversation; summed before and after the shuffle, so long conversations are no hot spot."""
    return df.groupBy(*keys).agg(F.sum(message_tokens(F.col(content))).alias("tokens"))


def array_tokens(messages: Column) -> Column:
    """The same for an array of ``{role, content}`` held in one row."""
    return F.aggregate(messages, F.lit(0).cast("bigint"), lambda acc, m: acc + message_tokens(m["content"]))


def used(tokens: Column, summary: Column | None = None) -> Column:
    """Message tokens plus those of a summary that is not empty."""
    if summary is None:
        return tokens
    return tokens + F.when(F.coalesce(summary, F.lit("")) != "", token_estimate(summary)).otherwise(0)


def fraction_used(tokens: Column, budget: int, summary: Column | None = None) -> Column:
    return used(tokens, summary) / F.lit(budget)


def is_over_threshold(tokens: Column, budget: int, summary: Column | None = None,
                      threshold: float = THRESHOLD) -> Column:
    """Exactly at the threshold counts as over."""
    return fraction_used(tokens, budget, summary) >= threshold
