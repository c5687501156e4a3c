"""The model catalogue: a small configuration table of model names and their enum names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from evalspark.schemas import MODELS

# The default catalogue, in catalogue order.
DEFAULT_MODELS = (
    ("GPT_51_NANO_OR", "openrouter/openai/gpt-5-nano"),
    ("GROK_41_FAST_OR", "openrouter/x-ai/grok-4.1-fast"),
    ("SONNET_45_OR", "openrouter/anthropic/claude-sonnet-4.5"),
    ("GEMINI_3_OR", "openrouter/google/gemini-3-pro-preview"),
    ("GEMINI_3_FLASH_OR", "openrouter/google/gemini-3-flash-preview"),
    ("OPUS_45_OR", "openrouter/anthropic/claude-opus-4.5"),
    ("OPUS_46_OR", "openrouter/anthropic/claude-opus-4.6"),
    ("GPT_52_OR", "openrouter/openai/gpt-5.2"),
    ("GLM_47_OR", "openrouter/z-ai/glm-4.7"),
    ("MINIMAX_21_OR", "openrouter/minimax/minimax-m2.1"),
)


def model_catalogue(
    spark: SparkSession, entries: Sequence[tuple[str, str]] = DEFAULT_MODELS
) -> DataFrame:
    """(position, model, enum_name) from (enum name, model) pairs in catalogue order."""
    rows = [(position, model, name) for position, (name, model) in enumerate(entries)]
    return spark.createDataFrame(rows, MODELS)
