"""Chat messages for a model stage."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoatlas.fixed_values import (
    CATEGORY_SYSTEM,
    CATEGORY_USER,
    MAX_MODEL_CHARS,
    RELEVANCE_SYSTEM,
    RELEVANCE_USER,
    SUMMARY_SYSTEM,
    SUMMARY_USER,
)
from repoatlas.functions.text import truncate_text


def chat_messages(
    text: str, system: str, user: str, max_chars: int = MAX_MODEL_CHARS
) -> Column:
    """System and user message, the text put in for ``{readme_text}``."""
    filled = F.replace(F.lit(user), F.lit("{readme_text}"), truncate_text(text, max_chars))
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), filled.alias("content")),
    )


def category_messages(text: str) -> Column:
    return chat_messages(text, CATEGORY_SYSTEM, CATEGORY_USER)


def summary_messages(text: str) -> Column:
    return chat_messages(text, SUMMARY_SYSTEM, SUMMARY_USER)


def relevance_messages(text: str, components: list[str]) -> Column:
    listed = ", ".join(f"'- {c}'" for c in components)
    return chat_messages(text, RELEVANCE_SYSTEM, RELEVANCE_USER.replace("{components}", listed))
