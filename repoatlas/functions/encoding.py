"""Delimited lists, language maps, JSON records and model responses."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoatlas.fixed_values import (
    KEYWORD_SEPARATOR,
    LANGUAGE_SEPARATOR,
    REASONS_FIELD,
    SCORE_FIELD,
    UNPARSED_SCORE,
)
from repoatlas.functions.text import _column


def encode_languages(languages) -> Column:
    """A map of language to bytes as ``C (10)| C++ (5)``."""
    parts = F.transform(
        F.map_entries(_column(languages)),
        lambda e: F.concat(e["key"], F.lit(" ("), e["value"].cast("string"), F.lit(")")),
    )
    return F.array_join(parts, LANGUAGE_SEPARATOR)


def language_entries(encoded) -> Column:
    """``C (10)| C++ (5)`` as an array of ``(language, bytes)``."""
    pattern = r"^(.*) \((\d+)\)$"
    parts = F.filter(
        F.transform(F.split(_column(encoded), r"\|"), lambda p: F.trim(p)),
        lambda p: p.rlike(pattern),
    )
    return F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, pattern, 1).alias("language"),
            F.regexp_extract(p, pattern, 2).cast("long").alias("bytes"),
        ),
    )


def decode_languages(encoded) -> Column:
    """``C (10)| C++ (5)`` as a map of language to bytes."""
    return F.map_from_entries(language_entries(encoded))


def join_keywords(keywords) -> Column:
    """Keywords sorted, distinct, without empty ones, joined by ``|``."""
    kept = F.filter(F.array_distinct(_column(keywords)), lambda k: k != "")
    return F.array_join(F.array_sort(kept), KEYWORD_SEPARATOR)


def split_keywords(joined) -> Column:
    """The keywords of a joined list, without empty ones."""
    parts = F.split(F.coalesce(_column(joined), F.lit("")), r"\|")
    return F.filter(parts, lambda k: k != "")


def merge_keywords(keyword, *keyword_arrays) -> Column:
    """All keywords of ``keyword_arrays`` but ``keyword`` itself, joined."""
    merged = F.array_distinct(
        F.concat(*[F.coalesce(_column(a), F.array().cast("array<string>")) for a in keyword_arrays])
    )
    return join_keywords(F.filter(merged, lambda k: ~k.eqNullSafe(_column(keyword))))


def parse_score_response(response) -> Column:
    """``(score, reasons)`` from the first line of a model's answer.

    Both fields must be there; otherwise, and for a missing answer or a
    malformed number, the fixed default score with no reasons is given.
    """
    first = F.substring_index(collapse_edges(response), "\n", 1)
    score = F.regexp_extract(first, SCORE_FIELD, 1).try_cast("double")
    reasons = F.filter(
        F.transform(
            F.split(F.regexp_extract(first, REASONS_FIELD, 1), ","),
            lambda r: collapse_edges(r),
        ),
        lambda r: r != "",
    )
    parsed = first.rlike(SCORE_FIELD) & first.rlike(REASONS_FIELD) & score.isNotNull()
    return F.when(
        parsed, F.struct(score.alias("score"), reasons.alias("reasons"))
    ).otherwise(
        F.struct(
            F.lit(UNPARSED_SCORE).alias("score"),
            F.array().cast("array<string>").alias("reasons"),
        )
    )


def collapse_edges(text) -> Column:
    """White space removed at both ends only."""
    return F.regexp_replace(_column(text), r"^\s+|\s+$", "")


def row_document(columns: list[str]) -> Column:
    """A row as one ``column: value`` line per column, for retrieval."""
    lines = [
        F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
        for c in columns
    ]
    return F.concat_ws("\n", *lines)
