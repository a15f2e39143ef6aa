import duckdb
import pytest

from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())


@pytest.fixture
def table(spark):
    """A documents table of (doc_id, text) or (doc_id, text, lang) rows."""

    def make(rows):
        full = [(i, t, rest[0] if rest else "en", None, len(t) if t is not None else None) for i, t, *rest in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


AWKWARD = [
    (None, None),
    (None, "same text here"),
    (None, "Same Text here"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "word " * 30_000),
    (5, "x" * 200_000),
    (6, "tie"),
    (7, "TIE"),
    (7, "tie"),
    (8, "again and again"),
    (8, "again and again"),
    (9, "ünï çødé 漢字 😀 é"),
]


@pytest.fixture
def awkward(table):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named like results."""
    from pyspark.sql import functions as F

    named = ("fp", "id", "kept", "hash", "score", "root", "size", "shard", "base", "spans", "n_words", "text_key", "piece", "lang_pred", "clean_text")
    return table(AWKWARD).withColumns({n: F.lit(n) for n in named})


@pytest.fixture
def empty(table):
    return table([])
