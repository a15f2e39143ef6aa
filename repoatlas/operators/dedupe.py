"""First row per key, and the rows dropped for it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedupe_first(rows: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Per ``key`` the row of lowest ``seq``.

    ``seq`` is unique. Only keys and numbers are aggregated; each task reduces
    its own rows of a key to one before the shuffle, however many copies the
    key has. The wide rows then meet the numbers that stay.
    """
    firsts = rows.groupBy(key).agg(F.min(seq).alias(seq)).select(seq)
    return rows.join(firsts, seq, "left_semi").select(*rows.columns)


def duplicate_rows(rows: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """All rows :func:`dedupe_first` drops.

    The first rows are known by their unique ``seq``, so the anti-join runs on
    that and meets no hot key.
    """
    firsts = rows.groupBy(key).agg(F.min(seq).alias(seq)).select(seq)
    return rows.join(firsts, seq, "left_anti").select(*rows.columns)


def text_key(text: str) -> Column:
    """A short key for exact copies of a long text."""
    return F.sha2(text, 256)
