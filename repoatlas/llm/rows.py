"""Carrying out verdicts on the rows of a table of texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoatlas.llm.tasks import text_of


def text_key(text: str = "text") -> Column:
    """With the id, what names a row: a digest of its text as it is."""
    return F.md5(text_of(text).cast("binary"))


def whole_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_id``, ``row_key`` and all columns as one ``row``, so that no name of theirs meets another."""
    return docs.select(
        F.col(id_col).alias("row_id"), text_key(text_col).alias("row_key"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    )


def keep_rows(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose verdict is ``kept``, with all their columns.

    ``verdicts`` has a row (``id``, ``text_key``, ``kept``) per document. Of
    rows that repeat an id and its text one stays. Only rows that go or repeat
    are looked up, so the texts meet a small table.
    """
    marked = (
        verdicts.groupBy(F.col("id").alias("marked_id"), F.col("text_key").alias("marked_key"))
        .agg(F.max("kept").alias("marked_kept"), F.count("*").alias("marked_rows"))
        .filter("marked_rows > 1 or not marked_kept")
    )
    keyed = whole_rows(docs, id_col, text_col).join(
        marked,
        F.col("row_id").eqNullSafe(F.col("marked_id")) & (F.col("row_key") == F.col("marked_key")),
        "left",
    )
    single = keyed.filter("marked_kept is null").select("row.*")
    repeated = keyed.filter("marked_kept").dropDuplicates(["row_id", "row_key"]).select("row.*")
    return single.unionByName(repeated)

