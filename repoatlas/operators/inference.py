"""Stages where a user plugs in a model; the only Python workers used."""

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoatlas.fixed_values import SPACES, WIDE_SPACES
from repoatlas.functions.arrays import term_places
from repoatlas.functions.text import terms
from repoatlas.functions.vectors import l2_normalize
from repoatlas.session import ship_package, written

# Values of about so many characters, or so many of them, are handed to a model at a time.
SLICE_CHARS = 1_000_000
SLICE_ROWS = 2_000

_SPACES = re.compile(f"[{SPACES}{WIDE_SPACES}]+")


def infer(
    rows: DataFrame,
    in_col: str,
    out_col: str,
    load: Callable[[], Callable[[pd.Series], pd.Series]],
    out_type: T.DataType = T.StringType(),
) -> DataFrame:
    """``rows`` with ``out_col`` from a model over batches of ``in_col``.

    ``load`` runs once per task and returns the batch function, so a model is
    loaded once and then sees Arrow batches, long ones in slices. What it makes
    on the way is then bounded, however many rows a task has.
    """
    ship_package(rows.sparkSession)

    @F.pandas_udf(out_type)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.concat([pd.Series(model(part)) for part in _slices(batch)], ignore_index=True)

    return rows.withColumn(out_col, run(in_col))


def _slices(batch: pd.Series) -> Iterator[pd.Series]:
    """Consecutive values, cut by the characters of texts; an empty batch is one slice."""
    texts = batch.dtype == object or pd.api.types.is_string_dtype(batch.dtype)
    sizes = [len(v) if isinstance(v, str) else 0 for v in batch] if texts else [0] * len(batch)
    start = size = 0
    for row, more in enumerate(sizes):
        if row > start and (size + more > SLICE_CHARS or row - start >= SLICE_ROWS):
            yield batch.iloc[start:row].reset_index(drop=True)
            start, size = row, 0
        size += more
    yield batch.iloc[start:].reset_index(drop=True)


def lead_summarizer(count: int = 3) -> Callable[[], Callable[[pd.Series], pd.Series]]:
    """The stand-in for a summarizing model: the first sentences of a whole batch."""

    def load():
        def first(texts: pd.Series) -> pd.Series:
            flat = texts.str.replace(_SPACES, " ", regex=True).str.strip(" ")
            return flat.str.split(r"(?<=[.!?]) ", n=count, regex=True).str[:count].str.join(" ")

        return first

    return load


def hash_embeddings(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dimensions: int = 1024
) -> DataFrame:
    """Length-one TF-IDF vectors over hashed terms, as ``positions`` and ``values``.

    The default encoder. A term's position is the beginning of its MD5 digest
    modulo ``dimensions``, at most 65,536. Each text is split once; the counts
    are written, and document frequencies, one row per dimension at most, are
    made of them and applied inside the row. A text without a term has no
    positions.
    """
    place = lambda t: (F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % dimensions)
    counted = written(
        docs.select(
            F.col(doc_id).alias("doc"),
            term_places(F.transform(F.coalesce(terms(text), F.array().cast("array<string>")), place)).alias("found"),
        )
    )
    frequencies = counted.select(F.explode("found.term").alias("pos")).groupBy("pos").agg(F.count("*").alias("df"))
    corpus = counted.agg(F.count("*").alias("n")).scalar()
    weights = (
        docs.sparkSession.range(dimensions)
        .select(F.col("id").cast("int").alias("pos"))
        .join(frequencies, "pos", "left")
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("df", F.lit(0)).alias("df")))).alias("all"))
        .scalar()
    )
    held = counted.withColumns({"n": corpus, "weights": weights})
    idf = lambda pos: F.log((F.col("n") + 1.0) / (F.get(F.col("weights"), pos)["df"] + 1.0))
    raw = held.select(
        "doc", F.col("found.term").alias("positions"), F.transform("found", lambda t: t["tf"] * idf(t["term"])).alias("raw")
    )
    return raw.select(F.col("doc").alias(doc_id), "positions", l2_normalize("raw").alias("values"))


def dense(positions: str, values: str, dimensions: int = 1024) -> Column:
    """A vector of ``dimensions`` numbers of the positions and values."""
    filled = F.map_from_arrays(positions, values)
    return F.transform(
        F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at(filled, i), F.lit(0.0))
    )


def encode_texts(
    docs: DataFrame,
    load: Callable[[], Callable[[pd.Series], pd.Series]],
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Vectors of an encoder the user brings, one per text."""
    narrow = docs.select(doc_id, F.col(text))
    return infer(narrow, text, "embedding", load, T.ArrayType(T.DoubleType())).drop(text)
