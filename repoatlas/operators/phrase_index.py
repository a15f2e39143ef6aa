"""Phrase search in texts without reading them all.

The index is built once. It holds the rows in blocks, written one after the
other, and a posting per block and trigram of its lower-cased texts. A phrase can
only stand in blocks that have all its trigrams; the texts of these are read and
compared. Postings are sorted by trigram, so a search reads a few row groups of
them, and a trigram of every block is spread over many.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoatlas.functions.text import _column
from repoatlas.session import ship_package

BLOCK_BITS = 7
# Trigrams are filed by a hash, so that a search opens few folders.
SHELVES = 64
# Up to so many blocks are named in the scan, which then skips the others' texts.
NAMED_BLOCKS = 1000
# Bytes of a row group, the least that a scan can skip.
GROUP_BYTES = 1 << 20


def trigrams(text: str) -> np.ndarray:
    """The different runs of three characters, as numbers of 21 bits a character."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])


def _shelf(gram) -> F.Column:
    return F.pmod(F.xxhash64(gram), F.lit(SHELVES)).cast("int")


def build_phrase_index(rows: DataFrame, folder: str, text: str = "readme") -> None:
    """Writes ``rows`` in blocks to ``folder/rows`` and their trigrams to ``folder/postings``.

    A null text has no trigram and is in no search.
    """
    spark = rows.sparkSession
    ship_package(spark)
    # The number of a row is that of its task, and its place there.
    numbered = rows.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
    numbered.write.option("parquet.block.size", GROUP_BYTES).parquet(f"{folder}/rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            texts = batch.column("text").to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for start, stop in zip(edges, edges[1:]):
                found = [trigrams(t) for t in texts[start:stop] if t]
                grams = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams), pa.array(np.full(len(grams), blocks[start] if stop > start else 0))], names=["gram", "block"]
                )

    saved = spark.read.parquet(f"{folder}/rows")
    postings = saved.select("block", F.lower(_column(text)).alias("text")).mapInArrow(run, "gram long, block long")
    # By range, so that a trigram of all blocks is no task of its own.
    (
        postings.withColumn("shelf", _shelf("gram"))
        .repartitionByRange("shelf", "gram", "block")
        .sortWithinPartitions("shelf", "gram", "block")
        .write.option("parquet.block.size", GROUP_BYTES)
        .partitionBy("shelf")
        .parquet(f"{folder}/postings")
    )


def candidate_blocks(spark: SparkSession, folder: str, phrase: str) -> DataFrame | None:
    """``block`` of the blocks that have all trigrams of ``phrase``; nothing if it has none."""
    grams = trigrams(phrase).tolist()
    if not grams:
        return None
    asked = spark.createDataFrame([(g,) for g in grams], "gram long").select("gram", _shelf("gram").alias("shelf"))
    shelves = sorted({r.shelf for r in asked.collect()})
    found = spark.read.schema("gram long, block long, shelf int").parquet(f"{folder}/postings")
    # A block split between two tasks has a posting of each.
    return (
        found.filter(F.col("shelf").isin(shelves) & F.col("gram").isin(grams))
        .select("block", "gram").distinct()
        .groupBy("block").agg(F.count("*").alias("n"))
        .filter(F.col("n") == len(grams))
        .select("block")
    )


def phrase_search(spark: SparkSession, folder: str, phrase: str, text: str = "readme") -> DataFrame:
    """The indexed rows whose lower-cased ``text`` contains ``phrase``, as a scan of all gives them.

    A phrase below three characters has no trigram; all texts are read for it.
    """
    rows = spark.read.parquet(f"{folder}/rows")
    holds = F.contains(F.lower(_column(text)), F.lit(phrase))
    blocks = candidate_blocks(spark, folder, phrase)
    if blocks is not None:
        named = [r.block for r in blocks.limit(NAMED_BLOCKS + 1).collect()]
        if len(named) <= NAMED_BLOCKS:
            rows = rows.filter(F.col("block").isin(named))
        else:
            rows = rows.join(blocks, "block", "left_semi")
    return rows.filter(holds).drop("block")
