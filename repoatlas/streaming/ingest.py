"""Resumable ingestion of landed files into sightings, catalog and history.

Every batch writes its own ``batch_id`` folder and overwrites just that one if
it is run again after a failure, so a restart repeats no row. The checkpoint
holds the resume pointer. A batch costs what it brings: the catalog is an
aggregate over the reduced sightings and is not rewritten per batch;
:func:`compact` folds the batches so far into one.
"""

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from repoatlas.functions.encoding import merge_keywords
from repoatlas.operators.upsert import first_sightings
from repoatlas.sources.readers import path_exists


def read_landing(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000
) -> DataFrame:
    """New files of a landing folder as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def _run(stream: DataFrame, checkpoint: str, save: Callable, mode: str = "append") -> StreamingQuery:
    """Everything landed so far processed, then stopped."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
    query.awaitTermination()
    return query


def read_batches(
    spark: SparkSession, folder: str, schema: T.StructType, before: int | None = None
) -> DataFrame:
    """All batches written to ``folder``, or those before one of them."""
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    if not path_exists(spark, folder):
        return spark.createDataFrame([], with_batch)
    rows = spark.read.schema(with_batch).parquet(folder)
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def _write_batch(rows: DataFrame, folder: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def ingest_pages(
    stream: DataFrame, folder: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]
) -> StreamingQuery:
    """Landed pages transformed and appended, picked up where it stopped."""
    return _run(
        stream, checkpoint, lambda rows, batch_id: _write_batch(transform(rows), folder, batch_id)
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def _state_on_disk(spark: SparkSession):
    """Queries started meanwhile keep their state in RocksDB, on disk instead of the heap."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def first_by_key(stream: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The rows of keys that come for the first time, of each the one of lowest ``seq``, as a stream.

    For output in update mode. The state store holds the first row of a key and
    when the key came first and last, by the time of the batch, which a batch
    that is run again keeps. A key is new if both are the same. Every task reduces its own rows
    of a key before they meet. A null key is a key like others.
    """
    names = stream.columns
    timed = stream.select(F.struct(*names).alias("row"), F.current_timestamp().alias("came"))
    state = timed.groupBy(F.col(f"row.{key}").alias("key")).agg(
        F.min_by("row", F.struct("came", f"row.{seq}")).alias("row"),
        F.min("came").alias("first_came"),
        F.max("came").alias("last_came"),
    )
    return state.filter("first_came = last_came").select("row.*")


def ingest_first_by_key(
    stream: DataFrame, folder: str, checkpoint: str, key: str, seq: str = "seq"
) -> StreamingQuery:
    """Only the first row ever seen of every ``key``; see :func:`first_by_key`.

    A batch reads what has landed and the state of its own keys, nothing that was
    written before.
    """
    with _state_on_disk(stream.sparkSession):
        return _run(
            first_by_key(stream, key, seq),
            checkpoint,
            lambda rows, batch_id: _write_batch(rows, folder, batch_id),
            mode="update",
        )


def ingest_sightings(
    stream: DataFrame, folder: str, checkpoint: str, order: list[str]
) -> StreamingQuery:
    """Sightings of repositories into ``history`` (all) and ``sightings`` (reduced)."""

    def save(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        try:
            _write_batch(rows, f"{folder}/history", batch_id)
            _write_batch(first_sightings(rows, order), f"{folder}/sightings", batch_id)
        finally:
            rows.unpersist()

    return _run(stream, checkpoint, save)


def catalog_view(
    spark: SparkSession, folder: str, schema: T.StructType, order: list[str]
) -> DataFrame:
    """The current catalog: first write wins, keywords of all batches merged."""
    sightings = read_batches(spark, f"{folder}/sightings", schema)
    return first_sightings(sightings, ["batch_id", *order]).drop("batch_id")


def history_view(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return read_batches(spark, f"{folder}/history", schema)


def compact(
    spark: SparkSession, folder: str, target: str, schema: T.StructType, order: list[str]
) -> None:
    """The catalog, and the whole history, written as the first batch of a new folder."""
    _write_batch(catalog_view(spark, folder, schema, order), f"{target}/sightings", -1)
    _write_batch(history_view(spark, folder, schema).drop("batch_id"), f"{target}/history", -1)


def running_keywords(stream: DataFrame, order: list[str]) -> DataFrame:
    """The growing keyword set per ``id``, as a stream."""
    state = stream.groupBy("id").agg(
        F.min_by("keyword", F.struct(*order)).alias("keyword"),
        F.collect_set("keyword").alias("keywords"),
    )
    return state.select(
        "id", "keyword", merge_keywords("keyword", "keywords").alias("additional_keywords")
    )


def ingest_keywords(stream: DataFrame, folder: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Changed keyword sets of every batch; the newest batch of an id holds."""
    return _run(
        running_keywords(stream, order),
        checkpoint,
        lambda rows, batch_id: _write_batch(rows, folder, batch_id),
        mode="update",
    )


def keywords_view(spark: SparkSession, folder: str) -> DataFrame:
    schema = T.StructType.fromDDL("id long, keyword string, additional_keywords string")
    rows = read_batches(spark, folder, schema)
    newest = F.max_by(F.struct(*schema.names), "batch_id")
    return rows.groupBy("id").agg(newest.alias("row")).select("row.*")
