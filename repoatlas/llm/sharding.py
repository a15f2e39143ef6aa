"""Shards by jump consistent hashing."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoatlas.llm.tasks import text_of
from repoatlas.session import written

# Fixed values of the published algorithm: factor of its random sequence.
JUMP_FACTOR = 2862933555777941757
WORD = 1 << 64
# About so many rows of a shard are numbered by one task.
BUCKET_ROWS = 10_000


def jump_hash(key: Column, shards: int) -> Column:
    """The shard of a 64-bit ``key`` among ``shards``, without any table of them.

    A key jumps forward from shard to shard along a random sequence that the
    key alone decides; it stays in the last one that exists. With one shard
    more, only keys that jump exactly there move. The sequence needs products
    modulo 2**64, which decimals hold exactly.
    """
    seed = F.when(key < 0, key.cast("decimal(20,0)") + F.lit(str(WORD)).cast("decimal(20,0)")).otherwise(
        key.cast("decimal(20,0)")
    )
    begin = F.struct(
        F.lit(-1).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("jump"),
        seed.cast("decimal(20,0)").alias("state"),
    )

    def step(at: Column, _: Column) -> Column:
        return F.when(at["jump"] >= shards, at).otherwise(moved(at))

    def moved(at: Column) -> Column:
        product = at["state"] * F.lit(JUMP_FACTOR).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")
        state = (product % F.lit(str(WORD)).cast("decimal(20,0)")).cast("decimal(20,0)")
        ahead = F.floor(state / F.lit(1 << 33)).cast("double") + 1
        jump = F.floor((at["jump"] + 1) * (F.lit(float(1 << 31)) / ahead)).cast("long")
        return F.struct(at["jump"].alias("shard"), jump.alias("jump"), state.alias("state"))

    steps = F.sequence(F.lit(1), F.lit(shards))
    return F.aggregate(steps, begin, step, lambda at: at["shard"].cast("int"))


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``size``, ``text_crc32``, ``shard`` and ``grown_shard`` (with one shard more) per document.

    The id alone decides (by its 64-bit hash, so it may have any type); null
    ids share a shard. A null text counts as empty: size 8.
    """
    content = text_of(text_col)
    key = F.xxhash64(id_col)
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(content) + 8).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
    )


def number_slots(rows: DataFrame, shards: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard.

    A shard's rows are dealt into buckets by a hash, numbered there, and moved
    up by the rows of the buckets before, so a shard of any size is numbered by
    many tasks. ``rows`` should be computed already.
    """
    buckets = max(1, math.ceil(rows.count() / (shards * bucket_rows)))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(buckets)))
    own = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("shard", "bucket")
        .agg(F.count("*").alias("held"))
        .select("shard", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    )
    return (
        dealt.withColumn("place", F.row_number().over(own).cast("long") - 1)
        .join(offsets, ["shard", "bucket"])
        .select(*rows.columns, (F.col("place") + F.col("offset")).alias("slot"))
    )


def shard_slots(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    Repeated rows have a slot each; an empty table gives an empty one; other
    columns are not read.
    """
    rows = written(assign_shards(docs, shards, id_col, text_col))
    return number_slots(rows, shards).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id") -> None:
    """``docs`` as Parquet with a folder ``shard=n`` for each shard; every task adds its own files.

    Where ``docs`` has a column ``shard``, the folders are named with as many ``_``
    more as make a new name, and the column stays in the files.
    """
    folder = "shard"
    while folder in (c.lower() for c in docs.columns):
        folder += "_"
    docs.withColumn(folder, jump_hash(F.xxhash64(id_col), shards)).write.partitionBy(folder).parquet(path)
