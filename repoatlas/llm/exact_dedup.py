"""Exact duplicates by 128-bit content hash, with the bytes compared."""

import hashlib
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoatlas.llm.rows import keep_rows
from repoatlas.llm.tasks import digest, map_texts
from repoatlas.operators.skew import lookup_join
from repoatlas.session import written

Hasher = Callable[[bytes], bytes]


def hash128(content: bytes) -> bytes:
    return hashlib.md5(content, usedforsecurity=False).digest()


def _hashed(docs: DataFrame, id_col: str, text_col: str, hasher: Hasher, with_text: bool = False) -> DataFrame:
    """``id``, ``hash`` and either the normalised ``content`` or the digests, per document."""
    fields = [("hash", T.BinaryType())]
    if with_text:
        fields += [("content", T.StringType())]
    else:
        fields += [("text_sha256", T.StringType()), ("text_key", T.StringType())]

    def start():
        def work(texts):
            raw = ["" if t is None else t for t in texts]
            # Lower-cases A-Z only.
            low = pc.ascii_lower(pa.array(raw, pa.string()))
            contents = [t.encode() for t in low.to_pylist()]
            hashes = [hasher(c) for c in contents]
            if with_text:
                return hashes, low
            return (
                hashes,
                [hashlib.sha256(c).hexdigest() for c in contents],
                [digest(t) for t in raw],
            )

        return work

    return map_texts(docs, fields, start, (id_col,), text_col).withColumnRenamed(id_col, "id")


def _verdicts(docs: DataFrame, keep: str, id_col: str, text_col: str, hasher: Hasher) -> DataFrame:
    best = F.min if keep == "smallest" else F.max
    rows = written(_hashed(docs, id_col, text_col, hasher))
    classes = written(
        _hashed(docs, id_col, text_col, hasher, with_text=True)
        .groupBy("hash", "content")
        .agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
        .select("hash", "keep_id", "group_size")
    )
    # Where a hash has more rows than one class of equal bytes, texts collide.
    held = classes.groupBy("hash").agg(F.max("group_size").alias("held"))
    collided = written(
        rows.groupBy("hash")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .join(held, "hash", "left")
        .filter("held is null or held < n")
        .select("hash")
    )
    if collided.isEmpty():
        found = lookup_join(rows, classes, "hash", "group_size", "id")
    else:
        found = _settled(docs, id_col, text_col, hasher, best, rows, classes, collided)
    alone = F.col("group_size").isNull()
    return found.select(
        "id",
        "text_key",
        "text_sha256",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
    ).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def _settled(docs, id_col, text_col, hasher, best, rows, classes, collided) -> DataFrame:
    """Rows of collided hashes meet their class of equal bytes, the others their hash."""
    clean = written(classes.join(collided, "hash", "left_anti"))
    found = lookup_join(rows.join(collided, "hash", "left_anti"), clean, "hash", "group_size", "id")
    by_bytes = (
        _hashed(docs, id_col, text_col, hasher, with_text=True)
        .join(collided, "hash", "left_semi")
        .groupBy("content")
        .agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))
        .select(F.sha2("content", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    settled = rows.join(collided, "hash", "left_semi").join(by_bytes, "text_sha256")
    return found.unionByName(settled.select(*found.columns))


def duplicate_groups(
    docs: DataFrame,
    keep: str = "smallest",
    id_col: str = "doc_id",
    text_col: str = "text",
    hasher: Hasher = hash128,
) -> DataFrame:
    """A row per document: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal if their bytes are, after lower-casing A-Z; a null text is
    empty. Of equal texts the row with the ``smallest`` (or ``largest``) id
    stays. A null id never wins over another; ``keep_id`` is null only if no
    row of the group has an id. Rows that repeat an id and its text are alike,
    so all of them are ``kept`` or none; ``drop_duplicates`` leaves one. An
    empty table gives an empty one; other columns are not read.

    Rows meet by hash and, inside a hash, by bytes: equal texts collapse in each
    task before the shuffle, so a group may be of any size. Of a hash that two
    different texts share (``hasher`` is a parameter to test that), each class
    of equal bytes is a group of its own.
    """
    return _verdicts(docs, keep, id_col, text_col, hasher).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256"
    )


def drop_duplicates(
    docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs``, all columns, with one row of each group of equal texts.

    Which one is said in ``duplicate_groups``. Of rows with the winning id
    whose texts differ in case, the smallest digest of the text as it is wins.
    """
    verdicts = written(_verdicts(docs, keep, id_col, text_col, hash128))
    # Only rows that repeat the winning id can tie.
    ties = (
        verdicts.filter("kept and group_size > 1")
        .groupBy(F.col("text_sha256").alias("tied_sha"))
        .agg(F.min("text_key").alias("first_key"))
    )
    marked = verdicts.join(ties, (F.col("text_sha256") == F.col("tied_sha")) & F.col("kept"), "left")
    return keep_rows(
        docs,
        marked.select(
            "id", "text_key", (F.col("kept") & (F.col("text_key") == F.coalesce("first_key", "text_key"))).alias("kept")
        ),
        id_col,
        text_col,
    )
