"""Keyword roll-up, first-write-wins upsert and history."""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas.functions.encoding import join_keywords, merge_keywords, split_keywords
from repoatlas.schemas import BATCH_TIMESTAMP, CATALOG_DEFAULTS


def apply_defaults(rows: DataFrame, batch_ts: str, defaults=CATALOG_DEFAULTS) -> DataFrame:
    """Nulls replaced by the column defaults of the catalog."""
    filled = {}
    for name, default in defaults.items():
        if name in rows.columns:
            kind = rows.schema[name].dataType
            value = batch_ts if default is BATCH_TIMESTAMP else default
            filled[name] = F.coalesce(name, F.lit(value).cast(kind))
    return rows.withColumns(filled)


def conform_columns(rows: DataFrame, header: list[str]) -> DataFrame:
    """The columns of ``header`` as text; a missing column or value is empty."""
    return rows.select(
        *[
            F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
            if c in rows.columns
            else F.lit("").alias(c)
            for c in header
        ]
    )


def keyword_rollup(sightings: DataFrame, order: list[str]) -> DataFrame:
    """Per ``id`` the first keyword, and the later ones joined.

    Sightings are reduced to one row per keyword first. A repository seen very
    often then brings no more rows to the second step than it has keywords.
    """
    per_keyword = sightings.groupBy("id", "keyword").agg(
        F.min(F.struct(*order)).alias("first_seen")
    )
    per_id = per_keyword.groupBy("id").agg(
        F.min_by("keyword", "first_seen").alias("keyword"),
        F.collect_set("keyword").alias("keywords"),
    )
    return per_id.select(
        "id", "keyword", merge_keywords("keyword", "keywords").alias("additional_keywords")
    )


def first_sightings(sightings: DataFrame, order: list[str]) -> DataFrame:
    """Per ``id`` its earliest full row, with all its keywords rolled up."""
    # Ids and order columns alone tell the first row; it is unique by them.
    firsts = sightings.groupBy("id").agg(F.min(F.struct(*order)).alias("first_seen"))
    firsts = firsts.select(
        F.col("id").alias("first_id"), *[F.col("first_seen")[c].alias(f"first_{c}") for c in order]
    )
    # An id or order column may be null.
    same = reduce(and_, [sightings[c].eqNullSafe(firsts[f"first_{c}"]) for c in ("id", *order)])
    first = sightings.join(firsts, same, "left_semi").dropDuplicates(["id"])
    carried = F.array_append(split_keywords("additional_keywords"), F.col("keyword"))
    keywords = (
        sightings.select("id", F.explode(carried).alias("seen"))
        .distinct()
        .groupBy("id")
        .agg(F.collect_set("seen").alias("keywords"))
        .withColumnRenamed("id", "keywords_id")
    )
    return (
        first.join(keywords, F.col("id").eqNullSafe(F.col("keywords_id")))
        .withColumn("additional_keywords", merge_keywords("keyword", "keywords"))
        .select(*sightings.columns)
    )


def catalog_upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """``current`` after an upsert of ``incoming`` (one row per ``id`` each).

    A known repository keeps everything but its additional keywords, which
    grow; a new one is inserted as it comes. Known rows need only the keywords
    of the incoming side, and new rows only the ids of the current side, so the
    wide columns of neither are shuffled when the other side is small.
    """
    news = incoming.select(
        "id",
        F.col("keyword").alias("new_keyword"),
        F.col("additional_keywords").alias("new_additional"),
    )
    merged = merge_keywords(
        "keyword",
        split_keywords("additional_keywords"),
        split_keywords("new_keyword"),
        split_keywords("new_additional"),
    )
    kept = (
        current.join(news, "id", "left")
        .withColumn("additional_keywords", merged)
        .select(*current.columns)
    )
    added = incoming.join(current.select("id"), "id", "left_anti").withColumn(
        "additional_keywords", join_keywords(split_keywords("additional_keywords"))
    )
    return kept.unionByName(added.select(*current.columns))


def history_rows(
    sightings: DataFrame, num_stars: int, days_ago: int, batch_ts: str
) -> DataFrame:
    """Every sighting as a history row of this batch."""
    stamp = F.lit(batch_ts).cast("timestamp_ntz")
    return sightings.withColumns(
        {
            "num_stars": F.lit(num_stars).cast("long"),
            "days_ago": F.lit(days_ago).cast("long"),
            "fetch_date": stamp,
            "timestamp": stamp,
        }
    )
