from datetime import datetime

from pyspark.sql import functions as F

from repoatlas.operators import upsert as U
from repoatlas.schemas import CATALOG_SCHEMA

SCHEMA = "id long, url string, keyword string, additional_keywords string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_upsert_keeps_first_metadata_and_merges_keywords(spark):
    current = frame(
        spark, (1, "old", "a", ""), (2, "old", "a", "b"), (3, "old", "a", "c|b"), (4, "old", "a", None)
    )
    incoming = frame(
        spark, (1, "new", "a", ""), (2, "new", "b", ""), (3, "new", "d", "e|b"), (9, "new", "x", "z||y")
    )
    once = U.catalog_upsert(current, incoming)
    assert rows_of(once) == [
        (1, "old", "a", ""), (2, "old", "a", "b"), (3, "old", "a", "b|c|d|e"),
        (4, "old", "a", ""), (9, "new", "x", "y|z"),
    ]
    assert rows_of(U.catalog_upsert(once, incoming)) == rows_of(once)


def test_first_sightings_roll_up_keywords(spark):
    seen = spark.createDataFrame(
        [(1, "u", "b", "", 2), (1, "v", "a", "k", 1), (1, "w", "a", "", 3), (2, "x", "c", "c", 1)],
        SCHEMA + ", ord int",
    )
    got = rows_of(U.first_sightings(seen, ["ord"]))
    assert got == [(1, "v", "a", "b|k", 1), (2, "x", "c", "", 1)]
    rolled = rows_of(U.keyword_rollup(seen, ["ord"]))
    assert rolled == [(1, "a", "b"), (2, "c", "")]


def test_history_keeps_every_sighting(spark):
    seen = frame(spark, (1, "u", "a", ""), (1, "u", "a", ""))
    history = U.history_rows(seen, 30, 183, "2024-01-01 00:00:00")
    assert history.count() == 2
    assert history.first().timestamp == datetime(2024, 1, 1)


def test_defaults_and_header(spark):
    empty = spark.createDataFrame([tuple([7] + [None] * 25)], CATALOG_SCHEMA)
    filled = U.apply_defaults(empty, "2024-01-01 00:00:00").first()
    assert (filled.license, filled.readme, filled.stars_count, filled.brief_desc) == ("Unknown License", "", 0, None)
    assert filled.fetch_date == filled.pushed_at and filled.fetch_date is not None
    assert U.apply_defaults(empty, "2024-01-01 00:00:00").schema["stars_count"].dataType == CATALOG_SCHEMA["stars_count"].dataType
    fixed = U.conform_columns(spark.createDataFrame([(1, None)], "repo_url int, extra string"), ["repo_url", "license"])
    assert rows_of(fixed) == [("1", "")]


def test_order_of_input_does_not_matter(spark):
    seen = spark.range(500).select(
        (F.col("id") % 7).alias("id"), F.concat(F.lit("k"), F.col("id") % 5).alias("keyword"), F.col("id").alias("ord")
    )
    a = U.keyword_rollup(seen.repartition(3), ["ord"])
    b = U.keyword_rollup(seen.orderBy(F.desc("ord")), ["ord"])
    assert rows_of(a) == rows_of(b)


def test_first_sightings_with_null_order_and_null_id(spark):
    seen = spark.createDataFrame(
        [(1, "u", "b", "", 2), (1, "v", "a", "", None), (2, "x", "c", "", 1), (None, "y", "d", "", 3)],
        SCHEMA + ", ord int",
    )
    got = {r.id: (r.url, r.keyword, r.additional_keywords) for r in U.first_sightings(seen, ["ord"]).collect()}
    assert got == {1: ("v", "a", "b"), 2: ("x", "c", ""), None: ("y", "d", "")}
