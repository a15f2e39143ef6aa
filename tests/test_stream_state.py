"""Streams that keep state: first rows by key, and landed pages."""

import pytest
from pyspark.sql import functions as F

from repoatlas.operators.dedupe import dedupe_first
from repoatlas.streaming import ingest, paged_source

ROWS = "key string, seq long, note string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def run_first(spark, tmp_path, batches):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in batches:
        spark.createDataFrame(rows, ROWS).repartition(3).write.mode("append").parquet(landing)
        stream = ingest.read_landing(spark, landing, spark.createDataFrame([], ROWS).schema)
        query = ingest.ingest_first_by_key(stream, out, state, "key")
    return ingest.read_batches(spark, out, spark.createDataFrame([], ROWS).schema), query


def test_first_rows_survive_restarts(spark, tmp_path):
    batches = [
        [("a", 3, "x"), ("a", 2, "y"), (None, 9, "n"), ("hot", 50, "h")] + [("hot", 100 + i, "h") for i in range(500)],
        [("a", 1, "late"), ("b", 7, "z"), (None, 1, "again"), (None, 2, "again")],
        [("c", 8, None), ("b", 5, "later"), ("hot", 1, "late"), ("c", 4, "first")],
    ]
    got, _ = run_first(spark, tmp_path, batches)
    assert rows_of(got) == rows_of(
        spark.createDataFrame(
            [("a", 2, "y", 0), (None, 9, "n", 0), ("hot", 50, "h", 0), ("b", 7, "z", 1), ("c", 4, "first", 2)],
            f"{ROWS}, batch_id long",
        )
    )


def test_first_rows_equal_the_batch_job(spark, tmp_path):
    batches = [[(f"k{(i * 7) % 40}", i, str(i)) for i in range(n * 60, n * 60 + 60)] for n in range(4)]
    got, query = run_first(spark, tmp_path, batches)
    everything = spark.createDataFrame([r for b in batches for r in b], ROWS)
    assert rows_of(got.drop("batch_id")) == rows_of(dedupe_first(everything, "key"))
    # The last batch read its own rows and the state, and no table written before.
    assert query.lastProgress["numInputRows"] == 60
    assert [s["numRowsTotal"] for s in query.lastProgress["stateOperators"]] == [40]
    assert "rocksdb" in str(query.lastProgress["stateOperators"][0]["customMetrics"]).lower()


def test_a_batch_costs_what_it_brings(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for n in range(20):
        rows = spark.range(n * 500, n * 500 + 500).select(F.col("id").cast("string").alias("key"), F.col("id").alias("seq"), F.lit("").alias("note"))
        rows.coalesce(1).write.mode("append").parquet(landing)
    stream = ingest.read_landing(spark, landing, rows.schema, files_per_batch=1)
    query = ingest.ingest_first_by_key(stream, out, state, "key")
    steps = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(steps) == 20 and {p["numInputRows"] for p in steps} == {500}
    times = [p["durationMs"]["triggerExecution"] for p in steps]
    # Flat but for noise: the last five against five after the start.
    assert sorted(times[-5:])[2] < 2.5 * sorted(times[3:8])[2]
    assert ingest.read_batches(spark, out, rows.schema).count() == 10_000


PAGES = {0: [2, 2, 1], 1: [], 2: [2], 3: [2, 2]}


def landed(spark, folder, keyword, page=None):
    """One page of a keyword, or its end."""
    if page is None:
        return paged_source.land_end(spark, folder, keyword, len(PAGES[keyword]))
    rows = [(keyword * 100 + page * 10 + i, keyword, page) for i in range(PAGES[keyword][page])]
    df = spark.createDataFrame(rows, "id long, keyword int, page long").withColumn("kind", F.lit("rows"))
    df.repartition(2).write.mode("append").partitionBy("keyword", "page", "kind").parquet(folder)


def consume(spark, tmp_path):
    schema = spark.createDataFrame([], "id long").schema
    stream = paged_source.read_pages(spark, str(tmp_path / "in"), schema)
    ingest.ingest_pages(stream, str(tmp_path / "out"), str(tmp_path / "state"), lambda b: b)
    rows = ingest.read_batches(spark, str(tmp_path / "out"), stream.schema)
    return [(r.id, r.keyword, r.page) for r in rows.orderBy("id").collect()]


def test_pages_go_on_after_a_stop_at_any_page(spark, tmp_path):
    steps = [(k, p) for k, sizes in PAGES.items() for p in [*range(len(sizes)), None]]
    expected = []
    for keyword, page in steps:
        landed(spark, str(tmp_path / "in"), keyword, page)
        if page is not None:
            expected += [(keyword * 100 + page * 10 + i, keyword, page) for i in range(PAGES[keyword][page])]
        assert consume(spark, tmp_path) == expected
    assert consume(spark, tmp_path) == expected


def test_a_missing_page_is_waited_for(spark, tmp_path):
    folder = str(tmp_path / "in")
    for keyword, page in ((0, 0), (0, 2), (2, 0)):
        landed(spark, folder, keyword, page)
    assert [r[:1] for r in consume(spark, tmp_path)] == [(0,), (1,)]
    landed(spark, folder, 0, 1)
    # Keyword 0 has no empty page yet, so keyword 2 has to wait.
    assert [r[0] for r in consume(spark, tmp_path)] == [0, 1, 10, 11, 20]
    landed(spark, folder, 0)
    landed(spark, folder, 1)
    assert [r[0] for r in consume(spark, tmp_path)] == [0, 1, 10, 11, 20, 200, 201]


def test_pages_are_read_in_parallel(spark, tmp_path):
    rows = spark.range(1000).select("id", F.lit(0).alias("ord"), F.floor(F.col("id") / 100).alias("page"))
    paged_source.land_pages(rows, str(tmp_path), [0, 1], page_rows=100)
    reader = paged_source.PageReader(str(tmp_path), rows.select("id").schema)
    end = reader.latestOffset()
    # The second keyword found nothing, so its first page is its empty one.
    assert end == {"keyword": 2, "page": 0}
    parts = reader.partitions(reader.initialOffset(), end)
    assert [(p.keyword, p.page) for p in parts] == [(0, n) for n in range(10)]
    assert sorted(i for b in reader.read(parts[3]) for i in b.column("id").to_pylist()) == list(range(300, 400))
    middle = reader.partitions({"keyword": 0, "page": 4}, {"keyword": 0, "page": 7})
    assert [p.page for p in middle] == [4, 5, 6]


def test_an_empty_landing(spark, tmp_path):
    reader = paged_source.PageReader(str(tmp_path / "none"), spark.createDataFrame([], "id long").schema)
    assert reader.latestOffset() == reader.initialOffset() and reader.partitions(reader.initialOffset(), reader.latestOffset()) == []


@pytest.mark.parametrize("path", ["/a/b", "file:/a/b", "file:///a/b"])
def test_paths_of_a_landing(path):
    assert paged_source._files(path)[1] == "/a/b"
