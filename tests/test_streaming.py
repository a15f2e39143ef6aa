from pyspark.sql import functions as F

from repoatlas.functions.text import clean_readme
from repoatlas.operators.dedupe import dedupe_first
from repoatlas.operators.upsert import catalog_upsert, first_sightings, keyword_rollup
from repoatlas.streaming import ingest

SCHEMA = "id long, url string, keyword string, additional_keywords string, seq long"
PAGES = [
    [(1, "u1", "a", "", 1), (2, "u2", "a", "", 2), (1, "u1", "b", "", 3)],
    [(1, "other", "c", "", 4), (3, "u3", "b", "x", 5), (2, "u2", "a", "", 6)],
    [(3, "u3", "b", "", 7), (1, "u1", "b", "", 8), (4, "u1", "z", "", 9)],
]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def land(spark, folder, number):
    frame(spark, PAGES[number]).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return ingest.read_landing(spark, folder, frame(spark, []).schema, files_per_batch=1)


def all_rows(spark):
    return frame(spark, [r for page in PAGES for r in page])


def test_pages_resume_where_they_stopped(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for number in range(3):
        land(spark, landing, number)
        ingest.ingest_pages(
            stream(spark, landing), out, state, lambda rows: rows.withColumn("url", clean_readme("url"))
        )
    got = ingest.read_batches(spark, out, frame(spark, []).schema)
    assert rows_of(got.drop("batch_id")) == rows_of(all_rows(spark))
    assert sorted(r.batch_id for r in got.select("batch_id").distinct().collect()) == [0, 1, 2]


def test_first_url_wins_over_all_batches(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for number in range(3):
        land(spark, landing, number)
        ingest.ingest_first_by_key(stream(spark, landing), out, state, "url")
    got = ingest.read_batches(spark, out, frame(spark, []).schema).drop("batch_id")
    assert rows_of(got) == rows_of(dedupe_first(all_rows(spark), "url"))


def test_catalog_equals_batch_upserts(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batch = None
    for number in range(3):
        land(spark, landing, number)
        ingest.ingest_sightings(stream(spark, landing), out, state, ["seq"])
        incoming = first_sightings(frame(spark, PAGES[number]), ["seq"])
        batch = incoming if batch is None else catalog_upsert(batch, incoming)
        view = ingest.catalog_view(spark, out, frame(spark, []).schema, ["seq"])
        assert rows_of(view) == rows_of(batch)
    history = ingest.history_view(spark, out, frame(spark, []).schema)
    assert rows_of(history.drop("batch_id")) == rows_of(all_rows(spark))

    compacted = str(tmp_path / "compacted")
    ingest.compact(spark, out, compacted, frame(spark, []).schema, ["seq"])
    again = ingest.catalog_view(spark, compacted, frame(spark, []).schema, ["seq"])
    assert rows_of(again) == rows_of(batch)


def test_a_batch_run_again_repeats_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    for _ in range(2):
        ingest._write_batch(frame(spark, PAGES[0]), out, 0)
    assert ingest.read_batches(spark, out, frame(spark, []).schema).count() == 3
    assert ingest.read_batches(spark, out, frame(spark, []).schema, before=0).count() == 0


def test_running_keywords_equal_the_rollup(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for number in range(3):
        land(spark, landing, number)
        ingest.ingest_keywords(stream(spark, landing), out, state, ["seq"])
    got = ingest.keywords_view(spark, out)
    assert rows_of(got) == rows_of(keyword_rollup(all_rows(spark), ["seq"]))
    assert got.filter(F.col("keyword") == "").count() == 0
