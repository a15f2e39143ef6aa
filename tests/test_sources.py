from pyspark.sql import functions as F

from repoatlas.schemas import CATALOG_SCHEMA, LEGACY_CSV_COLUMNS
from repoatlas.operators.report import report_csv
from repoatlas.session import cut_lineage, use_checkpoint_folder
from repoatlas.sources import readers as R
from repoatlas.sources import writers as W


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def legacy_rows(spark):
    row = ["u/a", "MIT", "1", "2", "2024", "C (1)", ["t1", "t2"], "k", "True", 'say "hi",\nyes', "d", "T", ["x", "y"]]
    schema = ", ".join(
        f"{c} {'array<string>' if c in ('topics', 'additional_keywords') else 'string'}" for c in LEGACY_CSV_COLUMNS
    )
    return spark.createDataFrame([row], schema)


def test_legacy_csv_appends_and_skips_repeated_headers(spark, tmp_path):
    folder = str(tmp_path / "csv")
    W.append_legacy_csv(legacy_rows(spark), folder)
    W.append_legacy_csv(legacy_rows(spark).withColumn("repo_url", F.lit("u/b")), folder)
    (tmp_path / "csv" / "extra.csv").write_text(
        ",".join(LEGACY_CSV_COLUMNS) + "\n" + ",".join(LEGACY_CSV_COLUMNS) + "\n" + "u/c" + "," * 12 + "\n"
    )
    rows = R.read_legacy_csv(spark, folder)
    assert sorted(r.repo_url for r in rows.collect()) == ["u/a", "u/b", "u/c"]
    first = rows.filter("repo_url = 'u/a'").first()
    assert (first.readme, first.topics, first.additional_keywords) == ('say "hi",\nyes', "t1,t2", "x,y")
    # Empty fields are empty texts, and rows are numbered in the order of the files.
    last = rows.filter("repo_url = 'u/c'").first()
    assert (last.license, last.languages) == ("", "")
    assert len({r.seq for r in rows.collect()}) == 3
    lines = [r.line for r in report_csv(rows).collect()]
    assert None not in lines and any("(u/c): License: : " in line for line in lines)


def test_catalog_export_and_replace(spark, tmp_path):
    catalog = spark.createDataFrame([tuple([7, "u", "MIT"] + [None] * 23)], CATALOG_SCHEMA)
    W.export_csv(catalog, str(tmp_path / "export"))
    assert spark.read.option("header", True).csv(str(tmp_path / "export")).first().id == "7"
    one = W.replace_table(catalog, str(tmp_path / "t"), "1")
    two = W.replace_table(R.read_catalog(spark, one).withColumn("license", F.lit("BSD")), str(tmp_path / "t"), "2")
    assert (R.read_catalog(spark, one).first().license, R.read_catalog(spark, two).first().license) == ("MIT", "BSD")


def test_sample_export_is_read_with_types(spark, tmp_path):
    header = (
        "id,url,license,stars_count,forks_count,pushed_at,updated_at,created_at,languages,topics,open_issues,"
        "closed_issues,description,fork,size,watchers_count,language,keyword,additional_keywords,is_relevant,"
        "brief_desc,class_label,fetch_data"
    )
    line = '5,u/x,MIT,7,1,2021-02-03 04:05:06,2021-02-02 01:02:03,2011-10-09 08:07:06,C (10)| C++ (5),"a,b",1,2,Text,0,9,7,C,k,,,,,2023'
    (tmp_path / "e.csv").write_text(header + "\n" + line + "\n")
    row = R.read_export_csv(spark, str(tmp_path / "e.csv")).first()
    assert (row.id, row.stars_count, row.topics, row.languages, row.fork) == (5, 7, "a,b", "C (10)| C++ (5)", 0)
    assert row.pushed_at.year == 2021 and row.is_relevant is None


def test_tsv_repair(spark, tmp_path):
    (tmp_path / "in.tsv").write_text("repo_url\textra\nu/a\tx\nu/b\n")
    W.repair_tsv(R.read_tsv(spark, str(tmp_path / "in.tsv")), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text == "repo_url\tlicense\nu/a\t\nu/b\t\n"


def test_progress(spark, tmp_path):
    path = str(tmp_path / "progress")
    assert R.read_progress(spark, path) == (None, None)
    W.save_progress(spark, path, "k", 3)
    W.save_progress(spark, path, "k", 4)
    assert R.read_progress(spark, path) == ("k", 4)


def test_history_is_partitioned_by_day(spark, tmp_path):
    rows = spark.sql("SELECT 1L AS id, timestamp'2024-01-02 03:00:00' AS timestamp")
    W.append_history(rows, str(tmp_path / "h"))
    W.append_history(rows, str(tmp_path / "h"))
    assert (tmp_path / "h" / "snapshot_date=2024-01-02").is_dir()
    history = R.read_history(spark, str(tmp_path / "h"))
    day = history.filter("snapshot_date = DATE'2024-01-02'")
    assert day.count() == 2 and history.filter("snapshot_date > DATE'2024-01-02'").count() == 0
    assert "PartitionFilters: [isnotnull(snapshot_date" in day._jdf.queryExecution().executedPlan().toString()


def test_reset_table(spark):
    assert W.reset_table(spark, "no_such_table") is False
    spark.range(3).withColumn("v", F.lit(1)).write.mode("overwrite").saveAsTable("to_reset")
    assert W.reset_table(spark, "to_reset") is True
    assert spark.table("to_reset").count() == 0
    spark.sql("DROP TABLE to_reset")


def test_bucketed_catalog_joins_without_shuffle(spark):
    W.write_bucketed(spark.range(1000).withColumn("v", F.lit("x")), "bucketed_catalog", 4)
    table = spark.table("bucketed_catalog")
    joined = table.hint("merge").join(table.withColumnRenamed("v", "w"), "id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE bucketed_catalog")


def test_results_are_computed_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.createDataFrame([(1, [3.0, 4.0])], "id long, embedding array<double>")

    for _ in range(2):
        out = W.cached_embeddings(spark, str(tmp_path / "emb"), compute)
        assert rows_of(out) == [(1, [0.6, 0.8])]
    assert len(calls) == 1


def test_source_tree(spark, tmp_path):
    for name in ("docs/a.py", "docs/deep/b.py", "docs/c.md", "other/d.py"):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(name)
    files = R.read_source_tree(spark, str(tmp_path / "tree"), ["docs"], [".py"])
    assert rows_of(files) == [("docs/a.py", "docs/a.py"), ("docs/deep/b.py", "docs/deep/b.py")]


def test_row_documents(spark):
    rows = spark.createDataFrame([(1, None)], "id long, name string")
    assert R.read_documents_for_retrieval(rows).first().document == "id: 1\nname: "


def test_lineage_is_cut_in_the_shared_folder(spark):
    folder = use_checkpoint_folder(spark)
    assert spark.sparkContext.getConf().get("spark.checkpoint.dir") in folder
    df = cut_lineage(spark.range(5))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Range" not in plan
    assert all(folder in name for name in df.inputFiles())
