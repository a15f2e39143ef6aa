"""Writers for tables, CSV, text reports, pointers and cached results."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoatlas.functions.vectors import l2_normalize
from repoatlas.operators.upsert import conform_columns
from repoatlas.schemas import LEGACY_CSV_COLUMNS
from repoatlas.sources.readers import path_exists

LEGACY_TSV_HEADER = ["repo_url", "license"]


def append_legacy_csv(rows: DataFrame, folder: str) -> None:
    """Enriched rows added to the result folder; list columns joined by commas."""
    flat = {
        f.name: F.array_join(f.name, ",")
        for f in rows.schema
        if f.dataType.typeName() == "array"
    }
    (
        rows.withColumns(flat).select(*LEGACY_CSV_COLUMNS)
        .write.mode("append").option("header", True).option("escape", '"').csv(folder)
    )


def export_csv(catalog: DataFrame, folder: str) -> None:
    catalog.write.option("header", True).option("escape", '"').csv(folder)


def repair_tsv(rows: DataFrame, folder: str, header: list[str] = LEGACY_TSV_HEADER) -> None:
    """The columns of ``header`` only, missing ones and nulls empty."""
    conform_columns(rows, header).write.option("header", True).option("sep", "\t").option(
        "emptyValue", ""
    ).csv(folder)


def write_report(lines: DataFrame, order: list[str], folder: str) -> None:
    """Sorted lines as text; the part files in name order are the document."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(folder)


def write_url_list(rows: DataFrame, url: str, order: str, folder: str) -> None:
    """The URLs of ``rows``, such as those dropped as duplicates, a line each in ``order``."""
    rows.orderBy(order).select(F.col(url).cast("string").alias("line")).write.mode("overwrite").text(folder)


def report_name(source: str, report_prefix: str, source_prefix: str = "filtered_readme_repos_") -> str:
    """The report's name for a result file: ending and prefix exchanged."""
    stem = source.rsplit(".", 1)[0] if "." in source.rsplit("/", 1)[-1] else source
    return f"{stem}.md".replace(source_prefix, report_prefix)


def save_progress(spark: SparkSession, path: str, keyword: str, page: int) -> None:
    pointer = spark.createDataFrame([(keyword, page)], "keyword string, last_page long")
    pointer.write.mode("overwrite").json(path)


def replace_table(rows: DataFrame, folder: str, version: str) -> str:
    """A new version of a table beside the ones still being read."""
    target = f"{folder}/version={version}"
    rows.write.mode("overwrite").parquet(target)
    return target


def write_bucketed(rows: DataFrame, table: str, buckets: int) -> None:
    """The catalog hashed by id, so that later upserts join it in place."""
    (
        rows.write.mode("overwrite").bucketBy(buckets, "id").sortBy("id").saveAsTable(table)
    )


def append_history(rows: DataFrame, folder: str) -> None:
    """Sightings added to the history, one folder per day."""
    (
        rows.withColumn("snapshot_date", F.to_date("timestamp"))
        .write.mode("append").partitionBy("snapshot_date").parquet(folder)
    )


def reset_table(spark: SparkSession, table: str) -> bool:
    """All rows of a table deleted; false if there is no such table."""
    if not spark.catalog.tableExists(table):
        return False
    spark.sql(f"TRUNCATE TABLE {table}")
    return True


def materialize(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """What ``compute`` gives, computed and written once and read after that."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_embeddings(
    spark: SparkSession, path: str, compute: Callable[[], DataFrame], vector: str = "embedding"
) -> DataFrame:
    """Vectors encoded once, at length one whenever they are read."""
    return materialize(spark, path, compute).withColumn(vector, l2_normalize(vector))
