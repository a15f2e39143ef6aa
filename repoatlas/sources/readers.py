"""Readers with explicit schemas."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoatlas.functions.encoding import row_document
from repoatlas.operators.catalog import path_filter
from repoatlas.schemas import (
    CATALOG_SCHEMA,
    EXPORT_CSV_SCHEMA,
    HISTORY_SCHEMA,
    LEGACY_CSV_SCHEMA,
    PROGRESS_SCHEMA,
)


def _csv(spark: SparkSession, schema: T.StructType):
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("maxCharsPerColumn", 10 * 1024 * 1024)
    )


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG_SCHEMA).parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The history; a filter on ``snapshot_date`` reads those days only."""
    with_day = T.StructType([*HISTORY_SCHEMA.fields, T.StructField("snapshot_date", T.DateType())])
    return spark.read.schema(with_day).parquet(path)


def read_legacy_csv(spark: SparkSession, path: str) -> DataFrame:
    """The legacy result files, with ``seq`` in the order of the rows in them.

    Files follow each other by name. Header rows repeated inside them are
    skipped, and empty fields are empty texts.
    """
    names = LEGACY_CSV_SCHEMA.names
    rows = _csv(spark, LEGACY_CSV_SCHEMA).csv(path).select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in names],
        F.col("_metadata.file_path").alias("file"),
        # A file is read by one task from beginning to end.
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"),
    )
    # One row per file.
    files = rows.select("file").distinct().withColumn(
        "file_seq", F.row_number().over(Window.orderBy("file")).cast("long") - 1
    )
    numbered = rows.join(files, "file").withColumn(
        "seq", F.shiftleft("file_seq", 33).bitwiseOR(F.col("place"))
    )
    return numbered.filter(F.col("repo_url") != "repo_url").select(*names, "seq")


def read_export_csv(spark: SparkSession, path: str) -> DataFrame:
    """The export of the catalog; a time that is no time is read as null."""
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in EXPORT_CSV_SCHEMA])
    rows = _csv(spark, as_text).csv(path)
    return rows.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in EXPORT_CSV_SCHEMA]
    )


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file with whatever columns its header names."""
    return spark.read.option("header", True).option("sep", "\t").csv(path)


def read_progress(spark: SparkSession, path: str) -> tuple[str | None, int | None]:
    """The one-row resume pointer; ``(None, None)`` if none was saved."""
    if not path_exists(spark, path):
        return None, None
    saved = spark.read.schema(PROGRESS_SCHEMA).json(path).first()
    return (saved["keyword"], saved["last_page"]) if saved else (None, None)


def read_source_tree(
    spark: SparkSession, path: str, directories: list[str], extensions: list[str]
) -> DataFrame:
    """Files of the given directories and endings, as ``(path, text)``.

    ``path`` is relative to the root. Only files of those folders and endings
    are listed and opened.
    """
    wanted = [f"{path.rstrip('/')}/{d.strip('/')}" for d in directories]
    wanted = [place for place in wanted if path_exists(spark, place)]
    if not wanted or not extensions:
        return spark.createDataFrame([], "path string, text string")
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    qualified = root.getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration()
    ).makeQualified(root).toString().rstrip("/")
    endings = "{" + ",".join(f"*{e}" for e in extensions) + "}"
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", endings)
        .load(wanted)
    )
    relative = files.select(
        F.substr("path", F.lit(len(qualified) + 2)).alias("path"), "content"
    )
    kept = path_filter(relative, "path", directories, extensions)
    return kept.select("path", F.decode("content", "UTF-8").alias("text"))


def read_documents_for_retrieval(rows: DataFrame) -> DataFrame:
    """Every row as one text of ``column: value`` lines."""
    return rows.select(row_document(rows.columns).alias("document"))


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return target.getFileSystem(conf).exists(target)
