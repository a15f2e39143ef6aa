"""A stream over pages that a search has landed, keyword by keyword.

The landing has a folder per keyword and page, ``keyword=3/page=0/kind=rows``.
Paging of a keyword stops at its empty page, which is landed as well, as
``kind=end``. A page that is not there yet stops the stream until it comes. The
offset is the keyword and page to read next, so a restart goes on at that page.
Pages are never changed once landed. Folder names alone tell how far the stream
can go; the rows of a batch's pages are read by as many tasks.
"""

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

FORMAT = "landed_pages"


def land_pages(
    rows: DataFrame, folder: str, searched: list[int], keyword: str = "ord", page: str = "page", page_rows: int = 1000
) -> None:
    """Lands whole pages of ``rows``, and after each keyword's last one an empty page.

    Keywords are numbered from 0 by the column ``keyword``, pages by ``page``.
    ``searched`` has the numbers of all keywords of this landing, as a keyword
    without any row has an empty page too. ``page_rows`` is what a page holds at
    most; it bounds the rows of a file.
    """
    kept = [c for c in rows.columns if c not in (keyword, page)]
    place = [F.col(keyword).cast("int").alias("keyword"), F.col(page).cast("long").alias("page")]
    pages = rows.select(*kept, *place, F.lit("rows").alias("kind"))
    # Only keywords and page numbers are aggregated, reduced by every task first.
    lasts = pages.groupBy("keyword").agg((F.max("page") + 1).alias("page"))
    numbers = rows.sparkSession.createDataFrame([(k,) for k in searched], "keyword int")
    ends = numbers.join(lasts, "keyword", "left").select("keyword", F.coalesce("page", F.lit(0).cast("long")).alias("page"))
    empty = ends.select(
        *[F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in kept], "keyword", "page", F.lit("end").alias("kind")
    )
    # A page's rows meet in one task and become one file.
    both = pages.unionByName(empty).repartition("keyword", "page")
    both.write.mode("append").partitionBy("keyword", "page", "kind").option("maxRecordsPerFile", page_rows).parquet(folder)


def land_end(spark: SparkSession, folder: str, keyword: int, page: int = 0) -> None:
    """Lands the empty page that ends a keyword."""
    row = spark.range(1).select(F.lit(keyword).alias("keyword"), F.lit(page).alias("page"), F.lit("end").alias("kind"), "id")
    row.write.mode("append").partitionBy("keyword", "page", "kind").parquet(folder)


class Page(InputPartition):
    def __init__(self, keyword: int, page: int, files: list[str]):
        super().__init__((keyword, page))
        self.keyword, self.page, self.files = keyword, page, files


class LandedPages(DataSource):
    """``path`` is the landing; the schema is that of its rows, before ``keyword`` and ``page``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return PageReader(self.options["path"], schema)


class PageReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"keyword": 0, "page": 0}

    def latestOffset(self) -> dict:
        _, (keyword, page) = self._landed()
        return {"keyword": keyword, "page": page}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = ((o["keyword"], o["page"]) for o in (start, end))
        pages, _ = self._landed()
        return [Page(*place, files) for place, files in pages if low <= place < high]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        files, _ = _files(self.path)
        kinds = to_arrow_schema(self.schema)
        for name in partition.files:
            with files.open_input_file(name) as file:
                for batch in pq.ParquetFile(file).iter_batches():
                    place = {"keyword": partition.keyword, "page": partition.page}
                    columns = [
                        pa.array([place[f.name]] * batch.num_rows, f.type) if f.name in place else batch.column(f.name).cast(f.type)
                        for f in kinds
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    def _landed(self) -> tuple[list, tuple[int, int]]:
        """The pages that can be read, in order, and the place of the one to come."""
        files, root = _files(self.path)
        found: dict[tuple[int, int], dict[str, list[str]]] = {}
        for info in files.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
            parts = info.path.split("/")
            if info.is_file and info.base_name.endswith(".parquet") and "_temporary" not in parts:
                keyword, page, kind = (p.split("=", 1)[1] for p in parts[-4:-1])
                found.setdefault((int(keyword), int(page)), {}).setdefault(kind, []).append(info.path)
        pages, place = [], (0, 0)
        while place in found:
            if "rows" in found[place]:
                pages.append((place, sorted(found[place]["rows"])))
                place = (place[0], place[1] + 1)
            else:
                place = (place[0] + 1, 0)
        return pages, place

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def read_pages(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The landed rows of ``schema`` as a stream, with ``keyword`` and ``page``."""
    # The process that plans a source's batches loads it before shipped packages
    # are there, so the source travels whole.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(LandedPages)
    placed = T.StructType([*schema.fields, T.StructField("keyword", T.IntegerType()), T.StructField("page", T.LongType())])
    return spark.readStream.format(FORMAT).schema(placed).option("path", folder).load()
