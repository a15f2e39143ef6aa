"""Python over texts inside Spark's tasks, in Arrow batches of bounded size."""

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from repoatlas.session import ship_package, spread

# Texts of no more UTF-8 bytes than this are handed over at a time; a longer
# text comes alone.
SLICE_BYTES = 4_000_000
SLICE_ROWS = 2_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table; a scan too narrow to use all cores is spread over them."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


def text_of(column: str = "text") -> Column:
    """The text, a null one being empty."""
    return F.coalesce(F.col(column), F.lit(""))


def remainder(column: str = "doc_id", parts: int = 5) -> Column:
    """crc32 of the id as text modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch``, cut by the bytes of their texts."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = size = 0
    for row, more in enumerate(sizes):
        if row > start and (size + more > most or row - start >= SLICE_ROWS):
            yield batch.slice(start, row - start)
            start, size = row, 0
        size += more
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(
    docs: DataFrame,
    fields: list[tuple[str, T.DataType]],
    start: Callable[[], Callable[[list[str | None]], tuple]],
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the ``fields`` made from its texts.

    ``start`` is called once per task and returns the function that is given a
    list of texts. That returns a list of values for each field, with a value
    per text. If a text may have any number of rows, it returns one list more,
    before the others: the number of the text that each row belongs to.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(*keep, text)
    kept = [rows.schema[i] for i in range(len(keep))]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in fields]])
    names = [f.name for f in schema]
    kinds = [to_arrow_type(t) for _, t in fields]
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for part in slices(batch, at):
                values = work(part.column(at).to_pylist())
                own = part.select(list(range(at)))
                if len(values) > len(kinds):
                    own, values = own.take(pa.array(values[0], pa.int64())), values[1:]
                made = [v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(values, kinds)]
                yield pa.RecordBatch.from_arrays([*own.columns, *made], names=names)

    return rows.mapInArrow(run, schema)


def digest(text: str | None) -> str:
    """What ``rows.text_key`` gives for the text."""
    return hashlib.md5((text or "").encode(), usedforsecurity=False).hexdigest()
