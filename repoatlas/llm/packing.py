"""Bounded-space online best-fit packing of tokenized documents."""

import math
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoatlas.llm.tasks import map_texts
from repoatlas.llm.token_ids import coder
from repoatlas.session import ship_package, written

CAPACITY = 2048
# Token after each document.
END_ID = 0
# Bins that are open at a time.
OPEN_BINS = 4096
# About so many pieces are packed by one task; only its open bins are in memory.
TASK_PIECES = 200_000


class BestFit:
    """A fixed number of open bins, found by their free space.

    Bit ``f`` of ``held`` is set if a bin with ``f`` free places is open. A piece
    goes to the bin with the least space that is enough: the lowest bit at or
    above its length. If there is none, a bin is opened, and if too many are
    open then, the fullest, at the lowest bit of all, is closed.
    """

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.held = self.count = self.next_bin = 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, length: int) -> tuple[int, int]:
        """The bin of a piece and its place there."""
        fitting = self.held >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.next_bin
            self.next_bin += 1
        left = free - length
        if left:
            if self.count == self.open_bins:
                self._take((self.held & -self.held).bit_length() - 1)
            self.bins[left].append(number)
            self.held |= 1 << left
            self.count += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        self.count -= 1
        if not self.bins[free]:
            self.held &= ~(1 << free)
        return number


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    capacity: int = CAPACITY,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Each document's ids and ``END_ID`` in pieces of at most ``capacity``.

    Columns ``id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if
    asked for, ``ids`` (little-endian unsigned 32-bit numbers). A null text is
    empty and has one piece, of the end token. Rows that repeat an id have
    pieces each.
    """
    width = 4
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(("ids", T.BinaryType()))
    end = END_ID.to_bytes(width, "little")

    def start():
        code = coder(tokenizer_path)

        def work(texts):
            rows = []
            for number, raw in enumerate(code.encode([t or "" for t in texts])):
                raw += end
                for piece, place in enumerate(range(0, len(raw), capacity * width)):
                    own = raw[place : place + capacity * width]
                    rows.append((number, piece, place // width, len(own) // width, zlib.crc32(own), own))
            values = [list(column) for column in zip(*rows)] or [[] for _ in range(6)]
            return tuple(values if with_ids else values[:-1])

        return work

    return map_texts(docs, fields, start, (id_col,), text_col).withColumnRenamed(id_col, "id")


def pack_lengths(lengths: Iterable[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> Iterator[tuple[int, int]]:
    """The bin and the place of each piece, in order of arrival."""
    fit = BestFit(capacity, open_bins)
    return map(fit.put, lengths)


def place_pieces(
    pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; gapless from offset 0.

    ``pieces`` (computed already) are dealt over tasks by a hash, in a fixed
    order, so a task that runs again places them alike. Every task packs its
    own sequences; there is no step for all pieces. A sequence's id is its
    task's number and its bin's.
    """
    ship_package(pieces.sparkSession)
    names = pieces.columns
    tasks = max(1, math.ceil(pieces.count() / task_pieces))
    mixed = F.xxhash64("id", "piece", "ids_crc32")
    dealt = (
        pieces.withColumn("dealt_by", mixed)
        .repartition(tasks, "dealt_by")
        .sortWithinPartitions("dealt_by", "id", "piece", "ids_crc32", "length")
        .select(*names)
    )
    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = names.index("length")

    def run(batches):
        first = TaskContext.get().partitionId() << 40
        fit = BestFit(capacity, open_bins)
        for batch in batches:
            placed = [fit.put(n) for n in batch.column(at).to_pylist()]
            ids = pa.array([first + b for b, _ in placed], pa.int64())
            offsets = pa.array([o for _, o in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, offsets], names=[f.name for f in schema])

    return dealt.mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every piece of every document with its place in a sequence.

    Columns: the id, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``. Only documents longer than ``capacity`` are
    cut. Null texts are empty (one end token), null ids and repeated rows are
    packed like others, an empty table gives an empty one, and other columns
    are not read.
    """
    pieces = written(token_pieces(docs, tokenizer_path, capacity, False, id_col, text_col))
    return place_pieces(pieces, capacity, open_bins).withColumnRenamed("id", id_col)


def packed_sequences(placed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` of placed pieces that carry their ``ids``: the training rows.

    A sequence is bounded by the capacity, so its pieces meet in one row.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"])).alias("ids")
    )
