"""Hard negatives of anchors, read from Hilbert-ordered blocks under zone maps.

All rows are sorted along a Hilbert curve, so rows that lie next to each other
are near in most dimensions, and packed into blocks of ``BLOCK_ROWS``: one row of
a Parquet table each, with the least and greatest value of every dimension (the
zone map), the labels inside, and the vectors. For an anchor the sums of the
smaller and of the greater products of its components with those two values
bound the score of all rows of a block. So the zone maps alone tell which blocks
a search must read: for the positives those that can reach the score that an
anchor's own block guarantees, for each window of negatives those whose bounds
meet the window. Only these blocks' vectors are joined to the anchors and scored.

Anchors are a stated set of queries. They are shipped in groups of bounded bytes,
one after the other; vectors are never shuffled by anchor.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoatlas.session import ship_package, written

BLOCK_BITS = 9
BLOCK_ROWS = 1 << BLOCK_BITS
# Levels of the curve; finer differences have no part in the order.
CURVE_BITS = 3
# Scaled components end here, so that sums of products are whole numbers in float64.
MOST = 1 << 23
SCALE = 256
# Bytes of the anchors' vectors that a task holds, and anchors scored at a time.
MAX_SHIPPED_BYTES = 32 << 20
STRIP = 512
POSITIVES = 5
NEGATIVES = 10
LEAST_PERCENT = 30
MOST_PERCENT = 90
NONE = np.iinfo(np.int64).min


def hilbert_keys(points: np.ndarray, bits: int) -> list[bytes]:
    """The places of whole points from 0 to ``2**bits - 1`` on the curve, as bytes in order.

    Bits are taken from the highest level down. At every level the cube is
    turned, as the curve enters and leaves it, before the next level is read.
    """
    x = points.astype(np.int64).copy()
    count, dims = x.shape
    # From coordinates to the transposed index: undo the turns of each level.
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for d in range(dims):
            turned = (x[:, d] & level) != 0
            swapped = np.where(turned, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(turned, low, swapped)
            if d:
                x[:, d] ^= swapped
        level >>= 1
    # Gray decoding.
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flips = np.zeros(count, np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        flips ^= np.where(x[:, dims - 1] & level, level - 1, 0)
        level >>= 1
    x ^= flips[:, None]
    shifts = np.arange(bits - 1, -1, -1)
    plane = (x[:, None, :] >> shifts[None, :, None]) & 1
    packed = np.packbits(plane.reshape(count, -1).astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def _usable(vectors: DataFrame, row_id: str, label: str, vector: str, label_of: Column | None) -> DataFrame:
    """``vec_id``, ``label`` and ``vector`` (scaled, whole) of the rows that take part, one per id."""
    whole = F.transform(
        F.col(vector).cast("array<double>"),
        lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(MOST)), F.lit(-MOST)).cast("int"),
    )
    usable = F.col(row_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()
    # Of null, a comparison is null, which forall() does not take for true.
    finite = F.forall(F.col(vector).cast("array<double>"), lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = vectors.filter(usable & F.coalesce(finite, F.lit(False))).select(
        F.col(row_id).alias("vec_id"), (F.col(label) if label_of is None else label_of).alias("label"), whole.alias("vector")
    )
    # Rows that repeat an id are one row, of the least label and vector.
    least = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return least.select("vec_id", F.col("row.label").cast("long").alias("label"), "row.vector")


def _with_keys(rows: DataFrame, dims: int, spread: float) -> DataFrame:
    """``rows`` with ``place``, their bytes on the curve; cells are as wide as the values spread."""
    ship_package(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField("place", T.BinaryType())])
    cells = 1 << CURVE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _padded(batch.column("vector"), dims)
            # Two deviations to both sides, beyond them the outer cells.
            points = np.clip(np.floor((matrix / (4 * spread) + 0.5) * cells), 0, cells - 1)
            keys = hilbert_keys(points, CURVE_BITS) if dims else [b""] * batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _padded(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows of a matrix; short ones end in zeros."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    matrix = np.zeros((len(vectors), dims), np.int64)
    matrix[np.repeat(np.arange(len(vectors)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return matrix


BLOCK = "block long, n int, labels array<long>, least binary, greatest binary, ids binary, label_of binary, vectors binary"


def _packed(ordered: DataFrame, dims: int) -> DataFrame:
    """The blocks of an ordered table: a task's rows in runs of ``BLOCK_ROWS``."""

    def block(number: int, rows: pa.Table) -> list:
        matrix = _padded(rows.column("vector").combine_chunks(), dims)
        ids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
        order = np.argsort(ids)
        matrix, ids, labels = matrix[order].astype("<i4"), ids[order], labels[order]
        return [
            number, len(ids), np.unique(labels).tolist(), matrix.min(axis=0).tobytes(), matrix.max(axis=0).tobytes(),
            ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), matrix.tobytes(),
        ]

    names = [column.split()[0] for column in BLOCK.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        number = None

        def give(parts, number):
            made = block(number, pa.Table.from_batches(parts))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(made, kinds)], names=names)

        for batch in batches:
            if number is None:
                # The first place of a task is its number, shifted; blocks are numbered from there.
                number = batch.column("spot")[0].as_py()
            while batch.num_rows:
                part = batch.slice(0, BLOCK_ROWS - rows)
                held.append(part)
                rows += part.num_rows
                batch = batch.slice(part.num_rows)
                if rows == BLOCK_ROWS:
                    yield give(held, number)
                    held, rows, number = [], 0, number + 1
        if rows:
            yield give(held, number)

    return ordered.mapInArrow(run, BLOCK)


class Anchors:
    """A shipped group of anchors: ids in order, labels, and vectors as float64."""

    def __init__(self, table: pa.Table, dims: int):
        self.ids = table.column("vec_id").to_numpy()
        self.labels = table.column("label").to_numpy()
        vectors = table.column("vector").combine_chunks()
        self.matrix = _padded(vectors, dims).astype(np.float64)
        self.rising, self.falling = np.maximum(self.matrix, 0), np.minimum(self.matrix, 0)

    def bounds(self, who: slice, least: np.ndarray, greatest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score that each anchor can have with a row of each block."""
        up, down = self.rising[who], self.falling[who]
        return up @ least.T + down @ greatest.T, up @ greatest.T + down @ least.T


def _label_zones(own: np.ndarray, labels: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Per query label and block, whether the block has rows of it, and whether it has others."""
    kinds, which = np.unique(own, return_inverse=True)
    sizes = pc.list_value_length(labels).to_numpy(zero_copy_only=False)
    flat, block = labels.flatten().to_numpy(), np.repeat(np.arange(len(labels)), sizes)
    has = np.zeros((len(kinds), len(labels)), bool)
    place = np.minimum(np.searchsorted(kinds, flat), len(kinds) - 1)
    known = kinds[place] == flat
    has[place[known], block[known]] = True
    return has[which], (has < sizes[None, :])[which]


def _numbers(column: pa.Array, dims: int) -> np.ndarray:
    """Binary rows of 32-bit numbers as a float64 matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims).astype(np.float64)


def _block_rows(batch: pa.RecordBatch, dims: int) -> Iterator[tuple]:
    """Ids, labels, vectors and all fields of each block, one unpacked at a time."""
    for number in range(batch.num_rows):
        row = batch.slice(number, 1).to_pylist()[0]
        ids, labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "label_of"))
        yield ids, labels, np.frombuffer(row["vectors"], "<i4").reshape(-1, dims).astype(np.float64), row


def _best(keys: np.ndarray, count: int) -> np.ndarray:
    """The places of the ``count`` greatest of each row, in any order."""
    if keys.shape[1] <= count:
        return np.broadcast_to(np.arange(keys.shape[1]), keys.shape)
    return np.argpartition(keys, keys.shape[1] - count, axis=1)[:, keys.shape[1] - count :]


class Kept:
    """The best rows found so far for each query of a task, fixed in number."""

    def __init__(self, queries: int, count: int):
        self.count = count
        self.scores = np.full((queries, count), NONE)
        self.ids = np.full((queries, count), np.iinfo(np.int64).max)

    def floor(self, who: np.ndarray) -> np.ndarray:
        """What a row must reach to be of use; ids may break a tie."""
        return self.scores[who, -1]

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Scores of the rows ``ids`` (in order) for the queries ``who``, where ``fits``."""
        rank = np.arange(scores.shape[1])[::-1]
        keys = np.where(fits, scores * BLOCK_ROWS + rank, NONE)
        place = _best(keys, self.count)
        chosen = np.take_along_axis(fits, place, 1)
        new = np.where(chosen, np.take_along_axis(scores, place, 1), NONE)
        names = np.where(chosen, ids[place], np.iinfo(np.int64).max)
        all_scores = np.concatenate([self.scores[who], new], axis=1)
        all_ids = np.concatenate([self.ids[who], names], axis=1)
        order = np.lexsort((all_ids, -all_scores.astype(np.float64)), axis=1)[:, : self.count]
        self.scores[who] = np.take_along_axis(all_scores, order, 1)
        self.ids[who] = np.take_along_axis(all_ids, order, 1)


FOUND = "query int, other_id long, score long"


def _ask(blocks: DataFrame, dims: int, count: int, queries: int, choose, score) -> DataFrame:
    """The ``count`` best rows per query that the read blocks hold, ``query``, ``other_id``, ``score``.

    ``choose`` tells from zone maps which queries must read a block, ``score``
    gives a block's scores for queries and where they fit.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, greatest = (_numbers(batch.column(c), dims) for c in ("least", "greatest"))
            labels = batch.column("labels")
            who: list[list[np.ndarray]] = [[] for _ in range(len(labels))]
            for start in range(0, queries, STRIP):
                needed = choose(slice(start, min(start + STRIP, queries)), least, greatest, labels)
                for k, column in enumerate(needed.T):
                    who[k].append(np.flatnonzero(column) + start)
            lists = pa.array([np.concatenate([*w, []]).astype(np.int32) for w in who], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("block"), lists], names=["block", "who"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(queries, count)
        for batch in batches:
            for ids, labels, matrix, row in _block_rows(batch, dims):
                who = np.array(row["who"], np.int64)
                for start in range(0, len(who), STRIP):
                    strip = who[start : start + STRIP]
                    scores, fits = score(strip, matrix, ids, labels)
                    # A full list's last score need not be met by a block below it.
                    fits &= scores >= kept.floor(strip)[:, None]
                    use = fits.any(axis=1)
                    if use.any():
                        kept.add(strip[use], scores[use], ids, fits[use])
        query, slot = np.nonzero(kept.scores != NONE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query.astype(np.int32)), pa.array(kept.ids[query, slot]), pa.array(kept.scores[query, slot])],
            names=["query", "other_id", "score"],
        )

    zones = blocks.select("block", "labels", "least", "greatest")
    reads = zones.mapInArrow(mark, "block long, who array<int>").filter(F.size("who") > 0)
    # A block has as many readers as a shipped group has queries, at most.
    return blocks.select("block", "ids", "label_of", "vectors").join(reads, "block").mapInArrow(read, FOUND)


def _guaranteed(blocks: DataFrame, dims: int, anchors: Anchors, count: int) -> np.ndarray:
    """For each anchor the score that its ``count``-th best positive reaches at least.

    It is known from the anchor's own block; without so many rows there, nothing is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for ids, labels, matrix, _ in _block_rows(batch, dims):
                at = np.flatnonzero(np.isin(ids, anchors.ids))
                for start in range(0, len(at), STRIP):
                    own = at[start : start + STRIP]
                    scores = (matrix[own] @ matrix.T).astype(np.int64)
                    fits = (labels[own][:, None] == labels[None, :]) & (ids[own][:, None] != ids[None, :])
                    scores = np.where(fits, scores, NONE)
                    if scores.shape[1] >= count:
                        worst = np.partition(scores, scores.shape[1] - count, axis=1)[:, -count]
                        out += zip(np.searchsorted(anchors.ids, ids[own]).tolist(), worst.tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([q for q, _ in out], pa.int32()), pa.array([s for _, s in out], pa.int64())],
                names=["query", "score"],
            )

    known = blocks.select("ids", "label_of", "vectors").mapInArrow(run, "query int, score long").toArrow()
    floor = np.full(len(anchors.ids), NONE)
    floor[known.column("query").to_numpy()] = known.column("score").to_numpy()
    return floor


def _positives(blocks: DataFrame, dims: int, anchors: Anchors, count: int) -> pa.Table:
    """``query``, ``rank``, ``other_id`` and ``score`` of each anchor's best rows of its label."""
    floor = _guaranteed(blocks, dims, anchors, count).astype(np.float64)

    def choose(who, least, greatest, labels):
        return _label_zones(anchors.labels[who], labels)[0] & (anchors.bounds(who, least, greatest)[1] >= floor[who][:, None])

    def score(who, matrix, ids, labels):
        scores = (anchors.matrix[who] @ matrix.T).astype(np.int64)
        return scores, (anchors.labels[who][:, None] == labels[None, :]) & (anchors.ids[who][:, None] != ids[None, :])

    return _ranked(_ask(blocks, dims, count, len(anchors.ids), choose, score), count).toArrow().sort_by([("query", "ascending"), ("rank", "ascending")])


def _ranked(found: DataFrame, count: int) -> DataFrame:
    """Of what the tasks kept, the best ``count`` per query."""
    best_first = Window.partitionBy("query").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= count)


def _negatives(blocks: DataFrame, dims: int, anchors: Anchors, positives: pa.Table, count: int, least_percent: int, most_percent: int) -> DataFrame:
    """The best negatives inside each positive's window."""
    owner, positive, own_score = (positives.column(c).to_numpy() for c in ("query", "other_id", "score"))
    # In whole numbers: least * p <= 100 * n <= most * p.
    low = -((-least_percent * own_score) // 100)
    high = (most_percent * own_score) // 100
    worth = low <= high
    owner, positive, own_score, low, high = (x[worth] for x in (owner, positive, own_score, low, high))

    def choose(who, least, greatest, labels):
        bottom, top = anchors.bounds(owner[who], least, greatest)
        others = _label_zones(anchors.labels[owner[who]], labels)[1]
        return others & (top >= low[who][:, None]) & (bottom <= high[who][:, None])

    def score(who, matrix, ids, labels):
        mine = owner[who]
        scores = (anchors.matrix[mine] @ matrix.T).astype(np.int64)
        fits = anchors.labels[mine][:, None] != labels[None, :]
        return scores, fits & (scores >= low[who][:, None]) & (scores <= high[who][:, None])

    ranked = _ranked(_ask(blocks, dims, count, len(owner), choose, score), count)
    spark = blocks.sparkSession
    # As many rows as the group has anchors and positives.
    windows = spark.createDataFrame(
        pa.table({"query": pa.array(np.arange(len(owner)), pa.int32()), "anchor_id": anchors.ids[owner], "positive_id": positive, "positive_score": own_score})
    )
    return ranked.join(F.broadcast(windows), "query").select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    row_id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    label_of: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
    most_percent: int = MOST_PERCENT,
    max_shipped_bytes: int = MAX_SHIPPED_BYTES,
) -> DataFrame:
    """For every anchor and each of its positives, the ``negatives`` best rows inside its window.

    ``anchors`` is a condition on ``vec_id`` that selects the anchors; ``label_of``
    may replace the label. A component x counts as floor(256 * x), beyond 2**23
    as that; short vectors end in zeros. A row's score is its inner product with
    the anchor; higher ones come first, ties by smaller id. Positives are the
    ``positives`` best other rows of the anchor's label. Negatives have another
    label and a score between ``least_percent`` and ``most_percent`` of the
    positive's, both included, so a positive of negative score has none.

    Rows with a null id, label, vector or component, or a component that is not
    finite, take no part. Rows that repeat an id count as one, of the least label
    and vector. Other columns are not read; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = written(_usable(vectors, row_id, label, vector, label_of))
    held = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    if not held["n"]:
        return spark.createDataFrame([], RESULT)
    dims = max(held["dims"], 1)
    # One spread for all dimensions, so that the cells are cubes.
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    total = rows.agg(F.sum(squares).alias("total")).first()["total"]
    spread = math.sqrt(total / held["n"] / dims) or 1.0
    ordered = _with_keys(rows, dims, spread).orderBy("place", "vec_id").withColumn("spot", F.monotonically_increasing_id())
    blocks = written(_packed(ordered.select("vec_id", "label", "vector", "spot"), dims))
    chosen = rows.filter(anchors)
    groups = max(1, math.ceil(chosen.count() * dims * 24 / (max_shipped_bytes // 2)))
    found = None
    for number in range(groups):
        # Hashing fills groups unevenly, so they are planned for half the bytes.
        part = chosen.filter(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == number).sort("vec_id").toArrow()
        if not part.num_rows:
            continue
        group = Anchors(part, dims)
        near = _positives(blocks, dims, group, positives)
        more = _negatives(blocks, dims, group, near, negatives, least_percent, most_percent)
        found = more if found is None else found.unionByName(more)
    return spark.createDataFrame([], RESULT) if found is None else found
