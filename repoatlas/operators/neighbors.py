"""Vector tables: prototypes, nearest prototype and top-k search.

Both searches multiply whole Arrow batches of the data with the other side in
NumPy. The other side is computed once and goes to the tasks in blocks of
bounded bytes, one after the other; the data's vectors are never shuffled.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from repoatlas.functions.vectors import cosine, l2_normalize
from repoatlas.operators.skew import lookup_join
from repoatlas.session import ship_package, written

# Bytes of the other side's vectors that a task holds besides its batch of data.
MAX_SHIPPED_BYTES = 64 << 20


def normalized(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    return vectors.withColumn(vector, l2_normalize(vector))


def label_centroids(
    vectors: DataFrame, label: str = "label", vector: str = "embedding"
) -> DataFrame:
    """Per label the mean vector, and how many vectors it is the mean of.

    Every task sums its own vectors first, so a large label is not collected.
    """
    parts = vectors.select(label, F.posexplode(F.col(vector)).alias("pos", "x"))
    means = parts.groupBy(label, "pos").agg(
        F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("n")
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean")))
    return means.groupBy(label).agg(
        F.transform(ordered, lambda p: p["mean"]).alias("centroid"), F.max("n").alias("members")
    )


def prototype_similarity(
    vectors: DataFrame, prototypes: DataFrame, row_id: str = "vec_id",
    label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """Every vector's cosine with the prototype of its own label.

    Pass prototypes that are computed already; they are read several times.
    """
    joined = lookup_join(vectors, prototypes, label, "members", row_id)
    return joined.withColumn("cosine", cosine(vector, "centroid"))


def nearest_prototype(
    vectors: DataFrame, prototypes: DataFrame, row_id: str = "vec_id",
    label: str = "label", vector: str = "embedding", prototype: str = "centroid",
    max_shipped_bytes: int = MAX_SHIPPED_BYTES,
) -> DataFrame:
    """``(row_id, label, score)``: the label of the most similar prototype, for every row.

    Scores are rounded before they are compared; the lowest label wins ties. A
    null vector has a null label. Vectors of another length than the
    prototypes' are refused.
    """
    data = vectors.select(F.col(row_id).alias("row_id"), F.col(vector).cast("array<double>").alias("vector"))
    blocks = _Blocks(prototypes, label, prototype, max_shipped_bytes)
    best = data.withColumns(
        {"other_id": F.lit(None).cast(blocks.id_type), "score": F.lit(None).cast("double")}
    )
    for number in range(blocks.count):
        # Each block but the last fixes what is the best so far.
        best = _better(best, blocks, number)
        if number + 1 < blocks.count:
            best = written(best)
    return best.select(F.col("row_id").alias(row_id), F.col("other_id").alias(label), "score")


def knn_topk(
    vectors: DataFrame, queries: DataFrame, k: int, row_id: str = "vec_id",
    query_id: str = "query_id", vector: str = "embedding",
    max_shipped_bytes: int = MAX_SHIPPED_BYTES,
) -> DataFrame:
    """The ``k`` most similar vectors per query, ``rank`` from 1.

    Each batch passes on only its own ``k`` best per query. Null vectors of
    either side are left out; vectors of different lengths are refused.
    """
    data = vectors.select(F.col(row_id).alias("row_id"), F.col(vector).cast("array<double>").alias("vector"))
    blocks = _Blocks(queries, query_id, vector, max_shipped_bytes)
    found = _nearest(data, blocks, 0, k)
    for number in range(1, blocks.count):
        found = found.unionByName(_nearest(data, blocks, number, k))
    best_first = Window.partitionBy("other_id").orderBy(F.desc("score"), "row_id")
    ranked = found.withColumn("rank", F.row_number().over(best_first))
    return ranked.filter(F.col("rank") <= k).select(
        F.col("other_id").alias(query_id), "rank", F.col("row_id").alias(row_id), "score"
    )


class _Blocks:
    """The other side, computed once, in blocks of bounded bytes."""

    def __init__(self, side: DataFrame, side_id: str, vector: str, max_bytes: int):
        ship_package(side.sparkSession)
        self.rows = written(
            side.select(F.col(side_id).alias("other_id"), F.col(vector).cast("array<double>").alias("vector"))
            .filter(F.col("vector").isNotNull())
        )
        self.id_type = self.rows.schema["other_id"].dataType
        held = self.rows.agg(
            F.count("*").alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")
        ).first()
        if held["least"] != held["most"]:
            raise ValueError(f"vectors of {held['least']} to {held['most']} numbers")
        self.width = held["most"] or 0
        # Hashing fills blocks unevenly, so they are planned for half the bytes.
        self.count = max(1, math.ceil(held["n"] * self.width * 8 / max(1, max_bytes // 2)))

    def side(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids in order, and their vectors at length one as a matrix."""
        table = (
            self.rows.filter(F.pmod(F.xxhash64("other_id"), F.lit(self.count)) == number).sort("other_id").toArrow()
        )
        matrix = np.array(table.column("vector").to_pylist(), np.float64).reshape(table.num_rows, self.width)
        return table.column("other_id").to_numpy(), _unit(matrix)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors without nulls as a matrix at length one."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths != width).any():
        raise ValueError(f"vectors of {lengths.min()} to {lengths.max()} numbers meet vectors of {width}")
    return _unit(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width))


def _scores(rows: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    # Adding zero turns a rounded -0.0 into 0.0.
    return np.round(rows @ matrix.T, 6) + 0.0


def _better(best: DataFrame, blocks: _Blocks, number: int) -> DataFrame:
    """``best`` with the matches of a block where they are better."""
    ids, matrix = blocks.side(number)
    width, kind = blocks.width, to_arrow_type(blocks.id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("vector").is_valid().to_numpy(zero_copy_only=False)
            if len(ids) and known.any():
                scores = _scores(_matrix(batch.column("vector").drop_null(), width), matrix)
                place = scores.argmax(axis=1)
                top = iter(zip(ids[place].tolist(), scores[np.arange(len(place)), place].tolist()))
                held = zip(known, batch.column("other_id").to_pylist(), batch.column("score").to_pylist())
                chosen = []
                for has_vector, other, score in held:
                    if has_vector:
                        new, value = next(top)
                        if score is None or (-value, new) < (-score, other):
                            other, score = new, value
                    chosen.append((other, score))
                columns = [pa.array([c[0] for c in chosen], kind), pa.array([c[1] for c in chosen], pa.float64())]
                batch = pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=batch.schema.names)
            yield batch

    return best.mapInArrow(run, best.schema)


def _nearest(data: DataFrame, blocks: _Blocks, number: int, k: int) -> DataFrame:
    """The ``k`` best rows of every batch for each vector of a block."""
    ids, matrix = blocks.side(number)
    width, kind = blocks.width, to_arrow_type(blocks.id_type)
    schema = T.StructType(
        [data.schema["row_id"], T.StructField("other_id", blocks.id_type), T.StructField("score", T.DoubleType())]
    )
    row_kind = to_arrow_type(data.schema["row_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            row_ids = batch.column("row_id").to_numpy(zero_copy_only=False)
            scores = _scores(_matrix(batch.column("vector"), width), matrix)
            for column, other in enumerate(ids.tolist()):
                mine = scores[:, column]
                if len(mine) > k:
                    bound = np.partition(mine, len(mine) - k)[len(mine) - k]
                    chosen = np.flatnonzero(mine >= bound)
                else:
                    chosen = np.arange(len(mine))
                order = chosen[np.lexsort((row_ids[chosen], -mine[chosen]))][:k]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row_ids[order].tolist(), row_kind),
                        pa.array([other] * len(order), kind),
                        pa.array(mine[order], pa.float64()),
                    ],
                    names=schema.names,
                )

    return data.filter(F.col("vector").isNotNull()).mapInArrow(run, schema)


def _unit(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(lengths == 0, 1.0, lengths)
