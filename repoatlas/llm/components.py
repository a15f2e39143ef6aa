"""Connected components of a graph of any size and shape."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas.operators.skew import lookup_join
from repoatlas.session import written


def connected_components(edges: DataFrame, left: str = "src", right: str = "dst") -> DataFrame:
    """``(node, root)`` for every node of ``edges``, ``root`` being one node of its component.

    In each round every node is merged into the smallest of itself and its
    neighbours, and the edges between different merged nodes go on. Only nodes
    smaller than all their neighbours remain, at most half of them, so there are
    no more rounds than the logarithm of the largest component. Then the merges
    are followed from the last round to the first. A node with any number of
    edges is a hot key of the joins, which ``lookup_join`` splits.
    """
    rest = written(
        edges.select(F.col(left).alias("src"), F.col(right).alias("dst"))
        .filter("src is not null and dst is not null and src != dst")
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct()
    )
    merges = []
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        merged = written(
            both.groupBy(F.col("src").alias("node"))
            .agg(F.min("dst").alias("least"), F.count("*").alias("degree"))
            .select("node", F.least("node", "least").alias("root"), "degree")
        )
        merges.append(merged)
        for side, other in (("src", "dst"), ("dst", "src")):
            joined = lookup_join(rest, merged.withColumnRenamed("node", side), side, "degree", other)
            rest = joined.withColumn(side, F.col("root")).drop("root", "degree")
        rest = written(
            rest.filter("src != dst")
            .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
            .distinct()
        )
    if not merges:
        return rest.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    roots = merges.pop().select("node", "root")
    while merges:
        earlier = merges.pop()
        later = written(
            earlier.groupBy("root")
            .agg(F.count("*").alias("held"))
            .join(roots.withColumnRenamed("root", "top"), F.col("root") == F.col("node"), "left")
            .select("root", "held", F.coalesce("top", "root").alias("top"))
        )
        roots = written(
            lookup_join(earlier.select("node", "root"), later, "root", "held", "node").select(
                "node", F.col("top").alias("root")
            )
        )
    return roots
