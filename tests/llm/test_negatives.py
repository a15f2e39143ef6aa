import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from repoatlas.llm import hard_negatives as H
from repoatlas.llm import queries
from tests.compare import difference, duck
from tests.conftest import SMALL

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, is_anchor, positives=5, negatives=10):
    rows = sorted((i, la, [math.floor(256 * float(np.float32(x))) for x in v]) for i, la, v in rows)
    out = set()
    for i, la, v in rows:
        if not is_anchor(i):
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in rows if j != i)
        for p, j, _ in [s for s in scores if s[2] == la][:positives]:
            near = [(-s, n) for s, n, other in scores if other != la and 30 * -p <= 100 * -s <= 90 * -p]
            out |= {(i, j, k + 1, n, -p, s) for k, (s, n) in enumerate(near[:negatives])}
    return out


def test_matches_sql(spark):
    name = "op11_hard_negatives"
    assert difference(queries.QUERIES[name](spark, SMALL), duck(SMALL), queries.ORACLE[name]) is None


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2)])
def test_neighbours_on_the_curve_are_one_step_apart(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = H.hilbert_keys(points, bits)
    assert len(set(keys)) == len(points)
    walk = points[sorted(range(len(keys)), key=keys.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def _clustered(count, dims=8, labels=4, seed=5):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    return [(i, rng.randrange(labels), [round(c + rng.gauss(0, 0.2), 1) for c in rng.choice(centres)]) for i in range(count)]


@pytest.mark.parametrize("shipped", [H.MAX_SHIPPED_BYTES, 20_000])
def test_matches_brute_force(spark, shipped, monkeypatch):
    """Many blocks, many ties, one label with a third of all rows, anchors in several groups."""
    rows = [(i, 0 if i % 3 == 0 else la, v) for i, la, v in _clustered(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % 25 == 0, max_shipped_bytes=shipped).collect()}
    assert got == brute(rows, lambda i: i % 25 == 0) and len(got) > 1000


def test_zone_maps_spare_blocks(spark):
    """Clusters far apart: of all pairs of anchors and blocks few are read."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 4, (40, 8))
    rows = [(i, i % 2, (centres[i % 40] + rng.normal(0, 0.05, 8)).tolist()) for i in range(40_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    usable = H._usable(df, "vec_id", "label", "embedding", None)
    blocks = H._packed(H._with_keys(usable, 8, 256 * 4.0).orderBy("place", "vec_id").withColumn("spot", F.monotonically_increasing_id()).drop("place"), 8).toArrow()
    zones = [np.frombuffer(b"".join(blocks.column(c).to_pylist()), "<i4").reshape(-1, 8).astype(float) for c in ("least", "greatest")]
    assert blocks.num_rows < 2 * 40_000 / H.BLOCK_ROWS + 10
    anchors = H.Anchors(usable.filter("vec_id < 40").sort("vec_id").toArrow(), 8)
    low, high = anchors.bounds(slice(None), *zones)
    for k, (raw, ids) in enumerate(zip(blocks.column("vectors").to_pylist(), blocks.column("ids").to_pylist())):
        scores = anchors.matrix @ np.frombuffer(raw, "<i4").reshape(-1, 8).T
        assert (scores >= low[:, [k]]).all() and (scores <= high[:, [k]]).all()
        assert (np.diff(np.frombuffer(ids, "<i8")) > 0).all()
    own = (anchors.matrix**2).sum(axis=1) * 0.99
    assert (high >= own[:, None]).mean() < 0.25


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.0]), (2, 2, [0.5, 0.0]), (3, 2, [0.5, 0.1]), (4, None, [0.6, 0.0]),
        (5, 2, None), (6, 2, [0.6, None]), (7, 2, [0.6, nan]), (8, 2, [inf, 0.0]), (None, 2, [0.6, 0.0]),
        (9, 2, [0.4]), (10, 2, []), (2, 2, [0.5, 0.0]), (11, 2, [-0.5, 0.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(n) for n in ("block", "place", "row", "score", "rank")})
    got = sorted(tuple(r) for r in H.hard_negatives(df, F.col("vec_id") == 0).collect())
    # 0.9 becomes 230 and its score 58,880; short vectors end in zeros.
    assert got == [(0, 1, 1, 2, 58880, 32768), (0, 1, 2, 3, 58880, 32768), (0, 1, 3, 9, 58880, 26112)]
    assert H.hard_negatives(df.limit(0), F.col("vec_id") == 0).collect() == []
    assert H.hard_negatives(df, F.col("vec_id") == 99).collect() == []
    # An anchor alone with its label has no positive.
    assert H.hard_negatives(df.filter("vec_id != 1"), F.col("vec_id") == 0).collect() == []


def test_negative_positives_have_no_window(spark):
    rows = [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-0.5]), (3, 1, [0.0]), (4, 2, [0.0])]
    got = {tuple(r) for r in H.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()}
    assert got == {(0, 3, 1, 4, 0, 0)}


def test_huge_components_end_at_the_bound(spark):
    rows = [(0, 1, [3e38]), (1, 1, [3e38]), (2, 2, [25000.0])]
    got = [tuple(r) for r in H.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()]
    assert got == [(0, 1, 1, 2, H.MOST**2, 25000 * 256 * H.MOST)]
