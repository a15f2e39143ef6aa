import numpy as np
import pytest

from repoatlas.functions import vectors as V
from repoatlas.operators import neighbors as N


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 8))
    vectors[7] = 0.0
    vectors[11] = vectors[10]
    return vectors


@pytest.fixture
def tables(spark, data):
    vectors = spark.createDataFrame(
        [(i, i % 3, v.tolist()) for i, v in enumerate(data)],
        "vec_id long, label int, embedding array<float>",
    ).repartition(4)
    queries = spark.createDataFrame(
        [(100 + i, v.tolist()) for i, v in enumerate(data[:23])], "query_id int, embedding array<double>"
    )
    return vectors, queries


def cosines(a, b):
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n == 0, 1, n)

    return np.round(unit(a.astype(np.float32).astype(float)) @ unit(b).T, 6)


@pytest.mark.parametrize("bound", [1 << 20, 1000])
def test_top_k_equals_brute_force_shipped_and_in_blocks(tables, data, bound):
    vectors, queries = tables
    got = N.knn_topk(vectors, queries, 4, max_shipped_bytes=bound).collect()
    scores = cosines(data, data[:23])
    for q in range(23):
        best = sorted(range(300), key=lambda i: (-scores[i, q], i))[:4]
        mine = sorted((r.rank, r.vec_id) for r in got if r.query_id == 100 + q)
        assert mine == list(enumerate(best, 1))


@pytest.mark.parametrize("bound", [1 << 20, 1000])
def test_nearest_prototype_shipped_and_in_blocks(tables, data, bound):
    vectors, queries = tables
    prototypes = queries.withColumnRenamed("query_id", "label").withColumnRenamed("embedding", "centroid")
    got = {r.vec_id: r.label for r in N.nearest_prototype(vectors, prototypes, max_shipped_bytes=bound).collect()}
    scores = cosines(data, data[:23])
    assert got == {i: 100 + int(scores[i].argmax()) for i in range(300)}


def test_centroids_and_own_similarity(tables, data):
    vectors, _ = tables
    centroids = N.label_centroids(vectors)
    means = {r.label: r.centroid for r in centroids.collect()}
    single = data.astype(np.float32).astype(float)
    for label in range(3):
        assert means[label] == pytest.approx(single[label::3].mean(axis=0).tolist())
    similar = {r.vec_id: r.cosine for r in N.prototype_similarity(vectors, centroids).collect()}
    own = [cosines(data[i : i + 1], np.array([means[i % 3]]))[0, 0] for i in range(300)]
    assert [similar[i] for i in range(300)] == pytest.approx(own, abs=1e-6)
    assert similar[7] == 0.0


def test_zero_vectors(values):
    rows = [([3.0, 4.0], [0.0, 0.0])]
    got = values(
        rows, "a array<double>, b array<double>",
        V.l2_normalize("a"), V.l2_normalize("b"), V.cosine("a", "b"), V.cosine("a", "a"), V.norm("a"),
    )
    assert got == [([0.6, 0.8], [0.0, 0.0], 0.0, 1.0, 5.0)]


@pytest.mark.parametrize("bound", [1 << 20, 200])
def test_string_ids_and_missing_vectors(spark, bound):
    vectors = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 1.0]), ("d", [1.0, 1.0]), ("d", [1.0, 0.1])],
        "vec_id string, embedding array<double>",
    )
    others = spark.createDataFrame(
        [(f"q{i:02}", [float(i % 7), float(i % 5)]) for i in range(30)] + [("none", None)], "label string, centroid array<double>"
    )
    nearest = N.nearest_prototype(vectors, others, max_shipped_bytes=bound).collect()
    got = sorted((r.vec_id, r.label, r.score) for r in nearest if r.vec_id != "b")
    assert [(r.label, r.score) for r in nearest if r.vec_id == "b"] == [(None, None)]
    assert got[0] == ("a", "q05", 1.0) and got[1] == ("c", "q07", 1.0) and len(got) == 4
    top = N.knn_topk(vectors, others.withColumnRenamed("centroid", "embedding"), 2, query_id="label", max_shipped_bytes=bound)
    rows = top.filter("label = 'q05'").orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in rows] == [(1, "a"), (2, "d")]
    assert top.filter("vec_id = 'b' or label = 'none'").count() == 0


def test_vectors_of_different_lengths_are_refused(spark):
    ragged = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0])], "vec_id long, embedding array<double>")
    whole = spark.createDataFrame([(1, [1.0, 0.0])], "label long, centroid array<double>")
    with pytest.raises(ValueError):
        N.nearest_prototype(whole.withColumnRenamed("label", "vec_id").withColumnRenamed("centroid", "embedding"), ragged.toDF("label", "centroid"))
    with pytest.raises(Exception, match="meet vectors of 2"):
        N.nearest_prototype(ragged, whole).collect()


def test_no_other_side(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    none = spark.createDataFrame([], "label long, centroid array<double>")
    assert [tuple(r) for r in N.nearest_prototype(vectors, none).collect()] == [(1, None, None)]
    assert N.knn_topk(vectors, none.toDF("query_id", "embedding"), 3).collect() == []
