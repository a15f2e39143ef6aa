import hashlib
import math
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoatlas.functions.text import lead_sentences
from repoatlas.operators import inference as M
from repoatlas.operators import prompts as P


def test_lead_summarizer_equals_the_expression(spark):
    rows = spark.createDataFrame([("One. Two!  Three? Four.",), ("a b",), (None,)], "t string")
    out = M.infer(rows, "t", "s", M.lead_summarizer()).withColumn("e", lead_sentences("t"))
    assert all(r.s == r.e for r in out.filter("t IS NOT NULL").collect())
    assert out.filter("t IS NULL").first().s is None


def test_own_encoder(spark):
    def load():
        return lambda texts: texts.map(lambda t: [float(len(t)), 1.0])

    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert M.encode_texts(docs, load).first() == (1, [3.0, 1.0])


def test_infer_other_types(spark):
    rows = spark.createDataFrame([("x",)], "t string")
    out = M.infer(rows, "t", "n", lambda: lambda s: pd.Series(len(s), index=s.index), T.LongType())
    assert out.first().n == 1


def test_hash_embeddings_equal_brute_force(spark):
    texts = ["spark join spark", "join plan", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    place = {w: int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 64 for w in ("spark", "join", "plan")}
    assert len(set(place.values())) == 3
    df = {"spark": 1, "join": 2, "plan": 1}
    vectors = M.hash_embeddings(docs, dimensions=64)
    got = {r.doc_id: r for r in vectors.select("*", M.dense("positions", "values", 64).alias("dense")).collect()}
    for i, text in enumerate(texts):
        vector = [0.0] * 64
        for word, n in Counter((text or "").split()).items():
            vector[place[word]] = n * math.log(5 / (1 + df[word]))
        length = math.sqrt(sum(x * x for x in vector)) or 1.0
        assert got[i].dense == pytest.approx([x / length for x in vector])
        assert got[i].positions == sorted({place[w] for w in (text or "").split()})


def test_prompts(spark):
    docs = spark.createDataFrame([("x" * 10_500 + "{readme_text}",)], "t string")
    summary, category, relevance = docs.select(
        P.summary_messages("t"), P.category_messages("t"), P.relevance_messages("t", ["alpha", "beta"])
    ).first()
    assert [m.role for m in summary] == ["system", "user"]
    assert summary[1].content.endswith("\n\n" + "x" * 10_000)
    assert "Choose from: 'AI - Machine Learning'" in category[1].content
    assert "'- alpha', '- beta'" in relevance[1].content
    assert docs.select(F.size(P.summary_messages("t"))).first()[0] == 2


def test_a_model_sees_a_long_batch_in_slices(spark):
    sizes = [900_000, 200_000, 10, 1_500_000, 5]
    rows = spark.createDataFrame([(n, "x" * size) for n, size in enumerate(sizes)], "id long, t string").coalesce(1)

    def load():
        return lambda texts: pd.Series([int(texts.str.len().sum())] * len(texts))

    out = M.infer(rows, "t", "n", load, T.LongType()).select("id", "n")
    assert dict(map(tuple, out.collect())) == {0: 900_000, 1: 200_010, 2: 200_010, 3: 1_500_000, 4: 5}
    many = spark.range(0, 5000, 1, 1).withColumn("t", F.lit("a"))
    assert M.infer(many, "t", "n", load, T.LongType()).agg(F.max("n")).first()[0] == M.SLICE_ROWS


def test_lead_summarizer_leaves_later_sentences_uncut():
    first = M.lead_summarizer(2)()
    assert list(first(pd.Series(["One. Two! Three? Four. ", "a.", "", None]))) == ["One. Two!", "a.", "", None]
