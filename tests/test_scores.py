import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from repoatlas.functions import arrays as A
from repoatlas.functions import scores as S
from repoatlas.functions.text import terms, words
from repoatlas.operators import classify as K
from repoatlas.operators import keywords as W

random.seed(3)
VOCABULARY = "spark join plan hot key scan the of and x intel_ext".split()
TEXTS = [" ".join(random.choices(VOCABULARY, k=n)) for n in (0, 1, 5, 40, 200)] + ["", "spark"]
KEYWORDS = ["spark", "hot key", "intel_ext", "absent", "x"]
CATEGORIES = [("A", "spark join, join scan"), ("B", "hot key of"), ("C", "nothing here")]


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def bm25(text, keyword):
    tf = text.split().count(keyword)
    return sigmoid(0.25 * math.log(1 / 3) * 2.5 * tf / (tf + 1.5))


def tfidf(text, keyword):
    a, b = (Counter(re.findall(r"\b\w\w+\b", s.lower())) for s in (keyword, text))
    idf = {t: math.log(3 / (1 + (t in a) + (t in b))) + 1 for t in {*a, *b}}
    va, vb = ({t: n * idf[t] for t, n in c.items()} for c in (a, b))
    norm = math.sqrt(sum(x * x for x in va.values()) * sum(x * x for x in vb.values()))
    return sum(va[t] * vb.get(t, 0) for t in va) / norm if norm else 0.0


def test_keyword_scores_equal_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, readme string")
    got = {(r.id, r.keyword): r for r in W.keyword_relevance(docs, KEYWORDS).collect()}
    assert len(got) == len(TEXTS) * len(KEYWORDS)
    for i, text in enumerate(TEXTS):
        for keyword in KEYWORDS:
            row = got[i, keyword]
            expected_tfidf = tfidf(text, keyword)
            assert row.tfidf == pytest.approx(expected_tfidf, abs=1e-9)
            total = 0.3 * expected_tfidf
            if text.split():
                assert row.bm25 == pytest.approx(bm25(text, keyword), abs=1e-12)
                total += 0.7 * bm25(text, keyword)
            else:
                assert row.bm25 is None
            assert row.relevance == pytest.approx(total / math.sqrt(0.58), abs=1e-9)
            assert row.is_relevant == (row.relevance > 0.5)


def test_cleaned_keywords_can_match(spark):
    docs = spark.createDataFrame([(1, "uses intel ext here")], "id long, readme string")
    (row,) = W.keyword_scores(docs, ["Intel_Ext"], clean_keywords=True).collect()
    assert row.keyword == "intel ext" and row.tfidf > 0


def test_squared_length_and_counts(values):
    rows = [("a b a c a b",), ("",)]
    got = values(
        rows, "t string",
        S.squared_length(words("t")),
        F.transform(A.token_counts(A.kept(words("t"), ["b", "a", "z"])), lambda c: F.concat(c["term"], c["n"].cast("string"))),
    )
    assert got == [(9 + 4 + 1, ["a3.0", "b2.0"]), (0, [])]


def test_category_scores_equal_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    scored = {r.id: r for r in K.category_scores(docs, CATEGORIES).collect()}
    vocabulary = [Counter(re.findall(r"[a-z0-9_]{2,}", t)) for _, t in CATEGORIES]
    idf = {
        t: math.log(4 / (1 + sum(t in c for c in vocabulary))) + 1 for c in vocabulary for t in c
    }
    for i, text in enumerate(TEXTS):
        expected = [sum(bm25(text, w) for w in c.split()) for _, c in CATEGORIES]
        assert scored[i].bm25_scores == pytest.approx(expected, abs=1e-5)
        own = {t: n * idf[t] for t, n in Counter(re.findall(r"[a-z0-9_]{2,}", text)).items() if t in idf}
        length = math.sqrt(sum(x * x for x in own.values()))
        for c, got in zip(vocabulary, scored[i].cosine_scores):
            dot = sum(own.get(t, 0) * n * idf[t] for t, n in c.items())
            norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
            assert got == pytest.approx(dot / norm / length if length else 0, abs=1e-5)


def test_scaling_and_ties(values):
    rows = [([1.0, 3.0, 2.0],), ([2.0, 2.0, 2.0],)]
    got = values(rows, "s array<double>", S.min_max("s"), S.best_category("s", CATEGORIES))
    assert got == [([0.0, 1.0, 0.5], "B"), ([1.0, 1.0, 1.0], "A")]


def test_labels_and_hybrid(spark):
    docs = spark.createDataFrame([(1, "hot key of the plan"), (2, "zzz")], "id long, text string")
    by_cosine = {r.id: r.class_label for r in K.classify_text(docs, CATEGORIES).collect()}
    assert by_cosine == {1: "B", 2: "A"}
    by_both = {r.id: r for r in K.classify_text(docs, CATEGORIES, use_bm25=True).collect()}
    assert by_both[1].class_label == "B"


def test_default_categories(spark):
    docs = spark.createDataFrame(
        [(1, "Object detection and face recognition with PyTorch"), (2, "Option pricing and risk management")],
        "id long, text string",
    )
    got = [r.class_label for r in K.classify_text(docs).orderBy("id").collect()]
    assert got == ["AI - Computer Vision", "Financial Services"]


def test_enrichment_label_reads_the_new_description(spark):
    rows = spark.createDataFrame([(1, "Hot key of it. More. And more. spark join", "spark")], "id long, readme string, topics string")
    out = K.enrich_catalog(rows, F.lit(0.5), categories=CATEGORIES).first()
    assert (out.brief_desc, out.class_label) == ("Hot key of it. More. And more.", "B")
    with_topics = K.enrich_catalog(rows, F.lit(0.5), categories=CATEGORIES, topics="topics").first()
    assert with_topics.relevance == 0.5 and with_topics.class_label == "B"


def test_terms_are_lower_case(values):
    assert values([("A bC d1 _x",)], "t string", terms("t")) == [(["bc", "d1", "_x"],)]
