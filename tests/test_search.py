"""Phrase index and keyword tables against plain scans."""

import random

import pytest
from pyspark.sql import functions as F

from repoatlas.operators import phrase_index as P
from repoatlas.operators.keyword_table import match_keywords

TEXTS = [
    "The quick brown fox", "the QUICK Brown dog", "", None, "ab", "aaaa aaa", "naïve ÜBER façade", "漢字かな交じり文", "😀 smile 😀😀",
    "line one\nline two", "quick", "brown  fox", "x" * 5000 + "needle" + "y" * 5000, "100% [sure] (ok) \\d+",
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(2)
    more = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Omega"]) for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    folder = str(tmp_path_factory.mktemp("index"))
    rows = spark.createDataFrame([(n, t, "block?") for n, t in enumerate(TEXTS + more)], "id long, readme string, note string")
    P.build_phrase_index(rows.repartition(3), folder + "/made")
    return folder + "/made", rows


@pytest.mark.parametrize(
    "phrase",
    ["quick", "the quick brown", "brown fox", "aaa", "aaaaa", "naïve ü", "字かな", "😀😀", "😀 s", "one\nline", "needle", "alpha beta",
     "omega omega omega", "Omega", "a", "ab", "", "%", "[sure]", "\\d+", "zzz"],
)
def test_a_search_gives_what_a_scan_gives(spark, index, phrase):
    folder, rows = index
    scan = rows.filter(F.contains(F.lower("readme"), F.lit(phrase)))
    found = P.phrase_search(spark, folder, phrase)
    assert found.columns == rows.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, scan.collect()))


def test_many_candidates_are_joined(spark, index, monkeypatch):
    folder, rows = index
    monkeypatch.setattr(P, "NAMED_BLOCKS", 2)
    assert P.phrase_search(spark, folder, "gamma").count() == rows.filter("lower(readme) like '%gamma%'").count()


def test_texts_of_other_blocks_are_skipped(spark, index):
    folder, _ = index
    found = P.phrase_search(spark, folder, "needle")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(block," in plan or "In(block," in plan
    assert P.candidate_blocks(spark, folder, "needle").count() < 3
    postings = P.candidate_blocks(spark, folder, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in postings and "shelf" in postings and "In(gram," in postings
    assert P.candidate_blocks(spark, folder, "not there at all").count() == 0
    assert P.candidate_blocks(spark, folder, "ab") is None


def test_an_empty_table(spark, tmp_path):
    P.build_phrase_index(spark.createDataFrame([], "id long, readme string"), str(tmp_path / "i"))
    assert P.phrase_search(spark, str(tmp_path / "i"), "anything").collect() == []


def brute(texts, keywords):
    out = set()
    for n, t in texts:
        for k in {k for k in keywords if k}:
            places = sum(t.startswith(k, p) for p in range(len(t))) if t else 0
            if places:
                out.add((n, k, places))
    return out


@pytest.mark.parametrize("max_chars", [10**9, 40])
def test_keywords_overlap(spark, max_chars):
    keywords = ["quick", "ick", "k b", "aa", "aaa", "aaaa", "x", "😀", "字か", "line", "ne", "", None, "quick", "absent", "\n", "ü"]
    texts = list(enumerate(TEXTS[:12] + TEXTS[13:]))
    docs = spark.createDataFrame(texts, "id long, readme string")
    got = match_keywords(docs, spark.createDataFrame([(k,) for k in keywords], "keyword string"), max_chars=max_chars)
    assert {tuple(r) for r in got.collect()} == brute(texts, keywords) and got.columns == ["id", "keyword", "n"]


def test_fifty_thousand_keywords(spark):
    rng = random.Random(8)
    keywords = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(4, 11))) for _ in range(90_000)})[:50_000]
    texts = [(n, "".join(rng.choice("abcd ") for _ in range(400))) for n in range(40)]
    table = spark.createDataFrame([(k,) for k in keywords], "keyword string")
    got = {tuple(r) for r in match_keywords(spark.createDataFrame(texts, "id long, readme string"), table).collect()}
    known, expected = set(keywords), {}
    for n, t in texts:
        for a in range(len(t)):
            for b in range(a + 4, min(a + 11, len(t)) + 1):
                if t[a:b] in known:
                    expected[(n, t[a:b])] = expected.get((n, t[a:b]), 0) + 1
    assert got == {(n, k, c) for (n, k), c in expected.items()} and len(got) > 1000


def test_no_keywords_and_no_texts(spark):
    none = spark.createDataFrame([], "keyword string")
    docs = spark.createDataFrame([(1, "text"), (None, "text"), (1, "text")], "id long, readme string")
    assert match_keywords(docs, none).collect() == []
    one = spark.createDataFrame([("ex",)], "keyword string")
    assert match_keywords(docs.limit(0), one).collect() == []
    assert sorted(map(repr, match_keywords(docs, one).select("id").collect())) == ["Row(id=1)", "Row(id=1)", "Row(id=None)"]
