import random

import pytest
from pyspark.sql import functions as F

from repoatlas.operators import catalog as C
from repoatlas.operators import keywords as W
from repoatlas.operators.dedupe import dedupe_first, duplicate_rows
from repoatlas.operators.skew import lookup_join, number_rows
from repoatlas.operators import skew
from repoatlas.operators import topics as T
from repoatlas.operators.topics import detect_language, extract_topics, route_language


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("bound", [10_000, 0])
def test_lookup_join_keeps_every_row_hot_or_not(spark, bound):
    """One key holds a third of all rows; some keys have no lookup row."""
    keys = ["hot"] * 3000 + [f"k{i % 2000}" for i in range(6000)] + ["missing", None]
    facts = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, key string")
    lookup = (
        facts.filter("key <> 'missing'").groupBy("key")
        .agg(F.count("*").alias("n"), F.min("id").alias("first"))
    )
    joined = lookup_join(facts, lookup, "key", "n", "id", max_broadcast_rows=bound)
    expected = facts.join(lookup, "key", "left").select("id", "key", "n", "first")
    assert joined.columns == expected.columns
    assert joined.exceptAll(expected).count() == 0 and expected.exceptAll(joined).count() == 0


def test_positions_over_many_tasks(spark):
    random.seed(1)
    data = [(i, random.choice(["a", "a", "a", "b", "c"]), random.randrange(5)) for i in range(2000)]
    rows = spark.createDataFrame(data, "id long, g string, x int").repartition(7)
    order = [F.desc("x"), F.asc("id")]
    got = {r.id: r.position for r in number_rows(rows, order).collect()}
    expected = sorted(data, key=lambda r: (-r[2], r[0]))
    assert got == {r[0]: i for i, r in enumerate(expected)}
    grouped = {r.id: r.position for r in number_rows(rows, order, "g").collect()}
    for g in "abc":
        mine = [r[0] for r in expected if r[1] == g]
        assert {i: grouped[i] for i in mine} == {i: n for n, i in enumerate(mine)}


def test_first_rows_and_duplicates_split_the_input(spark):
    data = [(i, f"u{i % 7 if i % 3 else 0}", f"v{i}") for i in range(300)]
    rows = spark.createDataFrame(data, "seq long, url string, v string").repartition(5)
    first, rest = dedupe_first(rows, "url"), duplicate_rows(rows, "url")
    assert rows_of(first.union(rest)) == sorted(data)
    seen = {}
    for row in data:
        seen.setdefault(row[1], row)
    assert rows_of(first) == sorted(seen.values())


def test_search_pages_and_top_k(spark):
    catalog = spark.sql(
        "SELECT id, concat('r/', id) AS url, id AS stars_count, "
        "CASE WHEN id = 3 THEN null ELSE 'has a Phrase here' END AS readme, "
        "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, CAST(id % 3 AS INT)) AS updated_at, "
        "timestamp_ntz'2024-01-05' AS pushed_at FROM range(10)"
    )
    found = C.catalog_search(catalog, "phrase", 2, 10, "2024-01-15")
    assert [r.id for r in found.orderBy("id").collect()] == [2, 4, 5, 6, 7, 8, 9]
    assert C.catalog_search(catalog, "phrase", 2, 9, "2024-01-15").count() == 0
    page = C.catalog_search(catalog, "phrase", 2, 10, "2024-01-15", page=1, page_size=3)
    assert [r.id for r in page.collect()] == [4, 7, 6]
    assert [r.id for r in C.top_k(catalog, 2, "stars_count").collect()] == [9, 8]
    assert [r.id for r in C.top_k(catalog, 1, "readme", ascending=True).collect()] == [0]


def test_nulls_last_both_ways(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, 4)], "id long, x int")
    assert [r.id for r in C.top_k(rows, 3, "x").collect()] == [2, 3, 1]
    assert [r.id for r in C.top_k(rows, 3, "x", ascending=True).collect()] == [3, 2, 1]


def test_detail_view_of_one_repository(spark):
    catalog = spark.createDataFrame([(1, "h/o/a"), (2, "h/o/b")], "id long, url string")
    activity = spark.createDataFrame(
        [(1, "issue", "open", "x"), (1, "pull", "closed", "x"), (1, "pull", "merged", "y")],
        "id long, kind string, state string, contributor string",
    )
    assert rows_of(C.repo_detail_view(catalog, activity, "o/a")) == [(1, "h/o/a", "o/a", 1, 1, 2, 2)]
    assert rows_of(C.repo_detail_view(catalog, activity, "o/b")) == [(2, "h/o/b", "o/b", 0, 0, 0, 0)]


def test_paths(spark):
    paths = ["docs/a.py", "docsx/a.py", "src/b.py", "docs/c.md"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = C.path_filter(rows, "path", ["docs", "lib"], [".py"])
    assert rows_of(kept) == [("docs/a.py",)]


def test_resume(spark):
    work = spark.createDataFrame([(o, p) for o in range(3) for p in range(3)], "ord int, page int")
    keywords = ["a", "b", "c"]
    assert W.resume_pages(work, keywords, None, None).count() == 9
    assert W.resume_pages(work, keywords, "zzz", 0).count() == 0
    assert rows_of(W.resume_pages(work, keywords, "b", 1)) == [(1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]


def test_keyword_match_drops_documents_without_match(spark):
    docs = spark.createDataFrame([(1, "a join b"), (2, "none"), (3, None)], "id long, readme string")
    assert rows_of(W.keyword_match(docs, ["join", "a join"])) == [(1, 0, "join"), (1, 1, "a join")]


def test_topics_and_language(spark):
    docs = spark.createDataFrame(
        [(1, "rare word and common common"), (2, "common text"), (3, "")], "id long, readme string"
    )
    got = dict(rows_of(extract_topics(docs, 3)))
    assert got == {1: "rare and common", 2: "common text", 3: ""}
    texts = spark.createDataFrame([("The end of the day",), ("der und die",), ("xyz",)], "text string")
    routed = {r.text: (r.language_id, r.route) for r in route_language(texts).collect()}
    assert routed == {
        "The end of the day": ("en", "summarize"), "der und die": ("de", "translate"), "xyz": (None, "translate"),
    }
    assert detect_language(texts).columns == ["text", "language_id"]


def test_common_terms_are_weighted_where_they_are(spark, monkeypatch):
    """Whatever is common, the topics are the same, and a common term is not shuffled."""
    docs = spark.createDataFrame(
        [(n, f"common word{n % 7} rare{n} common word{n % 3}") for n in range(60)] + [(60, None), (None, "common rare0")],
        "id long, readme string",
    )
    wanted = None
    for most in (0, 1, 5, 100_000):
        monkeypatch.setattr(T, "common_keys", lambda *a, most=most: skew.common_keys(*a, most=most))
        got = sorted(map(repr, map(tuple, extract_topics(docs, 2).collect())))
        wanted = wanted or got
        assert got == wanted
    counts = spark.createDataFrame([("a", 9), ("b", 8), ("c", 3), ("d" * 65, 99), (None, 5)], "k string, n long")
    held = lambda most: {r.k for r in counts.filter(skew.common_keys(counts, "k", "n", most)).collect()}
    assert held(0) == held(1) == set() and held(2) == {"a", "b"} and held(3) == {"a", "b", "c"}
