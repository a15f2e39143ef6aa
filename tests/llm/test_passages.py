import hashlib
import random

import pytest

from repoatlas.llm import queries, substring_dedup
from tests.compare import difference, duck
from tests.conftest import SMALL
from tests.llm.conftest import AWKWARD


def brute(rows, window=20):
    """Kept words per row; rows are in the operator's order of documents."""
    seen, out = set(), []
    for text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            gram = tuple(words[p : p + window])
            if gram in seen:
                gone[p : p + window] = [True] * window
            seen.add(gram)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def told(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_texts_are_shuffled_once(spark, table):
    rows = [(n, f"{n} " + "the same words again " * 9) for n in range(6)]
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        found = substring_dedup.passage_report(table(rows))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange [id" in plan and told(found) == dict(enumerate(brute([t for _, t in rows])))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_matches_sql(spark):
    name = "op13_substring_dedup"
    assert difference(queries.QUERIES[name](spark, SMALL), duck(SMALL), queries.ORACLE[name]) is None


def _mosaics(seed, count, vocabulary):
    """Texts pieced together from shared passages, their parts, and own words."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.randint(15, 90))] for _ in range(12)]
    texts = []
    for _ in range(count):
        words = []
        for _ in range(rng.randint(0, 6)):
            passage = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(passage) + 1), 2))
            words += passage if rng.random() < 0.5 else passage[a:b]
            words += [word() for _ in range(rng.choice([0, 0, 1, 3, 25]))]
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    return texts


@pytest.mark.parametrize("seed, vocabulary", [(1, 5000), (2, 3), (3, 1)])
def test_factors_break_and_overlap(spark, table, seed, vocabulary):
    texts = _mosaics(seed, 60, vocabulary)
    rows = list(enumerate(texts))
    random.Random(seed).shuffle(rows)
    got = told(substring_dedup.passage_report(table(rows).repartition(3)))
    assert got == dict(enumerate(brute(texts)))


def test_one_anchor_in_many_surroundings(table):
    """A common line whose windows all differ but for a few."""
    rng = random.Random(4)
    line = [f"line{i}" for i in range(10)]
    texts = [" ".join([f"a{rng.randrange(4)}" for _ in range(12)] + line + [f"b{rng.randrange(4)}" for _ in range(12)]) for _ in range(150)]
    texts += texts[:20]
    assert told(substring_dedup.passage_report(table(enumerate(texts)))) == dict(enumerate(brute(texts)))


def test_long_copies_are_factors(spark, table):
    """Only the ends of a copy are checked window by window."""
    text = " ".join(f"w{i}" for i in range(3000))
    rows = substring_dedup.keyed(table([(1, text), (2, text), (3, text + " more")]), "doc_id", "text")
    found = {r.id: r for r in substring_dedup.repeated_spans(rows).collect()}
    assert set(found) == {2, 3}
    for r in found.values():
        assert len(r.spans) == 2 and r.spans[1] - r.spans[0] > 2970 and len(r.starts) < 30


def test_awkward_rows(awkward, empty):
    rows = substring_dedup.passage_report(awkward)
    assert rows.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and rows.count() == len(AWKWARD)
    got = {(r.doc_id, r.n_words): r.n_removed for r in rows.collect()}
    assert got[(1, 0)] == got[(2, 0)] == got[(3, 0)] == got[(5, 1)] == got[(8, 3)] == 0
    # All but the first window of one word again and again.
    assert got[(4, 30_000)] == 29_999
    assert substring_dedup.passage_report(empty).collect() == []
    kept = substring_dedup.drop_passages(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD)
    assert {r.text for r in kept.filter("doc_id = 4").collect()} == {"word"}
    assert {r.text for r in kept.filter("doc_id = 3").collect()} == {" \n\t "} and kept.filter("spans = 'spans'").count() == len(AWKWARD)


def test_ids_that_repeat_or_are_null(table):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (5, text), (5, text), (5, "other " + text), (9, text)]
    got = sorted((r.doc_id or 99, r.n_words, r.n_removed) for r in substring_dedup.passage_report(table(rows)).collect())
    # The two rows of 5 with one text are one document; which of its two texts comes first, their hashes say.
    assert [g for g in got if g[0] in (9, 99)] == [(9, 30, 30), (99, 30, 30)]
    assert [g[2] for g in got if g[:2] == (5, 30)] in ([0, 0], [30, 30])
    assert sum(g[2] for g in got if g[0] == 5) in (30, 60)
