import collections
import random

import numpy as np

from repoatlas.llm import components, exact_dedup, queries, simhash
from tests.compare import difference, duck
from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.conftest import AWKWARD


def test_exact_dedup_matches_sql(spark):
    run, sql = queries.QUERIES["op6_exact_dedup"], queries.ORACLE["op6_exact_dedup"]
    assert difference(run(spark, SMALL), duck(SMALL), sql) is None


def test_exact_dedup_of_awkward_rows(awkward):
    rows = exact_dedup.duplicate_groups(awkward, keep="largest").collect()
    assert len(rows) == len(AWKWARD)
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows)
    # Nulls are empty texts; of them 2 is the largest id.
    assert got[(None, 2, 3, False)] == 1 and got[(1, 2, 3, False)] == 1 and got[(2, 2, 3, True)] == 1
    # A group without an id has no keep_id, and its rows are alike.
    assert got[(None, None, 2, True)] == 2
    assert got[(6, 7, 3, False)] == 1 and got[(7, 7, 3, True)] == 2
    assert got[(8, 8, 2, True)] == 2
    smallest = {(r.doc_id, r.keep_id) for r in exact_dedup.duplicate_groups(awkward).collect()}
    assert (7, 6) in smallest and (2, 1) in smallest


def test_one_row_of_each_text_stays(awkward):
    kept = exact_dedup.drop_duplicates(awkward)
    assert kept.columns == awkward.columns
    texts = [(t or "").translate(brute.LOW) for t in (r.text for r in kept.collect())]
    assert sorted(texts) == sorted({(t or "").translate(brute.LOW) for _, t in AWKWARD})


def test_texts_that_share_a_hash_are_told_apart(table):
    rows = [(i, f"text {i % 7}") for i in range(40)]
    got = exact_dedup.duplicate_groups(table(rows), hasher=lambda content: content[-1:][:0] or b"one").collect()
    for r in got:
        assert r.keep_id == r.doc_id % 7 and r.group_size == len([i for i in range(40) if i % 7 == r.keep_id])
    # One text alone under a hash that others share.
    got = exact_dedup.duplicate_groups(table([(1, "a"), (2, "b"), (3, "b")]), hasher=lambda c: b"one").collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(1, 1, 1), (2, 2, 2), (3, 2, 2)]


def test_empty_tables(empty):
    assert exact_dedup.duplicate_groups(empty).collect() == []
    assert exact_dedup.drop_duplicates(empty).collect() == []
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.drop_near_duplicates(empty).collect() == []


def test_simhash_matches_brute_force(spark, texts):
    rows = queries.QUERIES["op10_simhash"](spark, SMALL).collect()
    prints = {i: brute.fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: format(p, "016x") for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute.components(prints)


def test_simhash_of_awkward_rows(awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    # No words: fingerprint zero, linked like any other.
    assert [by_id[i][0].fingerprint for i in (1, 2, 3)] == ["0" * 16] * 3
    assert [by_id[i][0].component_id for i in (1, 2, 3)] == [1, 1, 1]
    assert {r.component_id for r in by_id[None]} == {1, None}
    assert {r.component_id for r in by_id[7]} == {6}
    kept = simhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == len({r.fingerprint for r in rows})


def _linked(prints, place):
    return {(int(prints[i]), int(prints[p])) for i, p in enumerate(place)}


def test_both_ways_through_a_list_agree():
    rng = random.Random(4)
    for size in (2, 5, 60, 400):
        fixed = rng.getrandbits(64)
        values = {fixed ^ (rng.getrandbits(8) << 16) ^ (rng.getrandbits(8) << 48) for _ in range(size)}
        members = np.sort(np.array([v - (1 << 64) if v >> 63 else v for v in values], np.int64))
        positions = simhash.OPEN.index((2, 6))
        by_pairs, by_variants = simhash._links_in_matrix(members), simhash._links_by_variants(members, positions)
        assert _linked(members, by_pairs) == _linked(members, by_variants)


def test_close_fingerprints_are_linked_at_every_pair_of_bits(spark):
    base = 0x0123456789ABCDEF
    values = [base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(64) if a != b] + [base]
    far = base ^ 0b111
    signed = [v - (1 << 64) if v >> 63 else v for v in {*values, far, base ^ 0x00FF00FF00FF00FF}]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = components.connected_components(simhash.links(prints)).collect()
    assert len({r.root for r in roots}) == 1
    assert len(roots) == len(set(values) | {far})


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    edges += [(5000 + i, 5000 + (i + 1) % 50) for i in range(50)] + [(7, 7), (None, 3)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert len(got) == 201 + 300 + 50
    for group in (range(201), range(1000, 1300), range(5000, 5050)):
        assert len({got[i] for i in group}) == 1
    assert len(set(got.values())) == 3
