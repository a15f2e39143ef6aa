import bisect
import collections
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest

from repoatlas.llm import alignment, queries
from repoatlas.llm.tasks import slices
from tests.conftest import SMALL
from tests.llm.conftest import AWKWARD


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Aligner(public_tokenizers.path(alignment.BYTE_BPE), public_tokenizers.path(alignment.PIECES))


def whole(own, text):
    """Both sides' ids of a whole text, without cutting it."""
    if not text:
        return None
    a = own.a.encode(" " + text, add_special_tokens=False).ids
    b = own.b.encode(text, num_threads=1)
    raw = (" " + text).encode()
    if b"".join(own.a_bytes[i] for i in a) != raw or b"".join(own.b_bytes[i] for i in b) != raw:
        return None
    return a, b


def groups_of(own, a, b):
    ends = []
    for ids, raw in ((a, own.a_bytes), (b, own.b_bytes)):
        place, mine = 0, []
        for i in ids:
            place += len(raw[i])
            mine.append(place)
        ends.append(mine)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups = [([], []) for _ in cuts]
    for side, (ids, mine) in enumerate(((a, ends[0]), (b, ends[1]))):
        for i, e in zip(ids, mine):
            groups[bisect.bisect_left(cuts, e)][side].append(i)
    return groups


def brute(own, texts):
    found, counts = [], collections.Counter()
    for text in texts:
        ids = whole(own, text)
        groups = groups_of(own, *ids) if ids else None
        links = [(p[-1], q[-1]) for p, q in groups] if groups else []
        counts.update(links)
        found.append((ids, groups, links))
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = []
    for ids, groups, links in found:
        if not ids:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        told = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        n_best = sum(counts[x] == best[x[1]] for x in links)
        digest = hashlib.sha256(told.encode()).hexdigest()
        rows.append((len(ids[0]), len(ids[1]), len(groups), len(links), n_best, sum(counts[x] for x in links), digest))
    return rows, counts


AWKWARD_PARTS = (
    " ", " ", "  ", "\n", "\t", "a", "the", " Don", ", ", ";", ":", "?", "'s", "1", "23", ".", "!!", "é", "漢", "😀", "▁", "<s>", "<|endoftext|>",
    "\r\n", "x", "<0x41>", "\x00", "​", "ﬁ", "́", "\x1c", "</s>", "Don't", "　", "<unk>", "▁ ",
)


def _fuzz(count):
    rng = random.Random(3)
    return ["".join(rng.choice(AWKWARD_PARTS) for _ in range(rng.randint(1, 14))) for _ in range(count)]


def test_cut_texts_have_the_ids_of_whole_texts(tokenizers):
    for text in _fuzz(3000):
        assert "".join(alignment.parts_of(text)) == " " + text
        cut = alignment.parts_of(text)
        known, ids = tokenizers.learn([cut]), whole(tokenizers, text)
        parts = [known[p] for p in cut]
        assert (None not in parts) == (ids is not None)
        if ids:
            groups = [g.split("|") for g in ";".join(p[2] for p in parts).split(";")]
            assert ids[0] == [int(i) for p, _ in groups for i in p.split(",")]
            assert ids[1] == [int(i) for _, q in groups for i in q.split(",")]


def test_ranks_give_the_tokenizers_ids(tokenizers, texts):
    assert tokenizers.fast_a is not None
    for text in [*texts.values(), *_fuzz(500)]:
        if text:
            expected = tokenizers.a.encode(" " + text, add_special_tokens=False).ids
            assert tokenizers.fast_a.encode_ordinary(" " + text) == expected


def test_matches_brute_force(spark, texts, tokenizers):
    rows = sorted(texts.items())
    expected, _ = brute(tokenizers, [t for _, t in rows])
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_alignment"](spark, SMALL).collect()}
    assert got == {i: e for (i, _), e in zip(rows, expected)}


def test_odd_texts_and_their_counts(table, tokenizers):
    texts = _fuzz(400)
    expected, counts = brute(tokenizers, texts)
    docs = table(enumerate(texts)).repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.alignment_report(docs).collect()}
    assert got == dict(enumerate(expected))
    assert {(r.a_id, r.b_id): r.n for r in alignment.link_counts(alignment.aligned_rows(docs)).collect()} == counts


def test_links_are_bounded_by_the_vocabularies(tokenizers):
    a = set(tokenizers.a_bytes)
    b = set(tokenizers.b_bytes)
    endings = lambda raw: {raw[k:] for k in range(len(raw))}
    bound = sum(len(endings(x) & b) for x in a) + sum(len(endings(x) & a) for x in b)
    assert bound < 500_000


def test_awkward_rows(awkward, empty):
    rows = alignment.alignment_report(awkward).collect()
    assert len(rows) == len(AWKWARD)
    nothing = [tuple(r)[1:] for r in rows if r.doc_id in (1, 2)]
    assert nothing == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert all(r.n_groups > 0 for r in rows if r.doc_id in (3, 4, 5, 9))
    assert alignment.alignment_report(empty).collect() == []


def test_texts_are_split_in_slices_of_their_own_size():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": ["a" * 600_000, "b" * 300_000, "c" * 200_000, None]})
    assert [part.num_rows for part in slices(batch, 1, alignment.SPLIT_BYTES)] == [2, 2]
    assert [part.num_rows for part in slices(batch, 1)] == [4]
