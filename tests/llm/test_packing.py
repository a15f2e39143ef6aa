import random

from hypothesis import given, settings
from hypothesis import strategies as st

from repoatlas.llm import packing, queries, token_ids
from tests.conftest import SMALL
from tests.llm import brute


def test_query_packs_every_token(spark, texts):
    rows = queries.QUERIES["op3_best_fit_packing"](spark, SMALL).collect()
    sequences = brute.check_packing(rows, texts)
    assert sequences <= 1.05 * (sum(r.length for r in rows) / 2048) + 1


def test_awkward_documents(awkward, empty):
    rows = packing.pack_documents(awkward.filter("doc_id is not null and doc_id not in (7, 8)"), capacity=64).collect()
    from tests.llm.conftest import AWKWARD

    brute.check_packing(rows, {i: t for i, t in AWKWARD if i not in (None, 7, 8)}, 64)
    # Nulls and repeated rows have pieces each.
    ids = [r.doc_id for r in packing.pack_documents(awkward).collect()]
    assert ids.count(None) == 3 and ids.count(7) == 2 and ids.count(8) == 2
    assert packing.pack_documents(empty).collect() == []


def test_sequences_hold_their_ids(spark, table):
    docs = table([(i, f"document number {i} " * (i + 1)) for i in range(20)])
    pieces = packing.token_pieces(docs, capacity=50, with_ids=True)
    placed = packing.place_pieces(pieces, capacity=50, task_pieces=8)
    held = {r.sequence_id: bytes(r.ids) for r in packing.packed_sequences(placed).collect()}
    for r in placed.collect():
        assert held[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert all(len(ids) <= 200 for ids in held.values())


def _plain(lengths, capacity, limit):
    """Best fit over a plain list of (free, bin)."""
    open_bins, placed, bins = [], [], 0
    for length in lengths:
        fitting = [b for b in open_bins if b[0] >= length]
        if fitting:
            chosen = min(fitting, key=lambda b: b[0])
            open_bins.remove(chosen)
        else:
            chosen = (capacity, bins)
            bins += 1
        placed.append((chosen[0], length))
        if chosen[0] > length:
            if len(open_bins) == limit:
                open_bins.remove(min(open_bins, key=lambda b: b[0]))
            open_bins.append((chosen[0] - length, chosen[1]))
    return placed, bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200), st.integers(1, 8))
def test_best_fit_closes_the_fullest(lengths, limit):
    placed = list(packing.pack_lengths(lengths, 40, limit))
    expected, bins = _plain(lengths, 40, limit)
    assert [(40 - offset, n) for (_, offset), n in zip(placed, lengths)] == expected
    assert len({b for b, _ in placed}) == bins
    held = {}
    for (number, offset), length in zip(placed, lengths):
        assert offset == held.get(number, 0)
        held[number] = offset + length
        assert held[number] <= 40


ALPHABET = "aAbZ.,!?'sStT:;-<|>019 \n\t\x1c\x1f\x85\xa0 　éÉßİΣσς漢😀é​"


def test_word_ids_are_the_tokenizers():
    rng = random.Random(11)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["<|endoftext|>", "x<|endoftext|>.", "<|ENDOFTEXT|>.", "don't. We'LL!", "a" * 3000, "ΑΣ ΑΣ.", "İx"]
    coder = token_ids.WordCoder(token_ids.public_tokenizers.path(token_ids.WORD_BPE))
    got = coder.encode(texts)
    for text, raw in zip(texts, got):
        ids = coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert raw == token_ids.np.array(ids, "<u4").tobytes(), repr(text)
