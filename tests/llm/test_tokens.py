import gc
import random
from array import array

import public_tokenizers
import pytest
import sentencepiece

from repoatlas.llm import nbest, pieces, queries, token_counts
from tests.conftest import SMALL
from tests.llm.conftest import AWKWARD


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    """The library's own unigram model over the same pieces and scores."""
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    with open(public_tokenizers.path(pieces.PIECES), "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        if piece.piece in vocabulary.cost:
            piece.score = -vocabulary.cost[piece.piece] / pieces.UNIT
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


@pytest.fixture(scope="module")
def samples(texts):
    rng = random.Random(3)
    alphabet = " abcdethe.,\n▁é漢😀x  ingon"
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    return [t[:400] for t in texts.values()] + odd


def _cost(ids, library, vocabulary):
    """Bytes of unknown characters are left out on both sides."""
    return sum(vocabulary.cost[library.id_to_piece(i)] for i in ids if not library.is_byte(i))


def test_best_encodings_cost_what_the_librarys_do(samples, library, vocabulary):
    coder = nbest.NBestCoder(vocabulary)
    for text, found in zip(samples, coder.encode(samples, 1)):
        ids, expected = list(array("I", found[0][1])), library.encode(text)
        # The library adds up in single precision, so near ties may differ.
        assert ids == expected or abs(_cost(ids, library, vocabulary) - _cost(expected, library, vocabulary)) < 50


def test_nbest_costs_are_the_librarys(samples, library, vocabulary):
    coder = nbest.NBestCoder(vocabulary)
    short = [t for t in samples if 0 < len(t) < 30 and "▁" not in t]
    for text, found in zip(short, coder.encode(short, 4)):
        ours = [_cost(array("I", ids), library, vocabulary) for _, ids in found]
        theirs = [_cost(ids, library, vocabulary) for ids in library.nbest_encode(text, nbest_size=4)]
        assert len(ours) == len(theirs) and all(abs(a - b) < 100 for a, b in zip(ours, theirs)), text


def test_combined_pretokens_are_the_whole_lattice(samples, vocabulary):
    coder = nbest.NBestCoder(vocabulary)
    for text in samples[-120:]:
        whole = nbest.search(pieces.BLANK + text.replace(" ", pieces.BLANK), 5, vocabulary)
        assert [cost for cost, _ in whole] == [cost for cost, _ in coder.encode([text], 5)[0]]


def test_search_lists_every_segmentation_in_order(vocabulary):
    def every(word):
        if not word:
            return [0]
        return [c + rest for end in range(1, len(word) + 1) if (c := vocabulary.cost.get(word[:end])) is not None for rest in every(word[end:])]

    for word in ("▁then", "aaaa", "thing", "▁▁a"):
        expected = sorted(every(word))
        assert [c for c, _ in nbest.search(word, 1000, vocabulary)] == expected
    assert len(nbest.search("a" * 20_000, 3, vocabulary)) == 3


def test_encodings_decode_to_the_text(samples, vocabulary):
    coder = nbest.NBestCoder(vocabulary)
    for text, found in zip(samples, coder.encode(samples, 3)):
        assert len({ids for _, ids in found}) == len(found)
        assert all(coder.decode(ids) == text.replace(pieces.BLANK, " ") for _, ids in found)


def _plain_count(word, vocabulary):
    ways = [(0, 0)]
    for end in range(1, len(word) + 1):
        found = []
        for start in range(end):
            cost = vocabulary.cost.get(word[start:end])
            if cost is not None:
                found.append((ways[start][0] + cost, ways[start][1] + 1))
        if word[end - 1] not in vocabulary.cost:
            found.append((ways[end - 1][0] + vocabulary.unknown_cost, ways[end - 1][1] + len(word[end - 1].encode())))
        ways.append(min(found))
    return ways[-1][1]


def test_trie_counts_are_the_plain_counts(samples, vocabulary):
    counter = token_counts.TrieCounter(vocabulary)
    tokens, parts = counter.count(samples)
    for text, n, k in zip(samples[::5], tokens[::5], parts[::5]):
        words = pieces.pre_tokens(text)
        assert "".join(words) == pieces.BLANK + text.replace(" ", pieces.BLANK)
        assert (n, k) == (sum(_plain_count(w, vocabulary) for w in words), len(words))


def test_queries_over_the_table(spark, texts, vocabulary):
    counted = {r.doc_id: r for r in queries.QUERIES["op5_token_counts"](spark, SMALL).collect()}
    encoded = {r.doc_id: r for r in queries.QUERIES["op9_nbest_pieces"](spark, SMALL).collect()}
    assert set(counted) == set(encoded) == set(texts)
    counter = token_counts.TrieCounter(vocabulary)
    for i, text in texts.items():
        assert counted[i].n_tokens == counter.count([text])[0][0] and counted[i].n_bytes == len(text.encode())
        # Of equal costs the count takes the fewest, the encoding any.
        assert counted[i].n_tokens <= encoded[i].n_pieces
        assert encoded[i].decoded and encoded[i].n_best == 3 and encoded[i].best_score >= encoded[i].last_score


def test_awkward_rows(awkward, empty):
    rows = token_counts.count_tokens(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    encoded = nbest.encoding_report(awkward).collect()
    assert len(encoded) == len(AWKWARD) and all(r.decoded for r in encoded)
    assert {(r.n_pieces, r.n_best, r.best_score) for r in encoded if r.doc_id in (1, 2)} == {(0, 1, 0.0)}
    assert token_counts.count_tokens(empty).collect() == [] and nbest.encoding_report(empty).collect() == []
    full = nbest.encode_documents(awkward.filter("doc_id = 9"), 2)
    best = full.selectExpr("doc_id", "encodings[0].ids as ids")
    assert [r.text for r in nbest.decode_documents(best).collect()] == [AWKWARD[-1][1]]


def test_totals_by_group(table):
    docs = table([(1, "one two", "en"), (2, None, "en"), (3, "drei", "de")])
    got = {r.lang: (r.n_docs, r.n_bytes) for r in token_counts.corpus_tokens(docs, "lang").collect()}
    assert got == {"en": (2, 7), "de": (1, 4)}


def test_kept_words_are_not_searched_for_cycles():
    coder, found = nbest.NBestCoder(pieces.vocabulary()), []
    told = lambda phase, info: found.append(phase)
    gc.callbacks.append(told)
    try:
        coder.encode([" ".join(f"{n}word{n}" for n in range(k, k + 5_000)) for k in range(0, 20_000, 5_000)])
    finally:
        gc.callbacks.remove(told)
    assert not found and gc.isenabled()
