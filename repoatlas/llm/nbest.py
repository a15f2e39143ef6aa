"""N-best SentencePiece encoding, and decoding.

A forward Viterbi pass over the lattice of pieces gives the cost of the best way
from the beginning to every place. From the end, A-star search goes backward
with that cost as its heuristic; being exact, the search completes the
segmentations in order of their cost.
"""

import gc
import heapq
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from repoatlas.llm.pieces import BLANK, UNIT, Vocabulary, pre_tokens, vocabulary
from repoatlas.llm.tasks import map_texts

N_BEST = 3
# Pre-tokens kept with their best encoding per Python worker, and the longest kept.
CACHED_WORDS = 600_000
CACHED_CHARS = 48

# More than any way costs.
ENDLESS = 1 << 60

Path = tuple[int, list[str]]


def _arcs(word: str, end: int, pieces: Vocabulary) -> list[tuple[int, int]]:
    """(start, cost) of the pieces of ``word`` that end at ``end``."""
    cost_of = pieces.cost
    found = []
    for start in range(max(0, end - pieces.longest), end):
        cost = cost_of.get(word[start:end])
        if cost is not None:
            found.append((start, cost))
    if word[end - 1] not in cost_of:
        found.append((end - 1, pieces.unknown_cost))
    return found


def forward_all(words: Iterable[str], pieces: Vocabulary) -> Iterator[tuple[str, list[int], list[int], int | None]]:
    """Viterbi over each word, in sorted order: see ``forward``.

    What holds for the beginning of a word holds for the next word that shares
    it, so it is kept. The lists are good until the next word.
    """
    roots, unknown = pieces.tree, pieces.unknown_cost
    cost, back = [0], [0]
    # Cost of the second best way to every place; none is as good as endless.
    second = [ENDLESS]
    # Places from where a piece may still reach beyond, each with the node of the tree it came to.
    open_at: list[list[tuple[int, dict]]] = [[]]
    last = ""
    for word in sorted(words):
        shared = 0
        for a, b in zip(word, last):
            if a != b:
                break
            shared += 1
        for held in (cost, back, second, open_at):
            del held[shared + 1 :]
        came = shared
        for letter in word[shared:]:
            single = roots.get(letter)
            # A character of no piece is its bytes.
            own = unknown if single is None or single[1] is None else single[1]
            start = came
            best, runner = cost[came] + own, second[came] + own
            still = []
            for begin, node in open_at[came]:
                step = node.get(letter)
                if step is None:
                    continue
                node, own = step
                if node:
                    still.append((begin, node))
                if own is None:
                    continue
                found = cost[begin] + own
                if found < best:
                    best, runner, start = found, best, begin
                elif found < runner:
                    runner = found
                found = second[begin] + own
                if found < runner:
                    runner = found
            if single is not None and single[0]:
                still.append((came, single[0]))
            cost.append(best)
            back.append(start)
            second.append(runner)
            open_at.append(still)
            came += 1
        yield word, cost, back, None if second[-1] >= ENDLESS else second[-1]
        last = word


def forward(word: str, pieces: Vocabulary) -> tuple[list[int], list[int], int | None]:
    """Viterbi: cost to every place, start of the best piece there, and what the second best way costs."""
    return next(forward_all([word], pieces))[1:]


def best_pieces(word: str, back: list[int]) -> list[str]:
    found, end = [], len(word)
    while end:
        found.append(word[back[end] : end])
        end = back[end]
    return found[::-1]


def search(word: str, n: int, pieces: Vocabulary, cost: list[int] | None = None) -> list[Path]:
    """The ``n`` segmentations of least cost, as (cost, pieces), best first.

    A place need not be left more than ``n`` times, so the work is bounded by
    ``n`` times the lattice, also where many segmentations tie.
    """
    if not word:
        return [(0, [])]
    cost = cost or forward(word, pieces)[0]
    found: list[Path] = []
    taken = [0] * (len(word) + 1)
    # Of equal costs, what is nearest to the beginning first.
    agenda = [(cost[-1], len(word), 0, 0, None)]
    order = 0
    while agenda and len(found) < n:
        total, place, _, behind, chain = heapq.heappop(agenda)
        if place == 0:
            names = []
            while chain is not None:
                names.append(chain[0])
                chain = chain[1]
            found.append((total, names))
            continue
        taken[place] += 1
        if taken[place] > n:
            continue
        for start, own in _arcs(word, place, pieces):
            order += 1
            heapq.heappush(
                agenda, (cost[start] + own + behind, start, order, own + behind, (word[start:place], chain))
            )
    return found


class NBestCoder:
    """Encodes texts; each distinct pre-token's best way is kept, and what its second costs more."""

    def __init__(self, pieces: Vocabulary):
        self.pieces = pieces
        self.known: dict[str, tuple[bytes, int, int]] = {}

    def split(self, texts: list[str | None]) -> tuple[list[list[str]], dict[str, tuple[bytes, int, int]]]:
        """The pre-tokens of each text, and the entries of those not kept."""
        split = [pre_tokens(t) if t else [] for t in texts]
        if len(self.known) > CACHED_WORDS:
            # Common words came first.
            self.known = dict(islice(self.known.items(), CACHED_WORDS // 2))
        once = {}
        missing = set().union(*split).difference(self.known)
        for word, cost, back, second in forward_all(missing, self.pieces):
            entry = self._best_ids(word, back), cost[-1], ENDLESS if second is None else second - cost[-1]
            (self.known if len(word) <= CACHED_CHARS else once)[word] = entry
        return split, once

    def encode(self, texts: list[str | None], n: int = N_BEST) -> list[list[tuple[int, bytes]]]:
        """(cost, ids) of the ``n`` best encodings of each text, best first.

        Pre-tokens are independent. Only the n - 1 whose second best way costs
        least more can differ from their best in any of the n best encodings:
        a change of another could be replaced by one of theirs. Those few are
        searched, and their ways are combined, least cost first.
        """
        collects = gc.isenabled()
        # Nothing here refers to itself; searching hundreds of thousands of kept entries for that is dear.
        gc.disable()
        try:
            split, once = self.split(texts)
            self.known.update(once)
            found = [self._encode(words, n) for words in split]
            for word in once:
                del self.known[word]
        finally:
            if collects:
                gc.enable()
        return found

    def _encode(self, words: list[str], n: int) -> list[tuple[int, bytes]]:
        if not words:
            return [(0, b"")]
        raw, costs, more = map(list, zip(*map(self.known.__getitem__, words)))
        base = sum(costs)
        changes = []
        for _ in range(min(n - 1, len(words))):
            least = min(more)
            if least >= ENDLESS:
                break
            # Of equal ones the first.
            changes.append(more.index(least))
            more[changes[-1]] = ENDLESS
        ways = [(0, ())]
        for place in changes:
            own = search(words[place], n, self.pieces)
            # Of several best ways the search may have come by another first.
            raw[place] = self._ids(own[0][1])
            ways = heapq.nsmallest(
                n,
                (
                    (cost + way - own[0][0], (*chosen, (place, names)) if k else chosen)
                    for cost, chosen in ways
                    for k, (way, names) in enumerate(own)
                ),
                key=lambda w: w[0],
            )
        whole = b"".join(raw)
        # Other ways are the whole with the bytes of a few pre-tokens exchanged.
        changed = {place for _, chosen in ways for place, _ in chosen}
        begins = {place: sum(map(len, raw[:place])) for place in changed}
        found = []
        for more, chosen in ways:
            parts, last = [], 0
            for place, names in sorted(chosen):
                parts += whole[last : begins[place]], self._ids(names)
                last = begins[place] + len(raw[place])
            found.append((base + more, b"".join([*parts, whole[last:]])))
        return found

    def _best_ids(self, word: str, back: list[int]) -> bytes:
        """The ids of ``best_pieces``."""
        number, found, end = self.pieces.ids.get, [], len(word)
        while end:
            start = back[end]
            found.append(number(word[start:end]))
            end = start
        if None in found:
            return self._ids(best_pieces(word, back))
        found.reverse()
        return array("I", found).tobytes()

    def _ids(self, names: list[str]) -> bytes:
        return array("I", [i for p in names for i in self.pieces.encode_piece(p)]).tobytes()

    def decode(self, ids: bytes) -> str:
        """The text of an encoding: pieces and bytes joined, marks made blanks, the first dropped."""
        raw = b"".join(map(self.pieces.texts.__getitem__, array("I", ids)))
        text = raw.decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


_coders: dict[str | None, NBestCoder] = {}


def coder(path: str | None = None) -> NBestCoder:
    """The worker's coder for the pieces at ``path``."""
    if path not in _coders:
        _coders[path] = NBestCoder(vocabulary(path))
    return _coders[path]


ENCODING = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("ids", T.BinaryType())])


def encode_documents(
    docs: DataFrame, n: int = N_BEST, pieces_path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The id and ``encodings`` per document: (``score``, ``ids``) of the ``n`` best, best first.

    ``score`` is a log probability, ``ids`` are native unsigned 32-bit numbers.
    A null or empty text has one encoding, of no ids; a text may have fewer
    than ``n``.
    """

    def start():
        own = coder(pieces_path)
        return lambda texts: (
            [[{"score": -c / UNIT + 0.0, "ids": ids} for c, ids in found] for found in own.encode(texts, n)],
        )

    return map_texts(docs, [("encodings", T.ArrayType(ENCODING))], start, (id_col,), text_col)


def decode_documents(
    encoded: DataFrame, pieces_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """The id and ``text`` of each row's ``ids``; null ids decode to null."""

    def start():
        own = coder(pieces_path)
        return lambda rows: ([None if ids is None else own.decode(ids) for ids in rows],)

    return map_texts(encoded, [("text", T.StringType())], start, (id_col,), ids_col)


def encoding_report(
    docs: DataFrame, n: int = N_BEST, pieces_path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """What the encodings of each document are like, and whether they decode to it.

    Columns: the id, ``n_pieces`` and ``ids_crc32`` of the best, ``n_best``
    found, ``best_score``, ``last_score``, and ``decoded`` (all encodings give
    the text back, its own marks for blanks being blanks). Repeated rows have a
    row each; an empty table gives an empty one; other columns are not read.
    """
    fields = [
        ("n_pieces", T.LongType()),
        ("ids_crc32", T.LongType()),
        ("n_best", T.IntegerType()),
        ("best_score", T.DoubleType()),
        ("last_score", T.DoubleType()),
        ("decoded", T.BooleanType()),
    ]

    def start():
        own = coder(pieces_path)

        def work(texts):
            rows = []
            for text, found in zip(texts, own.encode(texts, n)):
                plain = (text or "").replace(BLANK, " ")
                rows.append(
                    (
                        len(found[0][1]) // 4,
                        zlib.crc32(found[0][1]),
                        len(found),
                        -found[0][0] / UNIT + 0.0,
                        -found[-1][0] / UNIT + 0.0,
                        all(own.decode(ids) == plain for _, ids in found),
                    )
                )
            return tuple(map(list, zip(*rows)))

        return work

    return map_texts(docs, fields, start, (id_col,), text_col)
