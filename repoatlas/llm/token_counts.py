"""Token counts by dynamic programming over a trie of pre-tokens.

The best segmentation of the first i characters of a word depends on those
characters alone, so words with a common prefix share it. The distinct
pre-tokens of a slice of texts are walked in order, as the paths of a trie;
each node holds its forward score and token count once, and the counts at the
ends are kept for the texts that come.
"""

from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoatlas.llm.pieces import Vocabulary, pre_tokens, vocabulary
from repoatlas.llm.tasks import map_texts

# Pre-tokens kept with their counts per Python worker, and the longest kept.
CACHED_WORDS = 1_000_000
CACHED_CHARS = 48


class TrieCounter:
    """Counts of the unigram segmentation with the best score, and of those the fewest tokens."""

    def __init__(self, pieces: Vocabulary):
        self.pieces = pieces
        self.known: dict[str, int] = {}

    def terminal_counts(self, words: list[str]) -> dict[str, int]:
        """The token count of each distinct word.

        ``cost`` and ``count`` hold the nodes on the path from the root to the
        current word; in sorted order a node is left only when no later word
        has it.
        """
        cost_of, longest, unknown = self.pieces.cost, self.pieces.longest, self.pieces.unknown_cost
        cost, count, last = [0], [0], ""
        ends: dict[str, int] = {}
        for word in sorted(words):
            shared = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                shared += 1
            del cost[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                # A character of no piece is its bytes.
                single = word[end - 1]
                own = cost_of.get(single)
                if own is None:
                    best = (cost[end - 1] + unknown, count[end - 1] + len(single.encode()))
                else:
                    best = (cost[end - 1] + own, count[end - 1] + 1)
                for start in range(max(0, end - longest), end - 1):
                    own = cost_of.get(word[start:end])
                    if own is not None:
                        found = cost[start] + own
                        if found <= best[0] and (found, count[start] + 1) < best:
                            best = (found, count[start] + 1)
                cost.append(best[0])
                count.append(best[1])
            ends[word] = count[len(word)]
            last = word
        return ends

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Tokens and pre-tokens of each text."""
        split = [pre_tokens(t) if t else [] for t in texts]
        if len(self.known) > CACHED_WORDS:
            # Common words came first.
            self.known = dict(islice(self.known.items(), CACHED_WORDS // 2))
        missing = set().union(*split) - self.known.keys() if split else set()
        new = self.terminal_counts(list(missing))
        self.known.update((w, n) for w, n in new.items() if len(w) <= CACHED_CHARS)
        known = self.known
        if all(len(w) <= CACHED_CHARS for w in new):
            return [sum([known[w] for w in words]) for words in split], list(map(len, split))
        return [sum([known[w] if w in known else new[w] for w in words]) for words in split], list(map(len, split))


_counters: dict[str | None, TrieCounter] = {}


def counter(path: str | None = None) -> TrieCounter:
    """The worker's counter for the pieces at ``path``."""
    if path not in _counters:
        _counters[path] = TrieCounter(vocabulary(path))
    return _counters[path]


def count_tokens(
    docs: DataFrame, pieces_path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The id, ``n_tokens``, ``n_pretokens`` and ``n_bytes`` per document.

    Null and empty texts have no tokens. Repeated rows and null ids have a row
    each; an empty table gives an empty one; other columns are not read.
    """
    fields = [("n_tokens", T.LongType()), ("n_pretokens", T.LongType()), ("n_bytes", T.LongType())]

    def start():
        own = counter(pieces_path)
        return lambda texts: (*own.count(texts), [len((t or "").encode()) for t in texts])

    return map_texts(docs, fields, start, (id_col,), text_col)


def corpus_tokens(docs: DataFrame, by: str, pieces_path: str | None = None, text_col: str = "text") -> DataFrame:
    """Documents, tokens and bytes per value of column ``by``."""
    counted = count_tokens(docs, pieces_path, by, text_col)
    return counted.groupBy(by).agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_bytes").alias("n_bytes")
    )
