"""Token ids of whole texts by a word-splitting public tokenizer."""

import os
import re
from itertools import islice

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
# Words kept with their ids per Python worker, and the longest that is kept.
CACHED_WORDS = 500_000
CACHED_CHARS = 48

# White space as the tokenizer's rules have it. str.split() also cuts at the
# four separators below, which are no white space there.
_CHUNK = re.compile("[^\t-\r \x85\xa0  -     　]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_MARKS = ".,;:!?"

_coders: dict[str, "WordCoder"] = {}


def chunks(text: str) -> list[str]:
    if any(s in text for s in _SEPARATORS):
        return _CHUNK.findall(text)
    return text.split()


def lowered(text: str) -> str:
    """Texts of Latin-1 letters in lower case, as the tokenizer makes them.

    Its special tokens keep their case, and other letters have rules of their own.
    """
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class WordCoder:
    """Ids of texts, each distinct word being encoded once while it is kept.

    The tokenizer splits at white space and drops it, so the ids of a text are
    those of its words one after the other. It lower-cases, and it splits
    between a letter and a mark after it; words share ids by that too.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        split = [chunks(lowered(t)) for t in texts]
        if len(self.known) > CACHED_WORDS:
            # Common words came first.
            self.known = dict(islice(self.known.items(), CACHED_WORDS // 2))
        once: dict[str, bytes] = {}
        missing = set().union(*split) - self.known.keys() if split else set()
        parts = {w: self._parts(w) for w in missing}
        new = list({p for ps in parts.values() for p in ps} - self.known.keys())
        for part, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            raw = np.array(found.ids, "<u4").tobytes()
            (self.known if len(part) <= CACHED_CHARS else once)[part] = raw
        for word, ps in parts.items():
            raw = b"".join([self.known[p] if p in self.known else once[p] for p in ps])
            (self.known if len(word) <= CACHED_CHARS else once)[word] = raw
        known = self.known
        if not once:
            return [b"".join([known[w] for w in words]) for words in split]
        return [b"".join([known[w] if w in known else once[w] for w in words]) for words in split]

    @staticmethod
    def _parts(word: str) -> tuple[str, ...]:
        if not word.isascii() or "<|" in word:
            return (word,)
        head = word.rstrip(_MARKS)
        if head and len(head) < len(word) and head[-1].isalpha():
            return head.lower(), word[len(head) :]
        return (word.lower(),)


def coder(path: str | None = None) -> WordCoder:
    """The worker's coder for the tokenizer file at ``path``."""
    path = path or public_tokenizers.path(WORD_BPE)
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]
