"""A vocabulary of text pieces with a log probability each.

The file is a public SentencePiece model; only its list of pieces is used. Its
scores are ranks, so a piece's probability is set by Zipf's law: in proportion
to 1 / (rank + ``ZIPF_OFFSET``). Log probabilities are whole micro-units, so
that sums are exact and ties are ties.
"""

import re
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import sentencepiece

PIECES = "piece_bpe_32k.model"
# The mark that stands for a blank in pieces.
BLANK = "▁"
ZIPF_OFFSET = 2.7
UNIT = 1_000_000
# Fixed value: what a character of no piece costs beyond the rarest piece.
UNKNOWN_PENALTY = 10 * UNIT
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Vocabulary:
    """``cost`` (micro-units, positive) and ``ids`` of each piece; bytes stand for unknown characters."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_ids = [0] * 256
        self.ids: dict[str, int] = {}
        for number, name in enumerate(names):
            byte = _BYTE.fullmatch(name)
            if byte:
                self.byte_ids[int(byte[1], 16)] = number
            elif not model.is_control(number) and not model.is_unknown(number):
                self.ids[name] = number
        ranks = {name: -model.get_score(number) for name, number in self.ids.items()}
        norm = sum(1 / (r + ZIPF_OFFSET) for r in ranks.values())
        self.cost = {n: round(UNIT * float(np.log((r + ZIPF_OFFSET) * norm))) for n, r in ranks.items()}
        self.unknown_cost = max(self.cost.values()) + UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids))
        # Cost of every beginning of a piece; those that are no piece have none.
        self.begins: dict[str, int | None] = {n[:k]: None for n in self.cost for k in range(1, len(n))}
        self.begins |= self.cost
        # Text is cut before blanks, which is exact as no piece has one inside.
        if any(BLANK in name.lstrip(BLANK) for name in names):
            raise ValueError("a piece crosses the beginning of a word")
        # What each id decodes to; ids that stand for no text give none.
        self.texts = [
            bytes([int(b[1], 16)]) if (b := _BYTE.fullmatch(n)) else n.encode() if n in self.ids else b""
            for n in names
        ]

    @cached_property
    def tree(self) -> dict[str, tuple[dict, int | None]]:
        """``begins`` per letter: the node beyond it, and the cost of the piece that ends there."""
        nodes = {"": {}}
        for name in sorted(self.begins):
            nodes[name] = {}
            nodes[name[:-1]][name[-1]] = nodes[name], self.begins[name]
        return nodes[""]

    def encode_piece(self, piece: str) -> list[int]:
        """The id of a piece, or its bytes' ids if it is an unknown character."""
        number = self.ids.get(piece)
        return [number] if number is not None else [self.byte_ids[b] for b in piece.encode()]


@lru_cache(maxsize=4)
def vocabulary(path: str | None = None) -> Vocabulary:
    return Vocabulary(path or public_tokenizers.path(PIECES))


_PRE_TOKEN = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")


def pre_tokens(text: str) -> list[str]:
    """The parts that no piece crosses: words with the blanks before them, and line breaks.

    As in the vocabulary, a blank is put before the text and blanks are marked.
    An empty text has none.
    """
    return _PRE_TOKEN.findall(BLANK + text.replace(" ", BLANK)) if text else []
