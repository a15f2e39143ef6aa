"""Alignment of two tokenizers' ids over a corpus.

Both tokenizers cut the same bytes. Where a token of A and a token of B end
together a group of each ends, and these two tokens are linked. Most groups have
one token of each side, which then have the same bytes: an array from each A id
to the B id of its bytes, made once of the vocabularies, names that link, and it
is counted in a vector as long as A's vocabulary. Only the links of other groups
are counted as pairs of ids and shuffled.

Linked tokens end together, so one's bytes are an ending of the other's. All
tokens have no more endings than bytes, and so the table of links is bounded by
the vocabularies and not by the corpus: it is sent to every task.

Neither tokenizer has a token that begins before a single blank or line break
between other text and ends behind it, so texts are cut there, and each distinct
part is encoded once while it is kept. New parts are encoded together, as one text, and aligned in arrays.
"""

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from repoatlas.llm.tasks import slices
from repoatlas.session import ship_package, written

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
# Parts kept with their groups per Python worker, and the longest that is kept.
KNOWN_PARTS = 150_000
KNOWN_CHARS = 48
# New parts of up to so many characters are encoded as one text.
JOINED_CHARS = 24_000
# Marks that a word and its text are cut at, where both tokenizers do.
MARKS = ".,;:!?"
# Different pairs of irregular groups that a task holds before it passes them on.
HELD_PAIRS = 250_000
# Texts of no more bytes than this are split into parts at a time.
SPLIT_BYTES = 1_000_000

# Between other text, a single blank or line break begins a part.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
# White space that is not alone.
_ODD = re.compile(r"[ \n](?!\S)|[^\S\n ]\n")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_aligners: dict[tuple[str, str], "Aligner"] = {}


def parts_of(text: str) -> list[str]:
    """``text`` with a blank before it, cut before blanks and line breaks that stand alone."""
    text = " " + text
    if _ODD.search(text) is None:
        return [p if p[0] == "\n" else " " + p for p in text.replace("\n", " \n").split(" ")[1:]]
    return _CUT.split(text)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


# What a part of a text adds: the numbers of its tokens, its groups as text, and
# its links' codes as little-endian 32-bit numbers. Nothing if the tokens of
# either side do not give the part back.
Part = tuple[int, int, str, bytes] | None


class Aligner:
    """Both vocabularies, the identity array, and the parts aligned before."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        names = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, number in names.items():
            if all(c in alphabet for c in name):
                self.a_bytes[number] = bytes(alphabet[c] for c in name)
        self.fast_a = _ranked(path_a, alphabet)
        self.b_bytes = []
        by_bytes: dict[bytes, int] = {}
        for number in range(self.b.get_piece_size()):
            name = self.b.id_to_piece(number)
            byte = _BYTE.fullmatch(name)
            raw = bytes([int(byte[1], 16)]) if byte else name.replace("▁", " ").encode()
            self.b_bytes.append(raw)
            # Of ids with the same bytes, pieces come before single bytes.
            if not byte or raw not in by_bytes:
                by_bytes[raw] = number
        self.same = np.array([by_bytes.get(raw, -1) for raw in self.a_bytes], np.int64)
        self.a_sizes, self.b_sizes = (np.array([len(r) for r in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.width = len(self.b_bytes)
        if len(self.a_bytes) * self.width >= 1 << 31:
            raise ValueError("pairs of ids do not fit 32 bits")
        self.a_names, self.b_names = (list(map(str, range(len(x)))) for x in (self.a_bytes, self.b_bytes))
        # A cuts between a letter and these marks; B does if no piece has both.
        crossed = {m for n in map(self.b.id_to_piece, range(self.width)) for c, m in zip(n, n[1:]) if c.isalpha()}
        self.marks = "".join(m for m in MARKS if m not in crossed)
        self.known: dict[str, Part] = {}

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """Both sides' ids of ``text``, which begins with a blank or line break."""
        if self.fast_a is not None and len(text) <= JOINED_CHARS:
            a = self.fast_a.encode_ordinary(text)
        else:
            a = self.a.encode(text, add_special_tokens=False).ids
        # B puts a blank before its text; before a line break it is a piece of its own.
        if text[0] == " ":
            return a, self.b.encode(text[1:], num_threads=1)
        return a, self.b.encode(text, num_threads=1)[1:]

    def align(self, parts: list[str]) -> list[Part]:
        """The parts; several are encoded as one text, in which each is cut as it would be alone."""
        text = "".join(parts)
        a_ids, b_ids = self.ids(text)
        raw = text.encode()
        if b"".join([self.a_bytes[i] for i in a_ids]) != raw or b"".join([self.b_bytes[i] for i in b_ids]) != raw:
            if len(parts) == 1:
                return [None]
            return [x for p in parts for x in self.align([p])]
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        last_a, last_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        one_a, one_b = a[last_a], b[last_b]
        codes = (one_a * self.width + one_b).astype("<i4").tobytes()
        a_names, b_names = self.a_names, self.b_names
        told = [f"{a_names[x]}|{b_names[y]}" for x, y in zip(one_a.tolist(), one_b.tolist())]
        several = (np.diff(last_a, prepend=-1) > 1) | (np.diff(last_b, prepend=-1) > 1)
        for k in np.flatnonzero(several).tolist():
            from_a, from_b = (last_a[k - 1] + 1, last_b[k - 1] + 1) if k else (0, 0)
            own_a, own_b = a_ids[from_a : last_a[k] + 1], b_ids[from_b : last_b[k] + 1]
            told[k] = f"{','.join([a_names[x] for x in own_a])}|{','.join([b_names[x] for x in own_b])}"
        # Parts end where both sides' tokens do.
        at = np.searchsorted(ends, np.cumsum([len(p.encode()) for p in parts]))
        stops = (at + 1).tolist()
        n_a, n_b = (np.diff(last[at] + 1, prepend=0).tolist() for last in (last_a, last_b))
        return [
            (x, y, ";".join(told[start:stop]), codes[4 * start : 4 * stop])
            for x, y, start, stop in zip(n_a, n_b, [0, *stops[:-1]], stops)
        ]

    def learn(self, split: list[list[str]]) -> dict[str, Part]:
        """Every different part of the split texts, aligned."""
        if len(self.known) > KNOWN_PARTS:
            # Common parts came first.
            self.known = dict(islice(self.known.items(), KNOWN_PARTS // 2))
        different = set().union(*split)
        known, once = self.known, {}
        missing = different.difference(known)
        # White space at an end would meet the next part's blank, so such parts come alone.
        plain = [p for p in missing if len(p) <= KNOWN_CHARS and p.split() == [p[1:]]]
        alone = [[p] for p in missing.difference(plain)]
        # Words with marks behind them are put together of both.
        heads = {p: p.rstrip(self.marks) for p in plain} if self.marks else {}
        ends = {p: p[len(h) :] for p, h in heads.items() if len(h) < len(p) and h[-1].isalpha()}
        words = list({heads[p] if p in ends else p for p in plain}.difference(known))
        together = JOINED_CHARS // KNOWN_CHARS
        for parts in [*alone, *(words[k : k + together] for k in range(0, len(words), together))]:
            for part, found in zip(parts, self.align(parts)):
                (known if len(part) <= KNOWN_CHARS else once)[part] = found
        tails = {t: self.align([" a", t])[1] for t in set(ends.values())}
        for part, tail in ends.items():
            head, more = known[heads[part]], tails[tail]
            known[part] = (
                (head[0] + more[0], head[1] + more[1], f"{head[2]};{more[2]}", head[3] + more[3]) if head and more else None
            )
        return {p: known[p] if p in known else once[p] for p in different}


def _ranked(path: str, alphabet: dict[str, int]) -> tiktoken.Encoding | None:
    """The same byte-level vocabulary as ranks, if its ids are in the order of its merges.

    It gives the ids of :meth:`Tokenizer.encode` in a fraction of the time.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    singles = {model["vocab"][c] for c in alphabet}
    if made != list(range(256, 256 + len(merges))) or singles != set(range(256)):
        return None
    ranks = {bytes(alphabet[c] for c in name): number for name, number in model["vocab"].items() if number < 256 + len(merges)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def aligner(path_a: str | None = None, path_b: str | None = None) -> Aligner:
    """The worker's aligner of two tokenizer files."""
    key = (path_a or public_tokenizers.path(BYTE_BPE), path_b or public_tokenizers.path(PIECES))
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


TOLD = "n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
COUNTED = "a_id int, b_id int, n long, regular boolean"


def aligned_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None
) -> DataFrame:
    """Two kinds of rows: what each document has, and how often each task met each link.

    The first have the codes of their ``links``; those of the second kind have no
    ``n_a``. Texts are encoded in this step alone, so write its result.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(id_col, text_col)
    schema = T.StructType([rows.schema[0], *T.StructType.fromDDL(f"{TOLD}, {COUNTED}").fields])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def batch_of(columns: dict[int, pa.Array | list], size: int) -> pa.RecordBatch:
        full = [
            pa.array(columns[k], kind) if k in columns and not isinstance(columns[k], pa.Array) else columns.get(k, pa.nulls(size, kind))
            for k, kind in enumerate(kinds)
        ]
        return pa.RecordBatch.from_arrays(full, names=schema.names)

    def counted(own: Aligner, codes: np.ndarray, n: np.ndarray, regular: bool) -> pa.RecordBatch:
        return batch_of({6: codes // own.width, 7: codes % own.width, 8: n, 9: np.full(len(codes), regular)}, len(codes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        vector = np.zeros(len(own.same), np.int64)
        pairs: Counter[int] = Counter()
        for batch in batches:
            for part in slices(batch, 1, SPLIT_BYTES):
                split = [parts_of(t) if t else [] for t in part.column(1).to_pylist()]
                known = own.learn(split)
                n_a, n_b, told, links = [], [], [], []
                for ps in split:
                    found = [known[p] for p in ps]
                    if not found or None in found:
                        found = []
                    n_a.append(sum([f[0] for f in found]))
                    n_b.append(sum([f[1] for f in found]))
                    text = ";".join([f[2] for f in found])
                    told.append(hashlib.sha256(text.encode()).hexdigest() if found else "")
                    links.append(b"".join([f[3] for f in found]))
                yield batch_of({0: part.column(0), 1: n_a, 2: n_b, 3: [len(x) // 4 for x in links], 4: told, 5: links}, len(split))
                codes = np.frombuffer(b"".join(links), "<i4").astype(np.int64)
                a = codes // own.width
                # Tokens of the same bytes that end together begin together: a one-to-one group.
                regular = own.same[a] == codes % own.width
                vector += np.bincount(a[regular], minlength=len(vector))
                for link, times in zip(*(x.tolist() for x in np.unique(codes[~regular], return_counts=True))):
                    pairs[link] += times
                if len(pairs) > HELD_PAIRS:
                    yield counted(own, np.array(list(pairs)), np.array(list(pairs.values())), False)
                    pairs.clear()
        ids = np.flatnonzero(vector)
        yield counted(own, ids * own.width + own.same[ids], vector[ids], True)
        if pairs:
            yield counted(own, np.array(list(pairs)), np.array(list(pairs.values())), False)

    return rows.mapInArrow(run, schema)


def link_counts(aligned: DataFrame) -> DataFrame:
    """``a_id``, ``b_id`` and ``n``: how often each pair of ids is linked in all texts."""
    found = aligned.filter("a_id is not null")
    # One entry per id of A and task, so the vectors are summed by A's id alone.
    vectors = found.filter("regular").groupBy("a_id").agg(F.first("b_id").alias("b_id"), F.sum("n").alias("n"))
    pairs = found.filter("not regular").groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))
    return vectors.unionByName(pairs)


def alignment_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None
) -> DataFrame:
    """A row per document: its id, counts of tokens, groups and links, and the digest of its groups.

    ``n_best`` counts the links that are the commonest of their B id in the
    corpus, ties included, ``count_sum`` adds up how often the document's links
    stand in the corpus. A text that is null or empty, or that the tokens of
    either side do not give back byte by byte, has none: zeros, and no digest.
    Long texts are cut at blanks only, never shortened. Repeated rows count and
    are told one by one; an empty table gives an empty one; other columns are
    not read.
    """
    aligned = written(aligned_rows(docs, id_col, text_col, path_a, path_b))
    width = aligner(path_a, path_b).width
    table = link_counts(aligned).toArrow()
    a, b, n = (table.column(c).to_numpy().astype(np.int64) for c in ("a_id", "b_id", "n"))
    best = np.zeros(width, np.int64)
    np.maximum.at(best, b, n)
    order = np.argsort(a * width + b)
    # Bounded by the vocabularies.
    shipped = docs.sparkSession.sparkContext.broadcast(((a * width + b)[order], n[order], (n == best[b])[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, is_best = shipped.value
        for batch in batches:
            links = batch.column("links").to_pylist()
            at = np.searchsorted(keys, np.frombuffer(b"".join(links), "<i4"))
            ends = np.cumsum([len(x) // 4 for x in links])
            sums = []
            for values in (is_best[at], times[at]):
                total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
                sums.append(np.diff(total[ends], prepend=0))
            groups = batch.column("n_groups")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], groups, *map(pa.array, sums), batch.column("groups_sha256")], names=names
            )

    made = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    schema = T.StructType([aligned.schema[0], *T.StructType.fromDDL(made).fields])
    names = schema.names
    rows = aligned.filter("n_a is not null").select(id_col, "n_a", "n_b", "n_groups", "groups_sha256", "links")
    return rows.mapInArrow(run, schema)
