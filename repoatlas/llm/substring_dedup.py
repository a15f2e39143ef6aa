"""Repeated passages, found by relative Lempel-Ziv parsing.

A document is parsed into factors, stretches that also stand in an earlier
place, its reference. Texts are long and the corpus has many, so references are
met by anchors: of each window of ``WINDOW`` words the run of ``ANCHOR`` words
with the smallest hash. Equal windows have the same anchor at the same place, so
an index of all anchors, whose blocks are the partitions of a shuffle, holds
every possible reference, and a document asks just the blocks that can know it.

The index names an earlier place of each anchor and the phrase there, the words
up to the end of the next anchor. A document's phrases that continue one and the
same reference make a factor, however long, and all windows in it are repeats.
Greedy parsing breaks at the ends of copies, and where an anchor's earlier place
is elsewhere. There, and only there, windows are checked one by one: those with
a repeated anchor that lie in no factor are grouped by their 128-bit hash. The
first place of any window is in no factor, so each group has its first place.

Texts that are handed over together know each other's anchors, and only the
first of each goes to the index. So an anchor of every document, as often as it
stands, brings the index no more rows than there are such slices of texts.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoatlas.llm.tasks import slices, text_of
from repoatlas.session import ship_package, written

WINDOW = 20
ANCHOR = 8

# Odd factors of the two rolling hashes.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, np.ndarray] = {}
# Words kept with their hashes per Python worker, and the longest that is kept.
KNOWN_WORDS = 300_000
KNOWN_BYTES = 64
_UPPER = np.uint64(0xFFFFFFFF00000000)
_LOWER = np.uint64(0xFFFFFFFF)


class _Hashes(dict):
    """128-bit hashes of words; those of short words are kept."""

    def __missing__(self, word: bytes) -> bytes:
        found = xxhash.xxh3_128_digest(word)
        if len(word) <= KNOWN_BYTES:
            self[word] = found
        return found


_hashes = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    """The words, runs without the six characters that ``bytes.split`` cuts at."""
    return text.encode().split() if text else []


def _power(factor: int, count: int) -> np.ndarray:
    """The first powers of an odd factor, modulo 2**64."""
    if len(_powers.get(factor, ())) < count:
        steps = np.full(2 * count, factor, np.uint64)
        steps[0] = 1
        _powers[factor] = np.cumprod(steps, dtype=np.uint64)
    return _powers[factor][:count]


class Parsed:
    """The words of several texts in a row, with their windows and anchors.

    ``begins`` has the place of each text's first word and, last, the number of
    words; ``text_of`` the text of each word. ``starts`` has the windows' places,
    ``picks`` the place of each one's anchor, ``anchors`` the different places
    among those.
    """

    def __init__(self, texts: list[str | None], window: int, anchor: int):
        split = [words_of(t) for t in texts]
        lengths = [len(w) for w in split]
        self.begins = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        count = int(self.begins[-1])
        if len(_hashes) > KNOWN_WORDS:
            _hashes.clear()
        raw = b"".join([b"".join(map(_hashes.__getitem__, ws)) for ws in split])
        hashes = np.frombuffer(raw, "<u8").reshape(-1, 2)
        self.sums = []
        for which, factor in enumerate(_FACTORS):
            sums = np.zeros(count + 1, np.uint64)
            np.cumsum(hashes[:, which] * _power(factor, count), out=sums[1:], dtype=np.uint64)
            self.sums.append(sums)
        self.text_of = np.repeat(np.arange(len(texts)), lengths)
        if count < window:
            self.starts = self.picks = self.anchors = np.zeros(0, np.int64)
            return
        fits = np.arange(count) + window <= np.repeat(self.begins[1:], lengths)
        self.starts = np.flatnonzero(fits)
        grams = np.arange(count - anchor + 1)
        # A hash in the upper half, the place in the lower: the least is the leftmost of ties.
        least = (_mixed(self.hashed(0, grams, grams + anchor)) & _UPPER) | grams.astype(np.uint64)
        least = _sliding_least(least, window - anchor + 1)
        self.picks = (least[self.starts] & _LOWER).astype(np.int64)
        first = np.ones(len(self.picks), bool)
        # Places never go back within a text, and texts follow each other.
        first[1:] = self.picks[1:] != self.picks[:-1]
        self.anchors = self.picks[first]

    def hashed(self, which: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The hash of the words from ``start`` to ``stop``."""
        inverse = _power(pow(_FACTORS[which], -1, 1 << 64), len(self.sums[which]))
        return (self.sums[which][stop] - self.sums[which][start]) * inverse[start]


def _mixed(numbers: np.ndarray) -> np.ndarray:
    numbers = (numbers ^ (numbers >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return numbers ^ (numbers >> np.uint64(29))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row, by doubling."""
    reached = 1
    while 2 * reached <= width:
        values = np.minimum(values[:-reached], values[reached:])
        reached *= 2
    rest = width - reached
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _sources(name: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place the first one of the same name, by document and place."""
    order = np.lexsort((at, rank, *name))
    changed = np.zeros(len(at), bool)
    changed[:1] = True
    for column in name:
        held = column[order]
        changed[1:] |= held[1:] != held[:-1]
    source = np.empty(len(at), np.int64)
    source[order] = order[np.flatnonzero(changed)[np.cumsum(changed) - 1]]
    return source


def _ranks(part: pa.RecordBatch) -> np.ndarray:
    """The place of each row in the order of documents."""
    placed = pa.table({"id": part.column("id"), "row": part.column("row"), "k": np.arange(part.num_rows)})
    rank = np.empty(part.num_rows, np.int64)
    rank[placed.sort_by([("id", "ascending"), ("row", "ascending")]).column("k").to_numpy()] = np.arange(part.num_rows)
    return rank


DOC = ["id", "row"]


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``id``, ``row`` and ``text``. Documents are in the order of their ids, those without one last.

    Rows that repeat an id are in the order of ``row``, a hash of their texts;
    those that repeat the text as well are one document.
    """
    return docs.select(
        F.col(id_col).alias("id"), F.hash(text_of(text_col)).alias("row"), F.col(text_col).alias("text"), *more
    )


def _same_doc(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joined by document; an id may be null."""
    named = right.withColumnsRenamed({c: f"other_{c}" for c in DOC})
    same = left["id"].eqNullSafe(named["other_id"]) & (left["row"] == named["other_row"])
    return left.join(named, same, how).drop("other_id", "other_row")


def _anchor_rows(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """The anchors of all documents: ``id``, ``row``, ``pos``, ``anchor``, ``phrase`` and its end ``stop``.

    Those that stand earlier in the same slice of texts have that place as
    ``shift`` and ``reference``, and whether the phrase is the ``same``; their
    ``anchor`` is a number of their own. Of the others, ``again`` tells that
    they stand later in the slice too.
    """
    ship_package(rows.sparkSession)
    schema = T.StructType(
        [*rows.select(*DOC).schema.fields]
        + T.StructType.fromDDL(
            "pos int, stop int, anchor long, phrase long, again boolean, reference long, shift int, same boolean"
        ).fields
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                p = Parsed(part.column("text").to_pylist(), window, anchor)
                at = p.anchors
                if not len(at):
                    continue
                text = p.text_of[at]
                begin = p.begins[text]
                # A phrase ends with the next anchor of its text.
                follows = np.append(text[1:] == text[:-1], False)
                stop = np.where(follows, np.append(at[1:], 0) + anchor, at)
                phrase = np.where(follows, p.hashed(1, at, stop), np.uint64(0))
                name = p.hashed(0, at, at + anchor)
                source = _sources(name[None, :], _ranks(part)[text], at)
                known = source != np.arange(len(at))
                again = np.zeros(len(at), bool)
                again[source[known]] = True
                same = follows & (phrase == phrase[source])
                # Scatters rows that need no index; none of them is looked up.
                own = _mixed(name ^ ((at + 1).astype(np.uint64) * np.uint64(_FACTORS[0])))
                place = (at - begin).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.select(["id", "row"]).take(pa.array(text, pa.int64())).columns,
                        pa.array(place), pa.array(np.where(follows, stop - begin, 0).astype(np.int32)),
                        pa.array(np.where(known, own, name).view(np.int64)), pa.array(phrase.view(np.int64)), pa.array(again),
                        pa.array(text[source], pa.int64(), mask=~known), pa.array((place[source] - place).astype(np.int32), mask=~known),
                        pa.array(same, mask=~known),
                    ],
                    names=schema.names,
                )

    return rows.select(*DOC, "text").mapInArrow(run, schema)


def _met(anchors: DataFrame) -> DataFrame:
    """``id``, ``row`` and, for every anchor that stands twice, ``m``: what is known of it.

    One shuffle by anchor, in which a place sees the first place before it.
    """
    in_order = Window.partitionBy("anchor", "local").orderBy(F.col("id").asc_nulls_last(), "row", "pos")
    firsts = {f"first_{c}": F.first(c).over(in_order) for c in ("id", "row", "pos", "phrase")}
    seen = anchors.withColumn("local", F.col("reference").isNotNull()).withColumns(
        {"place": F.row_number().over(in_order), "next": F.lead(F.lit(True)).over(in_order), **firsts}
    )
    later = F.col("place") > 1
    same = later & (F.col("stop") > 0) & (F.col("phrase") == F.col("first_phrase"))
    reference = F.when(later, F.xxhash64("first_id", "first_row"))
    return seen.filter(F.col("local") | F.col("again") | later | F.col("next").isNotNull()).select(
        *DOC,
        F.struct(
            "pos", "stop",
            F.coalesce("same", same).alias("same"),
            F.coalesce("reference", reference).alias("reference"),
            F.coalesce("shift", F.col("first_pos") - F.col("pos")).alias("shift"),
        ).alias("m"),
    )


def _factors(met: DataFrame, window: int) -> DataFrame:
    """``id``, ``row``, the places ``repeated`` of its repeated anchors, and its long factors ``spans``.

    ``met`` has an array of ``(pos, stop, same, reference, shift)`` per document.
    """
    ship_package(met.sparkSession)
    schema = T.StructType([*met.select(*DOC).schema.fields, *T.StructType.fromDDL("repeated array<int>, spans array<int>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeated, spans = [], []
            for row in batch.column("met").to_pylist():
                row.sort(key=lambda m: m["pos"])
                repeated.append([m["pos"] for m in row])
                found, last = [], None
                for m in row:
                    if not m["same"]:
                        last = None
                        continue
                    # A phrase ends with the anchor that the next one starts with.
                    name = (m["reference"], m["shift"])
                    if last and last[0] == name and last[2] > m["pos"]:
                        last[2] = m["stop"]
                    else:
                        last = [name, m["pos"], m["stop"]]
                        found.append(last)
                spans.append([x for _, a, b in found if b - a >= window for x in (a, b)])
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (repeated, spans)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *lists], names=schema.names)

    return met.select(*DOC, "met").mapInArrow(run, schema)


def _open_windows(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """``id``, ``row``, ``start``, and the hash ``high``, ``low`` of the windows that factors leave to be checked.

    Those that are ``known`` to stand earlier, in the same slice of texts, have
    numbers of their own instead, which scatters them.
    """
    ship_package(rows.sparkSession)
    schema = T.StructType([*rows.select(*DOC).schema.fields, *T.StructType.fromDDL("start int, high long, low long, known boolean")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                p = Parsed(part.column("text").to_pylist(), window, anchor)
                # Per word: whether a repeated anchor starts there, and how far a factor reaches.
                hot = np.zeros(len(p.text_of) + 1, bool)
                reach = np.zeros(len(p.text_of) + 1, np.int64)
                for begin, places, spans in zip(
                    p.begins.tolist(), part.column("repeated").to_pylist(), part.column("spans").to_pylist()
                ):
                    hot[np.array(places, np.int64) + begin] = True
                    for a, b in zip(spans[::2], spans[1::2]):
                        reach[begin + a] = max(reach[begin + a], begin + b)
                reach = np.maximum.accumulate(reach)
                left = hot[p.picks] & (reach[p.starts] < p.starts + window)
                at = p.starts[left]
                name = np.stack([p.hashed(k, at, at + window) for k in (0, 1)])
                text = p.text_of[at]
                known = _sources(name, _ranks(part)[text], at) != np.arange(len(at))
                name[0][known] = _mixed(name[0] ^ ((at + 1).astype(np.uint64) * np.uint64(_FACTORS[0])))[known]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.select(["id", "row"]).take(pa.array(text, pa.int64())).columns,
                        pa.array((at - p.begins[text]).astype(np.int32)),
                        *(pa.array(x.view(np.int64)) for x in name), pa.array(known),
                    ],
                    names=schema.names,
                )

    return rows.select(*DOC, "text", "repeated", "spans").mapInArrow(run, schema)


def repeated_spans(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``id``, ``row``, ``spans`` and ``starts`` of the documents that repeat something.

    ``rows`` is a :func:`keyed` table. ``spans`` has pairs of a first and an end
    word, ``starts`` the beginnings of further windows.
    """
    met = _met(_anchor_rows(rows, window, anchor))
    # As many as the document has anchors; repeated rows are one document.
    factors = written(_factors(met.groupBy(*DOC).agg(F.collect_set("m").alias("met")), window))
    left = _open_windows(_same_doc(rows, factors, "inner"), window, anchor)
    # A window of every document has a row per slice here, as an anchor has.
    in_order = Window.partitionBy("high", "low", "known").orderBy(F.col("id").asc_nulls_last(), "row", "start")
    later = left.withColumn("place", F.row_number().over(in_order)).filter("known or place > 1")
    starts = later.groupBy(*DOC).agg(F.collect_set("start").alias("starts"))
    cuts = _same_doc(factors.select(*DOC, "spans"), starts, "left")
    # Not written: one shuffle of the texts by document then serves this join and the caller's.
    return cuts.filter("size(spans) > 0 or starts is not null")


def _cut(rows: DataFrame, found: DataFrame, window: int, keep: list[str]) -> DataFrame:
    """``keep``, ``n_words``, ``n_removed`` and ``kept_text`` of all ``rows``."""
    ship_package(rows.sparkSession)
    joined = _same_doc(rows, found, "left").select(*keep, "text", "spans", "starts")
    at = len(keep)
    schema = T.StructType([*joined.schema.fields[:at], *T.StructType.fromDDL("n_words long, n_removed long, kept_text string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                n_words, n_removed, kept = [], [], []
                for text, spans, starts in zip(*(part.column(at + k).to_pylist() for k in range(3))):
                    words = words_of(text)
                    total = len(words)
                    if spans or starts:
                        edges = np.zeros(total + 1, np.int64)
                        first = np.array([*(spans or [])[::2], *(starts or [])], np.int64)
                        end = np.array([*(spans or [])[1::2], *(s + window for s in starts or [])], np.int64)
                        np.add.at(edges, first, 1)
                        np.add.at(edges, end, -1)
                        stays = np.cumsum(edges[:-1]) == 0
                        words = [w for w, s in zip(words, stays.tolist()) if s]
                    n_words.append(total)
                    n_removed.append(total - len(words))
                    kept.append(b" ".join(words).decode())
                made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *made], names=schema.names)

    return joined.mapInArrow(run, schema)


def passage_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row per document: its id, ``n_words``, ``n_removed`` and ``kept_sha256`` of the kept words.

    A word goes if a window of ``window`` words around it also starts earlier: in
    a document of smaller id, or further up in its own. Null ids come last, and
    rows that repeat an id are in an order of their texts; rows that repeat the
    text as well are one document and get the same result each. Null and empty texts have
    no words, texts below ``window`` words keep all. An empty table gives an
    empty one; other columns are not read.
    """
    rows = keyed(docs, id_col, text_col)
    found = _cut(rows, repeated_spans(rows, window, min(ANCHOR, window)), window, ["id"])
    return found.select(
        F.col("id").alias(id_col), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def drop_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without its repeated passages, all columns.

    Texts that repeat nothing stay as they are, the others are their kept words
    joined by blanks. Every row stays, also one that keeps no word.
    """
    rows = keyed(docs, id_col, text_col, F.struct("*").alias("own"))
    found = _cut(rows, repeated_spans(rows, window, min(ANCHOR, window)), window, ["own"])
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("own")[text_col])
    return found.select(*[text.alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns])
