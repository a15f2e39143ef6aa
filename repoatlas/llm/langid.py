"""Language identification of words, spans and documents.

Scripts narrow the languages a word may have; each word has a score per
language from its letters; Viterbi with a penalty per switch labels the words of
a text, and runs of one label are its spans.
"""

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoatlas.llm.tasks import map_texts, remainder, slices
from repoatlas.operators.skew import lookup_join
from repoatlas.session import ship_package, written

UNDETERMINED = "und"

# First and last code point of the scripts told apart. Letters of
# no range have script 0, which any language may use.
SCRIPTS = (
    (0x0041, 0x024F),  # Latin
    (0x0370, 0x03FF),  # Greek
    (0x0400, 0x052F),  # Cyrillic
    (0x0530, 0x058F),  # Armenian
    (0x0590, 0x05FF),  # Hebrew
    (0x0600, 0x077F),  # Arabic
    (0x0900, 0x097F),  # Devanagari
    (0x0980, 0x09FF),  # Bengali
    (0x0A00, 0x0A7F),  # Gurmukhi
    (0x0B80, 0x0BFF),  # Tamil
    (0x0C00, 0x0C7F),  # Telugu
    (0x0E00, 0x0E7F),  # Thai
    (0x10A0, 0x10FF),  # Georgian
    (0x1E00, 0x1EFF),  # Latin, additional
    (0x3040, 0x30FF),  # Kana
    (0x3400, 0x9FFF),  # Han
    (0xAC00, 0xD7AF),  # Hangul
)

# Letter triples, and words, are counted under one of so many numbers.
FEATURES = 1 << 17
# The model knows every language that has a labelled document. It is fitted on
# about so many documents of each, a share of its documents by a hash of the id,
# or on fewer if all languages would then have more than ``MAX_DOCS``, but on
# ``LEAST_PER_LANGUAGE`` if there are so many.
MAX_DOCS = 20_000
DOCS_PER_LANGUAGE = 2_000
LEAST_PER_LANGUAGE = 20
# With more languages than this, features share numbers, so that the counts are
# bounded by ``FEATURES`` times this, down to ``LEAST_FEATURES`` numbers.
MAX_LANGUAGES = 200
LEAST_FEATURES = 1 << 12
# A script belongs to a language if it has this share of its letters.
MIN_SCRIPT_SHARE = 0.01
# Cost of a switch of language between two words, in log units.
SWITCH_PENALTY = 12.0
# Weight of the whole word's score beside that of its triples.
WORD_WEIGHT = 1.0
SMOOTHING = 0.5
# Documents of a lower share of told letters are rejected where only identified ones are kept.
MIN_SCORE = 0.4


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point whether it is a letter, and its script's number."""
    letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    script = np.zeros(sys.maxunicode + 1, np.int8)
    for number, (first, last) in enumerate(SCRIPTS, 1):
        script[first : last + 1] = number
    return letter, script


class Words:
    """The words of a text, runs of letters, in lower case: places and features."""

    def __init__(self, text: str | None):
        low = _lower(text) if text else ""
        codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letter, script = _letters()
        is_letter = np.concatenate([[False], letter[codes], [False]])
        edges = np.flatnonzero(is_letter[1:] != is_letter[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.n = len(self.starts)
        if not self.n:
            return
        self.script = script[codes[self.starts]]
        # Each word with one blank before and after it, one after the other.
        lengths = self.ends - self.starts
        self.sizes = lengths + 1
        first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.first = first
        row = np.zeros(int(self.sizes.sum()) + 1, np.int64)
        inside = np.ones(len(row), bool)
        inside[first] = False
        inside[-1] = False
        row[inside] = codes[is_letter[1:-1]]
        # Triples around each place but the last blank; each word has its letters' and its end's.
        before = row[:-1]
        after = row[1:]
        back = np.concatenate([[0], before[:-1]])
        back[first] = 0
        self.triples = ((before * 0x9E3779B1 + after * 0x85EBCA6B + back * 0xC2B2AE35) >> 7) % FEATURES
        weights = (np.arange(len(before)) - np.repeat(first, self.sizes)) * 0x27D4EB2F + 0x165667B1
        word = np.add.reduceat(before * (weights & 0xFFFFFFFF), first)
        self.words = (word >> 5) % FEATURES


def _lower(text: str) -> str:
    """Lower case with a character for each one, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


class Model:
    """Scores per feature and language; bounded by ``FEATURES`` times the languages."""

    def __init__(self, languages: list[str], triples: np.ndarray, words: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        self.triples = _log_shares(triples)
        self.words = _log_shares(words)
        # Words never seen say nothing of their own.
        self.words[words.sum(axis=1) == 0] = 0
        shares = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
        allowed = shares >= MIN_SCRIPT_SHARE
        allowed[0] = True
        allowed[~allowed.any(axis=1)] = True
        self.allowed = allowed

    def scores(self, words: Words) -> np.ndarray:
        """Score of every word in every language; languages of other scripts have none."""
        features = len(self.triples)
        own = np.add.reduceat(self.triples[words.triples % features], words.first, axis=0)
        own += WORD_WEIGHT * self.words[words.words % features]
        return np.where(self.allowed[words.script], own, -1e6)

    def label(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The best sequence of languages of the words, and the scores."""
        scores = self.scores(words)
        return viterbi(scores, SWITCH_PENALTY), scores


def _log_shares(counts: np.ndarray) -> np.ndarray:
    """Log share of each feature in each language, over the languages' mean."""
    shares = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * len(counts))
    return (shares - shares.mean(axis=1, keepdims=True)).astype(np.float32)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The sequence of columns with the best sum of scores less ``penalty`` per switch.

    A way of runs of columns is compared with the best single column. If none
    of the others gains more than ``penalty`` over it in any run of rows, runs
    between its own cannot pay: m of them gain at most m penalties and cost that
    at least. A way without it has a switch less; it cannot pay either if a run
    from the beginning and one to the end gain no more than one penalty
    together. Most texts end here.
    """
    best = int(scores.sum(axis=0, dtype=np.float64).argmax())
    gains = np.zeros((len(scores) + 1, scores.shape[1]))
    np.cumsum(scores - scores[:, [best]], axis=0, dtype=np.float64, out=gains[1:])
    run = (gains - np.minimum.accumulate(gains, axis=0)).max()
    to_end = (gains[-1] - gains.min(axis=0)).max()
    if run <= penalty and gains.max() + to_end <= penalty:
        return np.full(len(scores), best)
    rows, columns = scores.shape
    came = np.empty((rows, columns), np.int32)
    value = scores[0].astype(np.float64)
    stay = np.arange(columns)
    for row in range(1, rows):
        top = int(value.argmax())
        switch = value[top] - penalty
        moved = switch > value
        came[row] = np.where(moved, top, stay)
        value = np.where(moved, switch, value) + scores[row]
    path = np.empty(rows, np.int64)
    path[-1] = int(value.argmax())
    for row in range(rows - 1, 0, -1):
        path[row - 1] = came[row, path[row]]
    return path


def identify(model: Model | None, text: str | None) -> tuple[str, float, list[tuple[int, int, str]]]:
    """Language, score and spans (start, end, language) of a text.

    The language is the one with most letters in its spans. Its score is their
    share of all letters times the probability of the language against the
    others over those words. A text without a letter is ``und``, as is any if
    there is no model.
    """
    words = Words(text)
    if not words.n or model is None:
        return UNDETERMINED, 0.0, []
    path, scores = model.label(words)
    letters = (words.ends - words.starts).astype(np.float64)
    held = np.bincount(path, letters, len(model.languages))
    best = int(held.argmax())
    own = scores[path == best].sum(axis=0, dtype=np.float64)
    odds = np.exp(np.clip(own - own[best], -700, 0))
    score = float(held[best] / letters.sum() / odds.sum())
    cuts = np.flatnonzero(np.diff(path)) + 1
    spans = [
        (int(words.starts[a]), int(words.ends[b - 1]), model.languages[int(path[a])])
        for a, b in zip([0, *cuts], [*cuts, words.n])
    ]
    return model.languages[best], score, spans


def told_share(model: Model, text: str | None) -> float:
    """The share of the letters of a text whose span has a language, whichever.

    The letters of a span count by the probability of its language against the
    others over its words. A text without a letter has share 0.
    """
    words = Words(text)
    if not words.n:
        return 0.0
    path, scores = model.label(words)
    letters = (words.ends - words.starts).astype(np.float64)
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1)]
    of_span = np.add.reduceat(scores, cuts, axis=0, dtype=np.float64)
    own = of_span[np.arange(len(cuts)), path[cuts]]
    odds = np.exp(np.clip(of_span - own[:, None], -700, 700)).sum(axis=1)
    return float((np.add.reduceat(letters, cuts) / odds).sum() / letters.sum())


def sample_labelled(
    docs: DataFrame, max_docs: int = MAX_DOCS, per_language: int = DOCS_PER_LANGUAGE, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "lang",
) -> DataFrame:
    """``lang`` and ``text`` of a bounded sample of the documents that may be learned from.

    These have a text, a language, and an id whose crc32 modulo 5 is not 0.
    """
    usable = docs.filter(
        F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & (remainder(id_col) != 0)
    ).select(
        F.xxhash64(id_col).alias("order"),
        F.col(id_col).alias("chosen_id"),
        F.col(label_col).cast("string").alias("chosen_lang"),
    )
    labelled = written(usable.groupBy("chosen_lang").agg(F.count("*").alias("labelled")))
    languages = labelled.count()
    quota = min(per_language, max(max_docs // max(languages, 1), LEAST_PER_LANGUAGE))
    share = F.lit(float(quota)) / F.col("labelled")
    # A row per language, and a language may have any share of the rows.
    chosen = (
        lookup_join(usable, labelled, "chosen_lang", "labelled", "order")
        .filter(F.pmod("order", F.lit(1 << 31)) < share * (1 << 31))
        .select("chosen_id", "chosen_lang")
        .distinct()
    )
    # Few enough for any task, unless very many languages have their least number.
    if languages * quota <= 2 * max_docs:
        chosen = F.broadcast(chosen)
    rows = docs.select(
        F.col(id_col).alias("chosen_id"), F.col(label_col).cast("string").alias("chosen_lang"), F.col(text_col).alias("text")
    )
    return rows.join(chosen, ["chosen_id", "chosen_lang"]).select(F.col("chosen_lang").alias("lang"), "text")


def bounded_features(languages: int) -> int:
    """So many numbers of features that all languages' counts stay bounded."""
    features = FEATURES
    while features > LEAST_FEATURES and features * languages > FEATURES * MAX_LANGUAGES:
        features //= 2
    return features


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, per_language: int = DOCS_PER_LANGUAGE, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "lang") -> Model | None:
    """A model of the languages that occur in ``label_col``; None if there are none.

    Features are counted by Spark over the sample; what comes back has at most
    ``bounded_features`` counts per language and kind.
    """
    sample = sample_labelled(docs, max_docs, per_language, id_col, text_col, label_col)
    features = bounded_features(sample.select("lang").distinct().count())
    spark = docs.sparkSession
    ship_package(spark)
    schema = "lang string, kind int, feature int, n long"

    def count(batches):
        for batch in batches:
            for part in slices(batch, 1):
                found: dict[str, list[Words]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = Words(text)
                    if words.n:
                        found.setdefault(lang, []).append(words)
                for lang, all_words in found.items():
                    folded = [[w.triples % features for w in all_words], [w.words % features for w in all_words]]
                    letter_scripts = [np.repeat(w.script, w.ends - w.starts) for w in all_words]
                    for kind, values in enumerate((*folded, letter_scripts)):
                        feature, n = np.unique(np.concatenate(values), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([lang] * len(n), pa.string()),
                                pa.array(np.full(len(n), kind, np.int32)),
                                pa.array(feature.astype(np.int32)),
                                pa.array(n.astype(np.int64)),
                            ],
                            names=["lang", "kind", "feature", "n"],
                        )

    counts = (
        sample.select("lang", "text").mapInArrow(count, schema).groupBy("lang", "kind", "feature").agg(F.sum("n").alias("n"))
    ).toArrow()
    languages = sorted(set(counts.column("lang").to_pylist()))
    if not languages:
        return None
    place = {lang: i for i, lang in enumerate(languages)}
    column = np.array([place[x] for x in counts.column("lang").to_pylist()])
    kind, feature, n = (counts.column(c).to_numpy() for c in ("kind", "feature", "n"))
    tables = []
    for number, rows in enumerate((features, features, len(SCRIPTS) + 1)):
        table = np.zeros((rows, len(languages)))
        own = kind == number
        table[feature[own], column[own]] = n[own]
        tables.append(table)
    return Model(languages, *tables)


SPAN = T.StructType(
    [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]
)


def predict(
    docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", with_spans: bool = False
) -> DataFrame:
    """``keep``, ``lang_pred``, ``score`` and, if asked for, ``lang_spans`` per document; see ``identify``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType())]
    if with_spans:
        fields.append(("lang_spans", T.ArrayType(SPAN)))

    def start():
        own = shared.value

        def work(texts):
            found = [identify(own, t) for t in texts]
            spans = [[{"start": a, "end": b, "lang": x} for a, b, x in f[2]] for f in found] if with_spans else None
            return ([f[0] for f in found], [f[1] for f in found], *([spans] if with_spans else []))

        return work

    return map_texts(docs, fields, start, keep, text_col)


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The id, ``held_out``, ``lang_pred`` and ``score`` per document, by a model fitted on ``docs``.

    Null and letterless texts are ``und`` with score 0. A null id counts as
    empty text for ``held_out``. Repeated rows have a row each; an empty table
    gives an empty one; other columns are not read.
    """
    model = fit(docs, id_col=id_col, text_col=text_col, label_col=label_col)
    found = predict(docs, model, (id_col,), text_col)
    return found.select(id_col, (remainder(id_col) == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(
    docs: DataFrame, model: Model | None, min_score: float = MIN_SCORE, text_col: str = "text"
) -> DataFrame:
    """``docs``, all columns, without the documents whose language is not told.

    A document goes if ``told_share`` is below ``min_score``: it has no letters,
    or too few of them are in a span of some language. Texts of several
    languages stay. Without a model nothing is known of any language, and
    nothing goes.
    """
    if model is None:
        return docs
    own = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index(text_col)
            for part in slices(batch, at):
                shares = [told_share(shared.value, t) for t in part.column(at).to_pylist()]
                yield part.filter(pa.array([s >= min_score and s > 0 for s in shares], pa.bool_()))

    return docs.mapInArrow(run, docs.schema).select(*own)
