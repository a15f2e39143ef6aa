"""A quality classifier: an additive model of lookup tables, with pair interactions.

Each feature has a table of scores by bin, and so have a few pairs of features.
Shallow trees, boosted in turn over the features, are added into the tables, so
scoring a document is binning its features and adding up table entries.
"""

import re
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoatlas.llm.tasks import map_texts, remainder

FEATURES = (
    "log_words",
    "word_length",
    "distinct_share",
    "top_word_share",
    "repeated_neighbours",
    "repeated_windows",
    "symbol_share",
    "digit_share",
    "upper_share",
    "space_share",
    "other_share",
    "exclamation_share",
    "separator_share",
    "log_lines",
    "line_length",
    "repeated_lines",
    "sentence_lines",
    "marked_words",
)

# The model is fitted on at most so many labelled documents, those of the
# smallest hash of their id.
MAX_DOCS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 10
ROUNDS = 200
PAIR_ROUNDS = 100
RATE = 0.1
LEAVES = 3
MIN_LEAF = 10
RIDGE = 1.0
# A score of this or more predicts label 1.
THRESHOLD = 0.3

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&<>~^_=+@\\{}[]"
_ENDS = (".", "!", "?", "…", ":", ";", '"', "”", "»", ")")


def features(text: str | None) -> list[float]:
    """The values of ``FEATURES``; all are 0 for a text without a word."""
    words = _WORD.findall(text) if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    counts = Counter(words)
    windows = Counter(zip(words, words[1:], words[2:]))
    symbols = sum(map(text.count, _SYMBOLS))
    digits = sum(map(text.count, "0123456789"))
    raised = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÀÇÑÍÓÁÚÊ"))
    spaces = size - sum(map(len, words))
    lines = [line for line in map(str.strip, text.split("\n")) if line]
    bare = sum(c for w, c in counts.items() if w[-1].isalpha() or (w[-1] in ".,;:" and w[:-1].isalpha()))
    return [
        float(np.log1p(n)),
        (size - spaces) / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        sum(c for c in windows.values() if c > 1) / n,
        symbols / size,
        digits / size,
        raised / size,
        spaces / size,
        (size - len(text.encode("ascii", "ignore"))) / size,
        text.count("!") / n,
        text.count("|") / n,
        float(np.log1p(len(lines))),
        float(np.log1p((size - spaces) / max(1, len(lines)))),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(line.endswith(_ENDS) for line in lines) / max(1, len(lines)),
        1 - bare / n,
    ]


class AdditiveModel:
    """Tables by bin; ``score`` is the logistic of their sum."""

    def __init__(self, start: float, cuts: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple]):
        self.start, self.cuts, self.tables, self.pairs = start, cuts, tables, pairs

    def score(self, values: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(cut, values[:, i], side="right") for i, cut in enumerate(self.cuts)]
        total = np.full(len(values), self.start)
        for table, own in zip(self.tables, bins):
            total += table[own]
        for i, j, coarse_i, coarse_j, table in self.pairs:
            total += table[coarse_i[bins[i]], coarse_j[bins[j]]]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _tree(gradient: np.ndarray, curvature: np.ndarray, count: np.ndarray, leaves: int) -> np.ndarray:
    """The value per bin of a tree of up to ``leaves`` leaves over the bins in order."""
    parts = [(0, len(gradient))]
    g, h, n = (np.concatenate([[0.0], np.cumsum(x)]) for x in (gradient, curvature, count))
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + RIDGE)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for part in parts:
            a, b = part
            at = np.arange(a + 1, b)
            at = at[(n[at] - n[a] >= MIN_LEAF) & (n[b] - n[at] >= MIN_LEAF)]
            if len(at):
                gains = gain(a, at) + gain(at, b) - gain(a, b)
                top = int(gains.argmax())
                if gains[top] > best[0]:
                    best = (float(gains[top]), part, int(at[top]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    values = np.zeros(len(gradient))
    for a, b in parts:
        values[a:b] = (g[b] - g[a]) / (h[b] - h[a] + RIDGE)
    return values


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts each of two features once."""
    sums = [np.pad(x.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0))) for x in (g, h)]
    best, values = 0.0, np.zeros(g.shape)
    whole = sums[0][-1, -1] ** 2 / (sums[1][-1, -1] + RIDGE)
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            boxes = [(slice(0, a), slice(0, b)), (slice(0, a), slice(b, None)), (slice(a, None), slice(0, b)), (slice(a, None), slice(b, None))]
            quarter = []
            for s in sums:
                c = s[a, b]
                top, left, all_ = s[a, -1], s[-1, b], s[-1, -1]
                quarter.append((c, top - c, left - c, all_ - top - left + c))
            gain = sum(x * x / (y + RIDGE) for x, y in zip(*quarter)) - whole
            if gain > best:
                best, values = gain, np.zeros(g.shape)
                for box, x, y in zip(boxes, *quarter):
                    values[box] = x / (y + RIDGE)
    return best, values


def fit_tables(values: np.ndarray, labels: np.ndarray) -> AdditiveModel:
    """Cyclic boosting over single features, then over the pairs that explain most of the rest."""
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    cuts = [_cuts(values[:, i], BINS) for i in range(values.shape[1])]
    bins = [np.searchsorted(cut, values[:, i], side="right") for i, cut in enumerate(cuts)]
    sizes = [len(cut) + 1 for cut in cuts]
    counts = [np.bincount(b, minlength=s).astype(float) for b, s in zip(bins, sizes)]
    tables = [np.zeros(s) for s in sizes]
    total = np.full(len(labels), start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i, own in enumerate(bins):
            g, h = slopes()
            step = RATE * _tree(
                np.bincount(own, g, sizes[i]), np.bincount(own, h, sizes[i]), counts[i], LEAVES
            )
            tables[i] += step
            total += step[own]
    coarse = [np.minimum(np.arange(s) * PAIR_BINS // s, PAIR_BINS - 1) for s in sizes]
    g, h = slopes()

    def grid(i: int, j: int, x: np.ndarray) -> np.ndarray:
        place = coarse[i][bins[i]] * PAIR_BINS + coarse[j][bins[j]]
        return np.bincount(place, x, PAIR_BINS * PAIR_BINS).reshape(PAIR_BINS, PAIR_BINS)

    gains = {(i, j): _quadrants(grid(i, j, g), grid(i, j, h))[0] for i, j in combinations(range(len(sizes)), 2)}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    pairs = [(i, j, coarse[i], coarse[j], np.zeros((PAIR_BINS, PAIR_BINS))) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for i, j, _, _, table in pairs:
            g, h = slopes()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            table += step
            total += step[coarse[i][bins[i]], coarse[j][bins[j]]]
    return AdditiveModel(start, cuts, tables, pairs)


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = MAX_DOCS,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``label`` and ``text`` of a bounded number of labelled ids that may be learned from.

    Their crc32 modulo 5 is not 0. Of an id with several labels the mean counts,
    and none if that is one half.
    """
    known = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (remainder(id_col) != 0))
        .groupBy(F.col(id_col).alias("known_id"))
        .agg(F.avg(F.col(label).cast("double")).alias("mean_label"))
        .filter("mean_label != 0.5")
        .select("known_id", (F.col("mean_label") > 0.5).cast("double").alias("known_label"))
    )
    # A bounded number of ids, so few enough for any task.
    chosen = known.orderBy(F.xxhash64("known_id"), "known_id").limit(max_docs)
    texts = docs.select(F.col(id_col).alias("known_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "known_id").select(
        F.col("known_id").alias("id"), F.col("known_label").alias("label"), "text"
    )


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = MAX_DOCS,
        id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel | None:
    """A model of ``label``; None if there is no labelled document.

    Spark computes the features; of ids that repeat one row is used, so at most
    ``max_docs`` rows of numbers come back.
    """
    rows = training_rows(docs, labels, label, max_docs, id_col, text_col)
    measured = map_texts(rows, [("values", T.ArrayType(T.DoubleType()))], lambda: lambda texts: ([features(t) for t in texts],), ("id", "label"), "text")
    table = measured.groupBy("id").agg(F.max("label").alias("label"), F.min("values").alias("values")).orderBy("id").toArrow()
    if not table.num_rows:
        return None
    values = np.array(table.column("values").to_pylist())
    return fit_tables(values, table.column("label").to_numpy())


def predict(docs: DataFrame, model: AdditiveModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``score`` per document; 0.5 if there is no model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def work(texts):
            values = np.array([features(t) for t in texts])
            return ([0.5] * len(texts) if shared.value is None else shared.value.score(values),)

        return work

    return map_texts(docs, [("score", T.DoubleType())], start, (id_col,), text_col)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``held_out``, ``score`` and ``predicted`` per document.

    Null and empty texts are scored by features that are all 0. A null id counts
    as empty text for ``held_out``. Repeated rows have a row each; an empty table
    gives an empty one; other columns are not read.
    """
    found = predict(docs, fit(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    return found.select(
        id_col, (remainder(id_col) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
