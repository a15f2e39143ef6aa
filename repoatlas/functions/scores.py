"""Relevance and category scores of one text, computed inside its row.

None of these needs a join: the keywords and categories are literals in the
plan, and a text's own term counts come from its token array.
"""

import math
import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoatlas.fixed_values import (
    BM25_EPSILON,
    BM25_K1,
    HYBRID_BM25_WEIGHT,
    HYBRID_COSINE_WEIGHT,
    RELEVANCE_BM25_WEIGHT,
    RELEVANCE_TFIDF_WEIGHT,
    TFIDF_TOKEN,
)
from repoatlas.functions.arrays import (
    bind,
    constant,
    kept,
    literal_strings,
    occurrences,
    token_counts,
)
from repoatlas.functions.text import _column

# Smoothed inverse frequency of a term that one of two texts holds; a term of
# both has 1.
_ONE_OF_TWO = math.log(1.5) + 1.0
# A one-text corpus gives every term a negative frequency weight, which the
# ranking replaces by this share of the (equal) average.
_ONE_TEXT_IDF = BM25_EPSILON * math.log(0.5 / 1.5)
MAX_RELEVANCE = math.sqrt(RELEVANCE_TFIDF_WEIGHT**2 + RELEVANCE_BM25_WEIGHT**2)


def squash(x) -> Column:
    return 1 / (1 + F.exp(-_column(x)))


def one_text_bm25(count) -> Column:
    """Squashed score of a word seen ``count`` times in a one-text corpus.

    The length of the only text is the average length, so it cancels out.
    """
    count = _column(count)
    return squash(_ONE_TEXT_IDF * count * (BM25_K1 + 1) / (count + BM25_K1))


def squared_length(tokens) -> Column:
    """The sum of squared term counts of a token array."""
    return F.aggregate(
        token_counts(tokens), F.lit(0.0), lambda acc, c: acc + c["n"] * c["n"]
    )


def keyword_table(keywords: list[str]) -> Column:
    """Keywords as a literal array of ``(ord, keyword, terms)``."""
    rows = [
        {
            "ord": ord_,
            "keyword": keyword,
            "terms": [
                {"term": term, "n": n}
                for term, n in Counter(re.findall(TFIDF_TOKEN, keyword.lower())).items()
            ],
        }
        for ord_, keyword in enumerate(keywords)
    ]
    return constant(
        rows, "array<struct<ord:int,keyword:string,terms:array<struct<term:string,n:int>>>>"
    )


def keyword_terms(keywords: list[str]) -> list[str]:
    """All terms of all keywords, each once."""
    return list(dict.fromkeys(t for k in keywords for t in re.findall(TFIDF_TOKEN, k.lower())))


def two_text_tfidf(term_hits, length2, keyword_term_counts) -> Column:
    """Cosine of a text and a keyword as the two texts of one corpus.

    ``term_hits`` are the text's terms that some keyword has, ``length2`` is
    the text's :func:`squared_length` over all its terms.
    """
    matched = F.transform(
        _column(keyword_term_counts),
        lambda k: F.struct(
            k["n"].cast("double").alias("n"),
            occurrences(term_hits, k["term"]).cast("double").alias("m"),
        ),
    )

    def total(value) -> Column:
        return F.aggregate(matched, F.lit(0.0), lambda acc, x: acc + value(x))

    unshared = _ONE_OF_TWO**2
    dot = total(lambda x: x["n"] * x["m"])
    text2 = unshared * _column(length2) + total(lambda x: x["m"] * x["m"] * (1 - unshared))
    keyword2 = total(
        lambda x: x["n"] * x["n"] * F.when(x["m"] > 0, F.lit(1.0)).otherwise(F.lit(unshared))
    )
    return F.when(dot > 0, dot / F.sqrt(text2 * keyword2)).otherwise(F.lit(0.0))


def relevance(bm25, tfidf) -> Column:
    """Weighted mean of the two scores; without words only the second counts."""
    weighted = RELEVANCE_TFIDF_WEIGHT * _column(tfidf)
    both = RELEVANCE_BM25_WEIGHT * _column(bm25) + weighted
    return F.coalesce(both, weighted) / MAX_RELEVANCE


def min_max(scores) -> Column:
    """Scores scaled to 0..1; all 1 where they are equal."""
    scores = _column(scores)
    bounds = F.struct(F.array_min(scores).alias("low"), F.array_max(scores).alias("high"))

    def scale(s, b):
        span = b["high"] - b["low"]
        return F.when(span == 0, F.lit(1.0)).otherwise((s - b["low"]) / span)

    return bind(bounds, lambda b: F.transform(scores, lambda s: scale(s, b)))


def category_bm25(text_words, categories: list[tuple[str, str]]) -> Column:
    """One summed, squashed word score per category, in category order.

    A category word the text lacks counts 0.5, so the sum starts from half the
    number of words and only the words found change it.
    """
    counts = [Counter(text.split()) for _, text in categories]
    vocabulary = list(dict.fromkeys(w for c in counts for w in c))
    start = constant([0.5 * sum(c.values()) for c in counts], "array<double>")
    per_word = constant(
        {w: [c[w] for c in counts] for w in vocabulary}, "map<string,array<double>>"
    )

    def step(scores, found):
        change = one_text_bm25(found["n"]) - 0.5
        return bind(
            change,
            lambda c: F.zip_with(
                scores, F.try_element_at(per_word, found["term"]), lambda s, n: s + n * c
            ),
        )

    return F.aggregate(token_counts(kept(text_words, vocabulary)), start, step)


def category_cosine(text_terms, categories: list[tuple[str, str]]) -> Column:
    """TF-IDF cosine of a text with every category text, in category order.

    The categories are the corpus: they give the vocabulary and the term
    frequencies; terms outside it do not count.
    """
    counts = [Counter(re.findall(TFIDF_TOKEN, text.lower())) for _, text in categories]
    vocabulary = list(dict.fromkeys(t for c in counts for t in c))
    idf = {
        t: math.log((1 + len(counts)) / (1 + sum(t in c for c in counts))) + 1
        for t in vocabulary
    }
    norms = [math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items())) or 1.0 for c in counts]
    # A text's own weight of a term, and what the term adds to each dot product.
    own = constant(idf, "map<string,double>")
    shared = constant(
        {
            t: [c[t] * idf[t] ** 2 / norm for c, norm in zip(counts, norms)]
            for t in vocabulary
        },
        "map<string,array<double>>",
    )
    start = constant([0.0] * len(categories), "array<double>")

    def step(sums, found):
        weights = F.try_element_at(shared, found["term"])
        return F.zip_with(sums, weights, lambda s, w: s + w * found["n"])

    def score(found):
        squares = F.aggregate(
            found,
            F.lit(0.0),
            lambda acc, f: acc + F.pow(F.try_element_at(own, f["term"]) * f["n"], F.lit(2)),
        )
        dots = F.aggregate(found, start, step)
        return bind(
            F.sqrt(squares),
            lambda length: F.transform(
                dots, lambda d: F.when(length == 0, F.lit(0.0)).otherwise(d / length)
            ),
        )

    return bind(token_counts(kept(text_terms, vocabulary)), score)


def hybrid(bm25_scores, cosine_scores) -> Column:
    """Weighted sum of both score arrays, each scaled to 0..1 first."""
    return F.zip_with(
        min_max(bm25_scores),
        min_max(cosine_scores),
        lambda b, c: HYBRID_BM25_WEIGHT * b + HYBRID_COSINE_WEIGHT * c,
    )


def rounded(scores, digits: int = 6) -> Column:
    """Scores rounded, so that equal ones tie on every machine."""
    return F.transform(_column(scores), lambda s: F.round(s, digits))


def best_category(scores, categories: list[tuple[str, str]]) -> Column:
    """The category of the highest score; the first one on ties."""
    scores = _column(scores)
    names = literal_strings([name for name, _ in categories])
    position = F.array_position(scores, F.array_max(scores)).cast("int")
    return F.try_element_at(names, position)
