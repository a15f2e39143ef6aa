"""Zero-shot categories of texts, and the enrichment that uses them."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoatlas.fixed_values import CATEGORIES
from repoatlas.functions import scores as S
from repoatlas.functions.arrays import literal_strings
from repoatlas.functions.text import collapse_spaces, lead_sentences, terms, words

Categories = list[tuple[str, str]]


def category_scores(
    docs: DataFrame, categories: Categories = CATEGORIES, text: str = "text"
) -> DataFrame:
    """``docs`` with the arrays ``bm25_scores`` and ``cosine_scores``.

    The categories travel with the plan, so a document is scored where it is.
    """
    tokens = docs.withColumns({"_words": words(collapse_spaces(text)), "_terms": terms(text)})
    return tokens.withColumns(
        {
            "bm25_scores": S.rounded(S.category_bm25("_words", categories)),
            "cosine_scores": S.rounded(S.category_cosine("_terms", categories)),
        }
    ).drop("_words", "_terms")


def classify_text(
    docs: DataFrame,
    categories: Categories = CATEGORIES,
    text: str = "text",
    use_bm25: bool = False,
) -> DataFrame:
    """``docs`` with ``class_label`` and its ``class_score``.

    By cosine alone, or with ``use_bm25`` by the weighted sum of both scores,
    each scaled to 0..1 over the categories.
    """
    scored = category_scores(docs, categories, text)
    basis = S.rounded(S.hybrid("bm25_scores", "cosine_scores"), 9) if use_bm25 else F.col("cosine_scores")
    return (
        scored.withColumn("_basis", basis)
        .withColumn("class_label", S.best_category("_basis", categories))
        .withColumn("class_score", F.array_max("_basis"))
        .drop("_basis", "bm25_scores", "cosine_scores")
    )


def scores_by_category(scored: DataFrame, categories: Categories, **arrays: str) -> DataFrame:
    """One row per document and category from score arrays, by output name."""
    names = literal_strings([name for name, _ in categories])
    kept = [c for c in scored.columns if c not in arrays.values()]
    rows = scored.select(
        *kept, *set(arrays.values()), F.posexplode(names).alias("ord", "category")
    )
    values = [F.get(array, F.col("ord")).alias(name) for name, array in arrays.items()]
    return rows.select(*kept, "ord", "category", *values)


def enrich_catalog(
    catalog: DataFrame,
    relevance: Column,
    brief_desc: Callable[[str], Column] = lead_sentences,
    categories: Categories = CATEGORIES,
    text: str = "readme",
    topics: str | None = None,
) -> DataFrame:
    """Relevance, then brief description, then the label read from the latter.

    All three stay inside the row, so the wide texts are not shuffled.
    ``topics`` names a column that is put before the description for the label.
    """
    described = catalog.withColumns(
        {"relevance": relevance, "brief_desc": brief_desc(text)}
    )
    basis = F.concat(F.coalesce(topics, F.lit("")), "brief_desc") if topics else F.col("brief_desc")
    labelled = classify_text(described.withColumn("_label_text", basis), categories, "_label_text")
    return labelled.drop("_label_text", "class_score")
