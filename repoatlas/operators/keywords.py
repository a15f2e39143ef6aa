"""Keywords against documents: matching, scoring, ranking, resuming."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repoatlas.fixed_values import BM25_B, BM25_K1, RELEVANCE_THRESHOLD
from repoatlas.functions import scores as S
from repoatlas.functions.arrays import kept, literal_strings, occurrences
from repoatlas.functions.text import clean_readme, terms, words
from repoatlas.session import cut_lineage


def keyword_match(docs: DataFrame, keywords: list[str], text: str = "readme") -> DataFrame:
    """One row per document and keyword its text contains.

    The keywords travel as a literal with the plan and each document picks its
    own, so nothing is shuffled. The text itself is not carried on.
    """
    table = F.transform(
        S.keyword_table(keywords), lambda k: F.struct(k["ord"], k["keyword"])
    )
    found = F.filter(table, lambda k: F.contains(F.col(text), k["keyword"]))
    kept = [c for c in docs.columns if c != text]
    # The outer variant spares a second look at the text (for an empty array).
    return docs.select(*kept, F.inline_outer(found)).filter("ord IS NOT NULL")


def keyword_scores(
    docs: DataFrame,
    keywords: list[str],
    doc_id: str = "id",
    text: str = "readme",
    clean_keywords: bool = False,
) -> DataFrame:
    """Both relevance scores of every document for every keyword.

    The bm25 score is null for a text without words. ``clean_keywords`` cleans
    the keywords like the texts; as they are, those with an underscore cannot
    match cleaned text.
    """
    if clean_keywords:
        keywords = _cleaned(docs, keywords)
    counted = docs.select(
        doc_id, words(text).alias("words"), terms(text).alias("terms")
    ).select(
        doc_id,
        F.size("words").alias("n_words"),
        kept("words", keywords).alias("word_hits"),
        kept("terms", S.keyword_terms(keywords)).alias("term_hits"),
        S.squared_length("terms").alias("length2"),
    )
    pairs = counted.select("*", F.inline(S.keyword_table(keywords))).withColumnRenamed(
        "terms", "keyword_terms"
    )
    count = occurrences("word_hits", "keyword")
    return pairs.select(
        doc_id,
        "ord",
        "keyword",
        F.when(F.col("n_words") > 0, S.one_text_bm25(count)).alias("bm25"),
        S.two_text_tfidf("term_hits", "length2", "keyword_terms").alias("tfidf"),
    )


def keyword_relevance(docs: DataFrame, keywords: list[str], **options) -> DataFrame:
    """:func:`keyword_scores` with the combined relevance and its verdict."""
    scored = keyword_scores(docs, keywords, **options)
    combined = S.relevance("bm25", "tfidf")
    return scored.withColumn("relevance", combined).withColumn(
        "is_relevant", F.col("relevance") > RELEVANCE_THRESHOLD
    )


def bm25_rank(
    docs: DataFrame, keywords: list[str], k: int, doc_id: str = "id", text: str = "readme"
) -> DataFrame:
    """The ``k`` best documents per keyword by BM25 over the whole corpus.

    The texts are read once: what the ranking needs of them, their length and
    their keyword hits, is narrow and kept in the checkpoint folder for the two
    steps after. Each task passes on its own ``k`` best rows per keyword only.
    """
    tokens = docs.select(doc_id, words(text).alias("words"))
    counted = cut_lineage(
        tokens.select(
            doc_id,
            F.size("words").alias("n_words"),
            kept("words", keywords).alias("hits"),
        )
    )
    hits = counted.filter(F.size("hits") > 0)
    frequencies = (
        hits.select(F.explode(F.array_distinct("hits")).alias("keyword"))
        .groupBy("keyword")
        .agg(F.count("*").alias("df"))
    )
    # At most one entry per keyword of the given list.
    by_keyword = frequencies.agg(
        F.map_from_entries(F.collect_list(F.struct("keyword", "df")))
    ).scalar()
    corpus = counted.agg(F.struct(F.count("*").alias("n"), F.avg("n_words").alias("avg"))).scalar()
    pairs = (
        hits.select("*", F.inline(S.keyword_table(keywords)))
        .withColumn("tf", occurrences("hits", "keyword"))
        .filter("tf > 0")
        .withColumn("df", F.try_element_at(by_keyword, F.col("keyword")))
        .withColumn("corpus", corpus)
    )
    idf = F.log((F.col("corpus.n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    length = 1 - BM25_B + BM25_B * F.col("n_words") / F.col("corpus.avg")
    weight = F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * length)
    scored = pairs.select(
        doc_id, "ord", "keyword", F.round(idf * weight, 6).alias("score")
    )
    best_first = Window.partitionBy("ord").orderBy(F.desc("score"), doc_id)
    ranked = scored.withColumn("rank", F.row_number().over(best_first))
    return ranked.filter(F.col("rank") <= k)


def resume_matches(matches: DataFrame, keywords: list[str], last_keyword: str | None) -> DataFrame:
    """The matches (with ``ord``) of the keywords that a stop left to do.

    Applied before pages are numbered, it saves sorting what is done already.
    """
    if last_keyword is None:
        return matches
    if last_keyword not in keywords:
        return matches.filter(F.lit(False))
    return matches.filter(F.col("ord") >= keywords.index(last_keyword))


def resume_pages(
    work: DataFrame, keywords: list[str], last_keyword: str | None, last_page: int | None
) -> DataFrame:
    """The pages still to do after a stop, the page it stopped at included.

    ``work`` has ``ord`` (the keyword's position) and ``page``. Without a
    pointer everything is left to do; with an unknown keyword nothing is.
    """
    if last_keyword is None:
        return work
    if last_keyword not in keywords:
        return work.filter(F.lit(False))
    position = keywords.index(last_keyword)
    return work.filter(
        (F.col("ord") > position)
        | ((F.col("ord") == position) & (F.col("page") >= (last_page or 0)))
    )


def _cleaned(docs: DataFrame, keywords: list[str]) -> list[str]:
    one = docs.sparkSession.range(1)
    return one.select(F.transform(literal_strings(keywords), clean_readme)).first()[0]
