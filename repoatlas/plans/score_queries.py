"""Keyword scores, ranking, categories and vectors."""

import math

from pyspark.sql import functions as F

from repoatlas.functions import scores as S
from repoatlas.functions.vectors import l2_normalize
from repoatlas.operators import classify as K
from repoatlas.operators import keywords as W
from repoatlas.operators import neighbors as N
from repoatlas.operators import similarity_join as J
from repoatlas.plans import inputs as I
from repoatlas.plans.registry import query
from repoatlas.session import cut_lineage

_IDF1 = 0.25 * math.log(0.5 / 1.5)
_U = math.log(1.5) + 1


def _sql_squashed(tf: str) -> str:
    return f"(1 / (1 + exp(-(CAST({_IDF1!r} AS DOUBLE) * 2.5 * {tf} / ({tf} + 1.5)))))"


# --- keywords ---------------------------------------------------------------


@query(
    "keyword_match",
    f"""WITH {I.SQL_CLEANED}, {I.SQL_KEYWORDS}
        SELECT doc_id, ord, keyword FROM cleaned JOIN keywords ON contains(readme, keyword)""",
)
def keyword_match(spark, sf_dir):
    return W.keyword_match(I.cleaned(spark, sf_dir), I.KEYWORDS)


_SQL_BM25 = f"""{I.SQL_CLEANED}, {I.SQL_KEYWORDS},
  split AS (SELECT doc_id, {I.sql_words('readme')} AS tokens FROM cleaned),
  bm25 AS (SELECT doc_id, ord, keyword, len(tokens) AS n_words,
    len(list_filter(tokens, lambda t: t = keyword)) AS tf FROM split CROSS JOIN keywords),
  bm25_scores AS (SELECT doc_id, ord, keyword,
    CASE WHEN n_words > 0 THEN {_sql_squashed('tf')} END AS bm25 FROM bm25)"""
_SQL_TFIDF = f"""terms AS (SELECT doc_id, unnest({I.sql_terms('readme')}) AS term FROM cleaned),
  counted AS (SELECT doc_id, term, count(*) AS m FROM terms GROUP BY ALL),
  lengths AS (SELECT doc_id, sum(m * m) AS l2 FROM counted GROUP BY doc_id),
  keyword_terms AS (SELECT ord, unnest({I.sql_terms('keyword')}) AS term FROM keywords),
  keyword_counts AS (SELECT ord, term, count(*) AS n FROM keyword_terms GROUP BY ALL),
  tfidf_parts AS (SELECT d.doc_id, k.ord, sum(k.n * coalesce(c.m, 0)) AS dot,
      sum(coalesce(c.m, 0) ** 2) AS shared2,
      sum(k.n ** 2 * CASE WHEN c.m > 0 THEN 1 ELSE CAST({_U * _U!r} AS DOUBLE) END) AS k2
    FROM cleaned d CROSS JOIN keyword_counts k
    LEFT JOIN counted c ON c.doc_id = d.doc_id AND c.term = k.term GROUP BY ALL),
  tfidf_scores AS (SELECT doc_id, ord, CASE WHEN dot > 0 THEN
      dot / sqrt((CAST({_U * _U!r} AS DOUBLE) * l2 + shared2 * (1 - CAST({_U * _U!r} AS DOUBLE))) * k2)
      ELSE 0 END AS tfidf FROM tfidf_parts LEFT JOIN lengths USING (doc_id))"""


@query(
    "bm25_score",
    f"WITH {_SQL_BM25} SELECT doc_id, keyword, round(bm25, 6) AS bm25 FROM bm25_scores",
)
def bm25_score(spark, sf_dir):
    scored = W.keyword_scores(I.cleaned(spark, sf_dir), I.KEYWORDS, "doc_id")
    return scored.select("doc_id", "keyword", F.round("bm25", 6).alias("bm25"))


@query(
    "tfidf_score",
    f"""WITH {I.SQL_CLEANED}, {I.SQL_KEYWORDS}, {_SQL_TFIDF}
        SELECT doc_id, keyword, round(tfidf, 6) AS tfidf FROM tfidf_scores JOIN keywords USING (ord)""",
)
def tfidf_score(spark, sf_dir):
    scored = W.keyword_scores(I.cleaned(spark, sf_dir), I.KEYWORDS, "doc_id")
    return scored.select("doc_id", "keyword", F.round("tfidf", 6).alias("tfidf"))


@query(
    "is_relevant_context",
    f"""WITH {_SQL_BM25}, {_SQL_TFIDF},
        combined AS (SELECT doc_id, keyword,
          coalesce(0.7 * bm25 + 0.3 * tfidf, 0.3 * tfidf) / sqrt(CAST(0.58 AS DOUBLE)) AS relevance
          FROM bm25_scores JOIN tfidf_scores USING (doc_id, ord))
        SELECT doc_id, keyword, round(relevance, 6) AS relevance, relevance > 0.5 AS is_relevant
        FROM combined""",
)
def is_relevant_context(spark, sf_dir):
    scored = W.keyword_relevance(I.cleaned(spark, sf_dir), I.KEYWORDS, doc_id="doc_id")
    return scored.select(
        "doc_id", "keyword", F.round("relevance", 6).alias("relevance"), "is_relevant"
    )


@query(
    "bm25_rank",
    f"""WITH {I.SQL_CLEANED}, {I.SQL_KEYWORDS},
        split AS (SELECT doc_id, {I.sql_words('readme')} AS tokens FROM cleaned),
        corpus AS (SELECT count(*) AS n, avg(len(tokens)) AS avg_len FROM split),
        pairs AS (SELECT doc_id, ord, keyword, len(tokens) AS dl,
          len(list_filter(tokens, lambda t: t = keyword)) AS tf FROM split CROSS JOIN keywords),
        hits AS (SELECT *, count(*) OVER (PARTITION BY ord) AS df FROM pairs WHERE tf > 0),
        scored AS (SELECT doc_id, ord, keyword, round(ln((n - df + 0.5) / (df + 0.5) + 1)
          * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len)), 6) AS score FROM hits, corpus),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, doc_id) AS rank
          FROM scored)
        SELECT doc_id, keyword, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10""",
)
def bm25_rank(spark, sf_dir):
    ranked = W.bm25_rank(I.cleaned(spark, sf_dir), I.KEYWORDS, 10, "doc_id")
    return ranked.select("doc_id", "keyword", "score", "rank")


# --- categories -------------------------------------------------------------

_SQL_CATEGORY_BM25 = f"""{I.SQL_CATEGORIES},
  wanted AS (SELECT ord, unnest({I.sql_words('words')}) AS word FROM categories),
  found AS (SELECT doc_id, unnest({I.sql_words('readme')}) AS word FROM cleaned),
  counts AS (SELECT doc_id, word, count(*) AS tf FROM found GROUP BY ALL),
  bm25 AS (SELECT d.doc_id, w.ord, round(sum({_sql_squashed('coalesce(tf, 0)')}), 6) AS bm25
    FROM cleaned d CROSS JOIN wanted w LEFT JOIN counts c ON c.doc_id = d.doc_id AND c.word = w.word
    GROUP BY ALL)"""


def _sql_cosine(source: str, text: str) -> str:
    """Cosines of the texts of ``source`` with the categories."""
    return f"""category_terms AS (SELECT ord, unnest({I.sql_terms('words')}) AS term FROM categories),
  category_counts AS (SELECT ord, term, count(*) AS n FROM category_terms GROUP BY ALL),
  idf AS (SELECT term, ln((1 + (SELECT count(*) FROM categories)) / (1 + count(*))) + 1 AS idf
    FROM category_counts GROUP BY term),
  category_weights AS (SELECT ord, term, n * idf / sqrt(sum((n * idf) ** 2) OVER (PARTITION BY ord)) AS w
    FROM category_counts JOIN idf USING (term)),
  text_terms AS (SELECT doc_id, unnest({I.sql_terms(text)}) AS term FROM {source}),
  text_counts AS (SELECT doc_id, term, count(*) AS m FROM text_terms GROUP BY ALL),
  text_weights AS (SELECT doc_id, term, m * idf / sqrt(sum((m * idf) ** 2) OVER (PARTITION BY doc_id)) AS w
    FROM text_counts JOIN idf USING (term)),
  dots AS (SELECT doc_id, ord, sum(t.w * c.w) AS s FROM text_weights t JOIN category_weights c
    USING (term) GROUP BY ALL),
  cosine AS (SELECT d.doc_id, c.ord, c.category, round(coalesce(s, 0), 6) AS cosine
    FROM {source} d CROSS JOIN categories c
    LEFT JOIN dots ON dots.doc_id = d.doc_id AND dots.ord = c.ord)"""


def sql_cosine_label(source: str, text: str) -> str:
    return f"""{I.SQL_CATEGORIES}, {_sql_cosine(source, text)},
  placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, ord) AS n FROM cosine),
  labelled AS (SELECT doc_id, category AS class_label, cosine AS class_score FROM placed WHERE n = 1)"""


def _scaled(score: str) -> str:
    low, high = (f"{f}({score}) OVER (PARTITION BY doc_id)" for f in ("min", "max"))
    return f"CASE WHEN {low} = {high} THEN 1 ELSE ({score} - {low}) / ({high} - {low}) END"


@query(
    "category_bm25",
    f"""WITH {I.SQL_CLEANED}, {_SQL_CATEGORY_BM25}
        SELECT doc_id, category, bm25 FROM bm25 JOIN categories USING (ord)""",
)
def category_bm25(spark, sf_dir):
    scored = I.cleaned(spark, sf_dir).select("doc_id", K.words("readme").alias("w"))
    scored = scored.select("doc_id", S.rounded(S.category_bm25("w", I.CATEGORIES)).alias("s"))
    return K.scores_by_category(scored, I.CATEGORIES, bm25="s").drop("ord")


@query(
    "minmax_normalize",
    f"""WITH {I.SQL_CLEANED}, {_SQL_CATEGORY_BM25}
        SELECT doc_id, category, round({_scaled('bm25')}, 6) AS scaled
        FROM bm25 JOIN categories USING (ord)""",
)
def minmax_normalize(spark, sf_dir):
    scored = I.cleaned(spark, sf_dir).select("doc_id", K.words("readme").alias("w"))
    scored = scored.select("doc_id", S.rounded(S.category_bm25("w", I.CATEGORIES)).alias("s"))
    scaled = scored.select("doc_id", S.rounded(S.min_max("s")).alias("s"))
    return K.scores_by_category(scaled, I.CATEGORIES, scaled="s").drop("ord")


@query(
    "classify_text",
    f"""WITH {I.SQL_CLEANED}, {sql_cosine_label('cleaned', 'readme')}
        SELECT doc_id, class_label, class_score FROM labelled""",
)
def classify_text(spark, sf_dir):
    return K.classify_text(I.cleaned(spark, sf_dir), I.CATEGORIES, "readme").drop("readme")


@query(
    "classify_hybrid",
    f"""WITH {I.SQL_CLEANED}, {_SQL_CATEGORY_BM25}, {_sql_cosine('cleaned', 'readme')},
        scaled AS (SELECT doc_id, ord, category, {_scaled('bm25')} AS b, {_scaled('cosine')} AS c
          FROM bm25 JOIN cosine USING (doc_id, ord)),
        scored AS (SELECT doc_id, ord, category,
          round(CAST(0.3 AS DOUBLE) * b + CAST(0.7 AS DOUBLE) * c, 9) AS score FROM scaled),
        placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS n FROM scored)
        SELECT doc_id, category AS class_label, score AS class_score FROM placed WHERE n = 1""",
)
def classify_hybrid(spark, sf_dir):
    docs = I.cleaned(spark, sf_dir)
    return K.classify_text(docs, I.CATEGORIES, "readme", use_bm25=True).drop("readme")


# --- vectors ----------------------------------------------------------------

_SQL_CENTROIDS = """parts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
    generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
  means AS (SELECT label, pos, avg(x) AS mean FROM parts GROUP BY ALL),
  centroids AS (SELECT label, list(mean ORDER BY pos) AS centroid FROM means GROUP BY label)"""
_SQL_SIMILAR = f"""{_SQL_CENTROIDS}, similar_ AS (SELECT vec_id, e.label AS own, c.label AS label,
    round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) + 0 AS score
    FROM embeddings e CROSS JOIN centroids c)"""


def _vectors(spark, sf_dir):
    return I.table(spark, sf_dir, "embeddings")


@query(
    "l2_normalize",
    """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[],
         embedding::DOUBLE[])) AS norm FROM embeddings),
       x AS (SELECT vec_id, norm, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM n)
       SELECT vec_id, CAST(pos AS INTEGER) AS pos,
              round(CASE WHEN norm = 0 THEN x ELSE x / norm END, 6) + 0 AS value FROM x""",
)
def normalized(spark, sf_dir):
    unit = _vectors(spark, sf_dir).select("vec_id", l2_normalize("embedding").alias("v"))
    values = unit.select("vec_id", F.posexplode("v").alias("pos", "value"))
    return values.withColumn("value", F.round("value", 6))


@query(
    "label_centroids",
    f"""WITH {_SQL_CENTROIDS} SELECT label, CAST(pos AS INTEGER) AS pos, round(mean, 6) + 0 AS mean FROM means""",
)
def label_centroids(spark, sf_dir):
    centroids = N.label_centroids(_vectors(spark, sf_dir))
    values = centroids.select("label", F.posexplode("centroid").alias("pos", "mean"))
    return values.withColumn("mean", F.round("mean", 6))


@query(
    "cosine_pairs",
    f"WITH {_SQL_SIMILAR} SELECT vec_id, label, score AS cosine FROM similar_ WHERE own = label",
)
def cosine_pairs(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    prototypes = cut_lineage(N.label_centroids(vectors))
    similar = N.prototype_similarity(vectors, prototypes)
    return similar.select("vec_id", "label", F.round("cosine", 6).alias("cosine"))


@query(
    "classify_embedding",
    f"""WITH {_SQL_SIMILAR}, placed AS (SELECT *,
          row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS n FROM similar_)
        SELECT vec_id, label, score FROM placed WHERE n = 1""",
)
def classify_embedding(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return N.nearest_prototype(vectors, N.label_centroids(vectors))


@query(
    "knn_topk",
    f"""WITH {_SQL_SIMILAR}, placed AS (SELECT *,
          row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM similar_)
        SELECT label AS query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM placed WHERE rank <= 10""",
)
def knn_topk(spark, sf_dir):
    """The ten vectors nearest to the middle of every label."""
    vectors = _vectors(spark, sf_dir)
    queries = N.label_centroids(vectors).select(
        F.col("label").alias("query_id"), F.col("centroid").alias("embedding")
    )
    return N.knn_topk(vectors, queries, 10)


# --- similar texts ----------------------------------------------------------

# Least cosine, in hundredths, of similar documents, and of a document and a question.
_SIMILAR, _ANSWERING = 60, 30


@query(
    "similar_documents",
    f"""WITH {I.SQL_CLEANED},
        split AS (SELECT doc_id, list_sort(list_distinct({I.sql_terms('readme')})) AS terms FROM cleaned),
        classed AS (SELECT doc_id, terms, len(terms) AS n, min(doc_id) OVER (PARTITION BY terms) AS class_id FROM split),
        placed AS (SELECT class_id, n, unnest(terms) AS term FROM classed WHERE doc_id = class_id),
        pairs AS (SELECT a.class_id AS a, b.class_id AS b FROM placed a JOIN placed b USING (term)
          WHERE a.class_id <> b.class_id GROUP BY a.class_id, b.class_id, a.n, b.n
          HAVING 10000 * count(*) * count(*) >= {_SIMILAR ** 2} * a.n * b.n),
        links AS (SELECT a AS class_id, count(*) AS n_links FROM pairs GROUP BY a)
        SELECT doc_id, class_id, n AS n_terms, coalesce(n_links, 0) AS n_links
        FROM classed LEFT JOIN links USING (class_id)""",
)
def similar_documents(spark, sf_dir):
    """Every document's class of equal terms and how many other classes are similar."""
    return J.similar_rows(I.cleaned(spark, sf_dir), _SIMILAR, "doc_id", "readme")
