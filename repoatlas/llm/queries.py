"""The operators as registered queries over whole tables, with their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoatlas.llm import (
    alignment,
    exact_dedup,
    hard_negatives,
    langid,
    nbest,
    packing,
    pii,
    quality_model,
    quality_rules,
    sharding,
    simhash,
    substring_dedup,
    token_counts,
)
from repoatlas.llm.quality_rules import (
    BOILERPLATE,
    DECORATION,
    LINE_END,
    MAX_DECORATION_PER_WORD,
    MAX_LOSS,
    MAX_REPEAT_PERCENT,
    MAX_SENTENCE_WORDS,
    MIN_SEPARATORS,
    MIN_WORDS,
    SENTENCE_END,
    SEPARATORS,
    SPACE,
    SYMBOLS,
    WORDS_PER_SEPARATOR,
)
from repoatlas.llm.tasks import documents

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


# DuckDB's lower() also changes letters beyond A-Z, which translate() leaves.
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op6_exact_dedup",
    f"""
    WITH t AS (SELECT doc_id, sha256({LOW}) AS text_sha256, {LOW} AS content FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM t WINDOW g AS (PARTITION BY content)
    """,
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, sf_dir), keep="largest")


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query("op8_jump_sharding")
def op8_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_slots(documents(spark, sf_dir), shards=24)


# The word and line rules of ``quality_rules``; this engine's patterns know no
# possessive repeats, which change nothing here.
QUALITY_SQL = f"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM t),
    places AS (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w),
    windows AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM places),
    repeated AS (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows
                 QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
    n_repeated AS (SELECT r, count(DISTINCT p) AS n FROM repeated GROUP BY r),
    lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
    worded AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines
               WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
    trimmed AS (SELECT r, regexp_replace(line, '^{SPACE}|{SPACE}$', '', 'g') AS line FROM lines),
    counted AS (SELECT *, len(string_split_regex(line, '{SPACE}')) AS words,
                       len(regexp_extract_all(line, '{DECORATION}')) AS decorated,
                       len(regexp_extract_all(line, '{SENTENCE_END}')) AS sentences,
                       len(regexp_extract_all(line, '{SEPARATORS}')) AS separators FROM trimmed),
    passed AS (SELECT r, sum(len(regexp_replace(line, '{SPACE}', '', 'g'))) AS n FROM counted
               WHERE line = '' OR NOT ((NOT regexp_matches(line, '{LINE_END.replace("*+", "*").replace("'", "''")}')
                      AND sentences * {MAX_SENTENCE_WORDS} < words)
                     OR decorated > {MAX_DECORATION_PER_WORD} * words
                     OR (separators >= {MIN_SEPARATORS} AND separators * {WORDS_PER_SEPARATOR} >= words)
                     OR regexp_matches(lower(line), '{"|".join(BOILERPLATE)}')) GROUP BY r),
    base AS (SELECT w.r, doc_id, text, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
                    len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols,
                    coalesce(worded.n, 0)::BIGINT AS n_dup_lines, coalesce(n_repeated.n, 0)::BIGINT AS n_repeat_words,
                    coalesce(passed.n, 0) AS kept_chars
             FROM w LEFT JOIN worded USING (r) LEFT JOIN n_repeated USING (r) LEFT JOIN passed USING (r)),
    judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND (word_chars = 0 OR kept_chars / word_chars >= {1 - MAX_LOSS}) AS kept FROM judged
"""


@query("op1_quality_rules", QUALITY_SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(documents(spark, sf_dir)).drop("kept_share")


@query("op2_bootstrapped_pii")
def op2_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(documents(spark, sf_dir))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(documents(spark, sf_dir))


@query("op4_quality_gam")
def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model.quality_scores(documents(spark, sf_dir), labels)


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


@query("op9_nbest_pieces")
def op9_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.encoding_report(documents(spark, sf_dir))


NEGATIVES_SQL = """
    WITH usable AS (SELECT vec_id, label, embedding FROM embeddings
         WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scaled AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM usable),
    scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                      CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
               FROM scaled a JOIN scaled b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
                  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT anchor_id, positive_id,
           CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
           other_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, label_of=moved)


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(documents(spark, sf_dir))


PASSAGES_SQL = """
    WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM t),
    grams AS (SELECT doc_id, i, string_agg(word, ' ') OVER f AS gram, count(*) OVER f AS n FROM w
              WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
    later AS (SELECT doc_id, i, true AS repeats FROM grams WHERE n = 20
              QUALIFY row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) > 1),
    marked AS (SELECT doc_id, i, word, coalesce(bool_or(repeats) OVER (PARTITION BY doc_id ORDER BY i
                      ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
               FROM w LEFT JOIN later USING (doc_id, i)),
    told AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
                    string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256
    FROM documents LEFT JOIN told USING (doc_id)
"""


@query("op13_substring_dedup", PASSAGES_SQL)
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passage_report(documents(spark, sf_dir))
