"""The shared tables, read by column, and their catalog-shaped projection."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoatlas.functions.text import clean_readme, lead_sentences
from repoatlas.session import spread

AS_OF = "2024-12-31"
BATCH_TS = "2025-01-01 00:00:00"
# Events before this moment are the known state, later ones come in.
CUTOVER = "2024-01-16 00:00:00"
KEYWORDS = ["that", "tion", "oder", "les", "una", "de la"]
CATEGORIES = [
    ("English", "the of and to that, with the for"),
    ("French", "le la les des et que pour la"),
    ("German", "der die und den zu von mit"),
    ("Spanish", "el la los que y en del"),
    ("Mixed", "de en la que the der"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents spread over all cores, for the work on their texts."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", clean_readme("text").alias("readme"))


def catalog(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """Documents as catalog rows; ``wide`` keeps the columns made of the text."""
    documents = texts(spark, sf_dir) if wide else table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(365)).cast("int"))
    columns = {
        "id": F.col("doc_id"),
        "seq": F.col("doc_id"),
        "url": F.concat(
            F.lit("https://example.org/"), "source", F.lit("/repo-"), F.col("doc_id").cast("string")
        ),
        "stars_count": F.col("n_chars"),
        "language": F.col("lang"),
        "updated_at": day.cast("timestamp_ntz"),
        "pushed_at": day.cast("timestamp_ntz"),
        "class_label": F.concat(F.lit("Topic "), "source"),
    }
    if wide:
        columns["readme"] = F.col("text")
        columns["brief_desc"] = lead_sentences("text")
    rows = documents.select("doc_id", *[c.alias(n) for n, c in columns.items()])
    labels = table(spark, sf_dir, "labels").select(
        "doc_id",
        (
            F.lit(0.3) + F.lit(0.4) * F.col("quality") - F.lit(0.2) * F.col("toxic")
        ).alias("relevance"),
        "toxic",
    )
    return rows.join(labels, "doc_id", "left").drop("doc_id")


def ignored_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog rows marked toxic, as an exclusion list with repeats."""
    marked = catalog(spark, sf_dir).filter(F.col("toxic") == 1).select("url")
    return marked.union(marked)


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings of a repository (user) by a keyword (event type)."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("event_type").alias("keyword"), "ts", "event_id"
    )


SIGHTING_ORDER = ["ts", "event_id"]


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as work items of a repository (customer)."""
    state = F.when(F.col("o_orderstatus") == "O", "open").when(
        F.col("o_orderstatus") == "F", "closed"
    ).otherwise("merged")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"),
        F.when(F.col("o_totalprice") > 150_000, "pull").otherwise("issue").alias("kind"),
        state.alias("state"),
        F.col("o_orderpriority").alias("contributor"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("https://example.org/"), "c_mktsegment", F.lit("/"), "c_name").alias("url"),
    )


# --- the same inputs in SQL -------------------------------------------------

SPACE_CLASS = (
    r"\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def sql_clean(text: str) -> str:
    flat = f"trim(regexp_replace({text}, '[{SPACE_CLASS},]+', ' ', 'g'))"
    unfenced = f"regexp_replace({flat}, '(?s)```.*?```', ' ', 'g')"
    return f"regexp_replace({unfenced}, '[^a-zA-Z0-9.,!?{SPACE_CLASS}]+', ' ', 'g')"


def sql_clean_readme(text: str) -> str:
    return sql_clean(sql_clean(f"lower({text})"))


def sql_lead(text: str, count: int = 3) -> str:
    flat = f"trim(regexp_replace({text}, '[{SPACE_CLASS}]+', ' ', 'g'))"
    marked = f"regexp_replace({flat}, '([.!?]) ', '\\1' || chr(10), 'g')"
    return f"array_to_string(string_split({marked}, chr(10))[1:{count}], ' ')"


def sql_words(text: str) -> str:
    return f"regexp_extract_all({text}, '[^{SPACE_CLASS}]+')"


def sql_terms(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9_]{{2,}}')"


def sql_values(rows: list[tuple]) -> str:
    """A VALUES list with quoted texts."""

    def cell(value) -> str:
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)

    return "VALUES " + ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows)


SQL_CLEANED = f"cleaned AS (SELECT doc_id, {sql_clean_readme('text')} AS readme FROM documents)"
SQL_KEYWORDS = f"keywords(ord, keyword) AS ({sql_values(list(enumerate(KEYWORDS)))})"
SQL_CATEGORIES = (
    "categories(ord, category, words) AS ("
    + sql_values([(i, *c) for i, c in enumerate(CATEGORIES)])
    + ")"
)
SQL_CATALOG = f"""catalog AS (
  SELECT doc_id AS id, doc_id AS seq,
         'https://example.org/' || source || '/repo-' || doc_id AS url,
         n_chars AS stars_count, lang AS language, text AS readme,
         CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS TIMESTAMP) AS updated_at,
         CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS TIMESTAMP) AS pushed_at,
         'Topic ' || source AS class_label,
         {sql_lead('text')} AS brief_desc,
         CAST(0.3 AS DOUBLE) + CAST(0.4 AS DOUBLE) * quality - CAST(0.2 AS DOUBLE) * toxic AS relevance,
         toxic
  FROM documents LEFT JOIN labels USING (doc_id))"""
SQL_IGNORED = "ignored AS (SELECT url FROM catalog WHERE toxic = 1)"
SQL_SIGHTINGS = (
    "sightings AS (SELECT user_id AS id, event_type AS keyword, ts, event_id FROM events)"
)
