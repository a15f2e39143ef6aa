"""Catalog, history, report and streaming queries."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from repoatlas.fixed_values import REPORT_CONTENTS_TITLE, REPORT_TITLE
from repoatlas.functions.encoding import parse_score_response, row_document
from repoatlas.functions.text import date_floor, distinct_phrases, repo_name, run_name
from repoatlas.operators import catalog as C
from repoatlas.operators import report as R
from repoatlas.operators import upsert as U
from repoatlas.operators.classify import enrich_catalog
from repoatlas.operators.dedupe import dedupe_first, duplicate_rows, text_key
from repoatlas.operators.skew import number_rows
from repoatlas.operators.keywords import keyword_match, resume_matches, resume_pages
from repoatlas.plans import inputs as I
from repoatlas.plans.registry import query
from repoatlas.plans.score_queries import sql_cosine_label
from repoatlas.plans.text_queries import _RESPONSE, with_response
from repoatlas.schemas import EXPORT_CSV_SCHEMA
from repoatlas.session import use_checkpoint_folder, written
from repoatlas.sources import readers, writers
from repoatlas.streaming import ingest, paged_source

PAGE_SIZE = 30
SEARCH_PAGE_SIZE = 5
HEADER = ["url", "license", "relevance", "language"]


def _day(column: str):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


# --- reading and shaping ----------------------------------------------------


@query(
    "conform_columns",
    f"""WITH {I.SQL_CATALOG} SELECT url, '' AS license,
        coalesce(CAST(relevance >= 0.4 AS VARCHAR), '') AS relevance, language FROM catalog""",
)
def conform_columns(spark, sf_dir):
    rows = I.catalog(spark, sf_dir).withColumn("relevance", F.col("relevance") >= 0.4)
    return U.conform_columns(rows, HEADER)


@query(
    "apply_defaults",
    f"""WITH {I.SQL_CATALOG} SELECT id, url, 'Unknown License' AS license,
        coalesce(stars_count, 0) AS stars_count, coalesce(toxic, 0) AS forks_count,
        CASE WHEN toxic IS NULL THEN '2025-01-01 00:00:00'
             ELSE strftime(updated_at, '%Y-%m-%d 00:00:00') END AS created_at FROM catalog""",
)
def apply_defaults(spark, sf_dir):
    """Rows without a label know neither license, forks nor creation time."""
    rows = I.catalog(spark, sf_dir).select(
        "id", "url", F.lit(None).cast("string").alias("license"), "stars_count",
        F.col("toxic").alias("forks_count"),
        F.when(F.col("toxic").isNotNull(), F.col("updated_at")).alias("created_at"),
    )
    filled = U.apply_defaults(rows, I.BATCH_TS)
    return filled.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "row_to_document",
    f"""WITH {I.SQL_CATALOG} SELECT id, 'url: ' || url || chr(10) || 'stars_count: ' || stars_count
        || chr(10) || 'language: ' || language || chr(10) || 'toxic: ' || coalesce(CAST(toxic AS VARCHAR), '')
        || chr(10) || 'brief_desc: ' || brief_desc AS document FROM catalog""",
)
def row_to_document(spark, sf_dir):
    columns = ["url", "stars_count", "language", "toxic", "brief_desc"]
    rows = I.catalog(spark, sf_dir, wide=True)
    return rows.select("id", row_document(columns).alias("document"))


_PAGE_PATH = r"^https?://[^/]+/([^?#]*).*$"


@query(
    "path_filter",
    f"""WITH p AS (SELECT page_id, regexp_extract(url, '{_PAGE_PATH}', 1) AS path FROM pages)
        SELECT page_id, path FROM p
        WHERE (path LIKE 'en/%' OR path LIKE 'fr/%') AND (path LIKE '%.html' OR path LIKE '%/')""",
)
def path_filter(spark, sf_dir):
    pages = I.table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", _PAGE_PATH, 1).alias("path")
    )
    return C.path_filter(pages, "path", ["en", "fr"], [".html", "/"])


@query(
    "union_batches",
    """SELECT doc_id, source, lang, n_chars FROM documents WHERE lang = 'en' UNION ALL
       SELECT doc_id, NULL, lang, n_chars FROM documents WHERE lang <> 'en'""",
)
def union_batches(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    english = docs.filter(F.col("lang") == "en")
    return C.union_batches(english, docs.filter(F.col("lang") != "en").drop("source"))


# --- searching and counting -------------------------------------------------


@query(
    "catalog_search",
    f"""WITH {I.SQL_CATALOG} SELECT id, url, stars_count, strftime(updated_at, '%Y-%m-%d') AS updated_at
        FROM catalog WHERE contains(lower(readme), 'that') AND stars_count >= 300
        AND pushed_at >= DATE '{I.AS_OF}' - 183""",
)
def catalog_search(spark, sf_dir):
    found = C.catalog_search(I.catalog(spark, sf_dir, wide=True), "that", 300, 183, I.AS_OF)
    return found.select("id", "url", "stars_count", _day("updated_at"))


@query(
    "catalog_pages",
    f"""WITH {I.SQL_CATALOG} SELECT id, row_number() OVER (ORDER BY updated_at DESC, id) - 1 AS position,
        (row_number() OVER (ORDER BY updated_at DESC, id) - 1) // {PAGE_SIZE} AS page FROM catalog""",
)
def catalog_pages(spark, sf_dir):
    rows = I.catalog(spark, sf_dir).select("id", "updated_at")
    return C.catalog_pages(rows, PAGE_SIZE).drop("updated_at")


@query(
    "top_k",
    f"""WITH {I.SQL_CATALOG} SELECT id, url, stars_count FROM catalog
        ORDER BY stars_count DESC NULLS LAST, id LIMIT 20""",
)
def top_k(spark, sf_dir):
    rows = I.catalog(spark, sf_dir).select("id", "url", "stars_count")
    return C.top_k(rows, 20, "stars_count")


@query(
    "relevance_cutoff",
    f"WITH {I.SQL_CATALOG} SELECT id, round(relevance, 6) AS relevance FROM catalog WHERE relevance >= 0.4",
)
def relevance_cutoff(spark, sf_dir):
    kept = C.relevance_cutoff(I.catalog(spark, sf_dir))
    return kept.select("id", F.round("relevance", 6).alias("relevance"))


@query(
    "exclude_list",
    f"""WITH {I.SQL_CATALOG}, {I.SQL_IGNORED} SELECT id, url FROM catalog
        WHERE url NOT IN (SELECT url FROM ignored)""",
)
def exclude_list(spark, sf_dir):
    rows = I.catalog(spark, sf_dir).select("id", "url")
    return C.exclude_urls(rows, I.ignored_urls(spark, sf_dir))


@query(
    "new_rows_anti",
    """SELECT doc_id AS id, source FROM documents
       WHERE doc_id NOT IN (SELECT DISTINCT doc_id FROM labels)""",
)
def new_rows_anti(spark, sf_dir):
    """Documents the labelled history has never seen."""
    current = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    seen = I.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return C.new_rows(current, seen)


@query(
    "catalog_counts",
    f"""WITH {I.SQL_CATALOG} SELECT count(*) AS row_count, count(DISTINCT url) AS url_count FROM catalog""",
)
def catalog_counts(spark, sf_dir):
    return C.catalog_counts(I.catalog(spark, sf_dir))


@query("distinct_keywords", "SELECT DISTINCT event_type AS keyword FROM events")
def distinct_keywords(spark, sf_dir):
    return C.distinct_keywords(I.sightings(spark, sf_dir))


_SQL_STATES = """states AS (SELECT o_custkey AS id,
  count(*) FILTER (o_orderstatus = 'O') AS open_issues,
  count(*) FILTER (o_orderstatus = 'F') AS closed_issues,
  count(*) FILTER (o_totalprice > 150000) AS pulls, count(DISTINCT o_orderpriority) AS contributors FROM orders GROUP BY o_custkey)"""


@query("state_counts", f"WITH {_SQL_STATES} SELECT * FROM states")
def state_counts(spark, sf_dir):
    return C.state_counts(I.activity(spark, sf_dir))


@query(
    "repo_detail_view",
    f"""WITH {_SQL_STATES} SELECT c_custkey AS id, c_mktsegment || '/' || c_name AS full_name,
        coalesce(open_issues, 0) AS open_issues, coalesce(closed_issues, 0) AS closed_issues,
        coalesce(pulls, 0) AS pulls, coalesce(contributors, 0) AS contributors
        FROM customer LEFT JOIN states ON c_custkey = id""",
)
def repo_detail_view(spark, sf_dir):
    view = C.repo_detail_view(I.customers(spark, sf_dir), I.activity(spark, sf_dir))
    return view.drop("url")


# --- first rows and duplicates ----------------------------------------------


def _copies(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select(
        text_key("text").alias("key"), F.col("doc_id").alias("seq"), "source", "n_chars"
    )


_SQL_COPIES = (
    "copies AS (SELECT doc_id AS seq, source, n_chars,"
    " row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents)"
)


@query("dedupe_first", f"WITH {_SQL_COPIES} SELECT seq, source, n_chars FROM copies WHERE n = 1")
def first_copies(spark, sf_dir):
    return dedupe_first(_copies(spark, sf_dir), "key").drop("key")


@query("duplicate_rows", f"WITH {_SQL_COPIES} SELECT seq, source, n_chars FROM copies WHERE n > 1")
def later_copies(spark, sf_dir):
    return duplicate_rows(_copies(spark, sf_dir), "key").drop("key")


# --- keywords, upsert, history ----------------------------------------------

_SQL_ROLLUP = """SELECT id, first(keyword ORDER BY ts, event_id) AS keyword,
         list(DISTINCT keyword) AS keywords FROM {0} GROUP BY id"""


def _sql_rest(keyword: str, keywords: str) -> str:
    return (
        f"array_to_string(list_sort(list_filter(list_distinct({keywords}),"
        f" lambda k: k <> {keyword} AND k <> '')), '|')"
    )


_SQL_ALL_ROLLED = f"""WITH {I.SQL_SIGHTINGS}, r AS ({_SQL_ROLLUP.format('sightings')})
    SELECT id, keyword, {_sql_rest('keyword', 'keywords')} AS additional_keywords FROM r"""


@query("keyword_rollup", _SQL_ALL_ROLLED)
def keyword_rollup(spark, sf_dir):
    return U.keyword_rollup(I.sightings(spark, sf_dir), I.SIGHTING_ORDER)


@query(
    "catalog_upsert",
    f"""WITH {I.SQL_SIGHTINGS},
        before AS (SELECT * FROM sightings WHERE ts < TIMESTAMP '{I.CUTOVER}'),
        after AS (SELECT * FROM sightings WHERE ts >= TIMESTAMP '{I.CUTOVER}'),
        cur AS ({_SQL_ROLLUP.format('before')}), inc AS ({_SQL_ROLLUP.format('after')}),
        merged AS (SELECT id, coalesce(cur.keyword, inc.keyword) AS keyword,
          list_concat(coalesce(cur.keywords, []), coalesce(inc.keywords, [])) AS keywords
          FROM cur FULL JOIN inc USING (id))
        SELECT id, keyword, {_sql_rest('keyword', 'keywords')} AS additional_keywords FROM merged""",
)
def catalog_upsert(spark, sf_dir):
    seen = I.sightings(spark, sf_dir)
    cutover = F.lit(I.CUTOVER).cast("timestamp_ntz")
    current = U.keyword_rollup(seen.filter(F.col("ts") < cutover), I.SIGHTING_ORDER)
    incoming = U.keyword_rollup(seen.filter(F.col("ts") >= cutover), I.SIGHTING_ORDER)
    return U.catalog_upsert(current, incoming)


@query(
    "history_append",
    f"""WITH {I.SQL_SIGHTINGS} SELECT id, keyword, CAST(30 AS BIGINT) AS num_stars,
          CAST(183 AS BIGINT) AS days_ago,
          CASE WHEN ts < TIMESTAMP '{I.CUTOVER}' THEN '2024-01-16 00:00:00' ELSE '{I.BATCH_TS}' END AS timestamp
        FROM sightings""",
)
def history_append(spark, sf_dir):
    """The history of the first batch with the second one appended."""
    seen = I.sightings(spark, sf_dir)
    cutover = F.lit(I.CUTOVER).cast("timestamp_ntz")
    old = U.history_rows(seen.filter(F.col("ts") < cutover), 30, 183, I.CUTOVER)
    new = U.history_rows(seen.filter(F.col("ts") >= cutover), 30, 183, I.BATCH_TS)
    both = C.union_batches(old, new)
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp")
    return both.select("id", "keyword", "num_stars", "days_ago", stamp)


_SQL_WORK = f"""work AS (SELECT id, ord, keyword,
    (row_number() OVER (PARTITION BY ord ORDER BY updated_at DESC, id) - 1) // {PAGE_SIZE} AS page
    FROM catalog JOIN keywords ON contains(readme, keyword))"""


@query(
    "resume_pages",
    f"""WITH {I.SQL_CATALOG}, {I.SQL_KEYWORDS}, {_SQL_WORK}
        SELECT id, ord, keyword, page FROM work WHERE ord > 1 OR (ord = 1 AND page >= 2)""",
)
def pages_to_resume(spark, sf_dir):
    """Every keyword's matches in pages, from page 2 of the second keyword on."""
    rows = I.catalog(spark, sf_dir, wide=True).select("id", "updated_at", "readme")
    matches = resume_matches(keyword_match(rows, I.KEYWORDS), I.KEYWORDS, I.KEYWORDS[1])
    work = C.catalog_pages(matches, PAGE_SIZE, group="ord")
    left = resume_pages(work, I.KEYWORDS, I.KEYWORDS[1], 2)
    return left.select("id", "ord", "keyword", "page")


# --- enrichment and reports -------------------------------------------------


@query(
    "enrich_catalog",
    f"""WITH r AS (SELECT doc_id, {I.sql_lead('text')} AS brief_desc,
          string_split(regexp_replace({_RESPONSE}, '^\\s+|\\s+$', '', 'g'), chr(10))[1] AS line FROM documents),
        s AS (SELECT doc_id, brief_desc,
          TRY_CAST(regexp_extract(line, 'Relevancy_score\\s*=\\s*([\\d.]+)', 1) AS DOUBLE) AS score FROM r),
        {sql_cosine_label('s', 'brief_desc')}
        SELECT doc_id AS id, coalesce(score, CAST(0.1234 AS DOUBLE)) AS relevance, brief_desc, class_label
        FROM s JOIN labelled USING (doc_id)""",
)
def enriched(spark, sf_dir):
    docs = with_response(I.texts(spark, sf_dir)).select(
        F.col("doc_id").alias("id"), F.col("text").alias("readme"), "response"
    )
    relevance = parse_score_response("response").getField("score")
    rows = enrich_catalog(docs, relevance, categories=I.CATEGORIES)
    return rows.select("id", "relevance", "brief_desc", "class_label")


_ENTRY = """chr(10) || '- **[' || string_split(url, '/')[-1] || '](' || url || ')** - ' || brief_desc
  || ' ![GitHub stars](https://img.shields.io/badge/stars-' || stars_count || '-blue)' || chr(10)
  || '    - Components: ' || language || ', ' || chr(10) || '    - auto_generated = True' || chr(10)"""


def _report_catalog(spark, sf_dir):
    return I.catalog(spark, sf_dir, wide=True).select(
        "seq", "url", "stars_count", "class_label", "brief_desc", "relevance",
        F.col("language").alias("keyword"), F.lit("").alias("additional_keywords"),
    )


@query(
    "report_toc",
    f"""WITH {I.SQL_CATALOG} SELECT class_label, min(seq) AS section_seq, count(*) AS entries,
        replace(lower(class_label), ' ', '-') AS anchor FROM catalog GROUP BY class_label""",
)
def report_toc(spark, sf_dir):
    return R.report_toc(I.catalog(spark, sf_dir))


@query(
    "report_sections",
    f"""WITH {I.SQL_CATALOG} SELECT class_label, min(seq) OVER (PARTITION BY class_label) AS section_seq,
        seq, {_ENTRY} AS line FROM catalog""",
)
def report_sections(spark, sf_dir):
    rows = _report_catalog(spark, sf_dir)
    return R.report_sections(rows, R.catalog_entry("Components"))


def _sql_lines(*selects: str) -> str:
    head = f"""SELECT 0 AS block, CAST(0 AS BIGINT) AS section_seq, CAST(0 AS BIGINT) AS seq,
        '{REPORT_TITLE}' || chr(10) AS line
      UNION ALL SELECT 0, 0, 1, '{R.DEFAULT_INTRO}' || chr(10)
      UNION ALL SELECT 1, -1, -1, '{REPORT_CONTENTS_TITLE}' || chr(10)"""
    return " UNION ALL ".join([head, *selects])


_LAST = (1 << 63) - 1


@query(
    "report_db",
    f"""WITH {I.SQL_CATALOG}, {I.SQL_IGNORED},
        listed AS (SELECT * FROM catalog WHERE relevance >= 0.4 AND url NOT IN (SELECT url FROM ignored)),
        sections AS (SELECT class_label, min(seq) AS place FROM listed GROUP BY class_label)
        """
    + _sql_lines(
        """SELECT 1, place, place, '- [' || class_label || '](#' || replace(lower(class_label), ' ', '-')
           || ')' FROM sections""",
        f"SELECT 1, {_LAST}, 0, ''",
        "SELECT 2, place, -1, '### ' || class_label || chr(10) FROM sections",
        f"SELECT 2, place, seq, {_ENTRY} FROM listed JOIN sections USING (class_label)",
        f"SELECT 2, place, {_LAST}, '' FROM sections",
    ),
)
def report_db(spark, sf_dir):
    return R.report_db(_report_catalog(spark, sf_dir), I.ignored_urls(spark, sf_dir))


@query(
    "report_csv",
    f"""WITH {I.SQL_CATALOG},
        copies AS (SELECT *, row_number() OVER (PARTITION BY readme ORDER BY seq) AS n FROM catalog),
        listed AS (SELECT * FROM copies WHERE n = 1),
        sections AS (SELECT class_label, min(seq) AS place FROM listed GROUP BY class_label)
        """
    + _sql_lines(
        "SELECT 2, place, -1, '### ' || class_label || chr(10) FROM sections",
        """SELECT 2, place, seq, CASE WHEN seq = place THEN '' ELSE ' ' END || '- ['
           || md5(readme) || '](https://example.org/' || md5(readme) || '): License: Other: ' || brief_desc
           || ' ![GitHub stars](https://img.shields.io/badge/stars-' || stars_count || '-blue)' || chr(10)
           || 'Component used : ' || language || ' ' || chr(10) || 'Languages: ' || language || ' '
           FROM listed JOIN sections USING (class_label)""",
        f"SELECT 2, place, {_LAST}, ' ' FROM sections",
    ),
)
def report_csv(spark, sf_dir):
    """Copies of a text share a URL here, so the report leaves the later ones out."""
    rows = I.catalog(spark, sf_dir, wide=True).select(
        "seq",
        F.concat(F.lit("https://example.org/"), F.md5("readme")).alias("repo_url"),
        F.lit("Other").alias("license"),
        F.col("stars_count").alias("num_stars"),
        F.col("language").alias("languages"),
        F.col("language").alias("keyword"),
        "brief_desc",
        F.col("class_label").alias("topic"),
    )
    return R.report_csv(rows)


# --- written and read back --------------------------------------------------


def _legacy_rows(spark, sf_dir):
    """Result rows of the legacy file; French ones know no languages, copies share a URL."""
    rows = I.catalog(spark, sf_dir, wide=True)
    return rows.select(
        F.concat(F.lit("https://example.org/"), F.md5("readme")).alias("repo_url"),
        F.lit("Other").alias("license"),
        F.col("stars_count").cast("string").alias("num_stars"),
        F.lit("0").alias("num_forks"),
        F.date_format("pushed_at", "yyyy-MM-dd").alias("last_push"),
        F.when(F.col("language") != "fr", F.col("language")).alias("languages"),
        F.array("language", F.lit("x")).alias("topics"),
        F.col("language").alias("keyword"),
        F.lit("True").alias("is_relevant"),
        F.col("readme"),
        F.col("brief_desc"),
        F.col("class_label").alias("topic"),
        F.array().cast("array<string>").alias("additional_keywords"),
        "seq",
    )


def _legacy_file(spark, sf_dir) -> str:
    folder = _folder(spark, "legacy")
    # The order of the rows in the file is the order of the report.
    writers.append_legacy_csv(_legacy_rows(spark, sf_dir).orderBy("seq"), folder)
    return folder


@query(
    "legacy_csv_rows",
    f"""WITH {I.SQL_CATALOG} SELECT 'https://example.org/' || md5(readme) AS repo_url,
        CAST(stars_count AS VARCHAR) AS num_stars, CASE WHEN language = 'fr' THEN '' ELSE language END AS languages,
        language || ',x' AS topics, md5(readme) AS readme_md5, brief_desc,
        row_number() OVER (ORDER BY seq) AS place FROM catalog""",
)
def legacy_csv_rows(spark, sf_dir):
    """The legacy file written, and read back with its rows in file order."""
    rows = readers.read_legacy_csv(spark, _legacy_file(spark, sf_dir))
    numbered = number_rows(
        rows.select("repo_url", "num_stars", "languages", "topics", F.md5("readme").alias("readme_md5"), "brief_desc", "seq"),
        [F.col("seq")],
    )
    return numbered.select("*", (F.col("position") + 1).alias("place")).drop("seq", "position")


@query(
    "legacy_csv_report",
    f"""WITH {I.SQL_CATALOG},
        copies AS (SELECT *, row_number() OVER (PARTITION BY readme ORDER BY seq) AS n FROM catalog),
        listed AS (SELECT * FROM copies WHERE n = 1),
        sections AS (SELECT class_label, row_number() OVER (ORDER BY min(seq)) AS place, min(seq) AS first
          FROM listed GROUP BY class_label)
        SELECT place, row_number() OVER (PARTITION BY place ORDER BY seq) AS entry,
          CASE WHEN seq = first THEN '' ELSE ' ' END || '- ['
          || md5(readme) || '](https://example.org/' || md5(readme) || '): License: Other: ' || brief_desc
          || ' ![GitHub stars](https://img.shields.io/badge/stars-' || stars_count || '-blue)' || chr(10)
          || 'Component used : ' || language || ' ' || chr(10) || 'Languages: '
          || CASE WHEN language = 'fr' THEN '' ELSE language END || ' ' AS line
        FROM listed JOIN sections USING (class_label)""",
)
def legacy_csv_report(spark, sf_dir):
    """The legacy file written, read back and reported: the entries of its sections."""
    lines = R.report_csv(readers.read_legacy_csv(spark, _legacy_file(spark, sf_dir)))
    entries = lines.filter((F.col("block") == 2) & (F.col("seq") >= 0) & F.contains("line", F.lit("Component used")))
    place = F.dense_rank().over(Window.orderBy("section_seq"))
    places = entries.select("section_seq").distinct().withColumn("place", place.cast("long"))
    entry = F.row_number().over(Window.partitionBy("section_seq").orderBy("seq")).cast("long")
    return entries.join(places, "section_seq").select("place", entry.alias("entry"), "line")


@query(
    "duplicate_url_list",
    """SELECT 'https://example.org/' || key AS line FROM (SELECT md5(text) AS key,
         row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n > 1""",
)
def duplicate_url_list(spark, sf_dir):
    """The URLs left out as duplicates, as a text file."""
    folder = _folder(spark, "urls")
    rows = I.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("https://example.org/"), F.md5("text")).alias("url"), F.col("doc_id").alias("seq")
    )
    writers.write_url_list(duplicate_rows(rows, "url"), "url", "seq", folder)
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query(
    "export_csv_rows",
    f"""WITH {I.SQL_CATALOG} SELECT id, url, stars_count, language, class_label,
        strftime(updated_at, '%Y-%m-%d') AS updated_at FROM catalog""",
)
def export_csv_rows(spark, sf_dir):
    """The export written and read back with its types."""
    folder = _folder(spark, "export")
    rows = I.catalog(spark, sf_dir)
    names = EXPORT_CSV_SCHEMA.names
    writers.export_csv(rows.select(*[F.col(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names]), folder)
    back = readers.read_export_csv(spark, folder)
    return back.select("id", "url", "stars_count", "language", "class_label", _day("updated_at"))


@query(
    "tsv_repair_rows",
    f"WITH {I.SQL_CATALOG} SELECT url AS repo_url, CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END AS license FROM catalog",
)
def tsv_repair_rows(spark, sf_dir):
    """A file with a column too many and values missing, repaired and read back."""
    folder = _folder(spark, "tsv")
    license_ = F.when(F.col("toxic") == 1, F.lit("toxic")).alias("license")
    writers.repair_tsv(I.catalog(spark, sf_dir).select(F.col("url").alias("repo_url"), "language", license_), folder)
    back = readers.read_tsv(spark, folder)
    return back.select("repo_url", F.coalesce("license", F.lit("")).alias("license"))


@query(
    "history_by_day",
    f"""WITH {I.SQL_SIGHTINGS} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS sightings,
        count(DISTINCT id) AS repositories FROM sightings WHERE ts >= TIMESTAMP '{I.CUTOVER}' GROUP BY day""",
)
def history_by_day(spark, sf_dir):
    """The history written by day, and read from the cutover's day on."""
    folder = _folder(spark, "history")
    seen = I.sightings(spark, sf_dir)
    stamped = seen.select("id", "keyword", F.col("ts").cast("timestamp").alias("timestamp"))
    writers.append_history(stamped, folder)
    days = readers.read_history(spark, folder).filter(F.col("snapshot_date") >= F.lit(I.CUTOVER).cast("date"))
    return days.groupBy(F.date_format("snapshot_date", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("sightings"), F.countDistinct("id").alias("repositories")
    )


@query(
    "replaced_table",
    f"WITH {I.SQL_CATALOG} SELECT id, 'second' AS version, stars_count + 1 AS stars_count FROM catalog",
)
def replaced_table(spark, sf_dir):
    """A table's second version, made of the first while that is still there."""
    folder = _folder(spark, "versions")
    first = writers.replace_table(I.catalog(spark, sf_dir).select("id", "stars_count"), folder, "first")
    grown = spark.read.parquet(first).withColumn("stars_count", F.col("stars_count") + 1)
    second = writers.replace_table(grown, folder, "second")
    return spark.read.parquet(second).withColumn("version", F.lit("second"))


@query(
    "run_labels",
    f"""WITH {I.SQL_CATALOG} SELECT id, 'repos_2025-01-01_00-00-00' AS run,
        strftime(DATE '{I.AS_OF}' - 183, '%Y-%m-%d') AS pushed_since,
        language || ' ' || class_label || ' topic' AS phrases FROM catalog""",
)
def run_labels(spark, sf_dir):
    """A run's name, its earliest day, and phrases without repeats."""
    return I.catalog(spark, sf_dir).select(
        "id",
        run_name(F.lit(I.BATCH_TS)).alias("run"),
        date_floor(I.AS_OF, 183).alias("pushed_since"),
        distinct_phrases(F.array("language", "class_label", "language", F.lit("topic"), "class_label")).alias("phrases"),
    )


@query(
    "catalog_search_page",
    f"""WITH {I.SQL_CATALOG}, found AS (SELECT id, updated_at, row_number() OVER (ORDER BY updated_at DESC, id) - 1 AS n
          FROM catalog WHERE contains(lower(readme), 'that') AND stars_count >= 300
          AND pushed_at >= DATE '{I.AS_OF}' - 183)
        SELECT id, strftime(updated_at, '%Y-%m-%d') AS updated_at FROM found WHERE n // {SEARCH_PAGE_SIZE} = 1""",
)
def catalog_search_page(spark, sf_dir):
    """The second page of a search, newest first: a page is what is asked for."""
    rows = I.catalog(spark, sf_dir, wide=True)
    found = C.catalog_search(rows, "that", 300, 183, I.AS_OF, page=1, page_size=SEARCH_PAGE_SIZE)
    return found.select("id", _day("updated_at"))


# --- streams ----------------------------------------------------------------


def _folder(spark, name: str) -> str:
    return f"{use_checkpoint_folder(spark)}/{name}-{uuid.uuid4()}"


def _stream(spark, rows, order: str, parts: int = 4):
    """``rows`` landed in ``parts`` one after the other, in ``order``, read one part per batch.

    A part is written by all tasks. Rows without a place in the order come first.
    """
    folder = _folder(spark, "landing")
    files = spark.sparkContext.defaultParallelism
    place = F.col(order).cast("double")
    bounds = rows.select(place.alias("x")).approxQuantile("x", [n / parts for n in range(1, parts)], 0.01)
    edges = [float("-inf"), *bounds, float("inf")]
    for number, (low, high) in enumerate(zip(edges, edges[1:])):
        inside = (place > low) & (place <= high)
        part = rows.filter(inside | place.isNull() if number == 0 else inside)
        part.repartition(files).write.mode("append").parquet(folder)
    return ingest.read_landing(spark, folder, rows.schema, files_per_batch=files)


def _sighting_stream(spark, sf_dir):
    rows = I.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("event_type").alias("keyword"),
        F.lit("").alias("additional_keywords"), "ts", "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
    )
    return _stream(spark, rows, "micros").drop("micros")


@query(
    "stream_pages",
    """SELECT page_id, string_split(url, '/')[-1] AS repo_name, len(html) AS n_chars FROM pages""",
)
def stream_pages(spark, sf_dir):
    """Landed pages, transformed batch by batch and picked up where the last run stopped."""
    folder = _folder(spark, "pages")
    rows = I.table(spark, sf_dir, "pages")
    transformed = lambda batch: batch.select(
        "page_id", repo_name("url").alias("repo_name"), F.length("html").cast("long").alias("n_chars")
    )
    stream = _stream(spark, rows, "page_id")
    ingest.ingest_pages(stream, folder, _folder(spark, "pages-state"), transformed)
    return ingest.read_batches(spark, folder, transformed(rows).schema).drop("batch_id")


@query("stream_dedupe", f"WITH {_SQL_COPIES} SELECT seq, source, n_chars FROM copies WHERE n = 1")
def stream_dedupe(spark, sf_dir):
    folder = _folder(spark, "first")
    stream = _stream(spark, _copies(spark, sf_dir), "seq")
    ingest.ingest_first_by_key(stream, folder, _folder(spark, "first-state"), "key")
    return ingest.read_batches(spark, folder, stream.schema).select("seq", "source", "n_chars")


@query("stream_upsert", _SQL_ALL_ROLLED)
def stream_upsert(spark, sf_dir):
    folder = _folder(spark, "catalog")
    stream = _sighting_stream(spark, sf_dir)
    ingest.ingest_sightings(stream, folder, _folder(spark, "catalog-state"), I.SIGHTING_ORDER)
    view = ingest.catalog_view(spark, folder, stream.schema, I.SIGHTING_ORDER)
    return view.select("id", "keyword", "additional_keywords")


@query("stream_keyword_rollup", _SQL_ALL_ROLLED)
def stream_keyword_rollup(spark, sf_dir):
    folder = _folder(spark, "keywords")
    stream = _sighting_stream(spark, sf_dir)
    ingest.ingest_keywords(stream, folder, _folder(spark, "keywords-state"), I.SIGHTING_ORDER)
    return ingest.keywords_view(spark, folder)


LANDED_PAGE_SIZE = 2000


@query(
    "stream_landed_pages",
    f"""WITH {I.SQL_CATALOG}, {I.SQL_KEYWORDS}, {_SQL_WORK.replace(f"// {PAGE_SIZE}", f"// {LANDED_PAGE_SIZE}")}
        SELECT id, keyword, page FROM work""",
)
def stream_landed_pages(spark, sf_dir):
    """Every keyword's matches, landed in pages; the stream is stopped between two keywords and goes on there."""
    rows = I.catalog(spark, sf_dir, wide=True).select("id", "updated_at", "readme")
    work = C.catalog_pages(keyword_match(rows, I.KEYWORDS), LANDED_PAGE_SIZE, group="ord")
    work = written(work.select("id", F.col("keyword").alias("searched"), "ord", "page"))
    landing, folder, state = (_folder(spark, n) for n in ("pages", "paged", "paged-state"))
    schema = work.drop("ord", "page").schema
    numbers = list(range(len(I.KEYWORDS)))
    for searched in (numbers[:3], numbers[3:]):
        found = work.filter(F.col("ord").isin(searched))
        paged_source.land_pages(found, landing, searched, page_rows=LANDED_PAGE_SIZE)
        stream = paged_source.read_pages(spark, landing, schema)
        ingest.ingest_pages(stream, folder, state, lambda batch: batch)
    found = ingest.read_batches(spark, folder, stream.schema)
    return found.select("id", F.col("searched").alias("keyword"), "page")
