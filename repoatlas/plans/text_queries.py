"""Cleaning, cutting, encoding, language, license, phrase and keyword table queries."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas.fixed_values import (
    LANGUAGE_WORDS,
    LICENSE_RULES,
    SUMMARY_SYSTEM,
    SUMMARY_USER,
)
from repoatlas.functions import encoding as E
from repoatlas.functions import licenses as L
from repoatlas.functions import text as X
from repoatlas.operators import license_scan as scan
from repoatlas.operators.inference import hash_embeddings, infer, lead_summarizer
from repoatlas.operators.keyword_table import match_keywords
from repoatlas.operators.phrase_index import build_phrase_index, phrase_search
from repoatlas.operators.prompts import summary_messages
from repoatlas.operators.topics import detect_language, extract_topics, phrase_topics, route_language
from repoatlas.plans import inputs as I
from repoatlas.plans.registry import query
from repoatlas.session import use_checkpoint_folder


def _per_document(name: str, column, sql: str) -> None:
    """Registers a column over every document's text."""

    @query(name, f"SELECT doc_id, {sql} AS {name} FROM documents")
    def run(spark, sf_dir):
        return I.texts(spark, sf_dir).select("doc_id", column("text").alias(name))


_SPACES = f"[{I.SPACE_CLASS}]+"
_per_document("clean_text", X.clean_text, I.sql_clean("text"))
_per_document("clean_readme", X.clean_readme, I.sql_clean_readme("text"))
_per_document("brief_desc", X.lead_sentences, I.sql_lead("text"))
_per_document("truncate_text", X.truncate_text, "left(text, 10000)")
_SQL_CUT = (
    "CASE WHEN contains(text, '.') THEN regexp_extract(text, '(?s)^(.*)\\.', 1) ELSE text END"
)
_per_document("clean_summary", X.cut_at_last_stop, _SQL_CUT)
_per_document(
    "clean_summary_cap",
    X.cut_and_capitalize,
    f"upper(left({_SQL_CUT}, 1)) || lower(substr({_SQL_CUT}, 2))",
)
_per_document(
    "normalize_text",
    X.normalize_text,
    r"array_to_string(regexp_extract_all(text, '\w+|[^\w\s]'), ' ')",
)
_per_document(
    "normalize_label",
    X.normalize_label,
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, "
    "'^[^a-zA-Z]+', ''), '[^a-zA-Z]+$', ''), "
    f"'([^a-zA-Z{I.SPACE_CLASS}])', ' \\1 ', 'g'), '{_SPACES}', ' ', 'g')",
)


@query("lead3_summary", f"SELECT doc_id, {I.sql_lead('text')} AS summary FROM documents")
def lead3_summary(spark, sf_dir):
    docs = I.texts(spark, sf_dir).select("doc_id", "text")
    return infer(docs, "text", "summary", lead_summarizer()).drop("text")


@query(
    "decode_readme",
    f"""SELECT doc_id, {I.sql_clean('lower(text)')} AS readme FROM documents
        UNION ALL SELECT -1 - doc_id, 'no readme found' FROM documents WHERE lang = 'es'""",
)
def decode_readme(spark, sf_dir):
    """README contents as a host sends them; some more repositories have none."""
    docs = I.texts(spark, sf_dir)
    sent = docs.select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("content"))
    missing = I.table(spark, sf_dir, "documents").filter("lang = 'es'").select(
        (-1 - F.col("doc_id")).alias("doc_id"), F.lit(None).cast("string").alias("content")
    )
    return sent.unionByName(missing).select("doc_id", X.decode_readme("content").alias("readme"))


@query(
    "url_parts",
    """SELECT page_id, string_split(url, '/')[-1] AS repo_name,
              string_split(url, '/')[-2] || '/' || string_split(url, '/')[-1] AS full_name,
              replace(lower(string_split(url, '/')[-1]), ' ', '-') AS anchor
       FROM pages""",
)
def url_parts(spark, sf_dir):
    pages = I.table(spark, sf_dir, "pages")
    name = X.repo_name("url")
    return pages.select(
        "page_id",
        name.alias("repo_name"),
        X.repo_full_name("url").alias("full_name"),
        X.anchor(name).alias("anchor"),
    )


_RESPONSE = (
    "CASE WHEN lang = 'de' THEN 'Relevancy_score = n/a' "
    "ELSE chr(10) || '  Relevancy_score = 0.' || n_chars || ', Reasons = [ in ' || lang || ', , from ' "
    "|| source || ' ]' || chr(10) || 'Relevancy_score = 1' END"
)


def with_response(docs):
    """Model answers made of the row's own columns; German rows' are malformed."""
    good = F.concat(
        F.lit("\n  Relevancy_score = 0."), F.col("n_chars").cast("string"),
        F.lit(", Reasons = [ in "), "lang", F.lit(", , from "), "source",
        F.lit(" ]\nRelevancy_score = 1"),
    )
    answer = F.when(F.col("lang") == "de", F.lit("Relevancy_score = n/a")).otherwise(good)
    return docs.withColumn("response", answer)


@query(
    "parse_score_response",
    f"""WITH r AS (SELECT doc_id, string_split(regexp_replace({_RESPONSE}, '^\\s+|\\s+$', '', 'g'), chr(10))[1] AS line FROM documents),
        p AS (SELECT doc_id,
                TRY_CAST(regexp_extract(line, 'Relevancy_score\\s*=\\s*([\\d.]+)', 1) AS DOUBLE) AS score,
                regexp_extract(line, 'Reasons\\s*=\\s*\\[(.+)\\]', 1) AS reasons FROM r)
        SELECT doc_id,
          CASE WHEN score IS NULL OR reasons = '' THEN CAST(0.1234 AS DOUBLE) ELSE score END AS score,
          CASE WHEN score IS NULL OR reasons = '' THEN '' ELSE array_to_string(list_filter(
            list_transform(string_split(reasons, ','), lambda x: trim(x)), lambda x: x <> ''), '|')
          END AS reasons
        FROM p""",
)
def parse_score_response(spark, sf_dir):
    docs = with_response(I.table(spark, sf_dir, "documents"))
    parsed = docs.select("doc_id", E.parse_score_response("response").alias("parsed"))
    return parsed.select(
        "doc_id", "parsed.score", F.array_join("parsed.reasons", "|").alias("reasons")
    )


@query(
    "json_props",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
              '{"k":' || json_extract_string(props, '$.k') || '}' AS props_out FROM events""",
)
def json_props(spark, sf_dir):
    events = I.table(spark, sf_dir, "events")
    parsed = events.select("event_id", F.from_json("props", "k long").alias("record"))
    return parsed.select("event_id", "record.k", F.to_json("record").alias("props_out"))


_SQL_PRIORITIES = """counted AS (SELECT o_custkey AS id, o_orderpriority AS language, count(*) AS n
       FROM orders GROUP BY ALL),
     encoded AS (SELECT id, string_agg(language || ' (' || n || ')', '| ' ORDER BY language) AS languages
       FROM counted GROUP BY id)"""


def _encoded_languages(spark, sf_dir):
    """Orders per priority of a customer, as a repository's language map."""
    counted = (
        I.table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("language"))
        .agg(F.count("*").alias("n"))
    )
    entries = F.array_sort(F.collect_list(F.struct("language", "n")))
    maps = counted.groupBy("id").agg(F.map_from_entries(entries).alias("languages"))
    return maps.select("id", E.encode_languages("languages").alias("languages"))


@query("encode_languages", f"WITH {_SQL_PRIORITIES} SELECT id, languages FROM encoded")
def encode_languages(spark, sf_dir):
    return _encoded_languages(spark, sf_dir)


@query(
    "decode_languages",
    f"WITH {_SQL_PRIORITIES} SELECT id, language, CAST(n AS BIGINT) AS bytes FROM counted",
)
def decode_languages(spark, sf_dir):
    maps = _encoded_languages(spark, sf_dir).withColumn(
        "languages", E.decode_languages("languages")
    )
    return maps.select("id", F.explode("languages").alias("language", "bytes"))


@query(
    "build_prompts",
    f"""WITH m AS (SELECT doc_id, unnest([
          {{'pos': 0, 'role': 'system', 'content': '{SUMMARY_SYSTEM}'}},
          {{'pos': 1, 'role': 'user', 'content':
            replace('{SUMMARY_USER}', '{{readme_text}}', left(text, 10000))}}]) AS m FROM documents)
        SELECT doc_id, m.pos AS pos, m.role AS role, m.content AS content FROM m""",
)
def build_prompts(spark, sf_dir):
    messages = I.texts(spark, sf_dir).select(
        "doc_id", F.posexplode(summary_messages("text")).alias("pos", "message")
    )
    return messages.select("doc_id", "pos", "message.role", "message.content")


@query(
    "extract_topics",
    f"""WITH {I.SQL_CLEANED},
        split AS (SELECT doc_id, {I.sql_terms('readme')} AS terms FROM cleaned),
        placed AS (SELECT doc_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM split),
        counted AS (SELECT doc_id, term, count(*) AS tf, min(pos) AS first_pos FROM placed GROUP BY ALL),
        frequencies AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
        weighted AS (SELECT doc_id, term, first_pos,
          round(tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1), 6) AS weight
          FROM counted JOIN frequencies USING (term)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank
          FROM weighted)
        SELECT doc_id, coalesce(string_agg(term, ' ' ORDER BY first_pos), '') AS topics
        FROM documents LEFT JOIN ranked USING (doc_id) WHERE coalesce(rank, 1) <= 10 GROUP BY doc_id""",
)
def topics(spark, sf_dir):
    return extract_topics(I.cleaned(spark, sf_dir), 10, "doc_id", "readme")


def _sql_cell(seen: str, by_row: str, by_col: str) -> str:
    return f"CASE WHEN {seen} > 0 THEN ({seen}) * ln(({seen}) * total / (({by_row}) * ({by_col}))) ELSE 0.0 END"


_SQL_RATIO = " + ".join(
    _sql_cell(*cell)
    for cell in (
        ("k", "r", "c"),
        ("r - k", "r", "total - c"),
        ("c - k", "total - r", "c"),
        ("total - r - c + k", "total - r", "total - c"),
    )
)


@query(
    "phrase_topics",
    f"""WITH {I.SQL_CLEANED},
        split AS (SELECT doc_id, {I.sql_terms('readme')} AS terms FROM cleaned),
        placed AS (SELECT doc_id, unnest(list_zip(terms[:-2], terms[2:])) AS pair,
          unnest(range(len(terms) - 1)) AS pos FROM split WHERE len(terms) > 1),
        found AS (SELECT doc_id, pair[1] AS a, pair[2] AS b, min(pos) AS first_pos, count(*) AS tf FROM placed GROUP BY ALL),
        counts AS (SELECT a, b, CAST(sum(tf) AS DOUBLE) AS k FROM found GROUP BY ALL),
        tabled AS (SELECT a, b, k, CAST(sum(k) OVER (PARTITION BY a) AS DOUBLE) AS r,
          CAST(sum(k) OVER (PARTITION BY b) AS DOUBLE) AS c, CAST(sum(k) OVER () AS DOUBLE) AS total FROM counts),
        rated AS (SELECT a, b, round(2 * ({_SQL_RATIO}), 4) AS ratio FROM tabled WHERE k >= 3 AND k * total > r * c),
        ranked AS (SELECT doc_id, a || ' ' || b AS phrase, first_pos,
            row_number() OVER (PARTITION BY doc_id ORDER BY ratio DESC, a || ' ' || b) AS rank
          FROM found JOIN rated USING (a, b) WHERE ratio >= 10.83)
        SELECT doc_id, coalesce(string_agg(phrase, ', ' ORDER BY first_pos), '') AS topics
        FROM documents LEFT JOIN ranked USING (doc_id) WHERE coalesce(rank, 1) <= 10 GROUP BY doc_id""",
)
def topic_phrases(spark, sf_dir):
    return phrase_topics(I.cleaned(spark, sf_dir), 10, "doc_id", "readme")


def _sql_language(text: str) -> str:
    def count(listed):
        inside = ", ".join(f"'{w}'" for w in listed)
        return f"len(list_filter(tokens, lambda t: list_contains([{inside}], t)))"

    counts = ", ".join(count(listed) for _, listed in LANGUAGE_WORDS)
    codes = ", ".join(f"'{code}'" for code, _ in LANGUAGE_WORDS)
    return (
        f"tokens AS (SELECT doc_id, lang, regexp_extract_all(lower({text}), '[a-z\\x{{80}}-\\x{{10ffff}}]+') AS tokens"
        f" FROM documents), counts AS (SELECT doc_id, lang, [{counts}] AS n FROM tokens),"
        f" detected AS (SELECT doc_id, lang, CASE WHEN list_max(n) > 0"
        f" THEN [{codes}][list_position(n, list_max(n))] END AS language_id FROM counts)"
    )


@query(
    "detect_language",
    f"WITH {_sql_language('text')} SELECT doc_id, lang, language_id FROM detected",
)
def language(spark, sf_dir):
    docs = I.texts(spark, sf_dir).select("doc_id", "lang", "text")
    return detect_language(docs).drop("text")


@query(
    "route_language",
    f"""WITH {_sql_language('text')} SELECT route, language_id, count(*) AS documents FROM (
          SELECT language_id, CASE WHEN language_id = 'en' THEN 'summarize' ELSE 'translate' END AS route
          FROM detected) GROUP BY ALL""",
)
def routes(spark, sf_dir):
    docs = I.texts(spark, sf_dir).select("text")
    return route_language(docs).groupBy("route", "language_id").agg(F.count("*").alias("documents"))


@query(
    "hash_embeddings",
    f"""WITH split AS (SELECT doc_id, unnest({I.sql_terms('text')}) AS term FROM documents),
        counted AS (SELECT doc_id, CAST(CAST('0x' || md5(term)[1:4] AS INTEGER) % 1024 AS INTEGER) AS pos,
          count(*) AS tf FROM split GROUP BY ALL),
        weights AS (SELECT pos, ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) AS idf
          FROM counted GROUP BY pos),
        raw AS (SELECT doc_id, pos, tf * idf AS x FROM counted JOIN weights USING (pos)),
        norms AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM raw GROUP BY doc_id)
        SELECT doc_id, pos, round(CASE WHEN norm = 0 THEN x ELSE x / norm END, 6) + 0 AS value
        FROM raw JOIN norms USING (doc_id)""",
)
def embeddings(spark, sf_dir):
    vectors = hash_embeddings(I.texts(spark, sf_dir))
    values = vectors.select("doc_id", F.explode(F.arrays_zip("positions", "values")).alias("x"))
    return values.select("doc_id", F.col("x.positions").alias("pos"), F.round("x.values", 6).alias("value"))


# --- licenses ---------------------------------------------------------------


def _sql_rules(line: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({line}, '(?i){pattern}') THEN '{name}'"
        for name, pattern in LICENSE_RULES
    )
    return f"CASE {whens} ELSE 'Other' END"


_SQL_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_LICENSE_FILE = r"(?s)(?:licensed|Licensed|Released) under (?:the )?(.*)$"
_SQL_LINES = (
    "split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),"
    " lines AS (SELECT doc_id, unnest(lines) AS line,"
    " CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS line_no FROM split),"
    f" named AS (SELECT doc_id, line_no, line, {_SQL_TRIM.format('line')} AS bare FROM lines),"
    f" candidates AS (SELECT doc_id, line_no, line, regexp_replace(bare, '{L.LEAD_IN}', '') AS candidate"
    f" FROM named WHERE regexp_matches(bare, '{L.LEAD_IN}') OR regexp_matches(bare, '{L.LICENSE_WORD}'))"
)


@query(
    "license_first_line",
    f"""WITH files AS (SELECT doc_id,
          CASE lang WHEN 'fr' THEN 'Other' WHEN 'de' THEN 'Custom License' END AS provider,
          CASE WHEN regexp_matches(text, '{_LICENSE_FILE}')
            THEN regexp_extract(text, '{_LICENSE_FILE}', 1) ELSE text END AS content FROM documents),
        firsts AS (SELECT doc_id, provider,
          {_SQL_TRIM.format("string_split(content, chr(10))[1]")} AS line FROM files)
        SELECT doc_id, CASE WHEN provider <> 'Other' THEN provider ELSE {_sql_rules('line')} END AS license
        FROM firsts""",
)
def license_first_line(spark, sf_dir):
    """Texts as license files, from the license name on where they hold one."""
    provider = F.when(F.col("lang") == "fr", "Other").when(F.col("lang") == "de", "Custom License")
    content = F.when(
        F.col("text").rlike(_LICENSE_FILE), F.regexp_extract("text", _LICENSE_FILE, 1)
    ).otherwise(F.col("text"))
    files = I.texts(spark, sf_dir).select(
        "doc_id", provider.alias("provider"), content.alias("content")
    )
    return files.select("doc_id", L.repo_license("provider", "content").alias("license"))


@query(
    "license_scan",
    f"WITH {_SQL_LINES} SELECT doc_id, line_no, line, {_sql_rules('candidate')} AS license FROM candidates",
)
def license_scan(spark, sf_dir):
    return scan.license_scan(I.texts(spark, sf_dir))


@query(
    "license_histogram",
    f"""WITH {_SQL_LINES}, found AS (SELECT doc_id, {_sql_rules('candidate')} AS license FROM candidates)
        SELECT license, count(*) AS lines, count(DISTINCT doc_id) AS documents FROM found GROUP BY license""",
)
def license_histogram(spark, sf_dir):
    return scan.license_histogram(I.texts(spark, sf_dir))


def _sql_audit() -> str:
    rules = I.sql_values([(i, name, "(?i)" + pattern) for i, (name, pattern) in enumerate(LICENSE_RULES)])
    return f"""WITH {_SQL_LINES}, rules(ord, license, pattern) AS ({rules}),
        matched AS (SELECT doc_id, line_no, ord FROM candidates, rules
          WHERE regexp_matches(candidate, pattern)),
        firsts AS (SELECT *, min(ord) OVER (PARTITION BY doc_id, line_no) AS first FROM matched),
        counted AS (SELECT ord, count(*) AS m, count(*) FILTER (ord = first) AS f FROM firsts GROUP BY ord)
        SELECT ord, license, coalesce(m, 0) AS lines_matched, coalesce(f, 0) AS lines_fired,
               coalesce(m, 0) > 0 AND coalesce(f, 0) = 0 AS shadowed
        FROM rules LEFT JOIN counted USING (ord)"""


@query("license_rule_audit", _sql_audit())
def license_rule_audit(spark, sf_dir):
    return scan.license_rule_audit(I.texts(spark, sf_dir))


# --- phrases and keyword tables ---------------------------------------------

# Common, rare and absent ones, and one too short for the index.
PHRASES = ["tion the", "oder", "re, whthe", "zz", "éa", "no such phrase"]


@query(
    "phrase_search",
    f"""WITH phrases(phrase) AS ({I.sql_values([(p,) for p in PHRASES])})
        SELECT phrase, doc_id FROM documents JOIN phrases ON contains(lower(text), phrase)""",
)
def phrases_by_index(spark, sf_dir):
    """An index of all texts, built once, and several searches in it."""
    folder = f"{use_checkpoint_folder(spark)}/phrases-{uuid.uuid4()}"
    build_phrase_index(I.texts(spark, sf_dir).select("doc_id", F.col("text").alias("readme")), folder)
    found = [phrase_search(spark, folder, p).select(F.lit(p).alias("phrase"), "doc_id") for p in PHRASES]
    return reduce(DataFrame.unionAll, found)


@query(
    "keyword_table_match",
    """WITH keywords AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{7,}')) AS keyword FROM benchmark)
        SELECT doc_id, keyword FROM documents JOIN keywords ON contains(text, keyword)""",
)
def keywords_by_automaton(spark, sf_dir):
    """The long words of the benchmark as a keyword table, wherever a text has them, also inside a word."""
    long_words = F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0))
    keywords = I.table(spark, sf_dir, "benchmark").select(F.explode(long_words).alias("keyword"))
    docs = I.texts(spark, sf_dir).select("doc_id", F.col("text").alias("readme"))
    return match_keywords(docs, keywords, doc_id="doc_id").drop("n")
