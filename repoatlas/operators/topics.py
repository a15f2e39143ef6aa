"""Key terms of documents and their language."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoatlas.fixed_values import ASCII_NO_LETTERS, LANGUAGE_WORDS
from repoatlas.functions.arrays import bind, constant, kept, literal_strings, term_places
from repoatlas.functions.text import _column, terms
from repoatlas.operators.skew import common_keys, lookup_join
from repoatlas.session import written

# At most so many of the commonest strong phrases are sent to every task.
MAX_COMMON_PHRASES = 300_000


def extract_topics(
    docs: DataFrame, n: int = 10, doc_id: str = "id", text: str = "readme"
) -> DataFrame:
    """Per document its ``n`` strongest terms, in order of first appearance.

    Strength is the term's count times its inverse document frequency in the
    whole corpus. A document without a term has an empty text. Each text is
    split once, inside its row, into terms with their counts and first places;
    that table is written, and the corpus counts, the size of the corpus and
    the weights are all made of it. No text is shuffled. Common terms are
    weighted where they are, and a task keeps a document's ``n`` best of them;
    only the others are shuffled.
    """
    counted = written(docs.select(F.col(doc_id).alias("doc"), term_places(terms(text)).alias("found")))
    placed = counted.select("doc", F.explode("found").alias("t")).select("doc", "t.*")
    frequencies = written(placed.groupBy("term").agg(F.count("*").alias("df")))
    corpus = F.lit(float(counted.count()))
    weight = F.col("tf") * (F.log((1 + corpus) / (1 + F.col("df"))) + 1)
    is_common = common_keys(frequencies, "term", "df")
    common, others = frequencies.filter(is_common), frequencies.filter(~is_common)
    in_place = placed.join(F.broadcast(common), "term").select(*placed.columns, "df")
    rest = placed.join(F.broadcast(common.select("term")), "term", "left_anti")
    weighted = in_place.unionByName(lookup_join(rest, others, "term", "df", "doc")).select(
        "doc", "term", "first_pos", F.round(weight, 6).alias("weight")
    )
    # One document's terms form a group, never more than the document is long.
    strongest = Window.partitionBy("doc").orderBy(F.desc("weight"), "term")
    best = weighted.withColumn("rank", F.row_number().over(strongest)).filter(F.col("rank") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("first_pos", "term")))
    topics = best.groupBy("doc").agg(ordered.alias("found")).select(
        "doc", F.array_join(F.transform("found", lambda t: t["term"]), " ").alias("topics")
    )
    none = counted.filter(F.coalesce(F.size("found"), F.lit(0)) <= 0).select("doc", F.lit("").alias("topics"))
    return topics.unionByName(none).withColumnRenamed("doc", doc_id)


def collocations(phrases: DataFrame, min_count: int = 3, min_ratio: float = 10.83) -> DataFrame:
    """``phrase``, ``count``, ``ratio`` of the pairs that stand together more often than by chance.

    ``phrases`` holds ``phrase`` (two terms, one blank) and ``count``, one row
    per phrase; it is read several times. ``ratio`` is the log-likelihood ratio
    of the pair's two-by-two table; 10.83 leaves one chance in a thousand.
    """
    pairs = phrases.select("phrase", "count", *_sides())
    firsts = written(pairs.groupBy("first").agg(F.sum("count").alias("row")))
    seconds = written(pairs.groupBy("second").agg(F.sum("count").alias("col")))
    return _rated(pairs.filter(F.col("count") >= min_count), firsts, seconds, min_ratio)


def _sides() -> list[Column]:
    """The two terms of a ``phrase``."""
    return [F.substring_index("phrase", " ", 1).alias("first"), F.substring_index("phrase", " ", -1).alias("second")]


def _rated(frequent: DataFrame, firsts: DataFrame, seconds: DataFrame, min_ratio: float) -> DataFrame:
    """The ``frequent`` phrases that are collocations, by how often each term is a phrase's first or second."""
    total = F.lit(float(firsts.agg(F.sum("row")).first()[0] or 0))
    frequent = lookup_join(
        lookup_join(frequent, firsts, "first", "row", "phrase"), seconds, "second", "col", "phrase"
    )
    both, row, col = (F.col(c).cast("double") for c in ("count", "row", "col"))

    def cell(seen: Column, by_row: Column, by_col: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * total / (by_row * by_col))).otherwise(0.0)

    ratio = 2 * (
        cell(both, row, col)
        + cell(row - both, row, total - col)
        + cell(col - both, total - row, col)
        + cell(total - row - col + both, total - row, total - col)
    )
    return (
        frequent.filter(both * total > row * col)
        .select("phrase", "count", F.round(ratio, 4).alias("ratio"))
        .filter(F.col("ratio") >= min_ratio)
    )


def phrase_topics(
    docs: DataFrame, n: int = 10, doc_id: str = "id", text: str = "readme",
    min_count: int = 3, min_ratio: float = 10.83,
) -> DataFrame:
    """Per document its ``n`` strongest two-term phrases, in order of first appearance.

    Phrases are the corpus's ``collocations`` and ranked by their ratio; equal
    ones by name. They are distinct, with ", " between them; a document without
    one, or a null one, has an empty text. Each text is split once, inside its
    row, and the corpus counts are made of that written table. No text is
    shuffled. Phrases are shuffled to be counted; the commonest strong ones are
    then found where they are, and a task keeps a document's ``n`` best of them.
    """
    pairs = bind(
        terms(text),
        lambda held: F.transform(
            F.slice(held, F.lit(2), F.greatest(F.size(held) - 1, F.lit(0))),
            lambda t, i: F.concat_ws(" ", F.get(held, i), t),
        ),
    )
    split = written(docs.select(F.col(doc_id).alias("doc"), term_places(pairs).alias("found")))
    placed = split.select("doc", F.explode("found").alias("t")).select(
        "doc", F.col("t.term").alias("phrase"), "t.tf", "t.first_pos"
    )
    frequent = written(placed.groupBy("phrase").agg(F.sum("tf").alias("count")).filter(F.col("count") >= min_count))
    sides = placed.select("tf", *_sides())
    firsts = written(sides.groupBy("first").agg(F.sum("tf").alias("row")))
    seconds = written(sides.groupBy("second").agg(F.sum("tf").alias("col")))
    strong = written(_rated(frequent.select("phrase", "count", *_sides()), firsts, seconds, min_ratio))
    placed = placed.drop("tf")
    is_common = common_keys(strong, "phrase", "count", MAX_COMMON_PHRASES)
    common, others = strong.filter(is_common), strong.filter(~is_common)
    found = placed.join(F.broadcast(common), "phrase").select("doc", "phrase", "first_pos", "ratio")
    if not others.isEmpty():
        rest = placed.join(F.broadcast(common.select("phrase")), "phrase", "left_anti")
        named = lookup_join(rest, others, "phrase", "count", "doc").filter("ratio is not null")
        found = found.unionByName(named.select(*found.columns))
    # One document's phrases form a group, never more than the document is long.
    strongest = Window.partitionBy("doc").orderBy(F.desc("ratio"), "phrase", "first_pos")
    best = found.withColumn("rank", F.row_number().over(strongest)).filter(F.col("rank") <= n)
    shown = best.select("doc", F.struct(F.col("first_pos").alias("at"), "phrase").alias("entry"))
    # A document without a strong phrase has a row without an entry.
    rows = shown.unionByName(split.select("doc", F.lit(None).cast(shown.schema["entry"].dataType).alias("entry")))
    listed = rows.groupBy("doc").agg(F.sort_array(F.collect_list("entry")).alias("shown"))
    return listed.select(
        F.col("doc").alias(doc_id), F.array_join(F.transform("shown", lambda e: e["phrase"]), ", ").alias("topics")
    )


def language_scores(text) -> Column:
    """Per language of the profile, how many of its words the text has."""
    tokens = F.split(F.lower(_column(text)), f"[{ASCII_NO_LETTERS}]+")
    everyday = [w for _, listed in LANGUAGE_WORDS for w in listed]
    languages = constant([listed for _, listed in LANGUAGE_WORDS], "array<array<string>>")
    return bind(
        kept(tokens, everyday),
        lambda hits: F.transform(
            languages,
            lambda listed: F.size(F.filter(hits, lambda t: F.array_contains(listed, t))),
        ),
    )


def detect_language(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``language_id``: most function words, first on ties.

    A text with no such word gets null.
    """
    codes = literal_strings([code for code, _ in LANGUAGE_WORDS])
    counts = F.col("language_scores")
    best = F.array_max(counts)
    code = F.try_element_at(codes, F.array_position(counts, best).cast("int"))
    return (
        docs.withColumn("language_scores", language_scores(text))
        .withColumn("language_id", F.when(best > 0, code))
        .drop("language_scores")
    )


def route_language(docs: DataFrame, text: str = "text", target: str = "en") -> DataFrame:
    """``docs`` with the step each takes: straight on, or by translation first."""
    routed = F.when(F.col("language_id") == target, F.lit("summarize")).otherwise(
        F.lit("translate")
    )
    return detect_language(docs, text).withColumn("route", routed)
