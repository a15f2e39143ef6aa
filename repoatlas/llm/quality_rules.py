"""Line-first cleaning by rules, as expressions inside the row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoatlas.functions.arrays import bind
from repoatlas.llm.tasks import text_of

# White space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
# How a line of prose may end, marks in closing quotes included.
LINE_END = "[.!?…。！？:;][\"'’”»)\\]]*+$"
# How a sentence ends inside a line.
SENTENCE_END = r"[.!?…。！？][\x20\x09]"
# Marks that decorate or separate rather than punctuate.
DECORATION = r"[#*$%&|<>!~=_^]"
# Separators of menus and trails of links.
SEPARATORS = "[|»›•·>]"
# Phrases of notices that come with pages rather than belong to their text.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "click here",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "licensed under the",
    "log in to",
    "lorem ipsum",
    "powered by",
    "privacy policy",
    "read more",
    "sign up for",
    "skip to content",
    "subscribe to our",
    "terms of service",
    "terms of use",
    "this site uses cookies",
)

# A line that ends unlike prose passes with a sentence's end for so many words.
MAX_SENTENCE_WORDS = 60
# A line with more decoration per word than this fails.
MAX_DECORATION_PER_WORD = 0.5
# A line with so many separators, and one for so many words at least, is navigation.
MIN_SEPARATORS = 3
WORDS_PER_SEPARATOR = 4
# A document that loses more than this share of its characters is rejected.
MAX_LOSS = 0.5
# The base rules: fewest words, and largest share (%) of words in repeated windows.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def line_fails_punctuation(line: Column) -> Column:
    """It neither ends like a sentence nor holds some, or is decorated rather than punctuated."""
    unfinished = ~line.rlike(LINE_END) & (
        F.regexp_count(line, F.lit(SENTENCE_END)) * MAX_SENTENCE_WORDS < _line_words(line)
    )
    return unfinished | (
        F.regexp_count(line, F.lit(DECORATION)) > MAX_DECORATION_PER_WORD * _line_words(line)
    )


def line_is_navigation(line: Column) -> Column:
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    return (separators >= MIN_SEPARATORS) & (separators * WORDS_PER_SEPARATOR >= _line_words(line))


def line_is_boilerplate(line: Column) -> Column:
    return F.lower(line).rlike("|".join(BOILERPLATE))


def _line_words(line: Column) -> Column:
    return F.size(F.split(line, SPACE))


def _passes(line: Column) -> Column:
    """A line without a word passes: it is nothing to lose."""
    return (line == "") | ~(line_fails_punctuation(line) | line_is_navigation(line) | line_is_boilerplate(line))


def kept_lines(text: Column) -> Column:
    """The lines of ``text`` that pass every rule, trimmed, in order."""
    trimmed = F.transform(F.split(text, "\n"), lambda line: F.regexp_replace(line, rf"^{SPACE}|{SPACE}$", ""))
    return F.filter(trimmed, _passes)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return bind(lines, lambda held: (F.size(held) - F.size(F.array_distinct(held))).cast("long"))


def repeated_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that occur at least twice, first included.

    Windows are sorted by a 64-bit hash with their places; one is repeated if a
    neighbour has the same hash. The words from a repeated window's start up to
    the next one's, at most a window's length, are counted.
    """

    def windows(held: Column) -> Column:
        starts = F.when(F.size(held) >= WINDOW, F.sequence(F.lit(0), F.size(held) - WINDOW)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            starts, lambda i: F.struct(F.xxhash64(*[F.get(held, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i"))
        )

    def repeated(ordered: Column) -> Column:
        return F.filter(
            ordered,
            lambda w, k: F.coalesce(F.get(ordered, k - 1)["h"] == w["h"], F.lit(False))
            | F.coalesce(F.get(ordered, k + 1)["h"] == w["h"], F.lit(False)),
        )

    def covered(places: Column) -> Column:
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end")),
            lambda at, p: F.struct(
                (at["n"] + p + WINDOW - F.greatest(at["end"], p)).cast("long").alias("n"), (p + WINDOW).alias("end")
            ),
            lambda at: at["n"],
        )

    return bind(
        words,
        lambda held: bind(
            F.sort_array(windows(held)),
            lambda ordered: covered(F.sort_array(F.transform(repeated(ordered), lambda w: w["i"]))),
        ),
    )


def assess(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, ``clean_text``, ``kept_share`` and the verdict ``kept``.

    New columns replace old ones of the same name. A null or empty text has no
    words, so it fails the base rules. ``kept_share`` is the share of characters
    (white space aside) in lines that pass; a text of none has 1.
    """
    own = text_of(text_col)
    solid = lambda text: F.length(F.regexp_replace(text, SPACE, ""))
    counted = docs.withColumns(
        {
            "n_words": bind(words_of(own), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))),
            "word_chars": solid(own).cast("long"),
            "n_symbols": F.regexp_count(own, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": duplicate_lines(own),
            "clean_text": F.array_join(kept_lines(own), "\n"),
        }
    )
    counted = counted.withColumns({"n_repeat_words": F.col("n_words")["r"], "n_words": F.col("n_words")["n"]})
    judged = counted.withColumns(
        {
            "kept_share": F.when(F.col("word_chars") == 0, F.lit(1.0)).otherwise(
                solid(F.col("clean_text")) / F.col("word_chars")
            ),
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        }
    )
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= 1 - MAX_LOSS))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts and verdict per document, without texts; see ``assess``.

    Repeated rows and null ids have a row each; an empty table gives an empty
    one; other columns are not read.
    """
    return assess(docs.select(id_col, text_col), text_col).select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_share"
    )


def clean_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` for the documents kept, their failing lines removed."""
    rows = docs.select(F.col(text_col).alias("text"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    cleaned = assess(rows, "text").filter("kept")
    return cleaned.select(F.col("row").withField(f"`{text_col}`", F.col("clean_text")).alias("row")).select("row.*")
