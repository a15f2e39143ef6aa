"""Text cleaning, cutting and tokenizing as native column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoatlas.fixed_values import (
    CODE_FENCE,
    LETTERS,
    MAX_MODEL_CHARS,
    MISSING_README,
    NOT_PLAIN_ENGLISH,
    SPACES,
    TFIDF_TOKEN,
    WIDE_SPACES,
    WORD_OR_SYMBOL,
)


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def narrow_spaces(text) -> Column:
    """White space beyond Latin-1 as blanks; most texts pass untouched."""
    text = _column(text)
    narrowed = text
    for space in WIDE_SPACES:
        narrowed = F.replace(narrowed, F.lit(space), F.lit(" "))
    return F.when(text.rlike(r"[^\x00-\xff]"), narrowed).otherwise(text)


def collapse_spaces(text) -> Column:
    """Every run of white space as one blank, none at either end."""
    return F.trim(F.regexp_replace(narrow_spaces(text), f"[{SPACES}]+", " "))


def clean_text(text) -> Column:
    """One cleaning pass: line breaks and commas, fences, then other symbols.

    Commas become blanks before runs of blanks collapse, so one pattern does
    both. The symbols removed last leave blanks behind; a second pass
    (:func:`clean_readme`) collapses those.
    """
    flat = F.trim(F.regexp_replace(narrow_spaces(text), f"[{SPACES},]+", " "))
    unfenced = F.regexp_replace(flat, CODE_FENCE, " ")
    return F.regexp_replace(unfenced, NOT_PLAIN_ENGLISH, " ")


def clean_readme(text) -> Column:
    """Lower-cased text, cleaned twice.

    After the first pass no fence and no foreign symbol is left, so all the
    second one can still do is collapse the blanks.
    """
    return F.trim(F.regexp_replace(clean_text(F.lower(_column(text))), "  +", " "))


def decode_readme(content) -> Column:
    """Base64 README content as cleaned lower-case text."""
    decoded = F.decode(F.unbase64(_column(content)), "UTF-8")
    return F.coalesce(clean_text(F.lower(decoded)), F.lit(MISSING_README))


def truncate_text(text, max_chars: int = MAX_MODEL_CHARS) -> Column:
    return F.left(_column(text), F.lit(max_chars))


def cut_at_last_stop(summary) -> Column:
    """Everything before the last full stop; unchanged without one."""
    summary = _column(summary)
    return F.when(
        F.contains(summary, F.lit(".")),
        F.regexp_extract(summary, r"(?s)^(.*)\.", 1),
    ).otherwise(summary)


def cut_and_capitalize(summary) -> Column:
    """Cut at the last full stop, first letter upper-case, the rest lower."""
    cut = cut_at_last_stop(summary)
    return F.concat(F.upper(F.left(cut, F.lit(1))), F.lower(F.substr(cut, F.lit(2))))


def normalize_label(label) -> Column:
    """A model's label without outer symbols, inner symbols set apart."""
    inner = F.regexp_replace(narrow_spaces(label), f"^[^{LETTERS}]+", "")
    inner = F.regexp_replace(inner, f"[^{LETTERS}]+$", "")
    inner = F.regexp_replace(inner, f"([^{LETTERS}{SPACES}])", " $1 ")
    return F.regexp_replace(inner, f"[{SPACES}]+", " ")


def lead_sentences(text, count: int = 3) -> Column:
    """The first ``count`` sentences, white space collapsed."""
    marked = F.regexp_replace(collapse_spaces(text), r"([.!?]) ", "$1\n")
    return F.concat_ws(" ", F.slice(F.split(marked, "\n"), 1, count))


def normalize_text(text) -> Column:
    """Words and single symbols, one blank between them."""
    tokens = F.regexp_extract_all(_column(text), F.lit(WORD_OR_SYMBOL), 0)
    return F.array_join(tokens, " ")


def words(cleaned) -> Column:
    """Words of a text whose white space is collapsed; no empty ones."""
    return F.array_remove(F.split(_column(cleaned), " "), "")


def terms(text) -> Column:
    """Lower-case terms of two or more word characters."""
    return F.regexp_extract_all(F.lower(_column(text)), F.lit(TFIDF_TOKEN), 0)


def repo_name(url) -> Column:
    """The last path part of a URL."""
    return F.substring_index(_column(url), "/", -1)


def repo_full_name(url) -> Column:
    """``owner/name``: the last two path parts of a URL."""
    return F.substring_index(_column(url), "/", -2)


def anchor(heading) -> Column:
    """The link target of a report heading."""
    return F.replace(F.lower(_column(heading)), F.lit(" "), F.lit("-"))


def distinct_phrases(phrases) -> Column:
    """Phrases joined by blanks, later repeats dropped."""
    return F.array_join(F.array_distinct(_column(phrases)), " ")


def date_floor(as_of, days_ago: int) -> Column:
    """The day ``days_ago`` days before ``as_of``, as ``yyyy-MM-dd``."""
    return F.date_format(F.date_sub(F.lit(as_of).cast("date"), days_ago), "yyyy-MM-dd")


def run_name(batch_ts, prefix: str = "repos_") -> Column:
    """An output name carrying the batch timestamp."""
    stamp = F.date_format(F.lit(batch_ts).cast("timestamp"), "yyyy-MM-dd_HH-mm-ss")
    return F.concat(F.lit(prefix), stamp)
