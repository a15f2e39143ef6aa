"""The curated list as ordered text rows.

A section can hold any number of entries, so a report is never put together as
one string: it is a table of ``(block, section_seq, seq, line)`` whose sorted
lines, each followed by a line break, are the document.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoatlas.fixed_values import (
    REPORT_CONTENTS_TITLE,
    REPORT_RELEVANCE_CUTOFF,
    REPORT_TITLE,
    STAR_BADGE,
)
from repoatlas.functions.text import anchor, repo_name
from repoatlas.operators.catalog import exclude_urls, relevance_cutoff
from repoatlas.operators.dedupe import dedupe_first
from repoatlas.operators.skew import lookup_join
from repoatlas.session import cut_lineage

REPORT_ORDER = ["block", "section_seq", "seq"]
DEFAULT_INTRO = "A curated list of GitHub repositories related to various categories."

_HEAD, _CONTENTS, _SECTIONS = 0, 1, 2
# Sorts a section's closing row behind all its entries.
_LAST = (1 << 63) - 1


def report_toc(catalog: DataFrame, group: str = "class_label") -> DataFrame:
    """Sections in order of first appearance, with entry count and anchor."""
    return (
        catalog.groupBy(group)
        .agg(F.min("seq").alias("section_seq"), F.count("*").alias("entries"))
        .withColumn("anchor", anchor(group))
    )


def report_sections(catalog: DataFrame, line: Column, group: str = "class_label") -> DataFrame:
    """Every entry's line with its section's place in the report."""
    return _sectioned(catalog, line, group)[1]


def _sectioned(catalog: DataFrame, line: Column, group: str) -> tuple[DataFrame, DataFrame]:
    """Sections, and entries with their section's place.

    The entry lines are made once; contents, headings and entries read them.
    """
    entries = cut_lineage(catalog.select(group, "seq", line.alias("line")))
    sections = cut_lineage(report_toc(entries, group))
    lookup = sections.select(group, "section_seq", "entries")
    placed = lookup_join(entries, lookup, group, "entries", "seq").drop("entries")
    return sections, placed


def _rows(rows: DataFrame, block: int, section_seq, seq, line) -> DataFrame:
    return rows.select(
        F.lit(block).alias("block"),
        section_seq.cast("long").alias("section_seq"),
        seq.cast("long").alias("seq"),
        line.alias("line"),
    )


def _fixed_rows(rows: DataFrame, block: int, lines: list[str], section_seq: int, start: int) -> DataFrame:
    table = rows.sparkSession.createDataFrame(
        list(enumerate(lines, start)), "seq long, line string"
    )
    return _rows(table, block, F.lit(section_seq), F.col("seq"), F.col("line"))


def _star_badge(stars: str) -> Column:
    before, after = STAR_BADGE.split("{stars}")
    return F.concat(F.lit(before), _text(stars), F.lit(after))


def _text(column: str) -> Column:
    """The value as text; an entry is not lost for one that is missing."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def catalog_entry(component_label: str) -> Column:
    """The entry of a catalog row, one line with details below it."""
    others = F.replace(F.coalesce("additional_keywords", F.lit("")), F.lit("|"), F.lit(","))
    return F.concat(
        F.lit("\n- **["), repo_name(_text("url")), F.lit("]("), _text("url"), F.lit(")** - "),
        F.coalesce("brief_desc", F.lit("None")), F.lit(" "), _star_badge("stars_count"),
        F.lit(f"\n    - {component_label}: "), F.coalesce("keyword", F.lit("")),
        F.lit(", "), others, F.lit("\n    - auto_generated = True\n"),
    )


def csv_entry(component_label: str) -> Column:
    """The entry of a row of the legacy result file."""
    return F.concat(
        F.lit("- ["), repo_name(_text("repo_url")), F.lit("]("), _text("repo_url"),
        F.lit("): License: "), _text("license"), F.lit(": "), _text("brief_desc"),
        F.lit(" "), _star_badge("num_stars"), F.lit(f"\n{component_label} used : "),
        _text("keyword"), F.lit(" \nLanguages: "), _text("languages"), F.lit(" "),
    )


def report_db(
    catalog: DataFrame,
    ignored: DataFrame,
    cutoff: float = REPORT_RELEVANCE_CUTOFF,
    title: str = REPORT_TITLE,
    intro: str = DEFAULT_INTRO,
    component_label: str = "Components",
) -> DataFrame:
    """The report of the catalog: exclusions, cut-off, contents and sections."""
    listed = relevance_cutoff(exclude_urls(catalog, ignored), cutoff).withColumn(
        "class_label", F.coalesce("class_label", F.lit("None"))
    )
    sections, entries = _sectioned(listed, catalog_entry(component_label), "class_label")
    label, place = F.col("class_label"), F.col("section_seq")
    contents = F.concat(F.lit("- ["), label, F.lit("](#"), F.col("anchor"), F.lit(")"))
    parts = [
        _fixed_rows(catalog, _HEAD, [title + "\n", intro + "\n"], 0, 0),
        _fixed_rows(catalog, _CONTENTS, [REPORT_CONTENTS_TITLE + "\n"], -1, -1),
        _rows(sections, _CONTENTS, place, place, contents),
        _fixed_rows(catalog, _CONTENTS, [""], _LAST, 0),
        _rows(sections, _SECTIONS, place, F.lit(-1), F.concat(F.lit("### "), label, F.lit("\n"))),
        _rows(entries, _SECTIONS, place, F.col("seq"), F.col("line")),
        _rows(sections, _SECTIONS, place, F.lit(_LAST), F.lit("")),
    ]
    return _union(parts)


def report_csv(
    rows: DataFrame,
    title: str = REPORT_TITLE,
    intro: str = DEFAULT_INTRO,
    component_label: str = "Component",
) -> DataFrame:
    """The report of the legacy result rows (with ``seq``), first per URL."""
    listed = dedupe_first(rows, "repo_url").withColumn("topic", _text("topic"))
    sections, entries = _sectioned(listed, csv_entry(component_label), "topic")
    place = F.col("section_seq")
    # Entries end in a blank of their own that opens the next line.
    opened = F.when(F.col("seq") == place, F.col("line")).otherwise(
        F.concat(F.lit(" "), F.col("line"))
    )
    parts = [
        _fixed_rows(rows, _HEAD, [title + "\n", intro + "\n"], 0, 0),
        _fixed_rows(rows, _CONTENTS, [REPORT_CONTENTS_TITLE + "\n"], -1, -1),
        _rows(sections, _SECTIONS, place, F.lit(-1), F.concat(F.lit("### "), F.col("topic"), F.lit("\n"))),
        _rows(entries, _SECTIONS, place, F.col("seq"), opened),
        _rows(sections, _SECTIONS, place, F.lit(_LAST), F.lit(" ")),
    ]
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first
