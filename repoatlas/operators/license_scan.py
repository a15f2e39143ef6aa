"""License names on any line of a text, their counts, and a rule audit."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas.fixed_values import LICENSE_RULES
from repoatlas.functions.licenses import (
    license_candidate,
    license_of_line,
    matching_rules,
)


def license_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every line that speaks of a license, cut to start at its name."""
    # A quick look that no text with such a line fails.
    lowered = F.lower(text)
    speaking = docs.filter(
        F.contains(lowered, F.lit("licen")) | F.contains(lowered, F.lit(" under "))
    )
    lines = speaking.select(doc_id, F.posexplode_outer(F.split(text, "\n")).alias("line_no", "line"))
    named = lines.withColumn("candidate", license_candidate("line"))
    return named.filter(F.col("candidate").isNotNull())


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every license line with the license it names."""
    return license_lines(docs, doc_id, text).select(
        doc_id, "line_no", "line", license_of_line("candidate").alias("license")
    )


def license_histogram(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines and documents per license."""
    return (
        license_scan(docs, doc_id, text)
        .groupBy("license")
        .agg(F.count("*").alias("lines"), F.countDistinct(doc_id).alias("documents"))
    )


def license_rule_audit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per rule, the lines it matches and those where it is the first to match.

    A rule that matches but never comes first is shadowed by an earlier one.
    """
    matches = license_lines(docs, doc_id, text).select(
        matching_rules("candidate").alias("rules")
    )
    counted = (
        matches.select(
            F.explode_outer("rules").alias("ord"), F.get("rules", F.lit(0)).alias("first")
        )
        .filter("ord IS NOT NULL")
        .groupBy("ord")
        .agg(
            F.count("*").alias("lines_matched"),
            F.count_if(F.col("ord") == F.col("first")).alias("lines_fired"),
        )
    )
    rules = docs.sparkSession.createDataFrame(
        [(i, name) for i, (name, _) in enumerate(LICENSE_RULES)], "ord int, license string"
    )
    joined = rules.join(counted, "ord", "left")
    matched = F.coalesce("lines_matched", F.lit(0))
    fired = F.coalesce("lines_fired", F.lit(0))
    return joined.select(
        "ord",
        "license",
        matched.alias("lines_matched"),
        fired.alias("lines_fired"),
        ((matched > 0) & (fired == 0)).alias("shadowed"),
    )
