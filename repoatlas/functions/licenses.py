"""License names from first lines and from lines inside a text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoatlas.fixed_values import LICENSE_RULES, OTHER_LICENSE, UNKNOWN_LICENSE
from repoatlas.functions.encoding import collapse_edges
from repoatlas.functions.text import _column

# Words that introduce a license name inside running text.
LEAD_IN = (
    r"(?i)^(?:this (?:work|project|software) is )?"
    r"(?:licensed|released|distributed|available) under (?:the )?"
)
LICENSE_WORD = r"(?i)\blicen[cs]e\b"


def license_of_line(line) -> Column:
    """The first rule that matches ``line``; ``Other`` if none does."""
    line = _column(line)
    first_match = F.coalesce(
        *[
            F.when(line.rlike("(?i)" + pattern), F.lit(name))
            for name, pattern in LICENSE_RULES
        ],
        F.lit(OTHER_LICENSE),
    )
    return F.when(line.isNotNull(), first_match)


def license_of_text(text) -> Column:
    """The license named by the first line of a license file."""
    return license_of_line(collapse_edges(F.substring_index(_column(text), "\n", 1)))


def repo_license(provider_name, text) -> Column:
    """The host's own license name, else the one the file's first line names."""
    provider_name, text = _column(provider_name), _column(text)
    return (
        F.when(provider_name.isNull() & text.isNull(), F.lit(UNKNOWN_LICENSE))
        .when(provider_name.isNotNull() & (provider_name != OTHER_LICENSE), provider_name)
        .when(text.isNull(), F.lit(OTHER_LICENSE))
        .otherwise(license_of_text(text))
    )


def license_candidate(line) -> Column:
    """``line`` from the license name on; null where it speaks of none."""
    line = collapse_edges(line)
    return F.when(
        line.rlike(LEAD_IN) | line.rlike(LICENSE_WORD),
        F.regexp_replace(line, LEAD_IN, ""),
    )


def matching_rules(line) -> Column:
    """Positions of all rules that match ``line``, in rule order."""
    line = _column(line)
    return F.array_compact(
        F.array(
            *[
                F.when(line.rlike("(?i)" + pattern), F.lit(ord_))
                for ord_, (_, pattern) in enumerate(LICENSE_RULES)
            ]
        )
    )
