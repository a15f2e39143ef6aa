"""Array expressions that other expressions are made of."""

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoatlas.functions.text import _column


def bind(value, use) -> Column:
    """``use(value)`` with ``value`` computed once.

    Inside the function of an array operation a column expression would be
    computed again for every element.
    """
    return F.get(F.transform(F.array(_column(value)), use), F.lit(0))


def constant(value, kind: str) -> Column:
    """A list or dict as one constant of the plan, whatever its size."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def literal_strings(values: list[str]) -> Column:
    return constant(values, "array<string>")


def kept(tokens, wanted: list[str]) -> Column:
    """The tokens that are among ``wanted``, repeats included.

    The intersection hashes; the search per token is left with what it found.
    """

    def search(held) -> Column:
        return bind(
            F.array_intersect(held, literal_strings(wanted)),
            lambda found: F.filter(held, lambda t: F.array_contains(found, t)),
        )

    return bind(tokens, search)


def occurrences(tokens, token) -> Column:
    return F.size(F.filter(_column(tokens), lambda t: t == _column(token)))


def term_places(tokens) -> Column:
    """``(term, tf, first_pos)`` for each token, in term order.

    Tokens are sorted with their places; a term begins where the one before
    differs, and there its first place is.
    """

    def starts(ordered) -> Column:
        places = F.transform(
            ordered,
            lambda t, i: F.when((i == 0) | (F.get(ordered, i - 1)["term"] != t["term"]), i),
        )
        return F.filter(places, lambda i: i.isNotNull())

    def counts(ordered, first) -> Column:
        return F.transform(
            first,
            lambda place, i: F.struct(
                F.get(ordered, place)["term"].alias("term"),
                (F.coalesce(F.get(first, i + 1), F.size(ordered)) - place).alias("tf"),
                F.get(ordered, place)["pos"].alias("first_pos"),
            ),
        )

    numbered = F.transform(_column(tokens), lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    return bind(
        F.sort_array(numbered),
        lambda ordered: bind(starts(ordered), lambda first: counts(ordered, first)),
    )


def token_counts(tokens) -> Column:
    """``(term, n)`` for each token, in term order.

    Sorting puts equal tokens side by side; a count is the distance between the
    first places of two neighbouring terms.
    """

    def starts(ordered) -> Column:
        places = F.transform(
            ordered,
            lambda t, i: F.when((i == 0) | (F.get(ordered, i - 1) != t), i),
        )
        return F.filter(places, lambda i: i.isNotNull())

    def counts(ordered, first) -> Column:
        return F.transform(
            first,
            lambda place, i: F.struct(
                F.get(ordered, place).alias("term"),
                (F.coalesce(F.get(first, i + 1), F.size(ordered)) - place)
                .cast("double")
                .alias("n"),
            ),
        )

    return bind(
        F.sort_array(_column(tokens)),
        lambda ordered: bind(starts(ordered), lambda first: counts(ordered, first)),
    )
