"""Dense vector expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoatlas.functions.arrays import bind
from repoatlas.functions.text import _column


def as_double(vector) -> Column:
    return _column(vector).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(vector) -> Column:
    return F.sqrt(
        F.aggregate(as_double(vector), F.lit(0.0), lambda acc, x: acc + x * x)
    )


def l2_normalize(vector) -> Column:
    """``vector`` at length one; a zero vector stays as it is."""
    values = as_double(vector)
    return bind(
        norm(vector),
        lambda length: F.when(length == 0, values).otherwise(
            F.transform(values, lambda x: x / length)
        ),
    )


def cosine(a, b) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)
