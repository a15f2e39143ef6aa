"""Joins and numberings that keep a hot key off a single task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoatlas.session import cut_lineage

# A lookup of no more rows and bytes than these is sent to every task.
MAX_BROADCAST_ROWS = 10_000
MAX_BROADCAST_BYTES = 8 << 20
# At most this many keys can each hold more than 1/MAX_HOT_KEYS of all rows.
MAX_HOT_KEYS = 1000
# At most so many of the commonest keys, none of more bytes, are sent to every task.
MAX_COMMON_KEYS = 100_000
MAX_COMMON_BYTES = 64


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    weight: str,
    spread_by: str,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``facts`` with the columns of ``lookup``, which has one row per ``key``.

    The lookup is read several times, so pass one that is computed already (see
    ``cut_lineage``). Its rows and bytes are counted, and a small one is
    broadcast. Beyond that
    ``weight``, its count of fact rows per key, tells the hot keys: those that
    hold more than a thousandth of all rows, so no more than a thousand can be
    hot and only they are broadcast. Rows of all other keys meet their lookup
    row by a shuffled join; in it the hot rows are scattered by ``spread_by``,
    a column with many values.
    """
    held = lookup.agg(F.count("*").alias("n"), F.sum(_row_bytes(lookup)).alias("bytes")).first()
    if held["n"] <= max_broadcast_rows and (held["bytes"] or 0) <= MAX_BROADCAST_BYTES:
        own = [c for c in lookup.columns if c != key]
        return facts.join(F.broadcast(lookup), key, "left").select(*facts.columns, *own)
    total = lookup.agg(F.sum(weight)).scalar()
    is_hot = F.col(weight) * MAX_HOT_KEYS > total
    values = [c for c in lookup.columns if c != key]
    hot = lookup.filter(is_hot).select(
        F.col(key), *[F.col(v).alias(f"hot_{v}") for v in values]
    )
    cold = lookup.filter(~is_hot).withColumn("slot", F.lit(0).cast("long"))
    spread = F.when(F.col(f"hot_{weight}").isNull(), F.lit(0).cast("long")).otherwise(
        F.shiftrightunsigned(F.xxhash64(spread_by), 2) + 1
    )
    joined = (
        facts.join(F.broadcast(hot), key, "left")
        .withColumn("slot", spread)
        .join(cold, [key, "slot"], "left")
    )
    merged = [F.coalesce(f"hot_{v}", v).alias(v) for v in values]
    return joined.select(*facts.columns, *merged)


def common_keys(lookup: DataFrame, key: str, weight: str, most: int = MAX_COMMON_KEYS) -> Column:
    """Which rows of ``lookup``, which has one per ``key``, are those of its commonest keys.

    ``weight`` is the count of fact rows per key. Common keys are of bounded
    length and have a weight above a power of two, the least one that no more
    than ``most`` keys exceed.
    """
    short = F.octet_length(F.col(key).cast("string")) <= MAX_COMMON_BYTES
    above = [F.count_if(short & (F.col(weight) >= (1 << k))) for k in range(63)]
    counts = lookup.agg(*above).first()
    least = next((1 << k for k in range(63) if counts[k] <= most), (1 << 63) - 1)
    return F.coalesce(short & (F.col(weight) >= least), F.lit(False))


def _row_bytes(rows: DataFrame):
    """About how many bytes a row takes."""
    total = F.lit(16)
    for field in rows.schema:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif kind in ("array", "map"):
            total = total + 16 * F.greatest(F.coalesce(F.size(field.name), F.lit(0)), F.lit(0))
        else:
            total = total + 8
    return total.cast("long")


def number_rows(rows: DataFrame, order: list, group: str | None = None) -> DataFrame:
    """``rows`` with ``position``, counted from 0 in ``order`` (in each group).

    The rows are range-sorted, so any number of them, also of one group, is
    spread over all tasks. Each task's rows are counted, and a row's position
    is its place in its task plus the rows of the tasks before. The sorted rows
    are fixed in the checkpoint folder, since both steps must see the same
    placing; pass narrow rows.
    """
    keys = [F.col(group), *order] if group else list(order)
    placed = cut_lineage(
        rows.orderBy(*keys).withColumn("place", F.monotonically_increasing_id())
    )
    task = F.shiftright("place", 33)
    in_task = F.col("place").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumn("task", task)
    # One row per sorting task, so few enough to send to every task.
    counts = placed.groupBy("task").agg(F.count("*").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    numbered = placed.join(F.broadcast(offsets), "task").withColumn("position", F.col("offset") + in_task)
    if group:
        firsts = cut_lineage(
            numbered.groupBy(group).agg(
                F.min("position").alias("first_position"), F.count("*").alias("group_rows")
            )
        )
        numbered = lookup_join(numbered, firsts, group, "group_rows", "place").withColumn(
            "position", F.col("position") - F.col("first_position")
        )
    return numbered.select(*rows.columns, "position")
