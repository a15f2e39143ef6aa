"""Search, paging, counting, exclusion and detail views of the catalog."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas.fixed_values import REPORT_RELEVANCE_CUTOFF
from repoatlas.functions.text import repo_full_name
from repoatlas.operators.skew import number_rows


def catalog_search(
    catalog: DataFrame,
    phrase: str,
    min_stars: int,
    days_ago: int,
    as_of: str,
    page: int | None = None,
    page_size: int = 30,
) -> DataFrame:
    """Repositories whose README holds ``phrase``, newest update first.

    ``page`` (from 0) gives that page of the result; without it the whole
    result is returned, unordered.
    """
    pushed_since = F.date_sub(F.lit(as_of).cast("date"), days_ago).cast("timestamp_ntz")
    found = catalog.filter(
        (F.col("stars_count") >= min_stars)
        & (F.col("pushed_at") >= pushed_since)
        & F.contains(F.lower("readme"), F.lit(phrase.lower()))
    )
    if page is None:
        return found
    ordered = found.orderBy(F.desc("updated_at"), "id")
    return ordered.offset(page * page_size).limit(page_size)


def catalog_pages(
    catalog: DataFrame, page_size: int, group: str | None = None
) -> DataFrame:
    """Every row's page in the newest-first order (of its group)."""
    numbered = number_rows(catalog, [F.desc("updated_at"), F.asc("id")], group)
    return numbered.withColumn("page", F.floor(F.col("position") / page_size))


def top_k(rows: DataFrame, k: int, order_by: str, ascending: bool = False) -> DataFrame:
    """The first ``k`` rows by any column, nulls last, ties by ``id``."""
    key = F.asc_nulls_last(order_by) if ascending else F.desc_nulls_last(order_by)
    return rows.orderBy(key, "id").limit(k)


def relevance_cutoff(
    catalog: DataFrame, cutoff: float = REPORT_RELEVANCE_CUTOFF
) -> DataFrame:
    """Rows of at least the given relevance; rows without one are dropped."""
    return catalog.filter(F.col("relevance") >= cutoff)


def exclude_urls(catalog: DataFrame, ignored: DataFrame) -> DataFrame:
    """Rows whose ``url`` is not in the ``ignored`` list, which may repeat."""
    return catalog.join(ignored.select("url").distinct(), "url", "left_anti").select(
        *catalog.columns
    )


def new_rows(current: DataFrame, history: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``current`` whose key the history has never seen."""
    seen = history.select(key).distinct()
    return current.join(seen, key, "left_anti").select(*current.columns)


def catalog_counts(catalog: DataFrame, approximate: bool = False) -> DataFrame:
    """Row count and count of distinct URLs."""
    urls = F.approx_count_distinct("url") if approximate else F.countDistinct("url")
    return catalog.agg(F.count("*").alias("row_count"), urls.alias("url_count"))


def distinct_keywords(sightings: DataFrame) -> DataFrame:
    """Every keyword once."""
    return sightings.select("keyword").distinct()


def state_counts(activity: DataFrame) -> DataFrame:
    """Open, closed and all items and distinct contributors per repository.

    ``activity`` has one row per item: ``id``, ``kind``, ``state``,
    ``contributor``. Open and closed items are counted of every kind, as the
    host lists them, ``pulls`` only of kind ``pull``.
    """
    return activity.groupBy("id").agg(
        F.count_if(F.col("state") == "open").alias("open_issues"),
        F.count_if(F.col("state") == "closed").alias("closed_issues"),
        F.count_if(F.col("kind") == "pull").alias("pulls"),
        F.countDistinct("contributor").alias("contributors"),
    )


def repo_detail_view(
    catalog: DataFrame, activity: DataFrame, full_name: str | None = None
) -> DataFrame:
    """Detail rows with activity counts; of one ``owner/name`` if given."""
    named = catalog.withColumn("full_name", repo_full_name("url"))
    if full_name is not None:
        named = named.filter(F.col("full_name") == full_name)
        activity = activity.join(named.select("id"), "id", "left_semi")
    counts = ["open_issues", "closed_issues", "pulls", "contributors"]
    own = [c for c in named.columns if c not in counts]
    joined = named.select(*own).join(state_counts(activity), "id", "left")
    return joined.select(*own, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def path_filter(
    rows: DataFrame, path: str, directories: list[str], extensions: list[str]
) -> DataFrame:
    """Rows whose path lies in one of the directories and has one of the endings."""
    in_directory, has_ending = F.lit(False), F.lit(False)
    for directory in directories:
        in_directory = in_directory | F.startswith(F.col(path), F.lit(directory.rstrip("/") + "/"))
    for extension in extensions:
        has_ending = has_ending | F.endswith(F.col(path), F.lit(extension))
    return rows.filter(in_directory & has_ending)


def union_batches(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All batches one after another; a column a batch lacks is null."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
