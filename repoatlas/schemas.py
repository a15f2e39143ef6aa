"""Schemas of the catalog tables and of the file formats around them."""

from pyspark.sql import types as T

from repoatlas.fixed_values import UNKNOWN_LICENSE

# Columns whose default is the batch timestamp rather than a constant.
BATCH_TIMESTAMP = object()

_TEXT, _COUNT, _TIME = T.StringType(), T.LongType(), T.TimestampType()

# (name, type, default) of the current-state table; None means "stays null".
_CATALOG_COLUMNS = [
    ("id", _COUNT, None),
    ("url", _TEXT, None),
    ("license", _TEXT, UNKNOWN_LICENSE),
    ("readme", _TEXT, ""),
    ("stars_count", _COUNT, 0),
    ("forks_count", _COUNT, 0),
    ("pushed_at", _TIME, BATCH_TIMESTAMP),
    ("updated_at", _TIME, BATCH_TIMESTAMP),
    ("created_at", _TIME, BATCH_TIMESTAMP),
    ("languages", _TEXT, ""),
    ("topics", _TEXT, ""),
    ("open_issues", _COUNT, 0),
    ("closed_issues", _COUNT, 0),
    ("description", _TEXT, ""),
    ("fork", T.IntegerType(), 0),
    ("size", _COUNT, 0),
    ("watchers_count", _COUNT, 0),
    ("language", _TEXT, ""),
    ("keyword", _TEXT, ""),
    ("additional_keywords", _TEXT, ""),
    ("is_relevant", T.DoubleType(), None),
    ("brief_desc", _TEXT, None),
    ("class_label", _TEXT, None),
    ("num_stars", _COUNT, 0),
    ("days_ago", _COUNT, 0),
    ("fetch_date", _TIME, BATCH_TIMESTAMP),
]

CATALOG_SCHEMA = T.StructType(
    [T.StructField(name, kind, name != "id") for name, kind, _ in _CATALOG_COLUMNS]
)
CATALOG_DEFAULTS = {
    name: default for name, _, default in _CATALOG_COLUMNS if default is not None
}
HISTORY_SCHEMA = T.StructType(
    CATALOG_SCHEMA.fields + [T.StructField("timestamp", _TIME)]
)

# The legacy CSV carries strings only and may repeat its header row.
LEGACY_CSV_COLUMNS = [
    "repo_url", "license", "num_stars", "num_forks", "last_push", "languages",
    "topics", "keyword", "is_relevant", "readme", "brief_desc", "topic",
    "additional_keywords",
]
LEGACY_CSV_SCHEMA = T.StructType(
    [T.StructField(name, _TEXT) for name in LEGACY_CSV_COLUMNS]
)

# The export CSV leaves out the README and the search thresholds.
EXPORT_CSV_COLUMNS = [
    "id", "url", "license", "stars_count", "forks_count", "pushed_at",
    "updated_at", "created_at", "languages", "topics", "open_issues",
    "closed_issues", "description", "fork", "size", "watchers_count",
    "language", "keyword", "additional_keywords", "is_relevant", "brief_desc",
    "class_label", "fetch_data",
]
EXPORT_CSV_SCHEMA = T.StructType(
    [
        T.StructField(
            name,
            CATALOG_SCHEMA[name].dataType if name in CATALOG_SCHEMA.names else _TEXT,
        )
        for name in EXPORT_CSV_COLUMNS
    ]
)

PROGRESS_SCHEMA = T.StructType(
    [T.StructField("keyword", _TEXT), T.StructField("last_page", _COUNT)]
)
