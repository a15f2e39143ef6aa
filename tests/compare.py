"""Spark results against DuckDB's, value by value.

Run ``python -m tests.compare <sf_dir> [query ...]`` for a report.
"""

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _kind(dtype) -> str:
    text = str(dtype).lower()
    for names, kind in (
        (("bigint", "long"), "bigint"), (("int",), "int"), (("double",), "double"),
        (("varchar", "string"), "text"), (("bool",), "bool"),
    ):
        if any(n in text for n in names):
            return kind
    return text


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def difference(spark_df, connection, sql: str) -> str | None:
    """What differs, or None."""
    result = connection.sql(sql)
    if sorted(spark_df.columns) != sorted(result.columns):
        return f"columns {spark_df.columns} != {result.columns}"
    ours = {f.name: _kind(f.dataType.simpleString()) for f in spark_df.schema}
    theirs = {c: _kind(t) for c, t in zip(result.columns, result.types)}
    if ours != theirs:
        return f"types {ours} != {theirs}"
    mine = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    other = _rows(result.columns, result.fetchall())
    if len(mine) != len(other):
        return f"{len(mine)} rows != {len(other)}"
    for a, b in zip(mine, other):
        # By their text, which tells 0.0 from -0.0.
        if repr(a) != repr(b):
            return f"{sum(repr(x) != repr(y) for x, y in zip(mine, other))} rows differ, first {str(a)[:300]} != {str(b)[:300]}"
    return None if mine else "no rows"


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from repoatlas.session import get_spark

    spark = get_spark("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    oracle, failed = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracle:
                problem = difference(df, connection, oracle[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
