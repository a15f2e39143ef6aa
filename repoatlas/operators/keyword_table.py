"""Keyword tables of any length against texts, each text read once.

The keywords go to the tasks as an automaton that finds all of them in one pass
over a text, overlapping ones too, whatever their number. A table beyond the
bytes a task may hold is cut into parts, each with an automaton of its own.
"""

import math
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoatlas.functions.text import _column
from repoatlas.session import ship_package, written

# Characters of keywords in one automaton; it takes about a hundred bytes for each.
MAX_CHARS = 4_000_000

_automata: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, keywords: dict[str, int]) -> ahocorasick.Automaton:
    """The worker's automaton of a part; only the last one asked for is kept."""
    if name not in _automata:
        _automata.clear()
        built = ahocorasick.Automaton()
        for keyword, number in keywords.items():
            built.add_word(keyword, number)
        built.make_automaton()
        _automata[name] = built
    return _automata[name]


def match_keywords(
    docs: DataFrame,
    keywords: DataFrame,
    doc_id: str = "id",
    text: str = "readme",
    keyword: str = "keyword",
    max_chars: int = MAX_CHARS,
) -> DataFrame:
    """``(doc_id, keyword, n)`` for every keyword a text contains, ``n`` counting its places.

    Places may overlap. Keywords that are null or empty match nothing, repeated
    ones count once; null texts have none. Case counts. Rows of ``docs`` that
    repeat an id are told one by one.
    """
    ship_package(docs.sparkSession)
    table = written(
        keywords.select(F.col(keyword).alias("keyword")).filter("keyword is not null and keyword != ''").distinct()
    )
    chars = table.agg(F.sum(F.length("keyword")).alias("n")).first()["n"] or 0
    # Hashing fills parts unevenly, so they are planned for half.
    parts = max(1, math.ceil(2 * chars / max_chars))
    rows = docs.select(F.col(doc_id), _column(text).alias("text")).filter("text is not null")
    found = None
    for number in range(parts):
        held = table.filter(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == number)
        part = _matches(rows, [r.keyword for r in held.sort("keyword").toLocalIterator()])
        found = part if found is None else found.unionByName(part)
    return found


def _matches(rows: DataFrame, keywords: list[str]) -> DataFrame:
    shipped = rows.sparkSession.sparkContext.broadcast({k: n for n, k in enumerate(keywords)})
    name = uuid.uuid4().hex
    schema = T.StructType([rows.schema[0], *T.StructType.fromDDL("keyword string, n long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not shipped.value:
            return
        automaton, names = _automaton(name, shipped.value), list(shipped.value)
        for batch in batches:
            which, found, counts = [], [], []
            for place, text in enumerate(batch.column(1).to_pylist()):
                times: dict[int, int] = {}
                for _, number in automaton.iter(text):
                    times[number] = times.get(number, 0) + 1
                which += [place] * len(times)
                found += [names[k] for k in times]
                counts += times.values()
            ids = batch.column(0).take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.string()), pa.array(counts, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)
