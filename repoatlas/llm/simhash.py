"""Near duplicates by SimHash, found in a byte-position index.

A fingerprint has 64 bits in eight byte positions. Two that differ in at most
``MAX_BITS`` = 2 bits differ in at most two positions, so a pair's tally of
shared positional bytes is at least ``MIN_SHARED`` = 6. Posting lists of one
byte would hold 1/256 of all fingerprints each, and the pairs in them would grow
with the square of the input. The lists are therefore kept per set of six
positions: a pair's tally reaches six exactly if it meets in one of the 28
lists. A list's members differ in the two open positions only, so it never
holds more than 65,536 of them.
"""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoatlas.llm.components import connected_components
from repoatlas.llm.rows import keep_rows
from repoatlas.llm.tasks import digest, map_texts
from repoatlas.operators.skew import lookup_join
from repoatlas.session import ship_package, written

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
POSITIONS = 8
MIN_SHARED = POSITIONS - MAX_BITS
# The two open positions of each list.
OPEN = list(combinations(range(POSITIONS), MAX_BITS))
# Lists of up to so many members are compared pair by pair in one matrix.
MATRIX_MEMBERS = 64
# Hashes whose bits are counted at a time.
BLOCK = 1 << 16

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_hashes(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The hashes of the text's shingles of ``size`` words; fewer words are one shingle."""
    words = _WORD.findall(text.encode().lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    hash64 = xxhash.xxh64_intdigest
    return np.fromiter((hash64(s, SEED) for s in shingles), np.uint64)


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """The SimHash of the text's word shingles as a signed 64-bit number."""
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), BLOCK):
        block = hashes[start : start + BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``fp``, and ``text_key`` per document; null texts are empty, their ``fp`` zero."""
    def start():
        return lambda texts: ([fingerprint(t) for t in texts], [digest(t) for t in texts])

    fields = [("fp", T.LongType()), ("text_key", T.StringType())]
    return map_texts(docs, fields, start, (id_col,), text_col).withColumnRenamed(id_col, "id")


def posting_lists(prints: DataFrame) -> DataFrame:
    """``members`` of each list of distinct fingerprints that share six positional bytes."""
    masks = [(1 << 64) - 1 ^ sum(0xFF << (8 * p) for p in pair) for pair in OPEN]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    shared = F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])
    return (
        prints.select("fp", F.posexplode(shared).alias("positions", "bytes"))
        .groupBy("positions", "bytes")
        .agg(F.collect_list("fp").alias("members"))
        .filter(F.size("members") > 1)
        .select("positions", "members")
    )


def _links_in_matrix(members: np.ndarray) -> np.ndarray:
    """For each member the smallest place among those it is linked to by pairs."""
    differ = members[:, None] ^ members[None, :]
    tally = (differ.view(np.uint8).reshape(*differ.shape, POSITIONS) == 0).sum(axis=2)
    linked = (tally >= MIN_SHARED) & (np.bitwise_count(differ.view(np.uint64)) <= MAX_BITS)
    place = np.arange(len(members))
    while True:
        new = np.where(linked, place[None, :], len(members)).min(axis=1)
        new = new[new]
        if (new == place).all():
            return place
        place = new


def _links_by_variants(members: np.ndarray, positions: int) -> np.ndarray:
    """The same for a long list, in linear time.

    Two members are within two bits exactly if they share one of the values
    that each becomes with at most one bit of the open positions changed.
    """
    low, high = (((members >> (8 * p)) & 0xFF) for p in OPEN[positions])
    value = low | (high << 8)
    variants = value[:, None] ^ np.array([0, *(1 << b for b in range(16))])[None, :]
    place = np.arange(len(members))
    while True:
        least = np.full(1 << 16, len(members))
        np.minimum.at(least, variants, place[:, None])
        new = least[variants].min(axis=1)
        new = new[new]
        if (new == place).all():
            return place
        place = new


def links(prints: DataFrame) -> DataFrame:
    """``(src, dst)`` between distinct fingerprints: those within two bits are connected.

    A list gives each of its linked members one edge, to the smallest member it
    reaches inside the list, so edges stay linear in the members while no two
    fingerprints within two bits remain unconnected.
    """
    ship_package(prints.sparkSession)
    schema = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])

    def run(batches):
        for batch in batches:
            src, dst = [], []
            kinds = batch.column(0).to_numpy()
            lists = batch.column(1)
            values, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            for kind, start, end in zip(kinds, [0, *ends[:-1]], ends):
                members = np.sort(values[start:end])
                if len(members) <= MATRIX_MEMBERS:
                    root = members[_links_in_matrix(members)]
                else:
                    root = members[_links_by_variants(members, int(kind))]
                apart = root != members
                src.append(members[apart])
                dst.append(root[apart])
            if src:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x), pa.int64()) for x in (src, dst)], names=["src", "dst"]
                )

    return posting_lists(prints).mapInArrow(run, schema).distinct()


def _components(rows: DataFrame) -> DataFrame:
    """``rows`` (``id``, ``fp``, ..., computed already) with the ``component_id`` of each."""
    prints = written(rows.groupBy("fp").agg(F.min("id").alias("least_id"), F.count("*").alias("copies")))
    roots = connected_components(links(prints.select("fp")))
    placed = written(
        prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
            "root", F.coalesce("root", "fp")
        )
    )
    # Few fingerprints have one root, but no bound holds: the sizes tell.
    tops = written(
        placed.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("prints"))
        .filter("prints > 1")
    )
    named = written(
        lookup_join(placed, tops, "root", "prints", "fp").select(
            "fp", F.when(F.col("prints").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"),
            "copies", "root",
        )
    )
    return lookup_join(rows, named, "fp", "copies", "text_key")


def hex_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, ``fingerprint`` in hex and ``component_id``.

    ``component_id`` is the smallest id that can be reached over links of at
    most two differing bits, the document's own included. Ids that are null are
    passed over; a component of null ids only has a null ``component_id``.
    Documents without a word have fingerprint zero and are linked like any
    other. Repeated rows get a result each; an empty table gives an empty one;
    other columns are not read.
    """
    found = _components(written(fingerprints(docs, id_col, text_col)))
    return found.select(F.col("id").alias(id_col), hex_of("fp").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one document of each component.

    The smallest id stays (null ids come last), of rows that repeat it the one
    with the smallest digest of its text.
    """
    found = written(_components(written(fingerprints(docs, id_col, text_col))))
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("text_key").alias("text_key"))
    chosen = written(
        found.groupBy("root").agg(F.min(order).alias("pick"), F.count("*").alias("held")).filter("held > 1")
    )
    marked = lookup_join(found.select("id", "text_key", "root"), chosen, "root", "held", "text_key")
    own = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("text_key").alias("text_key"))
    verdicts = marked.select("id", "text_key", (F.col("pick").isNull() | (F.col("pick") == own)).alias("kept"))
    return keep_rows(docs, verdicts, id_col, text_col)
