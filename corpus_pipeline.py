"""Documents to packed training sequences, in five stages.

Each stage takes what the one before kept, as a table that was written and read
again, and its decisions take effect: documents whose language is not told go,
then exact copies, then near copies, personal data is replaced by the name of
its kind, and the rest is cut into tokens and packed into sequences.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoatlas.llm import exact_dedup, langid, packing, pii, simhash
from repoatlas.llm.tasks import documents
from repoatlas.session import use_checkpoint_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language a model fitted on the labelled ones can tell."""
    return langid.keep_identified(docs, langid.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for the case of A-Z: the smallest id."""
    return exact_dedup.drop_duplicates(docs, keep="smallest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints of at most two differing bits: the smallest id."""
    return simhash.drop_near_duplicates(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; ``n_chars`` follows the text."""
    redacted = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    # A null text keeps the count it came with.
    return redacted.withColumn("n_chars", F.coalesce(length, "n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

# Language models, fingerprint links and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result for the ``documents`` of ``sf_dir``.

    A stage's table is written to the checkpoint folder. An empty table goes
    through all stages; nulls, repeated rows and other columns are treated as
    the operators say.
    """
    docs = documents(spark, sf_dir)
    folder = f"{use_checkpoint_folder(spark)}/stages/{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
