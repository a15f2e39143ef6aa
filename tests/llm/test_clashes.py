"""A table whose other columns bear every name the operators use inside."""

import pytest
from pyspark.sql import functions as F

from repoatlas.llm import exact_dedup, langid, pii, quality_model, quality_rules, sharding, simhash

NAMES = (
    "own_key found_id found_key found_spans more_id more_key more id text_key base spans occurrences held_text masked "
    "words at unit start end seed instance pattern patterns plain places row row_id row_key "
    "marked_id marked_key marked_text marked_kept marked_rows tied_sha first_key keep_id group_size kept hash content "
    "chosen_id chosen_lang known_id known_label mean_label label order labelled "
    "n_words word_chars n_symbols n_dup_lines n_repeat_words clean_text kept_share base_failed "
    "shard bucket slot size place fp root node pick held no_id component_id score lang_pred"
).split()

LINES = [" ".join(f"{a}{b}{c}" for c in ("rn", "st", "ld", "mp", "nk", "rt")) + "." for a in "bdfgl" for b in "aeo"]
ROWS = [
    (1, "\n".join(LINES)),
    (2, "Read this mail of ann@example.com today."),
    (2, "Read this mail of ann@example.com today."),
    (3, "READ this mail of ann@example.com today."),
    (4, None),
    (None, "a text without an id"),
]


@pytest.fixture
def crowded(table):
    """The rows, each other column holding its own name and the row's id."""
    return table(ROWS).withColumns({n: F.concat(F.lit(n), F.lit(" "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in NAMES})


def _unharmed(result, crowded):
    assert result.columns == crowded.columns
    rows = result.collect()
    for r in rows:
        for n in NAMES:
            assert r[n] == f"{n} {'-' if r.doc_id is None else r.doc_id}", n
    return rows


def test_dedup_keeps_other_columns(crowded):
    ids = sorted(str(r.doc_id) for r in _unharmed(exact_dedup.drop_duplicates(crowded), crowded))
    assert ids == ["1", "2", "4", "None"]
    ids = sorted(str(r.doc_id) for r in _unharmed(simhash.drop_near_duplicates(crowded), crowded))
    assert ids == ["1", "2", "4", "None"]


def test_redaction_keeps_other_columns(crowded):
    texts = [r.text for r in _unharmed(pii.redact(crowded), crowded)]
    assert texts.count("Read this mail of [EMAIL] today.") == 2 and None in texts and len(texts) == len(ROWS)


def test_cleaning_keeps_other_columns(crowded):
    rows = _unharmed(quality_rules.clean_documents(crowded), crowded)
    assert [(r.doc_id, r.text) for r in rows] == [ROWS[0]]


def test_language_stage_keeps_other_columns(crowded):
    model = langid.fit(crowded)
    assert model.languages == ["en"]
    _unharmed(langid.keep_identified(crowded, model), crowded)


def test_training_rows_read_their_columns_only(crowded, spark):
    labels = spark.createDataFrame([(i, 1, "x") for i in range(1, 5)], "doc_id long, quality int, text string")
    rows = quality_model.training_rows(crowded, labels.withColumn("known_id", F.lit("x"))).collect()
    texts = {i: t for i, t in ROWS}
    assert rows and all(r.label == 1.0 and r.text in (texts[r.id], ROWS[1][1]) for r in rows)


def test_shards_keep_other_columns(crowded, spark, tmp_path):
    sharding.write_shards(crowded, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*crowded.columns, "shard_"}
    assert len(_unharmed(back.select(*crowded.columns), crowded)) == len(ROWS)
