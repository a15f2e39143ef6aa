import numpy as np
import pytest

from repoatlas.llm import langid, quality_model, queries
from repoatlas.llm.tasks import documents
from tests.conftest import SMALL
from tests.llm.conftest import AWKWARD


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(documents(spark, "/root/testdata/sf0.01"))


def test_held_out_language(spark):
    rows = queries.QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in documents(spark, "/root/testdata/sf0.01").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and len(held) > 100
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_spans_of_a_mixed_text(model, texts):
    rows = {langid.identify(model, t)[0]: t for t in texts.values() if 400 < len(t) < 4000}
    german, spanish = rows["de"][:300].rsplit(" ", 1)[0], rows["es"][:300].rsplit(" ", 1)[0]
    lang, score, spans = langid.identify(model, german + " " + spanish)
    assert [s[2] for s in spans] == ["de", "es"]
    assert abs(spans[1][0] - len(german)) < 30 and 0.4 < score < 0.6
    assert langid.identify(model, german)[0] == "de" and langid.identify(model, spanish)[0] == "es"


def _plain_viterbi(scores, penalty):
    value = scores[0].astype(float)
    for row in scores[1:]:
        value = np.maximum(value, value.max() - penalty) + row
    return value.max()


def test_viterbi_is_the_best_way():
    rng = np.random.default_rng(1)
    for rows in (1, 2, 7, 60):
        for spread in (0.2, 1, 5, 20):
            for _ in range(30):
                scores = rng.normal(0, spread, (rows, 4))
                path = langid.viterbi(scores, 3.0)
                cost = scores[np.arange(rows), path].sum() - 3.0 * (np.diff(path) != 0).sum()
                assert abs(cost - _plain_viterbi(scores, 3.0)) < 1e-6


def test_scripts_narrow_the_languages(table):
    rows = [(i, "привет мир это текст", "ru") for i in range(1, 40)] + [(i, "hello world this is text", "en") for i in range(40, 80)]
    fitted = langid.fit(table(rows))
    assert fitted.languages == ["en", "ru"]
    assert langid.identify(fitted, "мрак")[0] == "ru" and langid.identify(fitted, "zzzz")[0] == "en"
    # A script of no language is open to all.
    assert langid.identify(fitted, "漢字")[0] in ("en", "ru")
    spans = langid.identify(fitted, "hello world this is text привет мир это текст")[2]
    assert [s[2] for s in spans] == ["en", "ru"]


def test_language_of_awkward_rows(awkward, empty, table):
    rows = langid.language_report(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by_id = {r.doc_id: r for r in rows}
    assert [(by_id[i].lang_pred, by_id[i].score) for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert by_id[9].lang_pred == "en"
    assert langid.language_report(empty).collect() == []
    unlabelled = table([(1, "some text", None), (2, None, None)])
    assert {r.lang_pred for r in langid.language_report(unlabelled).collect()} == {"und"}
    # Nothing is known of any language, so nothing is rejected.
    assert langid.keep_identified(unlabelled, langid.fit(unlabelled)).count() == 2
    kept = langid.keep_identified(awkward, langid.fit(awkward))
    assert kept.columns == awkward.columns and kept.filter("text is null or trim(text) = ''").count() == 0


def test_held_out_quality(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op4_quality_gam"](spark, sf_dir).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and len(held) > 50
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_tables_learn_an_interaction():
    rng = np.random.default_rng(3)
    values = rng.uniform(-1, 1, (4000, len(quality_model.FEATURES)))
    labels = (values[:, 0] * values[:, 1] > 0).astype(float)
    fitted = quality_model.fit_tables(values, labels)
    assert (0, 1) in {(i, j) for i, j, *_ in fitted.pairs}
    fresh = rng.uniform(-1, 1, (2000, values.shape[1]))
    right = (fitted.score(fresh) > 0.5) == (fresh[:, 0] * fresh[:, 1] > 0)
    assert right.mean() > 0.85


def test_scores_are_sums_of_tables():
    rng = np.random.default_rng(4)
    values = rng.normal(size=(500, len(quality_model.FEATURES)))
    fitted = quality_model.fit_tables(values, (values[:, 2] > 0).astype(float))
    total = fitted.start
    for i, (cut, table) in enumerate(zip(fitted.cuts, fitted.tables)):
        total += table[sum(c <= values[7, i] for c in cut)]
    for i, j, ci, cj, table in fitted.pairs:
        total += table[ci[sum(c <= values[7, i] for c in fitted.cuts[i])], cj[sum(c <= values[7, j] for c in fitted.cuts[j])]]
    assert abs(fitted.score(values[7:8])[0] - 1 / (1 + np.exp(-total))) < 1e-9


def test_quality_of_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 0, 0), (4, 0, 0), (9, 1, 0), (9, 1, 0), (None, 1, 0), (6, None, 0), (8, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_model.quality_scores(awkward, labels).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert quality_model.quality_scores(empty, labels).collect() == []
    none = labels.filter("doc_id = -1")
    assert {r.score for r in quality_model.quality_scores(awkward, none).collect()} == {0.5}


def test_texts_of_several_languages_are_identified(table):
    letters = ("abcdefgh", "klmnopqr", "stuvwxyz")
    prose = [" ".join(a + b + c for a in x for b in x for c in x[:3]) for x in letters]
    rows = [(i, prose[i % 3] + f" {i}", f"l{i % 3}") for i in range(60)]
    model = langid.fit(table(rows))
    mixed = " ".join(prose)
    assert langid.identify(model, mixed)[1] < 0.4
    docs = table([(1, mixed), (2, prose[0]), (3, "12 34 !"), (4, None), (5, "")])
    assert sorted(r.doc_id for r in langid.keep_identified(docs, model).collect()) == [1, 2]


def test_rare_languages_are_learned(table):
    rows = [(i, f"word{i % 7} here", f"l{i % 210}") for i in range(2000)] + [(9001, "zzyx qqyx wwyx", "rare")]
    sample = langid.sample_labelled(table(rows), max_docs=300, per_language=5)
    assert len({r.lang for r in sample.select("lang").distinct().collect()} & {"rare"}) == 1
    model = langid.fit(table(rows))
    # The commonest 200 of 211 would have left out the rarest.
    assert len(model.languages) == 211 and model.languages.count("rare") == 1
    assert langid.bounded_features(200) == langid.FEATURES > langid.bounded_features(201)
