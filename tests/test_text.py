from pyspark.sql import functions as F

from repoatlas.functions import text as X

TEXTS = [
    "",
    "   ",
    "Plain, text.",
    "a\tb\r\nc,d  e",
    "before ```code\nmore, code``` after ``` open",
    "```one``` mid ```two```",
    "emoji \U0001f600\U0001f680 and café, naïve…",
    "nbsp x   y z 　 w",
    "sep\x1c\x1dfields\x85end",
    "under_score-dash/slash (paren) [x]!?",
    ",,, leading and trailing ,,,",
]


ONCE_AND_TWICE = [
    ("", ""),
    ("", ""),
    ("Plain text.", "plain text."),
    ("a b c d e", "a b c d e"),
    ("before   after   open", "before after open"),
    ("  mid  ", "mid"),
    ("emoji   and caf  na ve ", "emoji and caf na ve"),
    ("nbsp x y z w", "nbsp x y z w"),
    ("sep fields end", "sep fields end"),
    ("under score dash slash  paren   x !?", "under score dash slash paren x !?"),
    ("leading and trailing", "leading and trailing"),
]


def test_cleaned_texts(values):
    got = values([(t,) for t in TEXTS], "t string", X.clean_text("t"), X.clean_readme("t"))
    assert got == ONCE_AND_TWICE


def test_clean_readme_is_stable(values):
    cleaned = values([(t,) for t in TEXTS], "t string", X.clean_readme("t"))
    assert values(cleaned, "t string", X.clean_text("t")) == cleaned


def test_collapse_spaces_equals_split(values):
    got = values([(t,) for t in TEXTS], "t string", X.collapse_spaces("t"))
    assert [g[0] for g in got] == [" ".join(t.split()) for t in TEXTS]


def test_words_have_no_empty_ones(values):
    got = values([("a  b",), ("",), (" x ",)], "t string", X.words("t"))
    assert [g[0] for g in got] == [["a", "b"], [], ["x"]]


def test_lead_sentences(values):
    got = values(
        [("One.  Two!\nThree? Four.",), ("no stop",), ("v1.2 is out. Yes",), ("",)],
        "t string",
        X.lead_sentences("t"),
    )
    assert [g[0] for g in got] == ["One. Two! Three?", "no stop", "v1.2 is out. Yes", ""]


def test_summary_cuts(values):
    rows = [("A first. A SECOND half",), ("no stop",), ("Ends.",), ("x.\ny.z",)]
    got = values(rows, "t string", X.cut_at_last_stop("t"), X.cut_and_capitalize("t"))
    assert got == [
        ("A first", "A first"), ("no stop", "No stop"), ("Ends", "Ends"), ("x.\ny", "X.\ny"),
    ]


def test_labels(values):
    rows = [("'AI - Machine Learning'.",), ("Tools & Development",), ("123",), ("a -b",)]
    got = values(rows, "t string", X.normalize_label("t"))
    assert [g[0] for g in got] == ["AI - Machine Learning", "Tools & Development", "", "a - b"]


def test_urls_and_anchors(values):
    got = values(
        [("https://host/owner/name",), ("name",)],
        "u string",
        X.repo_name("u"), X.repo_full_name("u"), X.anchor(F.lit("AI - RL")),
    )
    assert got == [("name", "owner/name", "ai---rl"), ("name", "name", "ai---rl")]


def test_decode_readme(values):
    got = values([(b"SGksIFRIRVJF",), (None,)], "c binary", X.decode_readme(F.col("c").cast("string")))
    assert [g[0] for g in got] == ["hi there", "no readme found"]


def test_truncation_and_dates(values):
    got = values(
        [("x" * 10_001,)], "t string",
        F.length(X.truncate_text("t")), X.date_floor("2024-03-01", 1), X.run_name("2024-03-01 10:20:30"),
        X.distinct_phrases(F.array(F.lit("b"), F.lit("a"), F.lit("b"))),
    )
    assert got == [(10_000, "2024-02-29", "repos_2024-03-01_10-20-30", "b a")]
