from repoatlas.functions import encoding as E


def test_languages_round_trip(values):
    rows = [({"C": 10, "C++": 5},), ({"Jupyter Notebook": 3},)]
    encoded = values(rows, "m map<string,bigint>", E.encode_languages("m"))
    # A Python dict reaches Spark in any order.
    assert encoded[0][0] in ("C (10)| C++ (5)", "C++ (5)| C (10)")
    assert encoded[1] == ("Jupyter Notebook (3)",)
    assert values(encoded, "s string", E.decode_languages("s")) == rows
    assert values([("",)], "s string", E.decode_languages("s")) == [({},)]


def test_keyword_lists(values):
    rows = [("a", ["b", "", "a", "b"], "c||b"), ("a", None, None)]
    got = values(
        rows, "k string, new array<string>, old string",
        E.merge_keywords("k", "new", E.split_keywords("old")), E.split_keywords("old"),
    )
    assert got == [("b|c", ["c", "b"]), ("", [])]


def test_responses(values):
    answers = {
        "Relevancy_score = 0.7, Reasons = [uses it, and more]": (0.7, ["uses it", "and more"]),
        "  Relevancy_score=0.8 , Reasons =[ one ,, two ]": (0.8, ["one", "two"]),
        "Sorry.\nRelevancy_score = 0.9, Reasons = [x]": (0.1234, []),
        "Relevancy_score = 0.9": (0.1234, []),
        "Relevancy_score = 0.9, Reasons = []": (0.1234, []),
        "Relevancy_score = 1.2.3, Reasons = [x]": (0.1234, []),
        None: (0.1234, []),
    }
    got = values([(a,) for a in answers], "a string", E.parse_score_response("a"))
    assert [tuple(g[0]) for g in got] == list(answers.values())
