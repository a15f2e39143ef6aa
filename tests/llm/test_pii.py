import random

from repoatlas.llm import pii, queries
from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.conftest import AWKWARD


def _check(rows, texts):
    for r in rows:
        spans = brute.base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in spans) for n in range(4)], r
        assert r.base_sha256 == brute.spans_digest(spans), r
    assert len(rows) == len(texts)


def test_base_spans_of_the_query(spark, texts):
    _check(queries.QUERIES["op2_bootstrapped_pii"](spark, SMALL).collect(), texts)


def test_base_spans_of_odd_texts(table):
    rng = random.Random(5)
    alphabet = "a1.@-+ ()2é39😀_%b\n"
    texts = {k: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for k in range(2500)}
    texts |= {
        9001: "1" * 20_000 + " " + "1 " * 20_000,
        9002: "a" * 200_000 + "@",
        9003: "4111 1111 1111 1111 x4111-1111-1111-1111 999.1.1.1 1.2.3.4.5 00255.1.1.1 256.1.1.1",
        9004: "a@b.c_d@e.f x@y..z@w.v +1 (614) 555-8001, +1((((",
    }
    _check(pii.pii_report(table(list(texts.items())).repartition(4)).collect(), texts)


DOCS = [
    (1, "user id: ann@example.com wrote this."),
    (2, "user id: bob@example.com wrote that."),
    (3, "User ID: QX-99812; unknown before."),
    (4, "order no: 12345678 is no identifier of a person."),
    (5, "see the 1234567 things, of the 7654321."),
    (6, 'token = "carl@example.com" and token = "dora@example.com" and token = "9f8e7d6c5b4a"'),
    (7, "user id: eve@example.com"),
]


def test_contexts_of_seeds_find_other_identifiers(table):
    got = {r.doc_id: r for r in pii.pii_report(table(DOCS)).collect()}
    assert got[3].spans == "id:9:17" and got[3].n_id == 1
    assert got[6].n_id == 1 and got[6].n_email == 2 and got[6].spans.endswith("id:71:83")
    # A context without seeds, and words that lead to no value, say nothing.
    assert got[4].n_id == got[5].n_id == 0
    redacted = {r.doc_id: r.text for r in pii.redact(table(DOCS)).collect()}
    assert redacted[3] == "User ID: [ID]; unknown before."
    assert redacted[1] == "user id: [EMAIL] wrote this."
    assert redacted[4] == DOCS[3][1]


def test_scores_spread_over_the_graph(spark):
    rows = [("p", i, True) for i in "abc"] + [("p", "x", False), ("q", "x", False), ("q", "y", False), ("r", "a", True), ("r", "z", False)]
    got = {r.pattern: r for r in pii.score_patterns(spark.createDataFrame(rows, "pattern string, instance string, seed boolean")).collect()}
    assert got["p"].score > 0.75  # three seeds of four, and x is trusted by p itself
    assert got["q"].score == 0.0 and got["r"].score == 0.0  # too little support


def test_awkward_rows(awkward, empty):
    rows = pii.pii_report(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(r.spans == "" for r in rows)
    back = pii.redact(awkward)
    assert back.columns == awkward.columns
    assert sorted(map(repr, (r.text for r in back.collect()))) == sorted(repr(t) for _, t in AWKWARD)
    assert pii.pii_report(empty).collect() == [] and pii.redact(empty).collect() == []


def test_repeated_rows_have_a_row_each(table):
    rows = [(3, "user id: ann@example.com"), (3, "user id: ann@example.com"), (None, "user id: bo@example.com"), (None, "user id: Z-12345")]
    got = sorted((r.n_email, r.n_id) for r in pii.pii_report(table(rows)).collect())
    assert got == [(0, 1), (1, 0), (1, 0), (1, 0)]
    assert sorted(r.text for r in pii.redact(table(rows)).collect()) == ["user id: [EMAIL]"] * 3 + ["user id: [ID]"]


def test_no_python_on_the_main_path(awkward):
    plan = pii.scan(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


PLANTED = {
    "call me at 614-555-8001": "614-555-8001",
    "my e-mail is jane_smith99": "jane_smith99",
    "phone: (614) 555-8001": "(614) 555-8001",
    "phone: 614 555 8001": "614 555 8001",
    "phone: 614-555-8001": "614-555-8001",
    "user id: jane.smith": "jane.smith",
    "ticket by QX-99812 with thanks": "QX-99812",
}
ORDINARY = (
    "call me at home",
    "my e-mail is down",
    "phone: none given",
    "see the end of the 7654321 rows",
    "rows of the 1234567 tables of the year",
    "version 2.0.14 of the code, of the day",
)


def _contextual():
    """Seeds behind and before words, unseen identifiers in the same places, and ordinary texts.

    Seeds also stand behind "of the", as do three times as many ordinary words.
    """
    rng = random.Random(7)
    texts = []
    for n in range(24):
        mail, phone = f"user{n}@example.com", f"+1 614 555 {1000 + n}"
        texts += [f"{'please ' * (n % 3)}call me at {phone}", f"my e-mail is {mail}", f"phone: {phone}", f"user id: {mail}"]
        texts += [f"{n} ticket by {mail} with thanks", rng.choice(ORDINARY), "one of the " + mail]
    texts += [f"one of the {a}{b}{c} kind" for a in "bdfg" for b in "aeo" for c in ("n", "rk", "st", "lm", "mp", "ld")]
    return list(enumerate(texts + list(PLANTED) + list(ORDINARY)))


def test_identifiers_behind_plain_words(table):
    rows = _contextual()
    texts = dict(rows)
    got = {texts[r.doc_id]: r for r in pii.pii_report(table(rows)).collect()}
    for text, wanted in PLANTED.items():
        start = text.index(wanted)
        assert got[text].spans == f"id:{start}:{start + len(wanted)}", text
    for text in ORDINARY:
        assert got[text].spans == "", text


def _plain_bootstrap(edges):
    """The confident patterns and their scores, by sets; ``edges`` are (pattern, instance, seed, plain)."""
    inside, trusted, plain = {}, set(), set()
    for pattern, instance, seed, ordinary in edges:
        inside.setdefault(pattern, set()).add(instance)
        trusted |= {instance} if seed else set()
        plain |= {instance} if ordinary else set()
    while True:
        scores = {p: len(i & trusted) / len(i) if len(i & trusted) >= pii.MIN_SUPPORT else 0.0 for p, i in inside.items()}
        more = set().union(*(inside[p] - plain for p, s in scores.items() if s >= pii.MIN_SCORE)) | trusted
        if more == trusted:
            return scores
        trusted = more


def test_scores_of_random_graphs(spark):
    rng = random.Random(11)
    kinds = {f"i{n}": rng.choice(("seed", "plain", "plain", "other", "other")) for n in range(90)}
    picks = [(f"p{rng.randint(0, 40)}", rng.choice(list(kinds))) for _ in range(220)]
    edges = [(p, i, kinds[i] == "seed", kinds[i] == "plain") for p, i in picks]
    df = spark.createDataFrame(edges, "pattern string, instance string, seed boolean, plain boolean")
    got = {r.pattern: r.score for r in pii.score_patterns(df).collect()}
    assert got == _plain_bootstrap(edges)
    assert len({s >= pii.MIN_SCORE for s in got.values()}) == 2


def test_places_of_units(table):
    """Every place holds its instance, in texts with characters of any width and of many blocks."""
    rng = random.Random(3)
    words = ["word", "ab-12345", "é", "😀x", "ann@example.com", "jane.smith,", "(614) 555-8001;", "\n", "", "漢字 9x9x9"]
    rows = [(n, " ".join(rng.choice(words) for _ in range(rng.choice((0, 3, 40, 700))))) for n in range(30)]
    rows.append((99, pii.MASK * 5 + " mail ann@example.com  ab-12345"))
    texts = dict(rows)
    n = 0
    for r in pii.scan(table(rows)).collect():
        for o in r.occurrences:
            assert texts[r.id][o.start : o.end].lower() == o.instance
            assert o.seed == (o.instance == "ann@example.com")
            n += 1
    assert n > 500


def test_ordinary_words_meet_the_graph_in_one_shuffle(spark, table):
    """Repeats are not shuffled away first: the graph's own grouping does it."""
    docs = table([(1, "the cat of the cat"), (2, "the cat")])
    wanted = spark.createDataFrame([("< the", 3)], "pattern string, places long")
    found = pii._ordinary(docs, wanted, "text")
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("< the", "cat")] * 3


def test_patterns_without_hope_are_dropped_before_all_texts_are_read(spark, table, monkeypatch):
    """Two trusted units of four make a score of a half; a fifth word takes it away."""
    rows = [(n, f"{pattern} {word} {pattern} {word}") for pattern, count in (("the", 5), ("id", 4)) for n, word in enumerate("abcdefg"[:count])]
    wanted = spark.createDataFrame([("< the", 9, 2), ("< id", 9, 2), ("< unseen", 9, 2)], "pattern string, places long, support long")
    monkeypatch.setattr(pii, "PARTS", 1)
    kept = pii._hopeful(table(rows), wanted, "text")
    # Each pattern's own word stands behind none of its own.
    assert sorted(map(tuple, kept.collect())) == [("< id", 9), ("< unseen", 9)]


def test_identifiers_do_not_depend_on_what_is_read_first_or_listed(table, monkeypatch):
    rows = _contextual()
    near = [("call 614 555 8001 at", 3), ("by (614) 555-8002 at", 3), ("re 7 at", 2)]
    rows += [(1000 + n, f"{words} user{n}@example.org now") for n, (words, count) in enumerate(near * 3)]
    rows += [(2000 + n, f"{words} QX-{n}77{n}9 now, at 12 home") for n, (words, count) in enumerate(near)]
    got = []
    for parts, listed in ((32, 1000), (1, 1000), (1, 0), (10**9, 0)):
        monkeypatch.setattr(pii, "PARTS", parts)
        monkeypatch.setattr(pii, "MAX_LISTED", listed)
        got.append(sorted(map(tuple, pii.pii_report(table(rows)).collect())))
    assert got[0] == got[1] == got[2] == got[3]
    assert sum(row[5] for row in got[0]) > len(PLANTED)


def test_texts_without_signs_hold_no_identifiers(table, monkeypatch):
    """What is not searched holds nothing: with tests that pass every text and unit, all is the same."""
    rng = random.Random(8)
    alphabet = "aab1.@-+ ()239é😀_%b\nÀ:\t" + pii.MASK
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))) for k in range(1500)]
    rows += [(k, "plain words only, and more.") for k in range(1500, 1510)]
    found = [sorted(map(repr, pii.scan(table(rows)).collect()))]
    monkeypatch.setattr(pii, "SIGN", "")
    monkeypatch.setattr(pii, "SIGNS", "")
    found.append(sorted(map(repr, pii.scan(table(rows)).collect())))
    assert found[0] == found[1] and any("instance=" in r for r in found[0])


def test_white_space_is_listed_and_parts_units(spark):
    """Beside the mask, the class of white space makes the JVM ten times slower."""
    old = pii.UNIT.replace(r"\x20\t\n\x0b\f\r\"", r"\s\"")
    assert r"\s" not in pii.UNIT and old != pii.UNIT
    spaces = "".join(map(chr, [*range(1, 33), 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x3000]))
    text = "".join(f"ab{c}cd" for c in spaces)
    found = spark.sql("select regexp_extract_all(:t, :new, 0) = regexp_extract_all(:t, :old, 0)", args={
        "t": text, "new": pii.UNIT, "old": old
    })
    assert found.first()[0]
