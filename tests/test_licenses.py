import re

from pyspark.sql import functions as F

from repoatlas.fixed_values import LICENSE_RULES
from repoatlas.functions import licenses as L
from repoatlas.operators.license_scan import license_rule_audit, license_scan

FIRST_LINES = {
    "MIT License": "MIT License",
    "  mit license\nmore": "MIT License",
    "MITRE notice": "MIT License",
    "Apache License, Version 1.0": "Apache License 2.0",
    "Apache License\n Version 2.0": "Apache License 2.0",
    "BSD+Patent": "BSD License",
    "GNU General Public License v3.0 or later": "GNU GPL",
    "GNU Lesser General Public License v3.0": "GNU LGPL",
    "The ISC License": "Other",
    "\nMIT License": "Other",
    "": "Other",
}


def test_first_lines(values):
    got = values([(t,) for t in FIRST_LINES], "t string", L.license_of_text("t"))
    assert [g[0] for g in got] == list(FIRST_LINES.values())


def test_every_rule_matches_its_own_name_or_an_earlier_rule(values):
    heads = [re.sub(r"\(.*?\)\??|\\|\^", "", rule) or name for name, rule in LICENSE_RULES]
    expected = [
        next((n for n, rule in LICENSE_RULES if re.search(rule, head, re.I)), "Other") for head in heads
    ]
    got = values([(h,) for h in heads], "t string", L.license_of_line("t"))
    assert [g[0] for g in got] == expected


def test_host_name_wins_unless_other(values):
    rows = [("Zlib", "MIT"), ("Other", "MIT"), (None, "MIT"), ("Other", None), (None, None)]
    got = values(rows, "p string, t string", L.repo_license("p", "t"))
    assert [g[0] for g in got] == ["Zlib", "MIT License", "MIT License", "Other", "Unknown License"]


def test_scan_and_audit(spark):
    docs = spark.createDataFrame(
        [
            (1, "Intro\nLicensed under the Apache License, Version 2.0.\nmit freundlichen"),
            (2, "x\nReleased under BSD+Patent terms\nGNU General Public License v3.0 or later"),
        ],
        "doc_id long, text string",
    )
    found = {(r.doc_id, r.line_no): r.license for r in license_scan(docs).collect()}
    assert found == {(1, 1): "Apache License 2.0", (2, 1): "BSD License", (2, 2): "GNU GPL"}
    audit = {r.license: (r.lines_matched, r.lines_fired, r.shadowed) for r in license_rule_audit(docs).collect()}
    assert audit["GPLv3 or later"] == (1, 0, True)
    assert audit["BSD+Patent License"] == (1, 0, True)
    assert audit["GNU GPL"] == (1, 1, False)
    assert audit["WTFPL"] == (0, 0, False)
    assert len(audit) == len(LICENSE_RULES)


def test_null_line_stays_null(values):
    assert values([(None,)], "t string", L.license_of_line(F.col("t"))) == [(None,)]
