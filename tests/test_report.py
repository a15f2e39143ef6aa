from pathlib import Path

from repoatlas.operators.report import REPORT_ORDER, report_csv, report_db
from repoatlas.sources.writers import report_name, write_report


def text_of(folder) -> str:
    return "".join(p.read_text() for p in sorted(Path(folder).glob("part-*")))


def test_catalog_report_is_this_text(spark, tmp_path):
    catalog = spark.createDataFrame(
        [
            (1, "h/o/one", 5, "AI - RL", "First.", 0.9, "k", "a|b"),
            (2, "h/o/two", 6, "Tools", "Second.", 0.4, "k", ""),
            (3, "h/o/three", 7, "AI - RL", "Third.", 0.5, "k", None),
            (4, "h/o/low", 8, "Tools", "Low.", 0.39, "k", ""),
            (5, "h/o/null", 8, "Tools", "Null.", None, "k", ""),
            (6, "h/o/gone", 8, "Gone", "Gone.", 1.0, "k", ""),
        ],
        "seq long, url string, stars_count long, class_label string, brief_desc string, "
        "relevance double, keyword string, additional_keywords string",
    ).repartition(3)
    ignored = spark.createDataFrame([("h/o/gone",), ("h/o/gone",)], "url string")
    lines = report_db(catalog, ignored, title="# T", intro="I.", component_label="Parts")
    write_report(lines, REPORT_ORDER, str(tmp_path / "r"))

    def entry(name, desc, stars, rest):
        return (
            f"\n- **[{name}](h/o/{name})** - {desc} "
            f"![GitHub stars](https://img.shields.io/badge/stars-{stars}-blue)\n"
            f"    - Parts: k, {rest}\n    - auto_generated = True\n\n"
        )

    assert text_of(tmp_path / "r") == (
        "# T\n\nI.\n\n## Table of Contents\n\n- [AI - RL](#ai---rl)\n- [Tools](#tools)\n\n"
        "### AI - RL\n\n" + entry("one", "First.", 5, "a,b") + entry("three", "Third.", 7, "") + "\n"
        "### Tools\n\n" + entry("two", "Second.", 6, "") + "\n"
    )


def test_csv_report_is_this_text(spark, tmp_path):
    rows = spark.createDataFrame(
        [
            (1, "h/one", "MIT", "5", "C (1)", "k", "First", "B topic"),
            (2, "h/two", "MIT", "6", "C (1)", "k", "Second", "A topic"),
            (3, "h/one", "MIT", "5", "C (1)", "j", "Again", "A topic"),
            (4, "h/four", "MIT", "7", "", "k", "Fourth", "B topic"),
        ],
        "seq long, repo_url string, license string, num_stars string, languages string, "
        "keyword string, brief_desc string, topic string",
    )
    write_report(report_csv(rows, "# T", "I.", "Part"), REPORT_ORDER, str(tmp_path / "r"))

    def entry(name, desc, stars, langs):
        return (
            f"- [{name}](h/{name}): License: MIT: {desc} "
            f"![GitHub stars](https://img.shields.io/badge/stars-{stars}-blue)\n"
            f"Part used : k \nLanguages: {langs} \n "
        )

    assert text_of(tmp_path / "r") == (
        "# T\n\nI.\n\n## Table of Contents\n\n"
        "### B topic\n\n" + entry("one", "First", 5, "C (1)") + entry("four", "Fourth", 7, "") + "\n"
        "### A topic\n\n" + entry("two", "Second", 6, "C (1)") + "\n"
    )


def test_report_name():
    assert report_name("./r/filtered_readme_repos_2023.csv", "List") == "./r/List2023.md"
    assert report_name("./r/plain", "List") == "./r/plain.md"
