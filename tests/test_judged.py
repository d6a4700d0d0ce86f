"""Units are judged once, and word patterns are tried only on texts that hold the beginning of a word."""

import pytest

from srcloom import dims, rx
from srcloom.operators import fuse, retrieve
from srcloom.plans import answer

PATTERNS = [(r[5], "") for r in dims.WORKFLOW_EVIDENCE if r[4] == "stage_text"] + [
    (dims.SUPPORT_CODE, "i"), (dims.SALES_CODE, ""), (r"\b(config|env|settings?)\b", ""), (r"\b(ab|\w+x)\b", ""),
]
TEXTS = [
    "", "the collector", "resource", "re-source", "open source.", "prestored db", "db2", "a db", "process.env", "processXenv", "Zod", "ZODIAC",
    "use case", "use\ncase", "valued", "valueé", "setting", "setting_", "category", "subcategory", "ab", "zx", "ſchema", "schemaİ",
]


def test_words_are_found_as_by_the_pattern_alone(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for pattern, flags in PATTERNS:
        text = F.col("t") if flags else F.lower("t")
        rows = df.select("t", rx.test(text, pattern, flags).alias("a"), rx.test_words(text, F.lower("t"), pattern, flags).alias("b")).collect()
        assert [(r.t, r.a) for r in rows] == [(r.t, r.b) for r in rows]


@pytest.mark.parametrize("pattern, want", [(r"\b(score\w*|rank)\b", ["score", "rank"]), (r"\b(a\.b|settings?)\b", ["a.b", "setting"]), (r"^(a|b)$", []), (r"\b(x|\w+y)\b", [])])
def test_stems_of_a_pattern(pattern, want):
    assert rx.stems(pattern) == want


def test_judged_units_are_not_judged_again(spark):
    units = spark.createDataFrame(
        [("a", 1, "src/db/store.ts", "save", "rank customer", 1, False)],
        "id string, project_id long, file_path string, name string, code string, start_line int, is_vendored boolean",
    )
    judged = answer.judged(units)
    assert fuse.with_marks(judged) is judged and retrieve.with_support(judged) is judged and retrieve.with_overview(judged) is judged
    row = judged.first()
    assert row.workflow_marks == [False, False, True, False, False, True, True, False]
    assert (row.overview_base, row.sales_bonus, row.support) == (14, 8, 0)


def test_only_strings_of_text_roles_meet_the_text(spark):
    units = spark.createDataFrame(
        [("a", 1, "src/db/store.ts", "saveΣ", "function", "rank all", 1, False, None, ["Export"], [], [])],
        "id string, project_id long, file_path string, name string, kind string, code string, start_line int, is_vendored boolean,"
        " docstring string, exported_names array<string>, imports array<string>, called_functions array<string>",
    )
    asked = [("term", "rank"), ("ident", "rank"), ("part", "rank"), ("whole", "rank"), ("path", "rank"), ("ident", "saveς"), ("ident", "savς"),
             ("ident", "export"), ("part", "db"), ("path", "store.ts"), ("whole", "see src/db/store.ts")]
    for role, s in asked:
        strings = spark.createDataFrame([("q", 1, role, s, False, 1)], "query_id string, project_id long, role string, s string, code_like boolean, n long")
        rows = retrieve.evidence(strings, units).collect()
        wanted = role == "term" or s in ("saveς", "export", "db", "store.ts", "see src/db/store.ts")
        assert len(rows) == int(wanted), (role, s)
