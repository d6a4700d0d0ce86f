"""Strings of questions meet the units of their own project only, and every unit that holds them."""

import collections

import __spark_entry__ as entry
from srcloom.operators import retrieve

QUERY = "query_id string, project_id long, query string"
STRINGS = "query_id string, project_id long, role string, s string, code_like boolean, n long"
UNIT = (
    "id string, project_id long, file_path string, kind string, name string, code string, start_line int, end_line int, parent_name string,"
    " is_vendored boolean, imports array<string>, docstring string, exported_names array<string>, called_functions array<string>, language string"
)


def unit(id, project, code):
    return (id, project, f"src/{id}.ts", "function", id, code, 1, 2, None, False, [], None, [], [], "typescript")


def test_a_phrase_is_found_whatever_its_lower_case_becomes(spark):
    # The lower case of a last sigma differs from that of one inside a word.
    units = spark.createDataFrame([unit("a", 1, "x = ΟΔΟΣΑ"), unit("b", 1, "x = 1")], UNIT)
    query = spark.createDataFrame([("q", 1, 'Why "ΟΔΟΣ"?')], QUERY)
    assert [r.unit_id for r in retrieve.channel_hits(query, units, "grep", 10).collect()] == ["a"]


def test_evidence_of_many_questions_and_projects(spark):
    units = spark.createDataFrame([unit(f"u{p}", p, f"alpha beta{p}") for p in range(5)], UNIT)
    rows = [(f"q{p}-{i}", p, "term", s, False, 1) for p in range(5) for i in range(150) for s in ("alpha", "pha", f"beta{(p + 1) % 5}")]
    rows += [("many", 0, "term", f"w{i}", False, 1) for i in range(600)] + [("many", 0, "term", "beta0", False, 1)]
    strings = spark.createDataFrame(rows, STRINGS)
    groups = retrieve.string_groups(strings).collect()
    assert max(len(g.strings) for g in groups) <= retrieve.STRINGS_PER_READ
    assert max(len(s.uses) for g in groups for s in g.strings) <= retrieve.QUESTIONS_PER_STRING
    found = collections.Counter((r.project_id, r.query_id, r.s) for r in retrieve.evidence(strings, units).collect())
    want = [(p, f"q{p}-{i}", s) for p in range(5) for i in range(150) for s in ("alpha", "pha")] + [(0, "many", "beta0")]
    assert found == collections.Counter(want)


def test_whole_paths_inside_questions(spark):
    units = spark.createDataFrame([unit("a", 1, ""), unit("b", 1, ""), unit("a", 2, "")], UNIT)
    query = spark.createDataFrame([("q", 1, "what is SRC/A.ts?"), ("r", 2, "src/b.ts")], QUERY)
    assert [tuple(r) for r in retrieve._paths_inside_questions(query, units).collect()] == [("q", 1, "a")]


def test_the_plan_of_a_packed_followup_stays_small(spark):
    packed = entry.queries()["pack_followup"](spark, "/root/testdata/sf0.001")
    assert packed._jdf.queryExecution().executedPlan().toString().count("Exchange") < 100


def test_questions_and_units_are_shuffled_once_and_pairs_never(spark):
    units = spark.createDataFrame([unit(f"u{i}", 1, f"alpha test {i}") for i in range(9)], UNIT)
    query = spark.createDataFrame([("q", 1, "alpha storeLoader test config"), ("r", 1, 'Why "u3" in src/u4.ts?')], QUERY)
    hits = retrieve.channel_hits(query, units, "grep", 5)
    assert hits._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    found = {(r.query_id, r.unit_id): r.score for r in hits.collect()}
    assert len(found) == 10 and found["r", "u4"] == max(s for (q, _), s in found.items() if q == "r")
