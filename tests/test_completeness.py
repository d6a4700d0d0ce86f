"""Nothing is dropped where a caller asks for more, and selections equal plain computations."""

import collections

import pytest

import __spark_entry__ as entry
from srcloom.operators import followup, ingest, pack, retrieve, survey
from srcloom.sources import corpus

SMALL = "/root/testdata/sf0.001"


def test_file_limits_only_flag(spark):
    files = spark.createDataFrame([(1, f"f{i:02}.ts", 10) for i in range(50)], "project_id long, file_path string, bytes long")
    capped = ingest.cap_files(files, 30)
    assert capped.count() == 50 and capped.filter("over_file_limit").count() == 20
    assert ingest.cap_files(files).filter("over_file_limit").count() == 0
    reasons = collections.Counter(r.skip_reason for r in ingest.apply_byte_budget(capped, 100, 100).collect())
    assert reasons == {None: 10, "byte_budget": 20, "file_limit": 20}


def test_a_file_may_give_more_than_five(spark):
    rows = [("q", f"u{i}", i, "f", 1.0, 10, False, None, 1, 1000, 8) for i in range(12)]
    schema = (
        "query_id string, unit_id string, ord int, file_path string, pack_score double, tokens bigint, exact boolean,"
        " hit_rank int, start_line int, max_tokens int, max_per_file int"
    )
    assert pack.pack(spark.createDataFrame(rows, schema)).count() == 8


@pytest.mark.parametrize("k", [5, 50])
def test_grep_returns_as_many_as_asked(spark, k):
    units = corpus.units(spark, SMALL)
    query = spark.createDataFrame([("q", 1, "test config")], "query_id string, project_id long, query string")
    wide = retrieve.channel_hits(query, units, "grep", 10_000).collect()
    hits = retrieve.channel_hits(query, units, "grep", k).collect()
    best = sorted(wide, key=lambda r: r["rank"])[:k]
    assert [(r.unit_id, r.score) for r in sorted(hits, key=lambda r: r["rank"])] == [(r.unit_id, r.score) for r in best]


def test_survey_selection_rules(spark):
    files = [("README.md", True, 5, 9), ("docs/a.md", True, 4, 8), ("docs/b.md", True, 3, 7)]
    files += [(f"src/x/f{i}.ts", False, 50 - i, 0) for i in range(5)] + [("lib/v.js", False, 99, 0), ("main.go", False, 1, 0)]
    inventory = spark.createDataFrame(
        [(1, p, d, p.startswith("lib/"), e, s) for p, d, e, s in files],
        "project_id long, file_path string, documentation boolean, is_vendored boolean, entry_score int, doc_score int",
    )
    asked = [(1, "lib/v.js", 5), (1, "gone.ts", 4), (1, "src/x/f4.ts", 3)]
    requests = spark.createDataFrame(asked, "project_id long, file_path string, priority long")
    seen = spark.createDataFrame([], "project_id long, file_path string")
    rows = survey.select_files(inventory, requests, seen).orderBy("pos").collect()
    assert [r.file_path for r in rows if r.outcome == "selected"] == [
        "src/x/f4.ts", "README.md", "docs/a.md", "src/x/f0.ts", "main.go", "src/x/f1.ts",
    ]
    refused = [(r.file_path, r.reason) for r in rows if r.outcome == "rejected"]
    assert refused[:2] == [("lib/v.js", "vendored or third-party path"), ("gone.ts", "not found in deterministic inventory")]


def test_survey_selection_spreads_beyond_the_best_eighty(spark):
    files = [(f"src/x/f{i:03}.ts", 200 - i) for i in range(90)] + [("other/y/a.ts", 1)]
    inventory = spark.createDataFrame(
        [(1, p, False, False, e, 0) for p, e in files],
        "project_id long, file_path string, documentation boolean, is_vendored boolean, entry_score int, doc_score int",
    )
    requests = spark.createDataFrame([(1, "src/x/f050.ts", 1)], "project_id long, file_path string, priority long")
    seen = spark.createDataFrame([], "project_id long, file_path string")
    rows = survey.select_files(inventory, requests, seen).filter("outcome = 'selected'").orderBy("pos").collect()
    want = ["src/x/f050.ts", "src/x/f000.ts", "other/y/a.ts", "src/x/f001.ts", "src/x/f002.ts", "src/x/f003.ts"]
    assert [r.file_path for r in rows] == want


def test_followup_budget():
    assert [followup.followup_budget(n) for n in (1_000, 10_000, 100_000)] == [500, 1200, 2400]


def test_followup_context_keeps_to_its_limits(spark):
    rows = entry.queries()["pack_followup"](spark, SMALL).collect()
    assert rows
    by_query = collections.defaultdict(list)
    for r in rows:
        by_query[r.query_id].append(r)
    for found in by_query.values():
        assert sum(r.tokens for r in found) <= followup.followup_budget()
        assert max(collections.Counter(r.file_path for r in found if not r.exact).values(), default=0) <= 2


def test_projects_of_questions_grow_with_the_conversations(spark):
    counts = []
    for sf in (SMALL, "/root/testdata/sf0.01"):
        turns = corpus.answers(spark, sf).selectExpr("project_id", "answer_id div 100 as conversation").distinct()
        most = max(r["count"] for r in turns.groupBy("project_id").count().collect())
        assert most <= corpus.PER_PROJECT
        counts.append(turns.select("project_id").distinct().count())
    assert counts[1] > 4 * counts[0]
